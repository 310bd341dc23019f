"""Run documents (one JSON document per run) as a Python data source.

A document is read by one task, which is what the format allows, but never held whole (many
documents share a bounded number of tasks, each of which knows its own files only): its
examples are taken from the text one by one, checked against the types of the schema and
handed to Spark in Arrow batches, so no row holds a run (a malformed value alone is searched
to the end of its file before it fails).  ``artifacts.read_experiment`` reads
the same documents with Spark's JSON functions, a row each.

Workers open the files through pyarrow, so paths must be local or of a store it knows; files
named ``.gz`` are read unpacked."""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from fieldmark.schemas import EXAMPLE_REPORT, EXPERIMENT

EXAMPLES = T.StructType([T.StructField("run", T.StringType())] + EXAMPLE_REPORT.fields)
RUNS = T.StructType([T.StructField("run", T.StringType())]
                    + [f for f in EXPERIMENT.fields if f.name != "examples"]
                    + [T.StructField("n_examples", T.LongType())])
BATCH = 1000
#: Tasks of a read at most, for each shuffle partition of the session.
TASKS_A_PARTITION = 4
CHUNK = 1 << 16

# What must be there; the other fields may be absent or null.
REQUIRED = {"model", "mean_score", "pass_rate", "example_id", "overall_score", "passed",
            "field_results", "field", "scorer", "result", "score"}
#: Fields read as 0 where absent.
ZERO = {"latency_ms": 0.0, "mean_latency_ms": 0.0, "total_tokens": 0}


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON value")


class JsonText:
    """Values taken one by one from a JSON text that is read in chunks."""

    def __init__(self, read):
        self.read, self.buffer, self.at, self.ended = read, "", 0, False
        self.decode = json.JSONDecoder(parse_constant=_refuse).raw_decode

    def _more(self, size: int = CHUNK) -> None:
        chunk = self.read(size)
        self.ended = not chunk
        self.buffer, self.at = self.buffer[self.at:] + chunk, 0

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.buffer):
                if self.buffer[self.at] not in " \t\r\n":
                    return self.buffer[self.at]
                self.at += 1
            if self.ended:
                return ""
            self._more()

    def take(self, among: str) -> str:
        found = self.peek()
        if not found or found not in among:
            raise ValueError(f"expected one of {among!r}, found {found!r}")
        self.at += 1
        return found

    def value(self):
        """The next value; more text is read (twice as much each time) until it is whole."""
        self.peek()
        size = CHUNK
        while True:
            try:
                value, end = self.decode(self.buffer, self.at)
                # a number might go on where the text ends, or ends in half of one
                number = isinstance(value, (int, float)) and not isinstance(value, bool)
                after = self.buffer[end:end + 1]
                if self.ended or after and not (number and after in ".eE+-"):
                    self.at = end
                    return value
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self._more(size)
            size *= 2

    def members(self, streamed: str) -> Iterator[tuple[str, object, bool]]:
        """(name, value, item) of the document's members; those of the list ``streamed`` one
        by one with ``item`` true, after its name with None."""
        self.take("{")
        if self.peek() == "}":
            self.take("}")
        else:
            while True:
                name = self.value()
                if not isinstance(name, str):
                    raise ValueError("a member's name is no text")
                self.take(":")
                if name == streamed and self.peek() == "[":
                    self.take("[")
                    yield name, None, False
                    if self.peek() == "]":
                        self.take("]")
                    else:
                        yield name, self.value(), True
                        while self.take(",]") == ",":
                            yield name, self.value(), True
                else:
                    yield name, self.value(), False
                if self.take(",}") == "}":
                    break
        if self.peek():
            raise ValueError("text after the document")


def checker(kind: T.DataType, name: str) -> Callable:
    """A function that gives a parsed value as the schema's type, or raises ValueError; members
    the schema lacks are left out.  The schema is walked once, not once a value."""
    required, zero = name in REQUIRED, ZERO.get(name)
    members = [(f.name, checker(f.dataType, f.name)) for f in kind.fields] \
        if isinstance(kind, T.StructType) else []
    item = checker(kind.elementType, f"{name}_item") if isinstance(kind, T.ArrayType) else None
    whole, long = isinstance(kind, T.DoubleType), isinstance(kind, T.LongType)
    plain = bool if isinstance(kind, T.BooleanType) else str if isinstance(kind, T.StringType) else None

    def check(value):
        found = type(value)  # JSON gives dict, list, str, int, float, bool and None
        if found is dict and members:
            return {n: c(value.get(n)) for n, c in members}
        if found is list and item:
            return [item(_present(x, name)) for x in value]
        if found is float and whole or found is plain:
            return value
        if found is int and (whole or long and abs(value) < 2 ** 63):
            return float(value) if whole else value
        if value is None:
            if required:
                raise ValueError(f"{name} is absent")
            return zero
        raise ValueError(f"{name} has a wrong type")

    return check


def _present(value, name: str):
    if value is None:
        raise ValueError(f"{name} is absent")
    return value


class Documents(InputPartition):
    """The documents of one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class RunDocumentReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.runs = options.get("content", "examples") == "runs"
        self.paths = json.loads(options["paths"])
        self.tasks = int(options["tasks"])

    def __getstate__(self):
        """What every task gets: without the list of all files, it has its own."""
        return {**self.__dict__, "paths": None}

    def partitions(self):
        """A document a task, or of more documents than ``tasks`` an equal share."""
        n = min(len(self.paths), self.tasks)
        return [Documents(self.paths[i::n]) for i in range(n)]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        example = checker(EXAMPLE_REPORT, "example")
        for path in partition.paths:
            run = unquote(posixpath.basename(path)).removesuffix(".json")
            try:
                yield from self._batches(run, path, example)
            except (ValueError, RecursionError) as e:
                raise ValueError("artifact with required fields missing or of a wrong type: "
                                 f"{run}: {e}") from e

    def _batches(self, run: str, path: str, example: Callable) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        rows, n, head = [], 0, {}
        seen = False
        if path.startswith("file:"):
            store, path = fs.LocalFileSystem(), "/" + unquote(path[len("file:"):]).lstrip("/")
        elif "://" in path:
            store, path = fs.FileSystem.from_uri(path)
        else:
            store = fs.LocalFileSystem()
        with store.open_input_stream(path) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8", newline="")
            for name, value, item in JsonText(text.read).members("examples"):
                if item:
                    n += 1
                    row = example(_present(value, "examples"))
                    if not self.runs:
                        rows.append({"run": run, **row})
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                elif name == "examples":
                    if value is not None:
                        raise ValueError("examples has a wrong type")
                    seen = True
                else:
                    head[name] = value
        if not seen:
            raise ValueError("examples is absent")
        summary = {f.name: checker(f.dataType, f.name)(head.get(f.name))
                   for f in EXPERIMENT.fields if f.name != "examples"}
        if self.runs:
            rows = [{"run": run, **summary, "n_examples": n}]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class RunDocuments(DataSource):
    """``paths``: a JSON list of files' URIs; ``content``: ``examples`` (default) or ``runs``;
    ``tasks``: the most tasks of a read."""

    @classmethod
    def name(cls):
        return "run_documents"

    def schema(self):
        return RUNS if self.options.get("content") == "runs" else EXAMPLES

    def reader(self, schema):
        reader = RunDocumentReader(schema, self.options)
        # Spark sends the source with its options to every task, too
        self.options = {k: v for k, v in self.options.items() if k != "paths"}
        return reader


def read_run_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, examples) of the documents under ``path``; a run is named after its file.  A
    malformed document, an absent required field or a wrong type fails the read and names the
    run.  The files' names (one a run) come from Spark's listing."""
    listed = spark.read.format("binaryFile").load(path).inputFiles()  # empty files too
    paths = json.dumps(sorted(listed))
    spark.dataSource.register(RunDocuments)
    tasks = TASKS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def load(content: str) -> DataFrame:
        return spark.read.format("run_documents").option("paths", paths).option("tasks", str(tasks)) \
            .option("content", content).load()

    return load("runs"), load("examples")
