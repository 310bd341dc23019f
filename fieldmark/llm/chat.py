"""Chat formatting, in DataFrame functions alone.

Records of any layout come as JSON.  The schema fingerprint of a record is the hash of its
nested field paths; it selects a declarative mapping to canonical turns (role and
text in order).  Turns are then put into a template whose control strings are escaped
inside texts, so that the formatted text reads back to the same turns, with a loss mask
over the assistants' texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Opening and closing control strings by role; other roles name themselves.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"),
         "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[SEP]", "[/TURN]")
_REST = r"/?(?:INST|TURN|SEP)\]|/?s>|</?SYS>>"
_CONTROL = rf"([\[<])(\\*)({_REST})"
_ESCAPED = rf"([\[<])\\(\\*)({_REST})"
_TURN = (r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|"
         r"\[TURN\].*?\[SEP\].*?\[/TURN\]")


def escape(text: Column) -> Column:
    """A backslash behind the first character of every control string, and one more where
    there are some already."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


@dataclass(frozen=True)
class Layout:
    """A layout by the :func:`shape_of` its records: either a list of turns at ``turns`` with
    fields ``role`` and ``text``, or ``parts``, pairs of a fixed role and the field of its
    text (null ones are left out)."""

    shape: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, str], ...] = ()

    def columns(self) -> Column:
        """The record's turns, array<struct<role, text>>."""
        if self.turns:
            items = F.from_json("record", f"{self.turns} array<struct<{self.role}: string, "
                                          f"{self.text}: string>>")[self.turns]
            return F.transform(items, lambda t: F.struct(
                t[self.role].alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text")))
        got = F.from_json("record", ", ".join(f"{f} string" for _, f in self.parts))
        return F.filter(F.array(*[F.struct(F.lit(role).alias("role"), got[f].alias("text"))
                                  for role, f in self.parts]), lambda t: t["text"].isNotNull())


#: Names that other layouts give the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant",
         "model": "assistant"}
LAYOUTS = (
    Layout("messages: ARRAY<OBJECT<content, role>>", "messages"),
    Layout("conversations: ARRAY<OBJECT<from, value>>", "conversations", "from", "value"),
    Layout("instruction, output", parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction, output, system", parts=(
        ("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("prompt, response", parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt, response, system", parts=(
        ("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def shape_of(record: Column) -> Column:
    """All nested field paths of a JSON record in one string: names in order, the fields of
    an object between < and >, scalar types left out."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z]+(\([^)]*\))?", "")


def schema_fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS,
                    id_col: str = "conv_id", given_col: str | None = None,
                    roles: dict[str, str] = ROLES) -> DataFrame:
    """(conv_id, turn, role, text) of ``records(conv_id, record)``.

    Records of no known layout (their paths match none, or they are null, no JSON
    object, or beyond the parser's limits: 20 million characters a text, 128 MiB a record)
    give the turns in ``given_col`` (array<struct<role, text>>); without that column they
    give none, see :func:`unknown_layouts`.  A layout's lists are in order; a
    null text becomes empty, roles are brought to system, user and assistant where
    ``roles`` knows them (give none to keep those of the records).  Records that repeat are
    formatted each, an empty table gives an empty result."""
    turns = None
    known = schema_fingerprint(shape_of(F.col("record")))
    for layout in layouts:
        hit = known == schema_fingerprint(F.lit(f"OBJECT<{layout.shape}>"))
        turns = F.when(hit, layout.columns()) if turns is None else turns.when(
            hit, layout.columns())
    if given_col:
        turns = F.coalesce(turns, F.transform(given_col, lambda t: F.struct(
            t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))))
    role = F.col("t.role")
    if roles:
        known_as = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
        role = F.coalesce(F.element_at(known_as, role), role)
    return records.select(F.col(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "t")) \
        .select("conv_id", F.col("turn").cast("long"), role.alias("role"),
                F.col("t.text").alias("text"))


def unknown_layouts(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, shape, n) of the layouts that no mapping covers."""
    known = [schema_fingerprint(F.lit(f"OBJECT<{x.shape}>")) for x in layouts]
    return records.select(shape_of(F.col("record")).alias("shape")) \
        .withColumn("fingerprint", schema_fingerprint(F.col("shape"))) \
        .where(F.col("shape").isNull() | ~F.col("fingerprint").isin(*known)) \
        .groupBy("fingerprint", "shape").agg(F.count("*").alias("n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, mask) of ``turns(conv_id, turn, role, text)``.

    ``mask`` lists (start, length), in code points of ``formatted``, of the assistants'
    texts.  Turns are ordered by turn (then role and text, so ties are no accident; repeated
    rows are turns each); a null text is empty, a null role is written as an empty one.  An
    empty table gives an empty result."""
    role = F.coalesce(F.col("role"), F.lit(""))
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    tail = F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        head, tail = F.when(role == name, a).otherwise(head), F.when(role == name, b).otherwise(tail)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text") \
        .rowsBetween(W.unboundedPreceding, -1)
    pieces = turns.withColumns({"head": head, "body": body, "tail": tail}) \
        .withColumn("piece", F.concat("head", "body", "tail")) \
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct(
        (F.col("at") + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length")))
    rows = pieces.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("mask"))
    return rows.select("conv_id", "n_turns", F.array_join(F.col("pieces")["piece"], "")
                       .alias("formatted"), "mask")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    def back(piece: Column) -> Column:
        other = F.regexp_extract(piece, r"(?s)^\[TURN\](.*?)\[SEP\]", 1)
        role, skip = unescape(other), F.length(other) + len(OTHER[0]) + len(OTHER[1])
        tail = F.lit(len(OTHER[2]))
        for name, (a, b) in MARKS.items():
            hit = F.startswith(piece, F.lit(a))
            role = F.when(hit, name).otherwise(role)
            skip = F.when(hit, len(a)).otherwise(skip)
            tail = F.when(hit, len(b)).otherwise(tail)
        text = F.substring(piece, skip + 1, F.length(piece) - skip - tail)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), 0), back)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped, the spans one after the other."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(
        formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")
