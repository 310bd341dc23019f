"""Helpers shared by the text operators.

Conventions that hold for every operator here: only the named columns of an input are
read (others may have any name), a null text counts as empty, and results that are used
twice are written to the shared folder (``spark.checkpoint.dir``) first, so a lost
executor costs a re-read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.materialize import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts empty."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def save(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back."""
    return materialize(df, name)


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links(a, b)`` as (node, component), the
    component being its smallest node; only nodes that have a link are listed.

    Each round moves every node to the smallest label among its own and its
    neighbours', then to that label's label (pointer jumping), all as joins on written
    tables; links inside one component leave the work.  The driver sees one count a
    round.  Self links, null ends and repeated links are harmless."""
    pairs = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = save(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .distinct(), "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    labels = _jump(labels)
    open_edges = edges
    while True:
        # both ends of every link by their present labels; equal ends are settled
        open_edges = save(
            open_edges.join(labels.withColumnsRenamed({"node": "a", "component": "la"}), "a")
            .join(labels.withColumnsRenamed({"node": "b", "component": "lb"}), "b")
            .where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            .distinct(), "edges")
        if open_edges.isEmpty():
            break
        hooks = open_edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")) \
            .where("to < root")
        labels = _hook(labels, hooks)
        labels = _jump(labels)
    return labels


def _hook(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    moved = labels.join(hooks, labels["component"] == hooks["root"], "left").select(
        "node", F.coalesce("to", "component").alias("component"))
    return save(moved, "labels")


def _jump(labels: DataFrame) -> DataFrame:
    """Every label replaced by its own label until nothing changes."""
    while True:
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        up = up.where("up <> top")
        moved = labels.join(up, labels["component"] == up["up"], "left").select(
            "node", F.coalesce("top", "component").alias("component"),
            (F.col("top").isNotNull()).alias("moved"))
        moved = save(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
