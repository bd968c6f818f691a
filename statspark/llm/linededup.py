"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines with a word form a window. A window found again anywhere later (in ascending order of
key and line) makes its three lines there removable; lines under several such windows are removed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import SPACES, store

SPAN = 3


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(text: Column) -> Column:
    """(i, line) of the lines that have a word, trimmed; i counts all lines from 0."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(SPACES)).alias("x")))
    return F.filter(lines, lambda r: r["x"] != "")


def _windows(docs: DataFrame, text: str, key: str, span: int) -> DataFrame:
    """(id, h, h2, at): a window's two hashes and the number of its first line among the lines with a word, from 1."""

    def cut(rows):
        def one(k):
            body = F.transform(F.slice(rows, k, span), lambda r: r["x"])
            return F.struct(F.xxhash64(body).alias("h"), F.xxhash64(F.lit(7), body).alias("h2"), k.cast("int").alias("at"))

        return F.when(F.size(rows) >= span, F.transform(F.sequence(F.lit(1), F.size(rows) - (span - 1)), one))

    return docs.select(F.col(key).alias("id"), F.explode(_let(_numbered(F.col(text)), cut)).alias("w")).select("id", "w.*")


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN) -> DataFrame:
    """(id, gone): for each document with removable lines their sorted numbers among the lines with a word, from 1."""
    windows = store(_windows(docs, text, key, span), "windows")
    # the first place of each window, combined in every task before the shuffle; windows seen once go no further
    first = windows.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first"))
    again = store(first.where(F.col("n") > 1).select("h", "h2", "first"), "again")
    later = windows.join(again, ["h", "h2"]).where(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("at") == F.col("first.at")))
    )
    spread = F.flatten(F.transform(F.collect_set("at"), lambda a: F.sequence(a, a + (span - 1))))
    return later.groupBy("id").agg(F.array_sort(F.array_distinct(spread)).alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN) -> DataFrame:
    """``docs`` with the text without its removable lines, and n_lines, n_removed, n_spans (names are replaced).

    n_lines counts lines with a word; a span is a run of removed lines with no kept line (with a word) between.
    Lines without a word are never removed nor part of a window. Null texts stay null, empty ones empty. Rows with a
    null key come first in the order. Rows that repeat a key are one document to the order: a window of theirs is no
    later occurrence of itself, and all of them lose the same lines. An empty table stays empty.
    """
    gone = repeated_lines(docs, text, key, span).withColumnRenamed("id", "__id").withColumnRenamed("gone", "__gone")
    out = docs.join(gone, docs[key].eqNullSafe(gone["__id"]), "left").drop("__id")
    lines = F.split(F.col(text), "\n")
    dropped = _let(_numbered(F.col(text)), lambda rows: F.transform(F.col("__gone"), lambda k: F.get(rows, k - 1)["i"]))
    kept = _let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), dropped), lambda i: F.get(x, i)))
    steps = F.zip_with(F.slice("__gone", 1, F.size("__gone") - 1), F.slice("__gone", 2, F.size("__gone") - 1), lambda a, b: F.when(b > a + 1, 1).otherwise(0))
    hit = F.col("__gone").isNotNull()
    return out.withColumns({
        "n_lines": F.size(_numbered(F.col(text))).cast("long"),
        "n_removed": F.when(hit, F.size("__gone")).otherwise(0).cast("long"),
        "n_spans": F.when(hit, F.aggregate(steps, F.lit(1), lambda s, x: s + x)).otherwise(0).cast("long"),
        text: F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text)),
    }).drop("__gone")
