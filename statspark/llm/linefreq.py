"""Rule-based quality with cross-document line frequency, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated five-word windows of each text. The method then hashes
normalised lines (lower case, digits to 0, white space to one space), counts the documents of each host that have a
line, removes lines above the limits (``remove_frequent`` gives the texts), and rejects documents of which too little is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import SPACES, store, words_native

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` are the windows' in order."""

    def count(sorted_):
        # equal hashes are neighbours once sorted
        n = F.size(sorted_)
        same = F.filter(
            sorted_,
            lambda x, i: ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(sorted_, i + 1)["h"] == x["h"])),
        )
        at = F.array_sort(F.transform(same, lambda x: x["i"]))
        gaps = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return _let(at, lambda p: F.when(F.size(p) > 1, F.aggregate(gaps(p), F.lit(0), lambda s, g: s + g) + WINDOW).otherwise(0))

    places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(places, count)).otherwise(0)


def _repeats(words: Column) -> Column:
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, _let(windows(words), _covered)).otherwise(0)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (columns of these names are replaced)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0
    lines = F.filter(F.split(t, "\n"), has_word)
    size = lambda c: c.cast("long")
    of_words = lambda w: F.struct(
        size(F.size(w)).alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("c"), size(_repeats(w)).alias("r")
    )
    return docs.withColumns({
        "__w": _let(words_native(F.col(text)), of_words),
        "n_symbols": size(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))),
        "n_dup_lines": size(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
    }).withColumns({"n_words": F.col("__w.n"), "word_chars": F.col("__w.c"), "n_repeat_words": F.col("__w.r")}).drop("__w")


def _norm(line: Column) -> Column:
    flat = F.translate(F.lower(line), SPACES + "123456789", " " * len(SPACES) + "0" * 9)
    return F.array_join(F.array_remove(F.split(flat, " "), ""), " ")


def _lines(docs: DataFrame, text: str, key: str, host: str, once: bool) -> DataFrame:
    """(id, host, t, i, h, h2, chars): a row per normalised line with a word, i from 0; ``once``: equal lines of a row give one, without t and i."""
    norm = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _norm)
    ids = [F.col(key).alias("id"), F.col(host).alias("host")]
    chars = F.length(F.translate("line", " ", "")).cast("long").alias("chars")
    hashes = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), chars]
    if once:
        return docs.select(*ids, F.explode(F.array_distinct(F.array_remove(norm, ""))).alias("line")).select("id", "host", *hashes)
    lines = docs.select(*ids, F.xxhash64(F.col(text)).alias("t"), F.posexplode(norm).alias("i", "line")).where("line <> ''")
    return lines.select("id", "host", "t", "i", *hashes)


def frequent_lines(docs: DataFrame, text: str, key: str, host: str, min_docs: int, min_share: float) -> DataFrame:
    """(host, h, h2) of lines that more than ``min_docs`` documents and more than ``min_share`` of a host's documents have."""
    # counts are combined in every task before they shuffle, so a line that all documents have is a row per task
    per_doc = _lines(docs, text, key, host, once=True)
    counts = per_doc.groupBy("host", "h", "h2").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    sizes = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total"))
    joined = counts.join(sizes, counts["host"].eqNullSafe(sizes["host"]))
    return joined.where(F.col("n") > F.lit(min_share) * F.col("total")).select(counts["host"], "h", "h2")


def remove_frequent(
    docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", *, min_docs: int = 10, min_share: float = 0.002
) -> DataFrame:
    """``docs`` with the text without frequent lines, and removed_chars (a column of this name is replaced).

    removed_chars counts what the removed lines hold besides white space. Lines without a word stay. Null texts stay null,
    a null host is a host of its own, and of rows that repeat a key each loses its own lines. An empty table stays empty.
    """
    common = store(frequent_lines(docs, text, key, host, min_docs, min_share), "lines")
    rows = _lines(docs, text, key, host, once=False)
    hit = (rows["host"].eqNullSafe(common["host"])) & (rows["h"] == common["h"]) & (rows["h2"] == common["h2"])
    gone = rows.join(common, hit, "left_semi").groupBy("id", "host", "t").agg(F.collect_set(F.struct("i", "chars")).alias("__gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("host").alias("__host"), F.col("t").alias("__t"), "__gone")
    same = docs[key].eqNullSafe(gone["__id"]) & docs[host].eqNullSafe(gone["__host"]) & (F.xxhash64(docs[text]) == gone["__t"])
    out = docs.join(gone, same, "left").drop("__id", "__host", "__t")
    places = F.transform("__gone", lambda x: x["i"])
    kept = _let(F.split(F.col(text), "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places), lambda i: F.get(x, i)))
    return out.withColumns({
        "removed_chars": F.coalesce(F.aggregate("__gone", F.lit(0).cast("long"), lambda n, x: n + x["chars"]), F.lit(0).cast("long")),
        text: F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)),
    }).drop("__gone")


def quality(
    docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", *,
    min_words: int = 10, max_repeat_pct: int = 20, min_docs: int = 10, min_share: float = 0.002, min_left: float = 0.5, with_text: bool = False,
) -> DataFrame:
    """One row per document: key, base counts, base_failed, removed_chars, kept; ``with_text``: and the text without frequent lines.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_pct`` percent of them in repeated windows. A
    document that passes is kept if at least ``min_left`` of its word characters are outside frequent lines. Null and
    empty texts fail the base rules; a null host is a host of its own; rows that repeat a key are returned each, count
    as documents of their own, and lose their own frequent lines. An empty table gives no rows.
    """
    slim = docs.select(F.col(key), F.col(host).alias("__source"), F.col(text).alias("__text"))
    counted = base_counts(slim, "__text")
    out = remove_frequent(counted, "__text", key, "__source", min_docs=min_docs, min_share=min_share)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    gone = F.least("removed_chars", "word_chars")
    return out.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("removed_chars"),
        (~failed & (F.col("word_chars") - gone >= F.lit(min_left) * F.col("word_chars"))).alias("kept"),
        *([F.col("__text").alias(text)] if with_text else []),
    )
