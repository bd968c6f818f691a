"""Near duplicates by SimHash: 64-bit fingerprints, BK-tree search inside shards, components over the links.

Two fingerprints that differ in at most r bits agree on all but r of any b blocks of bits, so each fingerprint is
sent to one shard per choice of b - r blocks and every close pair meets in a shard. A shard's fingerprints stand
in a BK-tree (children keyed by the integer distance to their parent) and a search follows only the edges within
the radius. A shard over ``max_shard`` is dealt again by blocks of its remaining bits, which bounds its trees by
2**16 nodes. Trees travel by shuffle: their number grows with the data, so broadcasting all of them has no bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, store

_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority vote of the XXH64 hashes (seed 42) of all word shingles; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[at:stop], ends[at + shingle - 1 : stop + shingle - 1])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long (its 64 bits); null and empty texts have 0."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, prints(F.col(text)))


class BKTree:
    """Nodes in insertion order; ``children[i]`` maps the distance to node i to the child there."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within the radius, following only edges whose distance can hold one."""
        found, todo = [], [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            edges = self.children[i]
            todo.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)
        return found

    def add(self, value: int) -> None:
        i, new = 0, len(self.values)
        while new:
            d = (self.values[i] ^ value).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = new
                break
            i = self.children[i][d]
        self.values.append(value)
        self.children.append({})


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(i, j) with j the first member of i's group inside this shard; members without a neighbour are left out."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(i, r) for i in range(len(values)) if (r := root(i)) != i]


def _blocks(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    edges = [lo + (hi - lo) * k // n for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _keyed(prints: DataFrame, radius: int, blocks: int, fine: bool) -> DataFrame:
    """One row per fingerprint and shard key; ``fine`` adds a second key over the bits the first one leaves free."""
    keys = []
    parts = _blocks(0, 64, blocks)
    for a, kept in enumerate(combinations(range(blocks), blocks - radius)):
        spans = [parts[k] for k in kept]
        free = [s for k, s in enumerate(parts) if k not in kept]
        if not fine:
            keys.append((a, spans))
            continue
        bits = [b for lo, hi in free for b in range(lo, hi)]
        inner = _blocks(0, len(bits), blocks)
        for c, more in enumerate(combinations(range(blocks), blocks - radius)):
            keys.append((1000 + a * 100 + c, spans + [(bits[x], bits[x] + 1) for k in more for x in range(*inner[k])]))
    rows = []
    for k, spans in keys:
        mask = 0
        for lo, hi in spans:
            mask |= ((1 << (hi - lo)) - 1) << lo
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        rows.append(F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    cols = [F.col("fp"), F.col("rep")] + ([F.col("kind0"), F.col("key0")] if fine else [])
    return prints.select(*cols, F.explode(F.array(*rows)).alias("s")).select(*cols, "s.*")


def _search(shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between representatives, from sorted partitions of whole shards."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {"kind": [], "key": [], "fp": [], "rep": []}

        def flush(kind, key, fp, rep):
            edge = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
            edge = np.concatenate([[0], edge, [len(kind)]])
            a, b = [], []
            for k in np.flatnonzero(np.diff(edge) > 1):
                lo, hi = int(edge[k]), int(edge[k + 1])
                for i, j in shard_links(fp[lo:hi].view(np.uint64).tolist(), radius):
                    a.append(rep[lo + i])
                    b.append(rep[lo + j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for c in held:
                held[c].append(batch.column(c).to_numpy(zero_copy_only=False))
            kind, key = held["kind"][-1], held["key"][-1]
            if not len(kind):
                continue
            last = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
            cut = len(kind) - (last[-1] + 1 if len(last) else 0)  # the last shard may go on in the next batch
            if cut == len(kind):
                continue
            full = {c: np.concatenate(v) for c, v in held.items()}
            yield flush(*(full[c][:-cut] for c in held))
            held = {c: [v[-cut:]] for c, v in full.items()}
        if any(map(len, held["kind"])):
            yield flush(*(np.concatenate(held[c]) for c in held))

    ordered = shards.select("kind", "key", "fp", "rep").repartition("kind", "key").sortWithinPartitions("kind", "key", "rep")
    return ordered.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = 2, blocks: int = 4, max_shard: int = 2000) -> DataFrame:
    """Links between distinct fingerprints ``prints(fp, rep)`` that span every close pair's component."""
    keyed = _keyed(prints, radius, blocks, fine=False)
    sizes = keyed.groupBy("kind", "key").agg(F.count("*").alias("n"))
    crowded = store(sizes.where(F.col("n") > 1), "shards")
    small = keyed.join(crowded.where(F.col("n") <= max_shard), ["kind", "key"], "left_semi")
    large = keyed.join(crowded.where(F.col("n") > max_shard), ["kind", "key"], "left_semi")
    fine = _keyed(large.select("fp", "rep", F.col("kind").alias("kind0"), F.col("key").alias("key0")), radius, blocks, fine=True)
    fine = fine.where(F.floor((F.col("kind") - 1000) / 100) == F.col("kind0"))
    both = small.select("kind", "key", "fp", "rep").unionByName(fine.select("kind", "key", "fp", "rep"))
    return _search(both, radius).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), by alternating large and small stars.

    Each round halves path lengths and is written to the shared folder; a star keeps one row per edge, so a node
    with very many links is spread over its neighbours' rows. The number of rounds is logarithmic in the longest path.
    """
    pairs = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the lowest neighbours are written, so that the join deals both sides anew and can split a node of very many links
        low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large, "large")
        lows = store(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.withColumnRenamed("m", "v"))
        new = store(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        changed = new.join(pairs, ["u", "v"], "left_anti").limit(1).count() or pairs.join(new, ["u", "v"], "left_anti").limit(1).count()
        pairs = new
        if not changed:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 2, max_shard: int = 2000
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Fingerprints within ``radius`` bits are linked, and component_id is the smallest key reachable. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Rows with a null key link others like any row, but
    give no id; a component of such rows only has a null id. Repeated rows are all returned; an empty table gives no rows.
    """
    prints = store(add_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "t", shingle).select("id", "fp"), "prints")
    distinct = store(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comp = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius, max_shard=max_shard))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = store(named, "named")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = store(named.join(least, "c").select("fp", "component_id"), "ids")
    return (
        prints.join(named, "fp", "left")
        .select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component of near fingerprints: the one with the smallest key, null keys last.

    Rows are told apart by key and text: different texts under one key are documents of their own, as are those with a null
    key, and rows that repeat both keep one row. Null, empty and wordless texts are one component. An empty table stays empty.
    """
    marks = {"__h": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}
    prints = add_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "t", shingle)
    row = F.struct(F.col("id").isNull().alias("late"), "id", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("h2"))
    distinct = store(prints.select("fp", row.alias("row")).groupBy("fp").agg(F.min("row").alias("row")), "distinct")
    comp = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(F.coalesce("component", "fp").alias("c"), "row")
    first = store(named.groupBy("c").agg(F.min("row").alias("row")).select("row.id", "row.h", "row.h2"), "first")
    rows = docs.withColumns(marks)
    same = rows[key].eqNullSafe(first["id"]) & (rows["__h"] == first["h"]) & (rows["__h2"] == first["h2"])
    return rows.join(first, same, "left_semi").dropDuplicates([key, "__h", "__h2"]).drop(*marks)
