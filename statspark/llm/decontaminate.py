"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of ``min_match`` words are joined on these seeds. Tiles lie in shared
runs only, so the item words under them bound its coverage from above; a pair whose bound is below the threshold can't
pass and is not tiled. For each other pair the longest non-overlapping matches are marked again and again, longest
first, found by running Karp-Rabin hashes over the unmarked words; the share of the item's words under tiles is its
coverage. Order does not matter to coverage, so reordered passages are caught.

The benchmark is a stated query set: it is worked in blocks of about ``block_items`` items and ``BLOCK_WORDS`` words,
and only one block's seeds travel with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, spans_by_size

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of one block of items, at most (a longer item is a block of its own).
BLOCK_WORDS = 10_000_000
#: Moduli of the running hashes: products of two residues fit 64 bits.
_PRIMES = (2_147_483_647, 2_147_483_629)
_RADIX = (1_000_003_993, 1_299_709_031)


def normal_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def rolling_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` ids, in arithmetic modulo 2**64."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _BASE + (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _free_runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[1], marked.astype(np.int8), [1]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _powers(radix: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, radix
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        filled, step = filled + more, step * step % prime
    return out


class _Running:
    """Karp-Rabin hashes of all runs of any one length, from prefix sums modulo two primes."""

    def __init__(self, ids: np.ndarray, n: int) -> None:
        words = (ids + 2).astype(np.uint64)
        self.sums, self.lift = [], []
        for prime, radix in zip(_PRIMES, _RADIX):
            powers = _powers(radix, prime, n)
            terms = words % np.uint64(prime) * powers[: len(ids)] % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))
            self.lift.append(powers[::-1])  # brings a run at place i to one common power

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        parts = []
        for prime, sums, lift in zip(_PRIMES, self.sums, self.lift):
            parts.append((sums[at + length] - sums[at]) % np.uint64(prime) * lift[at] % np.uint64(prime))
        return parts[0] << np.uint64(31) | parts[1]


def _places(runs: list[tuple[int, int]], length: int) -> np.ndarray:
    """Where a run of ``length`` words fits into the free stretches."""
    return np.concatenate([np.arange(lo, hi - length + 1) for lo, hi in runs if hi - lo >= length] or [np.zeros(0, np.int64)])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(item place, document place, length) of the tiles, longest first; ties go to the earlier item place, then document place.

    The length of a round is found by bisection, as shorter parts of a match match as well. Each length comes once and
    lengths fall, so there are at most as many rounds as the root of twice the item's length, each a few passes.
    """
    n = max(len(item), len(doc)) + 1
    hash_item, hash_doc = _Running(item, n), _Running(doc, n)
    marked_item, marked_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    top = len(item)
    while True:
        free_item, free_doc = _free_runs(marked_item), _free_runs(marked_doc)
        top = min(top, max((hi - lo for lo, hi in free_item), default=0), max((hi - lo for lo, hi in free_doc), default=0))
        low, high, probe, found = min_match, top, top, None
        while low <= high:
            p, q = _places(free_item, probe), _places(free_doc, probe)
            hp, hq = hash_item(p, probe), hash_doc(q, probe)
            both = np.intersect1d(hp, hq)
            if len(both):
                found, low = (probe, p[np.isin(hp, both)], q[np.isin(hq, both)]), probe + 1
            else:
                high = probe - 1
            probe = (low + high + 1) // 2
        if found is None:
            return tiles
        length, p, q = found
        waiting: dict[int, list[int]] = {}
        for h, place in zip(hash_doc(q, length).tolist()[::-1], q.tolist()[::-1]):
            waiting.setdefault(h, []).append(place)
        for h, place in zip(hash_item(p, length).tolist(), p.tolist()):
            if marked_item[place] or marked_item[place + length - 1]:
                continue
            rest = waiting[h]
            while rest:  # a document place that is passed over is marked or used
                at = rest.pop()
                if not (marked_doc[at] or marked_doc[at + length - 1]) and (item[place : place + length] == doc[at : at + length]).all():
                    marked_item[place : place + length] = True
                    marked_doc[at : at + length] = True
                    tiles.append((place, at, length))
                    break
        top = length - 1


def _near_seeds(hits: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Places within ``reach`` words of a seed: tiles lie there, so the rest of a long text is not tiled."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, np.maximum(hits - reach, 0), 1)
    np.add.at(inside, np.minimum(hits + reach, n), -1)
    return np.flatnonzero(np.cumsum(inside)[:-1] > 0)


class Seeds:
    """The word runs of a block of items: vocabulary and, per run length, sorted run hashes with their places.

    Items shorter than ``min_match`` words have one run, their whole. Places count through all items one after another.
    """

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        place = 0
        for k, (item_id, words) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            length = min(min_match, max(1, len(ids)))
            own = rolling_hashes(ids, length)
            self.items.append((item_id, ids, length))
            found.setdefault(length, []).append((own, place + np.arange(len(own)), np.full(len(own), k)))
            place += len(ids)
        self.runs = {}
        for length, parts in found.items():
            hashes, places, owners = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.runs[length] = hashes[order], places[order], owners[order]
        self.sizes = np.array([max(1, len(ids)) for _, ids, _ in self.items], np.int64)

    def candidates(self, ids: np.ndarray, min_coverage: float) -> list[tuple[int, np.ndarray]]:
        """Items whose words under runs shared with ``ids`` reach ``min_coverage``, and where these runs are in ``ids``."""
        known = np.cumsum(np.concatenate([[0], ids >= 0]))
        out = []
        for length, (hashes, places, owners) in sorted(self.runs.items()):
            at = np.flatnonzero(known[length:] - known[:-length] == length) if len(ids) >= length else np.zeros(0, np.int64)
            h = np.zeros(len(at), np.uint64)
            for k in range(length):
                h = h * _BASE + (ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            distinct, back = np.unique(h, return_inverse=True)
            lo, hi = np.searchsorted(hashes, distinct, "left"), np.searchsorted(hashes, distinct, "right")
            shared = hi > lo
            at, h, lo, hi = at[shared[back]], h[shared[back]], lo[shared], hi[shared]
            if not len(at):
                continue
            # every item run that the text shares, each once however often the text repeats it
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            order = np.argsort(places[which], kind="stable")
            start, owner = places[which][order], owners[which][order]
            last = np.append(owner[1:] != owner[:-1], True)
            covered = np.where(last, length, np.minimum(np.append(start[1:] - start[:-1], length), length))
            names, first = np.unique(owner, return_index=True)
            bound = np.add.reduceat(covered, first)
            run_hash, ends = hashes[which][order], np.append(first[1:], len(owner))
            for k in np.flatnonzero(bound / self.sizes[names] >= min_coverage):
                out.append((int(names[k]), at[np.isin(h, run_hash[first[k] : ends[k]])]))
        return out

    def matches(self, text: str | None, min_coverage: float) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of each item that the text covers far enough."""
        get = self.vocabulary.get
        words = normal_words(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        for owner, hits in self.candidates(ids, min_coverage):
            item_id, item, length = self.items[owner]
            near = _near_seeds(hits, len(item) + length, len(ids))
            part = ids[near]
            # a jump between two stretches must not look like neighbouring words
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            tiles = greedy_tiles(item, np.insert(part, gaps, -1), length)
            coverage = sum(t[2] for t in tiles) / len(item)
            if tiles and coverage >= min_coverage:
                out.append((item_id, coverage, len(tiles), max(t[2] for t in tiles)))
        return out


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, min_match: int, block_items: int) -> Iterator[Broadcast]:
    """Broadcast seeds of one block of items after another.

    Items fall into parts by the hash of their id; whole parts are packed into blocks by what their items weigh, so the
    driver learns one number per part and holds one block.
    """
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.coalesce(item_text, F.lit("")).alias("t"))
    share = BLOCK_WORDS / block_items
    # a word takes two characters with its separator; a block holds as many words as block_items items of this share
    weight = F.greatest(F.lit(1.0), (F.length("t") + 1) / 2 / F.lit(share))
    total = items.agg(F.sum(weight)).first()[0]
    if total is None:
        return
    parts = 64 * max(1, -(-int(total) // block_items)) if total > block_items else 1
    numbered = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    weights = {r["b"]: r["w"] for r in numbered.groupBy("b").agg(F.sum(weight).alias("w")).collect()}
    for lo, hi in spans_by_size([weights.get(b, 0) for b in range(parts)], block_items):
        found = sorted((r["i"], r["t"]) for r in numbered.where(F.col("b").between(lo, hi - 1)).select("i", "t").toLocalIterator())
        words = [(i, w) for i, t in found if (w := normal_words(t))]
        if words:
            yield spark.sparkContext.broadcast(Seeds(words, min_match))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text",
    *, min_match: int = 4, min_coverage: float = 0.6, block_items: int = 20_000,
) -> DataFrame:
    """One row per document and benchmark item it covers: key, item key, coverage, n_tiles, longest_tile.

    Items shorter than ``min_match`` words are matched as a whole. Null, empty and wordless texts match nothing, on
    either side; an item without id is left out. Repeated documents are reported each; repeated items, too. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` long, coverage double, n_tiles long, longest_tile long"
    out = None
    for seeds in _blocks(benchmark, item_key, item_text, min_match, block_items):

        def run(batches, seeds=seeds):
            for batch in batches:
                k, got = batch.column("k"), []
                for row, t in enumerate(batch.column("t").to_pylist()):
                    got += [(row, *m) for m in seeds.value.matches(t, min_coverage)]
                cols = list(zip(*got)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [k.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    [key, item_key, "coverage", "n_tiles", "longest_tile"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _is_clean(seeds: Broadcast, min_coverage: float):
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not seeds.value.matches(t, min_coverage) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(clean, "boolean")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text",
    *, min_match: int = 4, min_coverage: float = 0.6, block_items: int = 20_000,
) -> DataFrame:
    """``docs`` without the rows whose text covers an item far enough, as ``contaminated`` reports them.

    Every row is judged by its own text: null and repeated keys make no difference, and nothing is shuffled. Null,
    empty and wordless texts stay.
    """
    small_batches(docs.sparkSession)
    for seeds in _blocks(benchmark, item_key, item_text, min_match, block_items):
        docs = docs.where(_is_clean(seeds, min_coverage)(docs[text]))
    return docs
