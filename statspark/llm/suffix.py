"""Removal of byte strings that occur earlier, by sorted cover samples.

The difference-cover way to sort suffixes rests on a sample of positions such that two equal strings have a sample at
the same offset: sampled tuples are sorted and named, names stand for longer strings, the other suffixes are settled
from the samples, and neighbours in the order are compared. The same steps are taken here for strings of ``length``
bytes, with a cover that is chosen by content (the least hash among the 50-byte tuples of a string) instead of by
position modulo v. It holds one position in about 26 instead of two in three, which is what makes it fit on disk:

1. cover: all strings whose least tuple has the same hash and that follow each other form a run; one row per run;
2. sort runs by the tuple's hash and name each by the hash of all its bytes; of equal runs all but the first repeat;
3. a tuple whose runs have different names, or recurs inside one, leaves the first run of each name open (edges of repeated passages, near copies);
4. the strings of open runs are sorted by hash, and all but the first of equal neighbours repeat;
5. bytes under repeating strings are removed.

A run or string that many documents have is reduced to its first place in every task before it is shuffled, and a
tuple that meets very many different runs in a task is opened there, so no task gathers a hot passage.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, store

LENGTH = 100
_U = np.uint64
_CHUNK = 1 << 20
#: Runs and strings held in a task before they are sent on.
_HOLD = 1 << 20
#: Different runs of one tuple in one batch of runs above which they are opened at once.
_CROWD = 32
_MARK = 0


class Rolling:
    """Hashes of any stretch of a buffer from prefix sums: sum of value(byte) * base**place, modulo 2**64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 4 + 3
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, 2 * len(self.power))
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((prefix[stop] - prefix[start]) * self.inverse[start])

    def all(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mixed((prefix[width:] - prefix[:n]) * self.inverse[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


_FIRST, _SECOND = Rolling(101), Rolling(202)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    out, reach = h, 1
    while reach < width:
        more = min(reach, width - reach)
        out, reach = np.minimum(out[:-more], out[more:]), reach + more
    return out


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(text, first place in it, strings, tuple hash, name, loop) of all runs of the texts ``data[starts:ends]``.

    loop: a string may occur twice in the run. For that the tuple must enter it once more after its first string.
    """
    sizes = np.maximum(ends - starts - length + 1, 0)
    total = int(sizes.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    width = length // 2
    sums = _FIRST.prefix(data)
    tuples = _FIRST.all(sums, width)
    least = _least(tuples, length - width + 1)
    owner = np.repeat(np.arange(len(starts)), sizes)
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
    low = least[place]
    new = np.ones(total, bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    loop = np.bitwise_or.reduceat((tuples[place + (length - width)] == low) & ~new, at)
    strings = np.diff(at, append=total)
    first = place[at]
    name = _FIRST.of(sums, first, first + strings + (length - 1)) + strings.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return owner[at], first - starts[owner[at]], strings, low[at], mixed(name), loop


def _small(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if len(x) == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _pack(cols: list[np.ndarray]) -> bytes:
    """Columns of one length as bytes; whole numbers are stored as differences in the narrowest type."""
    out = [len(cols[0]).to_bytes(8, "little")]
    for c in cols:
        if c.dtype == np.int64:
            c = _small(np.diff(c, prepend=0))
        out += [c.dtype.str.encode().ljust(4), c.tobytes()]
    return b"".join(out)


def _unpack(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        stored = np.dtype(data[at : at + 4].decode().strip())
        c = np.frombuffer(data, stored, n, at + 4)
        out.append(np.cumsum(c.astype(np.int64)) if kind is np.int64 else c)
        at += 4 + n * stored.itemsize
    return out


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in a row, and the offsets of its values."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), offsets


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes, starts, ends, first row, shift): texts together up to a chunk; a longer text in overlapping pieces.

    A run that a cut divides has other names than an undivided one; its strings are then compared one by one (step 4).
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > _CHUNK:
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            for at in range(lo, hi - length + 1, _CHUNK):
                part = data[at : min(hi, at + _CHUNK + length - 1)]
                yield part, np.array([0]), np.array([len(part)]), i, at - lo
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        lo = offsets[i]
        yield data[lo : offsets[j]], offsets[i:j] - lo, offsets[i + 1 : j + 1] - lo, i, 0
        i = j


def _spans(key: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring stretches of places merged."""
    order = np.lexsort((place, key))
    key, place, size = key[order], place[order], size[order]
    if not len(key):
        return key, place, size
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] > place[:-1] + size[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(place + size, at)
    return key[at], place[at], end - place[at]


def _first_of(order: np.ndarray, *same: np.ndarray) -> np.ndarray:
    new = np.ones(len(order), bool)
    for c in same:
        v = c[order]
        if c is same[0]:
            new[1:] = v[1:] != v[:-1]
        else:
            new[1:] |= v[1:] != v[:-1]
    return new


_SHAPE = "bucket int, kind int, body binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_RUN, _STRING, _GONE, _OPEN = 0, 1, 2, 3
_OUT = "kind int, k long, lo long, n long"
_OUT_NAMES = ["kind", "k", "lo", "n"]


def _deal(kind: int, cols: list[np.ndarray], by: np.ndarray, buckets: int):
    """Rows (bucket, kind, body), the columns dealt by hash."""
    if not len(by):
        return
    to = (by % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    cols = [c[order] for c in cols]
    ids, kinds, bodies = [], [], []
    for lo, hi in zip(edge, np.append(edge[1:], len(order))):
        ids.append(int(to[order[lo]]))
        kinds.append(kind)
        bodies.append(_pack([c[lo:hi] for c in cols]))
    for at in range(0, len(ids), 512):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 512], pa.int32()), pa.array(kinds[at : at + 512], pa.int32()), pa.array(bodies[at : at + 512], pa.binary())], schema=_SCHEMA)


def _rows(kind: int, k, lo, n):
    for at in range(0, len(k), 1 << 16):
        to = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[to]), kind, np.int32)), pa.array(k[to]), pa.array(lo[to]), pa.array(n[to])], _OUT_NAMES)


def _send_runs(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Steps 1 and 2 within a task: runs, reduced to their first place among the task's, dealt by tuple hash."""

    def run(batches):
        held: list[tuple] = []
        turn, size = count(), 0

        def flush():
            k, lo, n, low, name, loop = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((lo, k, name, low))
            first = _first_of(order, low, name)
            rest = order[~first]
            group = np.cumsum(first) - 1
            again = (k[rest] != k[order[first]][group[~first]]) | (lo[rest] != lo[order[first]][group[~first]])
            spread = np.full(1, next(turn) + 1, np.uint64)
            gone = _spans(k[rest][again], lo[rest][again], n[rest][again])
            yield from _deal(_GONE, list(gone), mixed(gone[0].astype(np.uint64) + spread), buckets)
            own = order[first]
            tuples = _first_of(own, low)
            edge = np.flatnonzero(tuples)
            sizes = np.diff(edge, append=len(own))
            crowded = np.repeat((sizes > _CROWD) | np.bitwise_or.reduceat(loop[own], edge), sizes)
            yield from _deal(_OPEN, [k[own][crowded], lo[own][crowded], n[own][crowded]], mixed(k[own][crowded].astype(np.uint64) + spread), buckets)
            n = n.copy()
            n[own[crowded]] = _MARK  # one mark of a crowded tuple goes on
            own = np.sort(own[~crowded | tuples])  # back in order of documents, which packs best
            ctx = name[own]
            cols = [k[own], lo[own], n[own], low[own], (ctx & _U(0xFFFFFFFF)).astype(np.uint32), ((ctx >> _U(32)) & _U(0xFF)).astype(np.uint8)]
            yield from _deal(_RUN, cols, low[own], buckets)

        for batch in batches:
            data, offsets = _texts(batch.column("t"))
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            for part, starts, ends, row, shift in _chunks(data, offsets, length):
                owner, lo, *found = runs(part, starts, ends, length)
                held.append((keys[row + owner], lo + shift, *found))
                size += len(lo)
                if size >= _HOLD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, _SHAPE)


def _settle_runs(dealt: DataFrame) -> DataFrame:
    """Steps 2 and 3 over all tasks: (kind, k, lo, n) of repeating (_GONE) and open (_OPEN) runs."""

    def run(batches):
        held = []
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
                if kind == _RUN:
                    held.append(_unpack(body, [np.int64] * 3 + [np.uint64, np.uint32, np.uint8]))
                else:
                    yield from _rows(kind, *_unpack(body, [np.int64] * 3))
        if not held:
            return
        k, lo, n, low, a, b = (np.concatenate(c) for c in zip(*held))
        held.clear()
        name = a.astype(np.uint64) | (b.astype(np.uint64) << _U(32))
        name[n == _MARK] = _U(1 << 63)
        order = np.lexsort((lo, k, name, low))
        first, tuples = _first_of(order, low, name), _first_of(order, low)
        group = np.cumsum(first) - 1
        rest, head = order[~first], order[first][group[~first]]
        again = ((k[rest] != k[head]) | (lo[rest] != lo[head])) & (n[rest] != _MARK)
        yield from _rows(_GONE, *_spans(k[rest][again], lo[rest][again], n[rest][again]))
        heads = order[first]
        names = np.add.reduceat(first.astype(np.int64), np.flatnonzero(tuples))
        many = np.repeat(names > 1, names) & (n[heads] != _MARK)
        yield from _rows(_OPEN, k[heads][many], lo[heads][many], n[heads][many])

    return dealt.mapInArrow(run, _OUT)


def _send_strings(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 4 within a task: strings of open runs, reduced to their first place among the task's, dealt by hash."""

    def run(batches):
        held: list[tuple] = []
        turn, size = count(), 0

        def flush():
            k, p, h, g = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((p, k, g, h))
            first = _first_of(order, h, g)
            group = np.cumsum(first) - 1
            rest, head = order[~first], order[first][group[~first]]
            again = (k[rest] != k[head]) | (p[rest] != p[head])
            gone = _spans(k[rest][again], p[rest][again], np.ones(int(again.sum()), np.int64))
            yield from _deal(_GONE, list(gone), mixed(gone[0].astype(np.uint64) + _U(next(turn) + 1)), buckets)
            own = np.sort(order[first])
            yield from _deal(_STRING, [k[own], p[own], h[own], g[own]], h[own], buckets)

        for batch in batches:
            data, offsets = _texts(batch.column("t"))
            for row, (key, los, ns) in enumerate(zip(batch.column("k").to_pylist(), batch.column("los").to_pylist(), batch.column("ns").to_pylist())):
                text = data[offsets[row] : offsets[row + 1]]
                spans = _spans(np.zeros(len(los), np.int64), np.array(los, np.int64), np.array(ns, np.int64))
                for lo, n in zip(spans[1].tolist(), spans[2].tolist()):
                    for at in range(lo, lo + n, _CHUNK):
                        part = text[at : min(lo + n, at + _CHUNK) + length - 1]
                        h = _FIRST.all(_FIRST.prefix(part), length)
                        g = (_SECOND.all(_SECOND.prefix(part), length) >> _U(32)).astype(np.uint32)
                        held.append((np.full(len(h), key, np.int64), np.arange(at, at + len(h)), h, g))
                        size += len(h)
                        if size >= _HOLD:
                            yield from flush()
                            held, size = [], 0
        if size:
            yield from flush()

    return rows.mapInArrow(run, _SHAPE)


def _settle_strings(dealt: DataFrame) -> DataFrame:
    def run(batches):
        held = []
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
                if kind == _STRING:
                    held.append(_unpack(body, [np.int64] * 2 + [np.uint64, np.uint32]))
                else:
                    yield from _rows(_GONE, *_unpack(body, [np.int64] * 3))
        if not held:
            return
        k, p, h, g = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((p, k, g, h))
        first = _first_of(order, h, g)
        group = np.cumsum(first) - 1
        rest, head = order[~first], order[first][group[~first]]
        again = (k[rest] != k[head]) | (p[rest] != p[head])
        yield from _rows(_GONE, *_spans(k[rest][again], p[rest][again], np.ones(int(again.sum()), np.int64)))

    return dealt.mapInArrow(run, _OUT)


def _with_lists(docs: DataFrame, spans: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """``docs(k, t)`` that have spans, with these as lists ``los`` and ``ns``.

    A bit map of hashed keys, of ``max_bits`` at most, keeps most other texts out of the shuffle; where keys outgrow it,
    more texts are shuffled and the join leaves them out.
    """
    lists = store(spans.groupBy("k").agg(F.collect_list(F.struct("lo", "n")).alias("s")).select("k", F.col("s.lo").alias("los"), F.col("s.n").alias("ns")), "lists")
    bits = 1 << 16
    while bits < max_bits and bits < 32 * lists.count():
        bits *= 2
    slot = F.pmod(F.xxhash64("k"), F.lit(bits))
    words = lists.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("b")).toPandas()
    table = np.zeros(bits // 32, np.uint32)
    table[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.uint64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def likely(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy(np.int64)
        return pd.Series((shared.value[s // 32] >> (s % 32).astype(np.uint32)) & 1 == 1)

    return docs.where(likely(slot)).join(lists, "k")


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` as (id, k, t): k orders documents. Where keys repeat (or are null), k numbers the different (key, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    doubtful = rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if not doubtful:
        return rows.select("id", F.col("id").alias("k"), "t")
    rows = rows.withColumns({"h": F.xxhash64("t"), "h2": F.xxhash64(F.lit(3), "t")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = rows.select("id", "h", "h2").distinct().repartitionByRange(parts, "id").sortWithinPartitions("id", "h", "h2")
    numbers = store(numbers.withColumn("k", F.monotonically_increasing_id()), "numbers").select(F.col("id").alias("i"), "h", "h2", "k")
    return rows.join(numbers, rows["id"].eqNullSafe(numbers["i"]) & (rows["h"] == numbers["h"]) & (rows["h2"] == numbers["h2"])).select("id", "k", "t")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, lo, n) of ``docs(k, t)``: at places lo … lo + n - 1 (bytes) begin strings that also begin earlier."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = buckets // 4
    found = store(_settle_runs(_send_runs(docs.select("k", "t"), length, buckets).repartition(parts, "bucket")), "runs")
    open_ = _with_lists(docs.select("k", "t"), found.where(F.col("kind") == _OPEN))
    more = store(_settle_strings(_send_strings(open_, length, buckets).repartition(parts, "bucket")), "strings")
    return found.where(F.col("kind") == _GONE).select("k", "lo", "n").unionByName(more.select("k", "lo", "n"))


def _cut(text: np.ndarray, los: list[int], ns: list[int], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept) once all strings that begin at the places are removed."""
    _, lo, size = _spans(np.zeros(len(los), np.int64), np.array(los, np.int64), np.array(ns, np.int64) + (length - 1))
    keep = np.ones(len(text), bool)
    for a, n in zip(lo.tolist(), size.tolist()):
        keep[a : a + n] = False
    return int(size.sum()), len(lo), text[keep].tobytes()


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Every byte of the UTF-8 text that a string of ``length`` bytes covers which also begins earlier (smaller key, or
    the same document further left) is removed. Null and empty texts have no bytes. Rows that repeat key and text are
    one document and get equal results; rows that share a key but not the text follow each other in the order of their
    texts' hashes; null keys come first. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs, text, key)
    touched = _with_lists(rows.select("k", "t"), repeated_spans(rows, length))

    def cut(batches):
        for batch in batches:
            data, offsets = _texts(batch.column("t"))
            gone, spans, digests, kept = [], [], [], []
            for row, (los, ns) in enumerate(zip(batch.column("los").to_pylist(), batch.column("ns").to_pylist())):
                a, b, body = _cut(data[offsets[row] : offsets[row + 1]], los, ns, length)
                gone.append(a)
                spans.append(b)
                digests.append(hashlib.sha256(body).hexdigest())
                kept.append(body if keep_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["k", "n_removed", "n_spans", "digest", "kept"])

    done = store(touched.mapInArrow(cut, "k long, n_removed long, n_spans long, digest string, kept binary").dropDuplicates(["k"]), "cut")
    body = F.encode("t", "UTF-8")
    whole = rows.select("id", F.col("k").alias("__k"), F.octet_length("t").cast("long").alias("n_bytes"), F.sha2(body, 256).alias("all"), *([body.alias("body")] if keep_bytes else []))
    out = whole.join(done, whole["__k"] == done["k"], "left")
    cols = [F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("digest", "all").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("kept", "body").alias("kept")] if keep_bytes else []))
