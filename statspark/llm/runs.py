"""Periodic runs of words: maximal stretches whose words repeat with some period, and texts with the repeats taken out.

Periods are handled by octave, [Q, 2Q). A document is cut into tiles that grow with the octave and overlap by more than
two of its largest periods, so every run is seen whole or in pieces that overlap. A tile is solved on its own: matches
of a word with the one q further on form stretches, a stretch that makes a run holds one of the boundaries that stand
every Q words, and the Z-values of that boundary at q (how far the text goes on like the text q further on, forward and
backward) give its ends. The Z-values of all boundaries and periods of an octave are found together, by bisection over
prefix hashes, and each stretch found is then compared word by word. Pieces are dealt by document and period, and
pieces that overlap or touch are stitched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, store

#: Documents up to this many words are one tile for all octaves.
TILE = 8192
#: Octaves of periods under this share the tiles of ``TILE`` words and twice the period of overlap.
_BASE = 2048
_PRIME, _ROOT = (1 << 31) - 1, 1_103_515_245
_PAIRS = 1 << 22
_FLUSH = 1 << 21


def tiles(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(lowest period, period limit, start, stop) of each tile of a document of n words."""
    if n <= TILE:
        yield 1, max(2, n), 0, n
        return
    lo, hi, core, halo = 1, _BASE, TILE, 2 * _BASE
    while 2 * lo <= n:
        for start in range(0, n, core):
            stop = min(n, start + core + halo)
            yield lo, hi, start, stop
            if stop == n:
                break
        lo, hi = hi, 2 * hi
        core = halo = 4 * lo


_powers = np.ones(1, np.int64)
_inverse = np.ones(1, np.int64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse modulo the prime, at least n of each."""
    global _powers, _inverse
    while len(_powers) < n:
        k = len(_powers)
        _powers = np.concatenate([_powers, _powers * pow(_ROOT, k, _PRIME) % _PRIME])
        _inverse = np.concatenate([_inverse, _inverse * pow(_ROOT, -k, _PRIME) % _PRIME])
    return _powers, _inverse


def _z_values(prefix: np.ndarray, b: np.ndarray, q: np.ndarray, limit: np.ndarray, sign: int) -> np.ndarray:
    """Longest equal extensions of positions b and b + q, forward (sign 1) or backward (sign -1), by prefix hashes."""
    powers, _ = _power_tables(len(prefix))
    size, step = np.zeros(len(b), np.int64), 1
    while len(limit) and step * 2 <= limit.max():
        step *= 2
    while step:
        fits = np.flatnonzero(size + step <= limit)
        lo = b[fits] + size[fits] if sign > 0 else b[fits] - size[fits] - step
        far = lo + q[fits]
        near_hash = (prefix[lo + step] - prefix[lo]) % _PRIME * powers[q[fits]] % _PRIME
        size[fits[near_hash == (prefix[far + step] - prefix[far]) % _PRIME]] += step
        step //= 2
    return size


def _z_by_words(codes: np.ndarray, b: int, q: int) -> tuple[int, int]:
    """The same for one pair by comparing words, without hashes."""
    f = r = 0
    while codes[b + f] == codes[b + q + f]:
        f += 1
    while codes[b - r - 1] == codes[b + q - r - 1]:
        r += 1
    return f, r


def solve(parts: list[np.ndarray], lo: int, hi: int, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, period, first match, end of matches) of every maximal stretch of matches inside each part.

    A stretch of period q needs max(q, least - q) matches, which makes a run of max(2 q, least) words. ``lo`` is a power
    of two. Of stretches over the same words in an octave only the smallest period is kept.
    """
    found = [np.zeros((0, 4), np.int64)]
    while lo < hi:
        chosen = [k for k, p in enumerate(parts) if len(p) >= max(2 * lo, least)]
        if not chosen:
            break
        stop = min(2 * lo, hi)
        step = min(max(q, least - q, 1) for q in (range(lo, min(stop, lo + least))))
        half = (step + 1) // 2
        # one sequence, each part between separators that occur once
        bits = [np.array([-1], np.int64)]
        for k in chosen:
            bits += [parts[k], np.array([-2 - k], np.int64)]
        codes = np.concatenate(bits)
        lengths = np.array([len(parts[k]) + 1 for k in chosen])
        begins = np.cumsum(lengths) - lengths + 1
        part_of = np.concatenate([[-1], np.repeat(np.arange(len(chosen)), lengths)])
        n = len(codes)
        powers, inverse = _power_tables(n + 1)
        prefix = np.zeros(n + 1, np.int64)
        np.cumsum(codes % _PRIME * powers[:n] % _PRIME, out=prefix[1:])
        prefix %= _PRIME
        blocks = np.full(n + stop + 1, -1, np.int32)
        blocks[: n - half + 1] = (prefix[half:] - prefix[:-half]) % _PRIME * inverse[: n - half + 1] % _PRIME
        width = stop - lo
        ahead = np.lib.stride_tricks.sliding_window_view(blocks, width)
        bounds, at, period = np.arange(0, n, step), [], []
        for i in range(0, len(bounds), max(1, _PAIRS // width)):
            b = bounds[i : i + max(1, _PAIRS // width)]
            same = (blocks[b][:, None] == ahead[b + lo]) & (b <= n - half)[:, None]
            back = np.maximum(b - half, 0)
            same |= (blocks[back][:, None] == ahead[back + lo]) & (b >= half)[:, None]
            x, y = np.nonzero(same)
            at.append(b[x])
            period.append(y + lo)
        b, q = np.concatenate(at), np.concatenate(period)
        inside = (b + q < n) & (part_of[b] == part_of[np.minimum(b + q, n - 1)])
        b, q = b[inside], q[inside]
        forward = _z_values(prefix, b, q, n - b - q, 1)
        backward = _z_values(prefix, b, q, b, -1)
        s, m = b - backward, b + forward
        good = m - s >= np.maximum(q, least - q)
        b, q, s, m, first = b[good], q[good], s[good], m[good], backward[good] < step
        # a stretch is seen from each of its boundaries: from the first one, and as it is, unless two blocks share a hash
        order = np.lexsort((~first, m, s, q))
        new = np.ones(len(q), bool)
        new[1:] = np.any([np.diff(c[order]) != 0 for c in (q, s, m)], axis=0)
        sound = first[order][new].all()
        once = _smallest(s[first], m[first], q[first])
        if sound and all(np.array_equal(codes[x:y], codes[x + p : y + p]) for x, y, p in once):
            stretches = once
        else:
            z = np.array([_z_by_words(codes, int(i), int(p)) for i, p in zip(b, q)])
            s, m = b - z[:, 1], b + z[:, 0]
            good = m - s >= np.maximum(q, least - q)
            stretches = _smallest(s[good], m[good], q[good])
        for x, y, p in stretches:
            k = part_of[x]
            found.append(np.array([[chosen[k], p, x - begins[k], y - begins[k]]], np.int64))
        lo *= 2
    part, period, s, m = np.concatenate(found).T
    return part, period, s, m


def _smallest(s: np.ndarray, m: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """(s, m, q) with the smallest q for each stretch of words [s, m + q)."""
    least: dict[tuple[int, int], tuple[int, int, int]] = {}
    for x, y, p in zip(s.tolist(), m.tolist(), q.tolist()):
        old = least.get((x, y + p))
        if old is None or p < old[2]:
            least[x, y + p] = (x, y, p)
    return list(least.values())


def _coded(split: list[bytes], names: defaultdict) -> np.ndarray:
    return np.fromiter(map(names.__getitem__, split), np.int64, len(split))


def _names() -> defaultdict:
    names: defaultdict = defaultdict()
    names.default_factory = names.__len__
    return names


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 12, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, n_words, runs, and the text without repeats.

    Words are runs of bytes that are not ASCII white space. ``runs`` is an array of (start, period, length) in words,
    ordered by start and period; a run is as long as its period allows, has at least ``least`` words and two periods, and
    its period is the smallest it has. The last column joins by single spaces the words that no run holds after its
    first period: ``collapsed``, or with ``texts=False`` only its SHA-256 in hexadecimal, ``collapsed_sha256``.

    Null, empty and wordless texts have no words, no runs and an empty text. Null and repeated keys are rows of their
    own; an empty table gives no rows; other columns are ignored. Texts may be of any length: those over ``TILE``
    words are dealt out tile by tile.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            plain = pa.schema([
                ("row", pa.int64()), ("id", batch.schema.field("id").type), ("n_words", pa.int64()), ("body", pa.binary()),
                ("digest", pa.string()), ("pieces", pa.list_(pa.struct([(c, pa.int64()) for c in ("q", "s", "m")]))),
                ("lo", pa.int64()), ("hi", pa.int64()), ("off", pa.int64()), ("codes", pa.binary()),
            ])

            def settle(rows: list[dict], coded: list[np.ndarray]) -> pa.RecordBatch:
                part, q, s, m = solve(coded, 1, TILE, least)
                for k, *piece in zip(part.tolist(), q.tolist(), s.tolist(), m.tolist()):
                    rows[k]["pieces"].append(dict(zip("qsm", piece)))
                for r in rows:
                    if not texts and not r["pieces"]:
                        r["body"] = None
                return pa.RecordBatch.from_pylist(rows, plain)

            bodies = batch.column("t").cast(pa.binary())
            rows, coded, size, names = [], [], 0, _names()
            for i, (row, of) in enumerate(zip(batch.column("row").to_pylist(), batch.column("id").to_pylist())):
                split = (bodies[i].as_py() or b"").split()
                joined = b" ".join(split)
                head = {"row": row, "id": of, "n_words": len(split), "body": joined, "digest": None if texts else _digest(joined), "pieces": []}
                if len(split) > TILE:
                    yield pa.RecordBatch.from_pylist([head], plain)
                    whole = _coded(split, _names())
                    for lo, hi, start, stop in tiles(len(split)):
                        tile = {"row": row, "lo": lo, "hi": hi, "off": start, "codes": whole[start:stop].astype("<i4").tobytes()}
                        yield pa.RecordBatch.from_pylist([tile], plain)
                    continue
                rows.append(head)
                coded.append(_coded(split, names))
                size += len(split)
                if size > _FLUSH:
                    yield settle(rows, coded)
                    rows, coded, size, names = [], [], 0, _names()
            if rows:
                yield settle(rows, coded)

    def solve_tiles(batches):
        out = pa.schema([(c, pa.int64()) for c in ("row", "q", "s", "m")])
        for batch in batches:
            for i in range(batch.num_rows):
                t = {c: batch.column(c)[i].as_py() for c in ("row", "lo", "hi", "off", "codes")}
                _, q, s, m = solve([np.frombuffer(t["codes"], "<i4").astype(np.int64)], t["lo"], t["hi"], least)
                yield pa.RecordBatch.from_pydict({"row": np.full(len(q), t["row"]), "q": q, "s": s + t["off"], "m": m + t["off"]}, out)

    def collapse(batches):
        for batch in batches:
            done = []
            for body, digest, runs in zip(*[batch.column(c).to_pylist() for c in ("body", "digest", "runs")]):
                if runs:
                    body = _without_repeats(body.split(), runs)
                    digest = None if texts else _digest(body)
                done.append(body if texts else digest)
            last = pa.array(done, pa.binary()).cast(pa.string()) if texts else pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "n_words", "runs")], last], [key, "n_words", "runs", name])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("t"))
    schema = f"row long, id {kind}, n_words long, body binary, digest string, pieces array<struct<q: long, s: long, m: long>>, lo long, hi long, off long, codes binary"
    scanned = store(numbered.mapInArrow(scan, schema), "scanned")
    heads = scanned.where(F.col("codes").isNull())
    cut = scanned.where(F.col("codes").isNotNull()).select("row", "lo", "hi", "off", "codes")
    cut = cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "lo", "off")
    pieces = heads.select("row", F.inline("pieces")).unionByName(cut.mapInArrow(solve_tiles, "row long, q long, s long, m long"))
    runs = stitch(pieces).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")
    name = "collapsed" if texts else "collapsed_sha256"
    joined = heads.join(runs, "row", "left").select("id", "n_words", "body", "digest", F.coalesce("runs", none).alias("runs"))
    return joined.mapInArrow(collapse, f"`{key}` {kind}, n_words long, runs array<struct<start: long, period: long, length: long>>, {name} string")


def stitch(pieces: DataFrame) -> DataFrame:
    """(row, start, period, length) of the runs that ``pieces(row, q, s, m)`` make up.

    Pieces of one period that overlap or touch are one stretch of matches; of stretches over the same words that with the
    smallest period is the run (a larger period is then a multiple of it).
    """
    order = Window.partitionBy("row", "q").orderBy("s", "m")
    before = F.max("m").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("first", (before.isNull() | (F.col("s") > before)).cast("int"))
    part = marked.withColumn("part", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = part.groupBy("row", "q", "part").agg(F.min("s").alias("start"), F.max("m").alias("m"))
    spans = whole.select("row", "q", "start", (F.col("m") + F.col("q") - F.col("start")).alias("length"))
    return spans.groupBy("row", "start", "length").agg(F.min("q").alias("period"))


def _without_repeats(words: list[bytes], runs: list[dict]) -> bytes:
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
