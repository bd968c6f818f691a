"""Token ids as binary shards in Simple-8b coding.

A shard is a word-aligned byte string, all numbers little-endian:

=============  =====================================================================
header         8 × int64: magic, version, ids a block, ids, words, documents, blocks, escapes
documents      int64 per document: its id; then int64 per document: its number of ids
block offsets  int64 per block: index of the block's first word
words          uint64 each: selector in the top four bits, packed ids in the other 60
escapes        uint64 each: ids of 60 bits or more
=============  =====================================================================

A selector fixes how many ids a word holds and how wide they are. Blocks are coded on their own, so any block can be
decoded alone; a whole shard is decoded one selector at a time over all words. Selector 1 is the escape: its payload
is an index into the escapes. Shards are the binary column of a Parquet folder, since Spark's writers are the only
way to every cluster's storage; each row also has its part, its place in the part and the ids before it in the part.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, spans_by_size

MAGIC = int.from_bytes(b"S8BTOKEN", "little")
VERSION = 1
BLOCK = 256
ESCAPE = 1
#: Fixed by the format: (ids in a word, bits of each) by selector; selector 1 is the escape.
SELECTORS = [
    (240, 0), (1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
_LIMIT = np.uint64(1 << 60)


_WIDTH = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if ids.max() < 1 << 16:
        return _WIDTH[ids]
    out = np.zeros(len(ids), np.uint8)
    for k in range(4):
        part = (ids >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _WIDTH[part] + np.uint8(16 * k), out)
    return out


def encode_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escapes) of an array of unsigned ids; every word takes as many ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    room = np.minimum(np.repeat(ends, ends - starts) - np.arange(n), 255).astype(np.uint8)
    wide = ids >= _LIMIT
    top, reach = _widths(ids), 1  # top[i]: the widest of the ids from i to i + reach
    best = np.zeros(n, np.uint8)  # 15 less the selector
    for s in range(14, -1, -1):
        count, bits = SELECTORS[s]
        if s == ESCAPE:
            continue
        while reach < count and len(top):
            more = min(reach, count - reach)
            top, reach = np.maximum(top[:-more], top[more:]), reach + more
        if not len(top):
            break
        fits = (top <= bits) & (room[: len(top)] >= count)
        own = best[: len(top)]
        np.maximum(own, fits.view(np.uint8) * np.uint8(15 - s), out=own)
    best = np.uint8(15) - best
    best[wide] = ESCAPE
    jump = _COUNTS[best]
    at, stop, found, live = starts.copy(), ends, [], np.arange(len(starts))
    while len(live):
        here = at[live]
        found.append(here)
        at[live] = here = here + jump[here]
        live = live[here < stop[live]]
    places = np.sort(np.concatenate(found))
    offsets = np.searchsorted(places, starts)
    chosen = best[places]
    words = np.zeros(len(places), np.uint64)
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        own = chosen == s
        body = np.zeros(int(own.sum()), np.uint64)
        if s == ESCAPE:
            body = np.cumsum(wide, dtype=np.int64)[places[own]].astype(np.uint64) - np.uint64(1)
        elif bits:
            for k in range(count):
                body |= ids[places[own] + k] << np.uint64(k * bits)
        words[own] = (np.uint64(s) << np.uint64(60)) | body
    return words, offsets.astype(np.int64), ids[wide]


def decode_words(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of the given words, one selector at a time."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        own = chosen == s
        body, to = words[own] & (_LIMIT - np.uint64(1)), starts[own]
        if s == ESCAPE:
            out[to] = escapes[body.astype(np.int64)]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[to + k] = (body >> np.uint64(k * bits)) & mask
    return out


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets, escapes = encode_words(ids, block)
    header = np.array([MAGIC, VERSION, block, len(ids), len(words), len(doc_ids), len(offsets), len(escapes)], "<i8")
    parts = (header, doc_ids.astype("<i8"), lengths.astype("<i8"), offsets.astype("<i8"), words.astype("<u8"), escapes.astype("<u8"))
    return b"".join(p.tobytes() for p in parts)


def open_shard(data: bytes) -> dict:
    """Views into a shard's bytes."""
    head = np.frombuffer(data, "<i8", 8)
    if head[0] != MAGIC or head[1] != VERSION:
        raise ValueError("not a shard of this format")
    block, n_ids, n_words, n_docs, n_blocks, n_escapes = (int(x) for x in head[2:])
    out, at = {"block": block, "n_ids": n_ids}, 64
    for name, kind, n in (("doc_ids", "<i8", n_docs), ("lengths", "<i8", n_docs), ("offsets", "<i8", n_blocks), ("words", "<u8", n_words), ("escapes", "<u8", n_escapes)):
        out[name] = np.frombuffer(data, kind, n, at)
        at += 8 * n
    return out


def decode_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids)."""
    s = open_shard(data)
    ids = decode_words(s["words"], s["escapes"])
    if len(ids) != s["n_ids"] or int(s["lengths"].sum()) != s["n_ids"]:
        raise ValueError("damaged shard")
    return s["doc_ids"], s["lengths"], ids


def decode_block(data: bytes, k: int) -> np.ndarray:
    """The ids of one block, without touching the others."""
    s = open_shard(data)
    stop = s["offsets"][k + 1] if k + 1 < len(s["offsets"]) else len(s["words"])
    return decode_words(s["words"][s["offsets"][k] : stop], s["escapes"])


class _Places(dict):
    """Where each known piece's ids are; unknown pieces are noted in passing."""

    missing: list[str]

    def __missing__(self, key: str) -> int:
        self.missing.append(key)
        return -2


class PieceEncoder:
    """Token ids of whole texts, with each distinct piece of text put through the tokenizer once.

    Byte-level BPE never merges over the border that a lone space between two visible characters makes: the space
    begins the next piece. So a text falls into pieces there (and around lone newlines), and its ids are the pieces'
    ids in a row. Texts with other white space are cut at safe spaces only; texts that hold the mark of a special token,
    or a zero character, go through the tokenizer whole. ``cap`` bounds the pieces remembered at a time; beyond it all are
    forgotten. A ``frugal`` encoder then keeps those met again, which makes a small cap cheap, and runs the tokenizer in the
    task's own thread, since each thread of a pool holds memory.

    A piece is known by its text without the space before it; one that no space precedes has a zero character instead.
    """

    _SAFE_SPACE = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")
    _TAIL = re.compile(r"(\0?)([^\W\d_]+)([!-/:-@\[-`{-~]+)")
    _MARKS = string.punctuation
    _RUN = 100

    def __init__(self, path: str, cap: int = 1_000_000, frugal: bool = False) -> None:
        from tokenizers import Tokenizer

        if frugal:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer, self._cap, self._frugal = Tokenizer.from_file(path), cap, frugal
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocab = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has one character per byte
        for token, i in vocab.items():
            self._bytes[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self._places = _Places()
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0
        self._begin, self._size, self._known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self._again = np.zeros(1 << 14, bool)
        self._put(["\n"], *self._each(["\n"]))

    def _forget(self) -> None:
        """Keep the pieces that a later call met again, or none if these are over half of the cap."""
        kept = {k: p for k, p in self._places.items() if p >= 0 and self._again[p] and k != "\n"}
        if len(kept) > self._cap // 2:
            kept = {}
        flat, sizes = self._gather(np.fromiter(kept.values(), np.int64, len(kept)))
        self._reset()
        self._put(list(kept), flat, sizes)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and their numbers."""
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _in_runs(self, bodies: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each`` for pieces that a space precedes, or lines, joined into runs; their bytes tell the ids apart."""
        if mark == " ":
            runs = [" " + " ".join(bodies[i : i + self._RUN]) for i in range(0, len(bodies), self._RUN)]
        else:
            runs = ["\n".join(bodies[i : i + self._RUN]) + "\n" for i in range(0, len(bodies), self._RUN)]
        ids, _ = self._each(runs)
        ends = np.cumsum(self._bytes[ids])
        raw = np.frombuffer((mark.join(bodies) + mark).encode("utf-8"), np.uint8)  # no body holds its mark
        sizes = np.diff(np.flatnonzero(raw == ord(mark)), prepend=-1)
        cuts = np.searchsorted(ends, np.cumsum(sizes)) + 1
        if len(ids) == 0 or ends[-1] != sizes.sum() or (ends[cuts - 1] != np.cumsum(sizes)).any():
            return self._each([(" " if mark == " " else "") + b for b in bodies])
        counts = np.diff(cuts, prepend=0)
        if mark == " ":
            return ids, counts
        return np.delete(ids, cuts - 1), counts - 1  # without the newlines

    def _put(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._known + len(keys) > len(self._begin):
            self._begin, self._size, self._again = (np.concatenate([a, np.zeros_like(a)]) for a in (self._begin, self._size, self._again))
        to = slice(self._known, self._known + len(keys))
        self._begin[to] = self._used + np.cumsum(sizes) - sizes
        self._size[to] = sizes
        self._flat[self._used : self._used + len(flat)] = flat
        self._places.update(zip(keys, range(self._known, self._known + len(keys))))
        self._used, self._known = self._used + len(flat), self._known + len(keys)

    @staticmethod
    def _edge(c: str) -> bool:
        return c.isspace() or c == "\u180e"

    def _learn(self, missing: list[str]) -> None:
        """Ids of new pieces; a word with punctuation after it is its word's ids and the punctuation's ids."""
        known = self._places
        spaced, lines, odd = [k for k in missing if k.isalnum()], [], []
        joined, words, tails = [], [], []
        for key in missing:
            if key.isalnum():
                continue
            word = key.rstrip(self._MARKS)
            if word.isalpha():  # most others: letters and marks
                joined.append(key)
                words.append(word)
                tails.append("\0" + key[len(word) :])
                continue
            first = key[:1] == "\0"
            body = key[1:] if first else key
            if not body or self._edge(body[0]) or self._edge(body[-1]):
                known[key] = -1
            elif m := self._TAIL.fullmatch(key):
                joined.append(key)
                words.append(m[1] + m[2])
                tails.append("\0" + m[3])
            elif len(body.split()) > 1:
                odd.append(key)
            else:
                (lines if first else spaced).append(key)
        new = [p for p in {*words, *tails} if p not in known]
        lines = list(dict.fromkeys(lines + [p for p in new if p[0] == "\0"]))
        spaced = list(dict.fromkeys(spaced + [p for p in new if p[0] != "\0"]))
        if spaced:
            self._put(spaced, *self._in_runs(spaced, " "))
        if lines:
            self._put(lines, *self._in_runs([k[1:] for k in lines], "\n"))
        if odd:
            self._put(odd, *self._each([k[1:] if k[0] == "\0" else " " + k for k in odd]))
        if joined:
            pairs = np.empty(2 * len(joined), np.int64)
            pairs[::2] = np.fromiter(map(known.__getitem__, words), np.int64, len(joined))
            pairs[1::2] = np.fromiter(map(known.__getitem__, tails), np.int64, len(joined))
            flat, sizes = self._gather(pairs)
            self._put(joined, flat, sizes.reshape(-1, 2).sum(axis=1))

    def _find(self, pieces: list[str]) -> np.ndarray:
        missing = self._places.missing = []
        places = np.fromiter(map(self._places.__getitem__, pieces), np.int64, len(pieces))
        if self._frugal:
            self._again[places[places >= 0]] = True
        if missing:
            self._learn(list(dict.fromkeys(missing)))
            places[places == -2] = np.fromiter(map(self._places.__getitem__, missing), np.int64, len(missing))
        return places

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self._size[places]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.repeat(self._begin[places] - ends + sizes, sizes) + np.arange(total)], sizes

    def _alone(self, text: str) -> np.ndarray:
        """A text with other white space than lone spaces and newlines, cut at safe spaces only."""
        if "\0" in text or any(s in text for s in self._special):
            return self._each([text])[0]
        units = self._SAFE_SPACE.split(text)
        units[0] = "\0" + units[0]
        places = self._find(units)
        if (places >= 0).all():
            return self._gather(places)[0]
        parts, at = [], 0  # only the first and the last unit can begin or end with white space
        for i in np.flatnonzero(places < 0):
            parts += [self._gather(places[at:i])[0], self._each([units[i][1:] if i == 0 else " " + units[i]])[0]]
            at = i + 1
        return np.concatenate([*parts, self._gather(places[at:])[0]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each."""
        if len(self._places) > self._cap:
            self._forget() if self._frugal else self._reset()
        pieces, sizes = [], []
        for text in texts:
            if "\0" in text or any(s in text for s in self._special):
                text = ""
            own = ("\0" + text.replace("\n", " \n \0")).split(" ")
            pieces += own
            sizes.append(len(own))
        places = self._find(pieces)
        starts = np.cumsum(sizes) - sizes
        odd = np.flatnonzero(np.minimum.reduceat(places, starts) < 0) if len(starts) else []
        ids, each = self._gather(np.maximum(places, 0) if len(odd) else places)
        lengths = np.add.reduceat(each, starts) if len(starts) else np.zeros(0, np.int64)
        if not len(odd):
            return ids, lengths
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in odd:
            parts[i] = self._alone(texts[i])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[tuple[str, int | None], PieceEncoder] = {}


def _encoder(path: str, pieces: int | None) -> PieceEncoder:
    """One encoder per Python worker, kept between tasks."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS.clear()  # a worker holds one at a time
        _ENCODERS[path, pieces] = PieceEncoder(path, pieces, frugal=True) if pieces else PieceEncoder(path)
    return _ENCODERS[path, pieces]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 2,
    shard_ids: int = 1 << 16, parts: int | None = None, pieces: int | None = None,
) -> str:
    """Tokenise whole texts and write them as shards in ascending key order; returns ``path``.

    Null and empty texts are one end id. Rows that repeat a key are all written, in order of their text. Null keys
    come first and are stored as the smallest 64-bit integer. A document is never split over shards, so a very long
    one makes a long shard. An empty table writes an empty folder of the same shape. With ``pieces`` a Python
    worker holds a frugal encoder that remembers about so many: less memory, more time, the same ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    shape = "part int, seq int, before long, n_ids long, shard binary"
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])

    def run(batches):
        enc, part, seq, before = _encoder(tokenizer, pieces), TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids, held = [], [], [], 0

        def flush():
            nonlocal seq, before, keys, lengths, ids, held
            data = pack_shard(np.concatenate(keys), np.concatenate(lengths), np.concatenate(ids))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "n_ids": [held], "shard": [data]}, schema)
            seq, before = seq + 1, before + held
            keys, lengths, ids, held = [], [], [], 0
            return row

        for batch in batches:
            own = batch.column("k").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            texts = batch.column("t").to_pylist()
            for lo, hi in spans_by_size([len(t) for t in texts], 1 << 18):
                got, sizes = enc.encode(texts[lo:hi])
                full = np.insert(got, np.cumsum(sizes), end_id)
                keys.append(own[lo:hi])
                lengths.append(sizes + 1)
                ids.append(full)
                held += len(full)
                if held >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = rows.repartitionByRange(parts, "k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(run, shape).write.parquet(path)
    return path


def read_tokens(spark, path: str, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Documents of a token folder: key, start (ids before it), n_tokens, ids_crc32, and the ids if asked for.

    Only one total per part travels to the driver: parts are as many as the writer's tasks.
    """
    small_batches(spark)
    shards = spark.read.schema("part int, seq int, before long, n_ids long, shard binary").parquet(path)
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    order = sorted(totals)
    base = dict(zip(order, accumulate([0] + [totals[p] for p in order[:-1]])))
    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        for batch in batches:
            for part, before, data in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("shard")):
                docs, lengths, ids = decode_shard(data.as_buffer())
                small = ids.astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(small.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                cols = [pa.array(docs, mask=docs == -(1 << 63)), pa.array(cuts[:-1] + base[part] + before), pa.array(lengths), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    shape = f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return shards.select("part", "before", "shard").mapInArrow(run, shape)
