"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are 3- and 4-byte windows of the lower-cased UTF-8 text in which every ASCII non-letter is a space;
a window may begin or end with a space (a word edge) but not hold one inside. Training is plain stochastic
gradient descent in numpy over a bounded sample of labelled rows (``quota`` per language); scoring reads every
whole text. Probabilities are calibrated by one temperature, fitted on sampled rows that training did not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspark.llm.common import quota_sample, small_batches, spans_by_size

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # and signs such as ² and ½
_FOLD = bytes(b if b >= 128 or chr(b).islower() else 32 for b in range(256))
_PIECE = 1 << 20


@dataclass
class LanguageModel:
    """``table`` holds a row per bucket and a zero row at the end: class logits, or embeddings if ``head`` is set."""

    languages: list[str]
    table: np.ndarray
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int


def _normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def _buckets(buf: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window length the bucket and validity of the window at every byte; the last three bytes must be spaces."""
    b = buf.astype(np.uint32)
    four = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16))
    inner1, inner2 = buf[1:-2] != 32, buf[2:-1] != 32
    edge = (buf[:-3] != 32) | inner2
    out = []
    shift = np.uint32(32 - bits)
    ok = inner1 & edge
    out.append(((four * np.uint32(0x9E3779B1)) >> shift, ok))
    four |= b[3:] << np.uint32(24)
    out.append((((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift, inner1 & inner2))
    return out


def _segments(texts: list[bytes]):
    """(rows, buffer, starts): texts joined by spaces up to about 1 MB; longer texts are cut with overlap.

    Sums over windows add up, so a cut text gives the same totals: the three bytes after a cut are repeated.
    """
    for lo, hi in spans_by_size([len(t) for t in texts], _PIECE):
        if hi - lo == 1 and len(texts[lo]) > 2 * _PIECE:
            t = b" " + texts[lo] + b" "
            for at in range(0, len(t), _PIECE):
                part = t[at : at + _PIECE + 3]
                yield [lo], np.frombuffer(part + b" " * (3 if at + _PIECE >= len(t) else 0), np.uint8), np.array([0])
            continue
        joined = b" ".join(texts[lo:hi])
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[lo : hi - 1]])
        yield list(range(lo, hi)), np.frombuffer(b" " + joined + b" " * 4, np.uint8), starts


def _sums(texts: list[bytes], table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of the table rows of its subwords, and their number."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    columns = [np.ascontiguousarray(table[:, c]) for c in range(table.shape[1])]
    zero = np.uint32(1 << bits)
    for rows, buf, starts in _segments(texts):
        if len(buf) < 4:
            continue
        for ids, ok in _buckets(buf, bits):
            ids = np.where(ok, ids, zero)
            np.add.at(count, rows, np.add.reduceat(ok.astype(np.int64), starts))
            for c, column in enumerate(columns):
                total[rows, c] += np.add.reduceat(column[ids], starts, dtype=np.float64)
    return total, count


def _train_features(docs: DataFrame, text: str, label: str, key: str, bits: int) -> pd.DataFrame:
    """Sampled rows as sparse bucket counts (at most 2**bits entries each): texts don't travel to the driver."""

    def counts(batches):
        for pdf in batches:
            ids, weights = [], []
            for t in pdf[text].fillna(""):
                acc = np.zeros(1 << bits, np.float32)
                for _, buf, _ in _segments([_normalise(t)]):
                    if len(buf) >= 4:
                        for i, ok in _buckets(buf, bits):
                            acc += np.bincount(i[ok], minlength=1 << bits)
                found = np.flatnonzero(acc)
                ids.append(found.astype(np.int32))
                weights.append((acc[found] / max(1.0, acc.sum())).astype(np.float32))
            yield pd.DataFrame({"k": pdf[key].astype(str), "y": pdf[label], "i": ids, "w": weights})

    return docs.mapInPandas(counts, "k string, y string, i array<int>, w array<float>").toPandas()


def train_language_model(
    docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", *,
    quota: int = 300, bits: int = 14, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 11,
    max_false_reject: float = 0.002,
) -> LanguageModel:
    """Fit on about ``quota`` labelled rows of each language; every fifth sampled row calibrates instead.

    A prediction is rejected if its calibrated probability is below ``reject_below``: the level under which only
    ``max_false_reject`` of the correct calibration rows fall, 0.4 at most. Rows with a null label or text
    are no training rows; without any labelled row the model knows no language and rejects everything.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label)
    data = _train_features(quota_sample(rows, label, key, quota, seed), text, label, key, bits)
    data = data[data["i"].map(len) > 0].sort_values(["k", "y"], kind="stable").reset_index(drop=True)
    languages = sorted(data["y"].unique())
    rng = np.random.default_rng(seed)
    size, n = 1 << bits, max(1, len(languages))
    emb = rng.uniform(-1 / dim, 1 / dim, (size + 1, dim)).astype(np.float32)
    emb[size] = 0
    head, bias = rng.normal(0, 0.5, (dim, n)).astype(np.float32), np.zeros(n, np.float32)
    if not languages:
        return LanguageModel([], emb, head, bias, 1.0, 1.0, bits)
    y = data["y"].map(languages.index).to_numpy()
    held = np.arange(len(data)) % 5 == 4
    fit = np.flatnonzero(~held)
    for epoch in range(epochs):
        for step, j in enumerate(rng.permutation(fit)):
            i, w = data["i"][j], data["w"][j]
            step_size = rate * (1 - (epoch * len(fit) + step) / (epochs * len(fit)))
            hidden = w @ emb[i]
            z = hidden @ head + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[j]] -= 1
            back = head @ p
            head -= step_size * np.outer(hidden, p)
            bias -= step_size * 0.1 * p
            emb[i] -= (step_size * 20) * np.outer(w, back)
    rest = np.flatnonzero(held) if held.any() else fit
    z = np.stack([data["w"][j] @ emb[data["i"][j]] for j in rest]) @ head + bias

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    right = np.arange(len(rest)), y[rest]
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
    losses = [-np.log(np.maximum(probabilities(t)[right], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = probabilities(temperature)
    correct = p.max(axis=1)[p.argmax(axis=1) == y[rest]]
    reject = min(0.4, float(np.quantile(correct, max_false_reject))) if len(correct) else 0.0
    if n <= dim:
        return LanguageModel(languages, (emb @ head).astype(np.float32), None, bias, temperature, reject, bits)
    return LanguageModel(languages, emb, head, bias, temperature, reject, bits)


def _has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def predict(model: LanguageModel, texts: pd.Series) -> pd.DataFrame:
    """Language, calibrated probability and rejection of each text."""
    known = np.array([isinstance(t, str) and _has_letter(t) for t in texts], dtype=bool)
    out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "rejected": True}, index=range(len(texts)))
    if not model.languages or not known.any():
        return out
    total, count = _sums([_normalise(t) for t in texts[known]], model.table, model.bits)
    mean = total / np.maximum(count, 1)[:, None]
    z = (mean if model.head is None else mean @ model.head) + model.bias
    p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    out.loc[known, "lang_pred"] = np.array(model.languages, dtype=object)[best]
    out.loc[known, "score"] = p.max(axis=1)
    out.loc[known, "rejected"] = p.max(axis=1) < model.reject_below
    return out


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Repeated rows get equal answers;
    an empty table stays empty; other columns pass through untouched.
    """
    small_batches(docs.sparkSession)
    shape = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ])

    @F.pandas_udf(shape)
    def score(texts: pd.Series) -> pd.DataFrame:
        return predict(model, texts.reset_index(drop=True))

    found = docs.withColumn("__lang", score(F.col(text)))
    names = ("lang_pred", "score", "rejected")
    return found.withColumns({c: F.col(f"__lang.{c}") for c in names}).drop("__lang")
