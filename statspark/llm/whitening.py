"""Whitening of embeddings with a covariance from sums of squares only (polarisation).

Vectors become whole numbers, so every sum is exact. The first pass over the distinct vectors takes their count n and the
sums S; the second one centres them, as n x - S, and adds up the squares of each dimension and of the sum of each pair of
dimensions. Since (a + b)^2 = a^2 + b^2 + 2 a b, a pair's covariance is half of what its sum varies more than its two
members, again in whole numbers; only the quotient is rounded. The matrix is decomposed on the driver (dimensions are few).
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import small_batches, store

_LIMB, _DIGITS = 21, 40


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``rows`` with column ``x``: floor(scale * c) + shift of each entry, as longs.

    Rows whose vector is null, empty, or holds a null or non-finite entry go, as do those whose length is not the table's
    most frequent one (the longer wins a tie). Entries beyond the range of a long are cut off at its ends.
    """
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    fit = rows.where(good & (F.size(v) > 0))
    sizes = fit.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    # the shift goes before the floor's cast only as a whole number, so large entries saturate instead of failing
    limit = float(1 << 62)
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("long") + F.lit(shift))
    return fit.where(F.size(v) == (sizes[0]["d"] if sizes else -1)).withColumn("x", whole)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def exact_squares(t: np.ndarray) -> list[int]:
    """Column sums of squares of a matrix of longs, as Python integers: never rounded, never overflown."""
    most = int(np.abs(t).max(initial=0))
    if most * most * len(t) < 1 << 62:
        return [int(v) for v in (t * t).sum(axis=0)]
    a = np.abs(t).astype(np.uint64)
    limbs = [((a >> np.uint64(_LIMB * k)) & np.uint64((1 << _LIMB) - 1)).astype(np.int64) for k in range(4)]
    out = [0] * t.shape[1]
    for i in range(4):
        for j in range(4):  # a product has 42 bits, so a batch of under 2**20 rows cannot overflow
            if limbs[i].any() and limbs[j].any():
                out = [o + (int(s) << (_LIMB * (i + j))) for o, s in zip(out, (limbs[i] * limbs[j]).sum(axis=0))]
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S as longs; as Python integers where a long could overflow."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    if most < 1 << 61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _narrow(d: np.ndarray) -> np.ndarray:
    """Centred values as longs wherever they fit: a shift common to all entries is gone by now."""
    if d.dtype == object and all(abs(v) < 1 << 61 for v in d.flat):
        return d.astype(np.int64)
    return d


def _sums_of_squares(t: np.ndarray) -> list[int]:
    return [int(v) for v in (t * t).sum(axis=0)] if t.dtype == object else exact_squares(t)


@dataclass
class Whitening:
    """Fitted on n distinct vectors. ``components``: unit eigenvectors in rows, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        d = _narrow(_centred(x, self.n, self.sums)).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (d @ self.components[:k].T) / np.sqrt(self.values[:k])
        return np.where(self.values[:k] > self._floor(), out, np.nan)

    def _floor(self) -> float:
        """Eigenvalues up to this are rounding errors of a matrix without full rank."""
        return float(np.abs(self.values).max(initial=0.0)) * len(self.sums) * np.finfo(float).eps * 8


def fit_whitening(vectors: DataFrame, x: str = "x") -> Whitening | None:
    """Covariance of the distinct vectors by polarisation, and its eigenvectors; None for an empty table.

    The driver gets d (d + 1) / 2 whole numbers a task-independent sum, with d the dimensions; no task holds more than a batch.
    """
    first = vectors.select(F.size(x).alias("d")).limit(1).collect()
    if not first:
        return None
    dims = first[0]["d"]
    limbs = [f"d{k}" for k in range(4)]

    def added(step) -> dict[tuple[int, int], int]:
        """Sums over all tasks of whole numbers that ``step`` finds in a task, sent in digits that a long can add up."""
        parts = vectors.select(x).mapInArrow(step, "i long, j long, d0 long, d1 long, d2 long, d3 long")
        found = parts.groupBy("i", "j").agg(*[F.sum(d).alias(d) for d in limbs]).collect()
        return {(r["i"], r["j"]): sum(r[d] << (_DIGITS * k) for k, d in enumerate(limbs)) for r in found}

    def digits(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
        i, j = zip(*sums)
        low = [[(v >> (_DIGITS * k)) & ((1 << _DIGITS) - 1) for v in sums.values()] for k in range(3)]
        return pa.RecordBatch.from_pydict(dict(zip(["i", "j", *limbs], [i, j, *low, [v >> (_DIGITS * 3) for v in sums.values()]])))

    def totals(batches):
        count, out = 0, [0] * dims
        for batch in batches:
            xs = _matrix(batch.column(0), dims)
            high, low = xs >> 31, xs & ((1 << 31) - 1)
            out = [o + (int(h) << 31) + int(v) for o, h, v in zip(out, high.sum(axis=0), low.sum(axis=0))]
            count += len(xs)
        if count:
            yield digits({(i, 0): v for i, v in enumerate(out)} | {(-1, 0): count})

    total = added(totals)
    n, sums = total[-1, 0], np.array([total[i, 0] for i in range(dims)], dtype=object)

    def squares(batches):
        out = [[0] * (dims - i) for i in range(dims)]
        for batch in batches:
            d = _narrow(_centred(_matrix(batch.column(0), dims), n, sums))
            for i in range(dims):
                pair = d[:, i:] + d[:, i : i + 1]
                pair[:, 0] = d[:, i]  # the dimension itself
                out[i] = [a + b for a, b in zip(out[i], _sums_of_squares(pair))]
        if any(map(any, out)):
            yield digits({(i, i + k): v for i, row in enumerate(out) for k, v in enumerate(row)})

    q = added(squares)
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            twice = 2 * q.get((i, i), 0) if i == j else q.get((i, j), 0) - q.get((i, i), 0) - q.get((j, j), 0)
            cov[i, j] = cov[j, i] = float(Fraction(twice, 2 * n**3))
    values, vectors_ = np.linalg.eigh(cov)
    return Whitening(n, sums, cov, values[::-1], vectors_[:, ::-1].T)


def identity_error(vectors: DataFrame, model: Whitening, k: int, x: str = "x") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all of ``vectors``.

    Components without variance are left out; None if none has any.
    """
    used = np.flatnonzero(model.values[:k] > model._floor())
    dims = len(model.sums)
    if not len(used):
        return None

    def moments(batches):
        count, mean, second = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
        for batch in batches:
            w = model.project(_matrix(batch.column(0), dims), k)[:, used]
            if len(w):
                centre = w.mean(axis=0)
                gap, joint = centre - mean, count + len(w)
                second += (w - centre).T @ (w - centre) + np.outer(gap, gap) * count * len(w) / joint
                mean, count = mean + gap * len(w) / joint, joint
        if count:
            yield pa.RecordBatch.from_pydict({"n": [count], "mean": [mean.tolist()], "second": [second.ravel().tolist()]})

    m = len(used)
    parts = vectors.select(x).mapInArrow(moments, "n long, mean array<double>, second array<double>")
    total = parts.agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(m)],
        *[F.sum(F.col("second")[i * m + j] + F.col("n") * F.col("mean")[i] * F.col("mean")[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)],
    ).first()
    n, worst = total["n"], 0.0
    for i in range(m):
        for j in range(i, m):
            c = total[f"c{i}_{j}"] / n - total[f"m{i}"] / n * total[f"m{j}"] / n
            worst = max(worst, abs(c - (i == j)))
    return worst


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row per vector and component up to ``k``.

    Which rows go is said at ``whole_vectors``. ``n`` counts the distinct vectors that the model is fitted on; ``deviation``
    is the sum over dimensions of (n x - S)^2, exact, null where it exceeds a long. Components without variance have a null
    ``whitened``; ``explained`` is null if nothing varies. Null and repeated keys are rows of their own; a table without a
    usable vector gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    valid = store(whole_vectors(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), "v").select("id", "x"), "vectors")
    distinct = store(valid.select("x").distinct(), "distinct")
    model = fit_whitening(distinct)
    if model is None:
        return spark.createDataFrame([], out)
    k = min(k, len(model.sums))
    error = identity_error(distinct, model, k)
    share = (model.values[:k] / model.trace).tolist() if model.trace > 0 else [None] * k

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = _matrix(batch.column(1), len(model.sums))
            away = _narrow(_centred(xs, model.n, model.sums))
            deviation = [d if d < 1 << 63 else None for d in _sums_of_squares(away.T)]
            rows, w = len(xs), model.project(xs, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(share * rows, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return valid.select("id", "x").mapInArrow(run, out)
