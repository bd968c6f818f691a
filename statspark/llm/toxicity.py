"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities: words of a lexicon (a fixed list, and word stems learned from labelled rows),
lexicon words near a second-person word, capitals, punctuation, and obfuscated words (letters mixed with digits or
symbols, and those that read as lexicon words once mended). Labelled rows are split by fold: stems are learned on some,
trees on others and the calibration on the rest. Each part takes about ``quota`` rows of each label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.llm.common import fold, quota_sample, small_batches, store

#: Fixed list of plain insults to start from; stems come from the labels.
LEXICON = frozenset(
    "awful brainless clown crap creep cretin damn disgusting dumb dumbass filth fool freak garbage hate hell idiot idiotic imbecile jerk kill "
    "liar loser lunatic maggot moron moronic pathetic pig psycho rat ridiculous scum shit shut sick stupid sucker trash ugly vermin vile "
    "worthless wretch".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur ya tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros".split())
#: Fixed readings of characters that stand in for letters.
MENDED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "*": None, ".": None, "-": None, "_": None})
FEATURES = [
    "log_words", "lexicon", "stems", "any_hits", "log_hits", "near_you", "second_person", "capitals", "capital_words", "exclaim", "question",
    "symbols", "punctuation", "mixed", "obfuscated", "densest",
]
_HIT, _STEM, _YOU, _MIXED, _HIDDEN, _CAPS = 1, 2, 4, 8, 16, 32
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_REACH, _DENSE = 5, 25


@dataclass
class ToxicityModel:
    stems: dict[int, frozenset] = field(default_factory=dict)
    trees: object = None
    calibration: object = None


def stems_of(word: str) -> list[str]:
    """The word itself (marked) and its first 4, 5 and 6 letters."""
    return ["=" + word] + [word[:k] for k in (4, 5, 6) if len(word) >= k]


class _Codes(dict):
    """What is known of each different word, kept up to a bound."""

    def __init__(self, stems: dict[int, frozenset]) -> None:
        super().__init__()
        self.stems = stems

    def __missing__(self, token: str) -> int:
        core = _EDGE.sub("", token)
        low = core.lower()
        code = 0
        if low in LEXICON:
            code |= _HIT
        if any(low[:k] in s if k else low in s for k, s in self.stems.items()):
            code |= _STEM
        if low in SECOND_PERSON:
            code |= _YOU
        if not low.isalpha() and any(c.isalpha() for c in low):
            mended = low.translate(MENDED)
            if any(not c.isalpha() for c in low[1:-1]) and "'" not in low and "-" not in low:
                code |= _MIXED
            if mended != low and mended in LEXICON:
                code |= _HIDDEN | _HIT
        if len(core) > 1 and core.isupper():
            code |= _CAPS
        self[token] = code
        return code


def features_of(text: str | None, codes: _Codes) -> list[float]:
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    if len(codes) > 400_000:
        codes.clear()
    c = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
    hit = (c & (_HIT | _STEM)) > 0
    you = np.flatnonzero(c & _YOU)
    hits = np.flatnonzero(hit)
    near = 0
    if len(you) and len(hits):
        right = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - hits), np.abs(you[np.maximum(right - 1, 0)] - hits))
        near = int((gap <= _REACH).sum())
    densest = 0
    if len(hits):
        densest = int((np.searchsorted(hits, hits + _DENSE) - np.arange(len(hits))).max())
    per_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(per_byte.sum()))
    letters = max(1, int(per_byte[65:91].sum() + per_byte[97:123].sum()))
    of = lambda chars: float(sum(int(per_byte[ord(x)]) for x in chars)) / size
    share = lambda bit: float(((c & bit) > 0).sum()) / n
    return [
        math.log1p(n), share(_HIT), share(_STEM), float(len(hits)) / n, math.log1p(len(hits)), near / n, len(you) / n,
        float(per_byte[65:91].sum()) / letters, share(_CAPS), of("!"), of("?"), of("#*$%&|<>"), of(".,;:'\"()"), share(_MIXED), share(_HIDDEN), densest / _DENSE,
    ]


def add_features(docs: DataFrame, stems: dict[int, frozenset], text: str, name: str) -> DataFrame:
    """``docs`` with the feature values as an array column."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def values(texts: pd.Series) -> pd.Series:
        codes = _cached(stems)
        return pd.Series([features_of(t, codes) for t in texts])

    return docs.withColumn(name, values(F.col(text)))


_CODES: dict[int, _Codes] = {}


def _cached(stems: dict[int, frozenset]) -> _Codes:
    """One memory of words per Python worker and lexicon."""
    mark = hash(tuple(sorted((k, tuple(sorted(s))) for k, s in stems.items())))
    if mark not in _CODES:
        _CODES.clear()
        _CODES[mark] = _Codes(stems)
    return _CODES[mark]


def learn_stems(rows: DataFrame, text: str, label: str, top: int, min_rows: int, min_log_odds: float) -> dict[int, frozenset]:
    """Word stems that many more toxic than clean rows have; the ``top`` by toxic rows times log odds."""
    small_batches(rows.sparkSession)

    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for pdf in batches:
            for t, y in zip(pdf[text].fillna(""), pdf[label]):
                words = {w for x in set(t.split()) if (w := _EDGE.sub("", x).lower()).isalpha()}
                (toxic if y else clean).update({s for w in words for s in stems_of(w)})
                n[int(y)] += 1
        keys = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({"stem": keys + [""], "t": [toxic[k] for k in keys] + [n[1]], "c": [clean[k] for k in keys] + [n[0]]})

    counts = rows.select(text, F.col(label).cast("int").alias(label)).mapInPandas(count, "stem string, t long, c long")
    counts = counts.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = counts.where("stem = ''").first()
    if not total or not total["t"] or not total["c"]:
        return {}
    odds = F.log((F.col("t") + 0.5) / (total["t"] + 1)) - F.log((F.col("c") + 0.5) / (total["c"] + 1))
    best = (
        counts.where((F.col("stem") != "") & (F.col("t") >= min_rows)).withColumn("o", odds).where(F.col("o") >= min_log_odds)
        .orderBy((F.col("t") * F.col("o")).desc(), "stem").limit(top).collect()
    )
    out: dict[int, set] = {}
    for r in best:
        whole = r["stem"][0] == "="
        out.setdefault(0 if whole else len(r["stem"]), set()).add(r["stem"][whole:])
    return {k: frozenset(v) for k, v in out.items()}


def train_toxicity_model(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", *, quota: int = 2000, trees: int = 20, depth: int = 3,
    top_stems: int = 400, min_rows: int = 3, min_log_odds: float = 2.5, seed: int = 5,
) -> ToxicityModel:
    """Fit on the texts of ``docs`` that ``labels`` (key, 0/1 label) marks; rows with a null label are left out, and of
    several labels of one key the largest counts.

    Folds 1 and 2 of the key's CRC-32 give stems, 3 the trees, 4 the calibration; fold 0 is never read here.
    ``quota`` bounds the rows taken of each label in each part, so about 6 × ``quota`` labels travel to the texts, and
    the texts themselves are read once and not shuffled. Without rows of both labels every score is 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label"))
    known = known.groupBy("__key").agg(F.max("__label").alias("__label"))
    known = known.withColumn("__fold", fold("__key")).where("__fold > 0")
    parts = [quota_sample(known.where(rule), "__label", "__key", quota, seed) for rule in ("__fold in (1, 2)", "__fold = 3", "__fold = 4")]
    taken = store(parts[0].unionByName(parts[1]).unionByName(parts[2]), "labels")
    found = docs.select(key, F.coalesce(text, F.lit("")).alias("__text")).join(F.broadcast(taken), F.col(key) == F.col("__key"))
    rows = store(found.select("__key", "__text", "__label", "__fold"), "labelled")
    stems = learn_stems(rows.where("__fold in (1, 2)"), "__text", "__label", top_stems, min_rows, min_log_odds)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="__x")
    dense = add_features(rows.where("__fold in (3, 4)"), stems, "__text", "__f")
    dense = store(dense.select("__key", "__fold", "__label", *[F.col("__f")[i].alias(c) for i, c in enumerate(FEATURES)]), "features")
    own, rest = (vector.transform(dense.where(F.col("__fold") == k)) for k in (3, 4))
    own = own.repartition(4, "__key").persist()
    try:
        if {r[0] for r in own.select("__label").distinct().collect()} != {0.0, 1.0}:
            return ToxicityModel(stems)
        boosted = GBTClassifier(
            labelCol="__label", featuresCol="__x", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=3, checkpointInterval=-1
        ).fit(own)
        boosted = boosted.setPredictionCol("__tree").setRawPredictionCol("__raw").setProbabilityCol("__p")
        if {r[0] for r in rest.select("__label").distinct().collect()} != {0.0, 1.0}:
            rest = own
        # the sample has its own share of each label: rows weigh as many as they stand for, so scores are true rates
        all_ = {r[0]: r[1] for r in known.where("__fold = 4").groupBy("__label").count().collect()}
        got = {r[0]: r[1] for r in rest.groupBy("__label").count().collect()}
        weight = F.when(F.col("__label") == 1.0, F.lit(all_.get(1.0, 1) / got[1.0])).otherwise(F.lit(all_.get(0.0, 1) / got[0.0]))
        raw = boosted.transform(rest).select(F.col("__label").alias("y"), vector_to_array("__p")[1].alias("__rate"), weight.alias("w"))
        # equal rates meet in a sum before the regression deals rows by rate
        raw = raw.groupBy("__rate").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))
        calibration = IsotonicRegression(labelCol="y", featuresCol="__rate", weightCol="w", predictionCol="__score").fit(raw)
        return ToxicityModel(stems, boosted, calibration)
    finally:
        own.unpersist()


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score reaches the threshold); names are replaced.

    Null and empty texts have zero features and are scored from these. Repeated rows get equal scores.
    """
    if model.trees is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    found = add_features(docs, model.stems, text, "__f").withColumns({f"__{c}": F.col("__f")[i] for i, c in enumerate(FEATURES)})
    found = VectorAssembler(inputCols=[f"__{c}" for c in FEATURES], outputCol="__x").transform(found)
    found = model.trees.transform(found)
    found = model.calibration.transform(found.withColumn("__rate", vector_to_array("__p")[1]))
    score = F.least(F.greatest(F.coalesce("__score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    keep = [F.col(c) for c in docs.columns if c not in ("score", "predicted")]
    return found.select(*keep, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
