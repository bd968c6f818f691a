"""Global order, checked against pandas for several layouts and with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statspark.operators import ordered as O
from statspark.operators import rank as R


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = np.round(rng.exponential(50, 3000), 1)
    x[:1000] = 12.5  # one value holds a third of the rows
    x[1000:1010] = -0.0
    pdf = pd.DataFrame({"k": range(3000), "x": x, "g": rng.choice(["a", "b"], 3000, p=[0.9, 0.1])})
    pdf.loc[5::97, "x"] = np.nan
    return pdf


@pytest.mark.parametrize("parts,buckets", [(1, 1), (7, 5), (32, 64)])
def test_midranks(spark, data, parts, buckets):
    df = spark.createDataFrame(data).repartition(parts)
    got = R.with_midranks(df, {"x": "r"}, buckets).toPandas().set_index("k")["r"].sort_index()
    want = data.set_index("k")["x"].rank()
    pd.testing.assert_series_equal(got, want, check_names=False)
    assert got.sum() == pytest.approx(got.count() * (got.count() + 1) / 2)


@pytest.mark.parametrize("buckets", [1, 4, 50])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles(spark, data, buckets, by):
    df = spark.createDataFrame(data)
    probs = [0, 0.05, 0.25, 0.5, 0.9, 0.99, 1]
    got = R.exact_quantiles(df, ["x", "k"], probs, by, buckets).toPandas()
    assert len(got) == len(probs) * 2 * (2 if by else 1)
    for _, r in got.iterrows():
        src = data[data.g == r["g"]] if by else data
        assert r["quantile"] == pytest.approx(src[r["feature"]].quantile(r["prob"]), abs=1e-9)


def test_rough_sketches_give_exact_quantiles(spark):
    """Brackets that miss their position are widened until they hold it."""
    df = spark.range(200_000).select((F.xxhash64("id") % 100_000).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    probs = [0.01, 0.5, 0.999]
    for by, options in ((), {"accuracy": 8, "slack": 1e-3}), (("g",), {"accuracy": 8, "slack": 0.01}):
        want = df.groupBy(*by).agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
        want = {(r["g"] if by else 0, p): q for r in want for p, q in zip(probs, r["q"])}
        got = R.exact_quantiles(df, ["x"], probs, by, **options).collect()
        assert len(got) == len(want)
        assert {(r["g"] if by else 0, r["prob"]): r["quantile"] for r in got} == pytest.approx(want, abs=1e-9)


def test_many_groups(spark, monkeypatch):
    """10,001 groups, one of them a third of all rows: brackets are a stored table; fewer of them are broadcast, with equal results."""
    g = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10_001)
    df = spark.range(120_000).select(g.alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("y"))
    pdf = df.toPandas()
    probs = [0, 0.25, 0.9]
    got = R.exact_quantiles(df, ["x", "y"], probs, ["g"]).toPandas()
    want = pd.concat([pdf.groupby("g")[c].quantile(probs).dropna().rename("want").rename_axis(["g", "prob"]).reset_index().assign(feature=c) for c in ("x", "y")])
    both = got.merge(want, on=["g", "feature", "prob"], how="outer")
    assert got.g.nunique() == 10_001 and len(both) == len(got) == len(want)
    assert both["quantile"].to_numpy() == pytest.approx(both["want"].to_numpy(), abs=1e-9)
    small = df.where("g < 80")
    few = sorted(R.exact_quantiles(small, ["x"], [0.5], ["g"]).collect())
    monkeypatch.setattr(R, "FEW_GROUPS", 3)
    assert sorted(R.exact_quantiles(small, ["x"], [0.5], ["g"]).collect()) == few and len(few) == 80


def test_quantiles_of_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    got = {r["feature"]: r["quantile"] for r in R.exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"b": 3.0}


def test_percent_rank(spark, data):
    got = R.with_percent_ranks(spark.createDataFrame(data), "x").toPandas().set_index("k")["pct_rank"].sort_index()
    pd.testing.assert_series_equal(got, data.set_index("k")["x"].rank(pct=True), check_names=False)


def test_tallies(spark, data):
    df = spark.createDataFrame(data)
    got = R.ranked_values(df, ["x"], tallies={"a": F.when(F.col("g") == "a", 1).otherwise(0)}).toPandas()
    ok = data.dropna()
    assert got["a"].sum() == (ok.g == "a").sum() == got["total_a"].max()
    row = got[got.value == 12.5].iloc[0]
    assert row["below_a"] == ((ok.x < 12.5) & (ok.g == "a")).sum()


@pytest.fixture(scope="module")
def moves():
    rng = np.random.default_rng(3)
    n = 2000
    pdf = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "ts": rng.integers(0, 50, n),
            "user": rng.choice(["hot", "u1", "u2"], n, p=[0.6, 0.3, 0.1]),
            "v": rng.integers(-5, 6, n),
            "mark": np.where(rng.random(n) < 0.2, rng.integers(0, 9, n).astype(float), np.nan),
        }
    )
    pdf.loc[:700, "ts"] = 25  # a third of all rows share one time
    pdf.loc[pdf.index % 10 == 0, "user"] = None
    return pdf


@pytest.mark.parametrize("buckets", [1, 6, 40])
def test_ordered_columns(spark, moves, buckets):
    df = spark.createDataFrame(moves).withColumn("mark", F.when(~F.isnan("mark"), F.col("mark")))
    df = df.withColumn("user", F.when(~F.col("user").isin("NaN"), F.col("user")))
    s = O.with_segments(df, ["ts", "id"], buckets)
    assert s.count() == len(moves)
    want = moves.sort_values(["ts", "id"])
    g = want.groupby("user", dropna=False)
    want = want.assign(total=g["v"].cumsum(), last=g["mark"].ffill(), was=g["v"].shift()).set_index("id").sort_index()
    total = O.running_sum(s, ["user"], ["ts", "id"], "v", "total").toPandas().set_index("id").sort_index()
    assert (total["total"] == want["total"]).all()
    last = O.carry_forward(s, ["user"], ["ts", "id"], {"mark": "last"}).toPandas().set_index("id").sort_index()
    np.testing.assert_array_equal(last["last"].to_numpy(float), want["last"].to_numpy(float))
    was = O.previous(s, ["user"], ["ts", "id"], "v", "was").toPandas().set_index("id").sort_index()
    np.testing.assert_array_equal(was["was"].to_numpy(float), want["was"].to_numpy(float))


def test_byte_budget_keeps_last_chunk_whole(spark):
    df = spark.createDataFrame([("f", i, "é" * 2) for i in range(5)], "f string, i long, t string")
    kept = O.byte_budget(df, ["f"], ["i"], "t", 10)
    assert sorted(r["i"] for r in kept.collect()) == [0, 1, 2]


def test_rows_of_hot_values_stay_where_they_are(spark):
    n = 40_000
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 10 < 9, 1.0).otherwise(F.col("id").cast("double")).alias("x"),
        F.when(F.col("id") % 10 < 9, 2.0).otherwise((F.col("id") % 7).cast("double")).alias("y"),
    )
    out = R.with_midranks(df, {"x": "rx", "y": "ry"})
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) < n / 4
    got, pdf = out.toPandas(), df.toPandas()
    for c in "xy":
        want = dict(zip(pdf[c], pdf[c].rank()))
        assert (got[c].map(want) == got[f"r{c}"]).all()


def test_several_lookups_with_missing_keys(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 5.0), (2.0, 5.0), (None, None), (None, 6.0)], "x double, y double")
    got = R.with_midranks(df, {"x": "rx", "y": "ry"}, 2).toPandas()
    pdf = df.toPandas()
    want = pdf.assign(rx=pdf.x.rank(), ry=pdf.y.rank())
    order = ["x", "y"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_wide_brackets_are_cut_into_pieces(spark):
    df = spark.range(50_000).select((F.xxhash64("id") % 20_000).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    probs = [0, 0.25, 0.5, 0.75, 1]
    got = R.exact_quantiles(df, ["x"], probs, ["g"], accuracy=20).collect()
    pdf = df.toPandas()
    assert len(got) == 15
    for r in got:
        assert r["quantile"] == pdf[pdf.g == r["g"]]["x"].quantile(r["prob"])
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    assert [r["quantile"] for r in R.exact_quantiles(ends, ["x"], [0, 0.5, 1]).orderBy("prob").collect()] == [float("-inf"), 1.5, float("inf")]


def test_few_groups_are_not_shuffled(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(i)) for i in range(40) for g in ("a", "b")], "g string, x double")
    means = df.groupBy("g").agg(F.avg("x").alias("m"))
    few = R.join_groups(df, means, ["g"])
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "FEW_GROUPS", 1)
    assert sorted(few.collect()) == sorted(R.join_groups(df, means, ["g"]).collect())


@pytest.mark.parametrize("buckets", [1, 6, 40])
@pytest.mark.parametrize("kind", ["bigint", "decimal(25,3)"])
def test_order_keys_beyond_doubles(spark, buckets, kind):
    """Keys that are one double are still in order, and a hot key among them is divided by the second one."""
    key = f"CAST(9007199254740992000 + CASE WHEN id % 3 = 0 THEN 7 ELSE (id * 37) % 900 END AS {kind}) AS k"
    df = spark.range(3000).selectExpr(key, "(id * 7) % 3000 AS j", "id % 11 AS v").repartition(5)
    want = sorted((r["k"], r["j"], r["v"]) for r in df.collect())
    sums = np.cumsum([v for _, _, v in want])
    got = O.running_sum(O.with_segments(df, ["k", "j"], buckets), [], ["k", "j"], "v", "t").collect()
    assert {(r["k"], r["j"]): r["t"] for r in got} == {(k, j): t for (k, j, _), t in zip(want, sums)}
    ranks = pd.Series([int(k) for k, _, _ in want]).rank()
    got = R.with_midranks(df, {"k": "r"}, buckets).collect()
    assert {int(r["k"]): r["r"] for r in got} == {int(k): x for (k, _, _), x in zip(want, ranks)}


@pytest.mark.parametrize("buckets", [1, 6, 40])
def test_text_order_keys(spark, buckets):
    """Text keys with a common beginning, empty, short, long and non-ASCII ends, and a hot key."""
    ends = ["", "a", "ab", "é", "zebra", "zebra crossing 1", "zebra crossing 2", "日本", "a\u0000"]
    rows = [("item/" + ("hot" if i % 3 == 0 else ends[i % len(ends)] + str(i % 5) * (i % 2)), (i * 7) % 1000, i % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, j long, v long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    sums = np.cumsum([v for _, _, v in want])
    got = O.running_sum(O.with_segments(df, ["k", "j"], buckets), [], ["k", "j"], "v", "t").collect()
    assert {(r["k"], r["j"]): r["t"] for r in got} == {(k, j): t for (k, j, _), t in zip(want, sums)}
    segments = O.with_segments(df, ["k", "j"], buckets).select(O.SEGMENT).distinct().count()
    assert segments > buckets / 2
    late = O.running_sum(df, [], ["j", "k"], "v", "t").collect()  # as the second key
    assert max(r["t"] for r in late) == sum(v for _, _, v in rows)
