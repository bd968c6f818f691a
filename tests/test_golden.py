"""Published figures, reproduced from contingency tables and formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.operators import association as A
from statspark.operators import features as X
from statspark.operators import findings as E
from statspark.operators import hypothesis as H
from statspark.operators import profile as P

# Fixed values: (positive, negative) counts per factor level.
TABLE = {
    "risk_class": {"High": (22339, 9564), "Medium": (10921, 61479), "Low": (16235, 92153)},
    "family_history": {"Yes": (20657, 43168), "No": (28838, 120028)},
    "radiation": {"Yes": (10270, 21590), "No": (39225, 141606)},
    "iodine": {"Yes": (16188, 36830), "No": (33307, 126366)},
    "smoking": {"Yes": (9905, 32526), "No": (39590, 130670)},
    "obesity": {"Yes": (14816, 49070), "No": (34679, 114126)},
    "diabetes": {"Yes": (9796, 32797), "No": (39699, 130399)},
}
# Chi-square, p, Cramér's V and label.
ASSOCIATIONS = {
    "family_history": (4223.059165917239, 0.0, 0.14090909526273998, "Moderate"),
    "radiation": (1685.7536394973827, 0.0, 0.08902715527909867, "Weak"),
    "iodine": (2085.3999378189264, 0.0, 0.09901936149435525, "Weak"),
    "smoking": (0.15284493753999137, 0.6958313253476616, 0.0008477171567252019, "Weak"),
    "obesity": (0.31720037478454166, 0.5732949946709196, 0.0012212154478802612, "Weak"),
    "diabetes": (2.1839324772175854, 0.13945772780815632, 0.0032043876317614842, "Weak"),
    "risk_class": (45942.931977139415, 0.0, 0.4647664788564607, "Strong"),
}
# Exposed, risks, risk ratio, odds ratio, CI, p.
RISKS = {
    ("risk_class", "High"): (31903, 0.7002162806005705, 0.15020908467376154, 4.661610728281629, 13.214174724421667, 12.859529381629278, 13.578600621029969, 0.0),
    ("risk_class", "Low"): (108388, 0.14978595416466767, 0.31887865162075874, 0.4697271310053317, 0.3763066235001128, 0.3684263880233894, 0.3843554085519678, 0.0),
    ("iodine", "Yes"): (53018, 0.3053302651929533, 0.20859506616647774, 1.4637463426353148, 1.6675781589421432, 1.6311677890657645, 1.7048012686503289, 0.0),
    ("smoking", "Yes"): (42431, 0.23343781669062713, 0.23252672383413603, 1.0039182285866677, 1.005111429538243, 0.980150747811344, 1.0307077641314617, 0.6958313253476616),
    ("diabetes", "No"): (170098, 0.2333889875248386, 0.22999084356584415, 1.01477512715858, 1.0192733040853088, 0.993899066167027, 1.0452953461638426, 0.13945772780815632),
}


@pytest.fixture(scope="module")
def tables(spark):
    out = {}
    for factor, levels in TABLE.items():
        rows = [(lv, y, n) for lv, (p, q) in levels.items() for y, n in (("pos", p), ("neg", q))]
        out[factor] = spark.createDataFrame(rows, f"{factor} string, outcome string, n long")
    return out


@pytest.mark.parametrize("factor", list(ASSOCIATIONS))
def test_association(tables, factor):
    row = A.association_scan(tables[factor], [factor], "outcome", "n").first()
    chi2, p, v, label = ASSOCIATIONS[factor]
    assert row["chi2"] == pytest.approx(chi2, rel=1e-9)
    assert row["p_value"] == pytest.approx(p, rel=1e-9, abs=1e-300)
    assert row["cramers_v"] == pytest.approx(v, rel=1e-9)
    assert row["strength"] == label and row["n"] == 212691


@pytest.mark.parametrize("factor", sorted({f for f, _ in RISKS}))
def test_risk_rows(tables, factor):
    rows = {r["level"]: r for r in A.sorted_risk_table(tables[factor], [factor], "outcome", "pos", "n").collect()}
    for (f, level), want in RISKS.items():
        if f == factor:
            r = rows[level]
            got = [r[c] for c in ("exposed_count", "risk_exposed", "risk_unexposed", "risk_ratio", "odds_ratio", "ci_lower", "ci_upper", "p_value")]
            assert got == pytest.approx(list(want), rel=1e-9, abs=1e-300)
            assert r["test"] == "Chi-square test"


def test_findings_order(tables):
    assoc = [A.association_scan(t, [f], "outcome", "n") for f, t in tables.items()]
    top = [r["factor"] for r in E.top_associations(P.stack_rows(assoc)).collect()]
    assert top[:3] == ["risk_class", "family_history", "iodine"]
    risks = P.stack_rows([A.risk_table(t, [f], "outcome", "pos", "n") for f, t in tables.items()])
    found = [(r["factor"], r["level"]) for r in E.top_risks(risks).collect()]
    assert found == [("risk_class", "High"), ("family_history", "Yes"), ("radiation", "Yes"), ("iodine", "Yes"), ("iodine", "No")]
    text = E.key_findings(risks=risks).first()["text"]
    assert "13.21" in text and "12.86-13.58" in text


def test_frequency_codes(spark):
    # Level counts and the published shares
    rows = spark.range(212691).select(
        F.when(F.col("id") < 108388, "Low").when(F.col("id") < 180788, "Medium").otherwise("High").alias("level")
    )
    got = {r["level"]: r["code"] for r in X.frequency_codes(rows, "level").collect()}
    assert got == pytest.approx({"Low": 0.50960313, "Medium": 0.34039992, "High": 0.14999694}, abs=1e-8)


def test_sequence_profile(spark):
    r = P.numeric_profile(spark.range(1, 212692), ["id"]).first()
    assert (r["mean"], r["median"], r["iqr"]) == (106346.0, 106346.0, 106345.0)
    assert r["std"] == pytest.approx(61398.74738950299, rel=1e-12)
    assert r["skewness"] == pytest.approx(0, abs=1e-9) and r["kurtosis"] == pytest.approx(-1.2, rel=1e-9)


# Skewness, kurtosis and K2 of samples of 5000.
K2 = [
    (0.007176431906022683, -1.205628355850292, 4483.845641976507),
    (-0.011401530600757093, -1.181051900879099, 3618.3074796151336),
    (-0.014487906307070033, -1.1922917324082223, 3979.0160666398087),
    (0.02013025671850406, -1.214318586620983, 4869.491347996485),
    (0.024389448905946118, -1.1981806741261951, 4190.810109436901),
]


def test_k2(spark):
    n = 5000
    rows = [
        (n, s * (n - 2) / math.sqrt(n * (n - 1)), (k * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1), want)
        for s, k, want in K2
    ]
    df = spark.createDataFrame(rows, "n long, g1 double, g2 double, want double")
    for r in df.select(H.k2_statistic(F.col("n"), F.col("g1"), F.col("g2")).alias("k2"), "want").collect():
        assert r["k2"] == pytest.approx(r["want"], rel=1e-10)


def test_point_biserial_p(spark):
    # R and p at n = 212691
    pairs = [
        (-0.002669820619754085, 0.21822024145464702),
        (-0.0026575586974202426, 0.22034192334918107),
        (0.0012155208759016187, 0.5750865561056754),
        (0.00011521356381000486, 0.9576248389726297),
    ]
    df = spark.createDataFrame([(r, 212691, p) for r, p in pairs], "r double, n long, want double")
    for r in A.with_correlation_test(df).collect():
        assert r["p_value"] == pytest.approx(r["want"], rel=1e-7)


def test_ks_law():
    # Distance and exact p at n = 5000
    for d, p in ((0.06787936906603143, 1.7828299902013093e-20), (0.0590142033385328, 1.405401673626126e-15)):
        assert dist.ks_two_sided(d, 5000) == pytest.approx(p, rel=1e-9)


def test_mann_whitney_normal_tail():
    # U and p of nearly untied columns, groups of 163196 and 49495
    n1, n2 = 163196.0, 49495.0
    sd = math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    for u, p in ((4038060852.5, 0.9578612884682219), (4053417432.5, 0.21847123707579397)):
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
        assert float(dist.norm_two_sided(np.array(z))) == pytest.approx(p, abs=1e-4)


def test_shapiro_known_sample():
    # Royston's published example
    w, p = dist.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)
