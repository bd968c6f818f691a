"""The registry, and representative queries against their SQL twins on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")
SAMPLE = [
    "a05_describe", "a08_group_summary", "c04_box_stats", "e04_top_risks", "f05_band", "j01_keep_top_levels",
    "l05_standings", "m11_stratified_split", "m26_threshold_sweep", "t08_mann_whitney", "t13_association_scan",
    "t16_fisher_p", "t25_two_way_anova", "w04_running_balance",
]


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return (0, str(v))
    return (1, "nan" if math.isnan(v) else repr(float(v) + 0.0))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(name == name.lower() for name in queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert want and got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 2
