"""Log parsing, replay, audits, showdowns and the stream, against independent arithmetic."""

from collections import Counter
import os

import pytest
from pyspark.sql import functions as F

from statspark.operators import actionlog as L
from statspark.session import scratch_dir
from statspark.sources.logs import read_log_lines, write_log_lines
from statspark.streaming import logs as X

GAME_1 = """Title line of the log - A vs B

Round #1, A (0), B (0)
A posts the blind of 5
B posts the blind of 10
A dealt [Ah Kh 2c]
B dealt [7d 7s 7c]
A raises to 30
B calls
Flop [Qh Jh], A (30), B (30)
Current stacks: 470, 470
B checks
A bets 40
B calls
Turn [Qh Jh Th 3d], A (70), B (70)
Current stacks: 430, 430
B checks
A checks
A shows [Ah Kh 2c]
B shows [7d 7s 7c]
A awarded 70
B awarded -70
Winning counts at the end of the round: , A (70), B (-70)

Round #2, B (-70), A (70)
B posts the blind of 5
A posts the blind of 10
B dealt [2h 3h 4h]
A dealt [9d 9s Tc]
B attempted illegal RaiseAction
B folds
B awarded -5
A awarded 5
Winning counts at the end of the round: , B (-75), A (75)

Final, A (75), B (-75)"""
GAME_2 = """Round #1, A (0), C D (0)
A posts the blind of 5
C D posts the blind of 10
A calls
C D response misformatted: x folds
C D checks
Flop [2h 3h], A (10), C D (10)
C D ran out of time
C D bets 12"""  # cut off


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "g1.txt").write_text(GAME_1)
    (folder / "g2.txt").write_text(GAME_2)
    lines = read_log_lines(spark, str(folder)).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    return L.with_rounds(L.parse_events(lines), chunk=7)


def test_lines_keep_their_order(events):
    rows = [r["line"] for r in events.where("file = 'g1.txt'").orderBy("line_no").collect()]
    assert rows == GAME_1.split("\n")


def test_line_numbers_across_splits(spark):
    path = write_log_lines(spark.range(5000).select("id", F.col("id").cast("string").alias("line")), scratch_dir(spark, "n"), ["id"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        back = read_log_lines(spark, path)
        got = back.withColumn("v", F.col("line").cast("long")).orderBy("file", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append((r["line_no"], r["v"]))
    assert sum(map(len, by_file.values())) == 5000
    for rows in by_file.values():
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        assert [v for _, v in rows] == sorted(v for _, v in rows)


def test_kinds_and_rounds(events):
    kinds = Counter((r["kind"]) for r in events.where("file = 'g1.txt'").collect())
    assert kinds["blind"] == 4 and kinds["awarded"] == 4 and kinds["other"] == 4 and kinds["final"] == 1
    r = events.where("kind = 'misformatted'").first()
    assert r["player"] == "C D" and r["round"] == 1
    assert events.where("kind = 'final'").first()["round"] is None
    assert {r["street"] for r in events.where("kind = 'bet'").collect()} == {2}


def test_results_standings_faults(events):
    res = L.round_results(events)
    got = {(r["round"], r["player"]): (r["delta"], r["ended_by"], r["won"]) for r in res.collect()}
    assert got == {
        (1, "A"): (70, "showdown", True), (1, "B"): (-70, "showdown", False),
        (2, "B"): (-5, "fold", False), (2, "A"): (5, "fold", True),
    }
    last = {r["player"]: r["balance"] for r in L.standings(res).where("round = 2").collect()}
    assert last == {"A": 75, "B": -75} == {r["player"]: r["balance"] for r in L.final_standings(res).collect()}
    faults = {r["player"]: r for r in L.fault_report(events).collect()}
    assert faults["B"]["illegal"] == 1 and faults["C D"]["misformatted"] == 1 and faults["C D"]["timeout"] == 1


def test_street_contributions(events):
    got = {(r["file"], r["round"], r["street"], r["player"]): r["put"] for r in L.street_contributions(events).collect()}
    first = {k[1:]: v for k, v in got.items() if k[0] == "g1.txt"}
    assert first == {(1, 0, "A"): 30, (1, 0, "B"): 30, (1, 2, "A"): 40, (1, 2, "B"): 40}
    assert {k[3]: v for k, v in got.items() if k[0] != "g1.txt"} == {"A": 10, "C D": 10}


def test_packets(spark):
    df = spark.createDataFrame([(1, "T179.500 P1 HAh,Kd,2c "), (2, "T178.000 R30 BQh,Jh D-12 Q")], "packet int, message string")
    rows = {(r["packet"], r["tag"]): r for r in L.explode_packets(df).collect()}
    assert rows[1, "H"]["cards"] == ["Ah", "Kd", "2c"] and rows[2, "D"]["number"] == -12 and (2, "Q") in rows
    clocks = L.explode_packets(df).where("tag = 'T'").select(F.lit("A").alias("player"), "packet", F.col("number").alias("clock"))
    used = {r["packet"]: r["seconds"] for r in L.clock_use(clocks, ["player"], ["packet"]).collect()}
    assert used == {1: None, 2: 1.5}


def test_stream_equals_batch(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"p{i}.txt").write_text("\n".join(GAME_1.split("\n")[i * 7 :]))
    out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
    totals = X.player_totals(X.stream_lines(spark, str(tmp_path), max_files=1))
    X.run_totals(totals, out, state).awaitTermination()
    assert len([f for f in os.listdir(out) if f.startswith("batch=")]) == 5
    got = sorted(map(tuple, X.latest_totals(spark, out).collect()))
    assert got == sorted(map(tuple, X.player_totals(spark.read.text(str(tmp_path)).withColumnRenamed("value", "line")).collect()))


def test_part_files_of_a_folder_are_one_log(spark):
    lines = spark.range(5000, numPartitions=4).select("id", F.concat(F.lit("line "), "id").alias("line"))
    path = write_log_lines(lines, scratch_dir(spark, "log"), ["id"])
    back = read_log_lines(spark, path, one_per_folder=True).toPandas().sort_values("line_no")
    assert back["file"].nunique() == 1
    assert back["line_no"].tolist() == list(range(1, 5001))
    assert back["line"].tolist() == [f"line {i}" for i in range(5000)]
