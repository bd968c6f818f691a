"""Action-log queries, on logs that Spark derives from the events and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.operators import actionlog as L
from statspark.operators.ordered import previous, running_sum
from statspark.plans.registry import Registry, report, table
from statspark.session import scratch_dir
from statspark.sources.logs import read_log_lines, write_log_lines

REG = Registry()


# --- a log of rounds of ten actions per user --------------------------------


def event_log(spark, d) -> DataFrame:
    """Log lines: each user is a file and a player; rounds of ten actions, with boards and awards."""
    ev = table(spark, d, "events").withColumn("_one", F.lit(1).cast("long"))
    ev = running_sum(ev, ["user_id"], ["ts", "event_id"], "_one", "rn")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    seat = (F.col("rn") - 1) % 10 + 1
    rnd = F.floor((F.col("rn") - 1) / 10) + 1
    cents = F.floor(F.col("value")).cast("int").cast("string")
    t = F.col("event_type")
    action = (
        F.when(t == "view", F.concat(name, F.lit(" checks")))
        .when(t == "click", F.concat(name, F.lit(" calls")))
        .when(t == "signup", F.concat(name, F.lit(" raises to "), cents))
        .when(t == "purchase", F.concat(name, F.lit(" folds")))
        .otherwise(F.concat(name, F.lit(" attempted illegal RaiseAction")))
    )
    head = F.when(seat == 1, F.concat(F.lit("Round #"), rnd.cast("string"), F.lit(", "), name, F.lit(" (0)")))
    whole = F.abs(F.floor(F.col("value"))).cast("int")

    def seats(cards: str, own: int, other: int):
        """A board line: what the player and the opponent have put in so far."""
        return F.concat(F.lit(cards + ", "), name, F.lit(" ("), (whole % 40 + own).cast("string"), F.lit("), B ("), (whole % 15 + other).cast("string"), F.lit(")"))

    board = F.when(seat == 5, seats("Flop [Ah 7d]", 10, 10)).when(seat == 8, seats("Turn [Ah 7d 2c Ts]", 60, 30))
    award = F.when(seat == 10, F.concat(name, F.lit(" awarded "), (F.floor(F.col("value")).cast("int") - 50).cast("string")))
    lines = F.array(*[F.struct(F.lit(i).alias("sub"), x.alias("line")) for i, x in enumerate((head, board, action, award))])
    return (
        ev.select(name.alias("file"), "rn", F.inline(lines))
        .where(F.col("line").isNotNull())
        .select("file", (F.col("rn") * 4 + F.col("sub")).alias("line_no"), "line")
    )


def events_of(spark, d) -> DataFrame:
    return L.with_rounds(L.parse_events(event_log(spark, d)))


RN = (
    "e AS (SELECT *, 'u' || user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "x AS (SELECT *, (rn - 1) % 10 + 1 AS seat, (rn - 1) // 10 + 1 AS round, floor(value)::INT AS cents FROM e)"
)


@REG.query(
    "l01_parse_events",
    f"WITH {RN}, k AS (SELECT CASE event_type WHEN 'view' THEN 'check' WHEN 'click' THEN 'call' WHEN 'signup' THEN 'raise' "
    "WHEN 'purchase' THEN 'fold' ELSE 'illegal' END AS kind, CASE WHEN event_type = 'signup' THEN cents END AS amount FROM x "
    "UNION ALL SELECT 'round', NULL FROM x WHERE seat = 1 UNION ALL SELECT 'board', NULL FROM x WHERE seat IN (5, 8) "
    "UNION ALL SELECT 'awarded', cents - 50 FROM x WHERE seat = 10) SELECT kind, count(*) AS n, sum(amount)::BIGINT AS amount FROM k GROUP BY 1",
)
def _(spark, d):
    ev = L.parse_events(event_log(spark, d))
    return ev.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@REG.query(
    "l02_carry_round",
    f"WITH {RN} SELECT file, rn * 4 + 2 AS line_no, round, CASE WHEN seat < 5 THEN 0 WHEN seat < 8 THEN 2 ELSE 4 END AS street FROM x",
)
def _(spark, d):
    ev = events_of(spark, d)
    acts = ev.where(F.col("code").isNotNull() | (F.col("kind") == "illegal"))
    return report(acts.select("file", "line_no", "round", "street"))


@REG.query(
    "l03_packet_clauses",
    "SELECT event_id, p AS pos, CASE p WHEN 0 THEN 'T' WHEN 1 THEN 'P' ELSE 'R' END AS tag, "
    "CASE p WHEN 0 THEN round(value, 3) WHEN 1 THEN (user_id % 2)::DOUBLE ELSE floor(value)::DOUBLE END AS number "
    "FROM events, (VALUES (0), (1), (2)) t(p)",
)
def _(spark, d):
    message = F.format_string(
        "T%.3f P%d R%d", F.col("value"), F.col("user_id") % 2, F.floor("value").cast("long")
    )
    packets = table(spark, d, "events").select("event_id", message.alias("message"))
    return report(L.explode_packets(packets).select("event_id", "pos", "tag", "number"))


RESULTS = (
    "a AS (SELECT file, round, file AS player, cents - 50 AS delta FROM x WHERE seat = 10), "
    "f AS (SELECT file, round, bool_or(event_type = 'purchase') AS folded FROM x GROUP BY ALL)"
)


@REG.query(
    "l04_round_results",
    f"WITH {RN}, {RESULTS} SELECT file, round, player, delta::BIGINT AS delta, CASE WHEN folded THEN 'fold' ELSE 'showdown' END AS ended_by, "
    "delta > 0 AS won FROM a JOIN f USING (file, round)",
)
def _(spark, d):
    return report(L.round_results(events_of(spark, d)))


@REG.query(
    "l05_standings",
    f"WITH {RN}, {RESULTS} SELECT file, round, player, sum(delta) OVER (PARTITION BY file ORDER BY round)::BIGINT AS balance FROM a",
)
def _(spark, d):
    out = L.standings(L.round_results(events_of(spark, d)))
    return report(out.select("file", "round", "player", "balance"))


@REG.query(
    "l05_final_standings",
    f"WITH {RN}, {RESULTS} SELECT file, player, sum(delta)::BIGINT AS balance, count(*) AS rounds FROM a GROUP BY ALL",
)
def _(spark, d):
    return report(L.final_standings(L.round_results(events_of(spark, d))))


@REG.query(
    "l07_action_mix",
    f"WITH {RN} SELECT file AS player, CASE WHEN seat < 5 THEN 0 WHEN seat < 8 THEN 2 ELSE 4 END AS street, "
    "count(*) FILTER (event_type = 'purchase') AS \"F\", count(*) FILTER (event_type = 'click') AS \"C\", "
    "count(*) FILTER (event_type = 'view') AS \"K\", count(*) FILTER (event_type = 'signup') AS \"R\" FROM x "
    "WHERE event_type <> 'error' GROUP BY ALL",
)
def _(spark, d):
    return report(L.action_mix(events_of(spark, d)))


@REG.query(
    "l12_clock_use",
    "SELECT event_id, round(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 6) AS seconds FROM events",
)
def _(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("value", "clock")
    return report(L.clock_use(ev, ["user_id"], ["ts", "event_id"]).select("event_id", "seconds"))


@REG.query(
    "l13_fault_report",
    "SELECT 'u' || user_id AS player, count(*) AS illegal, 0::BIGINT AS misformatted, 0::BIGINT AS timeout, 0::BIGINT AS disconnect "
    "FROM events WHERE event_type = 'error' GROUP BY 1",
)
def _(spark, d):
    return L.fault_report(L.parse_events(event_log(spark, d)))


@REG.query(
    "s05_text_log",
    "SELECT count(*) AS n, count(*) AS last_line, sum(event_id)::BIGINT AS total, 0::BIGINT AS out_of_order FROM events",
)
def _(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("line"))
    path = write_log_lines(ev, scratch_dir(spark, "log"), ["event_id"])
    back = read_log_lines(spark, path, one_per_folder=True).withColumn("id", F.col("line").cast("long"))
    checked = previous(L.chunked(back, "line_no"), ["file"], ["line_no"], "id", "was")
    return checked.agg(
        F.count("*").alias("n"), F.max("line_no").alias("last_line"), F.sum("id").alias("total"),
        F.count_if(F.col("was") >= F.col("id")).alias("out_of_order"),
    )


@REG.query(
    "l06_street_contributions",
    f"WITH {RN}, p AS (SELECT file, round, 0 AS street, file AS player, 10 + abs(cents) % 40 AS total FROM x WHERE seat = 5 "
    "UNION ALL SELECT file, round, 0, 'B', 10 + abs(cents) % 15 FROM x WHERE seat = 5 "
    "UNION ALL SELECT file, round, 2, file, 60 + abs(cents) % 40 FROM x WHERE seat = 8 "
    "UNION ALL SELECT file, round, 2, 'B', 30 + abs(cents) % 15 FROM x WHERE seat = 8) "
    "SELECT file, round, street::BIGINT AS street, player, "
    "(total - coalesce(lag(total) OVER (PARTITION BY file, round, player ORDER BY street), 0))::BIGINT AS put FROM p",
)
def _(spark, d):
    return report(L.street_contributions(events_of(spark, d)))
