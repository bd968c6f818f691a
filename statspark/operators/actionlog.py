"""Analytics over ordered action logs of two-player betting rounds.

Lines carry ``file, line_no, line``; all order-dependent steps work on bounded
chunks of a file, so that one very long file is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statspark.operators.ordered import carry_forward, chunked, previous, running_sum

# Line formats of the log, first match wins.
LINE_FORMATS = (
    ("round", r"^Round #\d+, "),
    ("final", r"^Final, "),
    ("standing", r"^Winning counts at the end of the round: "),
    ("stacks", r"^Current stacks: \d+, \d+$"),
    ("board", r"^(Flop|Turn) \[.*\]"),
    ("misformatted", r"^.+ response misformatted: "),
    ("blind", r"^.+ posts the blind of \d+$"),
    ("deal", r"^.+ dealt \[.*\]$"),
    ("shows", r"^.+ shows \[.*\]$"),
    ("fold", r"^.+ folds$"),
    ("call", r"^.+ calls$"),
    ("check", r"^.+ checks$"),
    ("bet", r"^.+ bets \d+$"),
    ("raise", r"^.+ raises to \d+$"),
    ("awarded", r"^.+ awarded -?\d+$"),
    ("illegal", r"^.+ attempted illegal \w+$"),
    ("timeout", r"^.+ ran out of time$"),
    ("disconnect", r"^.+ disconnected$"),
)
VERBS = (
    "posts the blind of|dealt|shows|folds|calls|checks|bets|raises to|awarded|attempted illegal|"
    "ran out of time|disconnected|response misformatted:"
)
# One-letter codes of the actions.
CODES = {"fold": "F", "call": "C", "check": "K", "bet": "R", "raise": "R"}
FAULTS = ("illegal", "misformatted", "timeout", "disconnect")


# --- parsing ----------------------------------------------------------------


def parse_events(lines: DataFrame) -> DataFrame:
    """Typed events; a line of no known format is kept with kind ``other``."""
    line = F.col("line")
    kind = None
    for name, pattern in LINE_FORMATS:
        kind = F.when(line.rlike(pattern), name) if kind is None else kind.when(line.rlike(pattern), name)
    typed = lines.withColumn("kind", kind.otherwise("other"))
    k = F.col("kind")
    has_player = ~k.isin("round", "final", "standing", "stacks", "board", "other")
    amount = F.regexp_extract(line, r"(-?\d+)$", 1).try_cast("int")
    cards = F.split(F.regexp_extract(line, r"\[(.*?)\]", 1), " ")
    street = F.when(k == "round", 0).when(k == "board", F.when(line.startswith("Flop"), 2).otherwise(4))
    code = None
    for name, c in CODES.items():
        code = F.when(k == name, c) if code is None else code.when(k == name, c)
    return typed.withColumns(
        {
            "round_head": F.when(k == "round", F.regexp_extract(line, r"^Round #(\d+)", 1).try_cast("int")),
            "street_head": street,
            "player": F.when(has_player, F.regexp_extract(line, rf"^(.+?) (?:{VERBS})", 1)),
            "amount": F.when(k.isin("blind", "bet", "raise", "awarded"), amount),
            "cards": F.when(k.isin("deal", "shows", "board"), cards),
            "code": code,
        }
    )


def with_rounds(events: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Carry the round number and street from their header lines to the lines below."""
    heads = {"round_head": "round", "street_head": "street"}
    out = carry_forward(chunked(events, "line_no", chunk), ["file"], ["line_no"], heads)
    closing = F.col("kind") == "final"
    return out.withColumns(
        {
            "round": F.when(~closing, F.col("round")),
            "street": F.when(~closing, F.col("street")),
        }
    ).drop("round_head", "street_head")


def explode_packets(packets: DataFrame, text: str = "message") -> DataFrame:
    """Split protocol messages into clauses: position, one-letter tag, payload and its typed forms."""
    out = packets.select(
        *[c for c in packets.columns if c != text], F.posexplode(F.split(F.trim(text), " ")).alias("pos", "clause")
    ).where(F.col("clause") != "")
    tag, rest = F.substring("clause", 1, 1), F.expr("substring(clause, 2)")
    return out.withColumns(
        {
            "tag": tag,
            "payload": rest,
            "number": F.when(tag.isin("T", "P", "R", "D"), rest.try_cast("double")),
            "cards": F.when(tag.isin("H", "B", "O"), F.split(rest, ",")),
        }
    ).drop("clause")


# --- rounds -----------------------------------------------------------------


def round_results(events: DataFrame) -> DataFrame:
    """Delta per player and round, whether they won, and how the round ended."""
    rounds = events.where(F.col("round").isNotNull())
    per_player = (
        rounds.where(F.col("kind") == "awarded")
        .groupBy("file", "round", "player")
        .agg(F.sum("amount").alias("delta"))
    )
    ended = rounds.groupBy("file", "round").agg(
        F.when(F.max(F.when(F.col("kind") == "fold", 1).otherwise(0)) == 1, "fold").otherwise("showdown").alias("ended_by")
    )
    return per_player.join(ended, ["file", "round"]).withColumn("won", F.col("delta") > 0)


def standings(results: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Running balance per player of a file after each round."""
    return running_sum(chunked(results, "round", chunk), ["file", "player"], ["round"], "delta", "balance")


def final_standings(results: DataFrame) -> DataFrame:
    return results.groupBy("file", "player").agg(F.sum("delta").alias("balance"), F.count(F.lit(1)).alias("rounds"))


def action_mix(events: DataFrame) -> DataFrame:
    """Count of each action code per player and street."""
    return (
        events.where(F.col("code").isNotNull())
        .groupBy("player", "street")
        .pivot("code", ["F", "C", "K", "R"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["F", "C", "K", "R"])
    )


def fault_report(events: DataFrame) -> DataFrame:
    """Illegal, misformatted, timed-out and disconnected responses per player."""
    return (
        events.where(F.col("kind").isin(*FAULTS))
        .groupBy("player")
        .pivot("kind", list(FAULTS))
        .agg(F.count(F.lit(1)))
        .na.fill(0, list(FAULTS))
    )


def clock_use(clocks: DataFrame, by: list[str], order: list[str], clock: str = "clock") -> DataFrame:
    """Seconds spent before each message: the previous clock of the player minus this one."""
    out = previous(clocks, by, order, clock, "_was")
    return out.withColumn("seconds", F.col("_was") - F.col(clock)).drop("_was")


# --- streets ----------------------------------------------------------------


def street_contributions(events: DataFrame) -> DataFrame:
    """Chips each player put in on each street that a board line closes.

    Board lines carry what every player has put in so far, so a street's share is the difference to the round's
    board line before. A round has a handful of board lines, so its window is small.
    """
    seats = F.regexp_extract(F.col("line"), r"\](.*)$", 1)
    pairs = F.arrays_zip(
        F.regexp_extract_all(seats, F.lit(r", ([^()]+) \((\d+)\)"), F.lit(1)).alias("player"),
        F.regexp_extract_all(seats, F.lit(r", ([^()]+) \((\d+)\)"), F.lit(2)).alias("total"),
    )
    boards = events.where(F.col("kind") == "board").select("file", "round", "line_no", (F.col("street") - 2).alias("street"), F.inline(pairs))
    boards = boards.toDF("file", "round", "line_no", "street", "player", "total").withColumn("total", F.col("total").try_cast("long"))
    earlier = F.lag("total").over(Window.partitionBy("file", "round", "player").orderBy("line_no"))
    return boards.select("file", "round", "street", "player", (F.col("total") - F.coalesce(earlier, F.lit(0))).alias("put"))
