"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domain, language and source. Siblings share their parent's budget by weight; a
sibling that cannot use its share (it has ``max_epochs`` times its tokens at most) leaves the rest to its siblings by
weight, and only what a whole family cannot use goes to the parent's siblings. Each leaf then takes its budget as whole
epochs and a token-prefix of one more epoch, whose order is a seeded shuffle of the leaf's documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspark.llm.common import store, words_native

#: Documents in one slice of a leaf's shuffled order, about; only the slice where the budget ends is sorted.
SLICE = 1_000


def _weight(path: Sequence[str], weights: Mapping[tuple, float]) -> Column:
    """Weight of the node at ``path`` (column names); nodes that are not named weigh 1."""
    out = F.lit(1.0)
    for names, w in weights.items():
        if len(names) == len(path):
            same = F.lit(True)
            for c, v in zip(path, names):
                same = same & F.col(c).eqNullSafe(F.lit(v))
            out = F.when(same, F.lit(float(w))).otherwise(out)
    return out


def share_budget(nodes: DataFrame, parent: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``nodes(…, cap, weight, parent_budget)`` with ``budget``: each family's budget by weight, filled up to caps.

    The family is walked from the node that its share fills first; the first node that can't be filled sets the
    level for it and all after it.
    """
    family = Window.partitionBy(*parent).orderBy("__ratio", *order)
    before = family.rowsBetween(Window.unboundedPreceding, -1)
    rest = family.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ready = nodes.withColumn("__ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    ready = ready.withColumn("__left", F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ready = ready.withColumn("__w", F.sum("weight").over(rest))
    ready = ready.withColumn("__level", F.when(F.col("__w") > 0, F.col("__left") / F.col("__w")).otherwise(F.lit(0.0)))
    ready = ready.withColumn("__open", F.first(F.when(F.col("__ratio") > F.col("__level"), F.col("__level")), ignorenulls=True).over(whole))
    level = F.greatest(F.col("__open"), F.lit(0.0)) * F.col("weight")
    filled = F.when(F.col("weight") <= 0, 0.0).when(F.col("__open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level))
    return ready.withColumn("budget", filled).drop("__ratio", "__left", "__w", "__level", "__open")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], budget_share: float, max_epochs: int) -> DataFrame:
    """``leaves(*levels, tokens, docs)`` with each leaf's ``budget`` in tokens (long)."""
    caps = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(float(budget_share))).cast("double").alias("parent_budget"))
    given, parent = total, []
    for k in range(1, len(levels) + 1):
        path = list(levels[:k])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(path, weights))
        if parent:
            up = given.select(*[F.col(c).alias(f"__p_{c}") for c in parent], F.col("budget").alias("parent_budget"))
            on = F.lit(True)
            for c in parent:
                on = on & nodes[c].eqNullSafe(up[f"__p_{c}"])
            nodes = nodes.join(up, on).drop(*[f"__p_{c}" for c in parent])
        else:
            nodes = nodes.crossJoin(F.broadcast(total))  # one row
        given, parent = share_budget(nodes, parent or [F.lit(0)], path), path
    last = given.select(*[F.col(c).alias(f"__g_{c}") for c in levels], F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))
    on = F.lit(True)
    for c in levels:
        on = on & leaves[c].eqNullSafe(last[f"__g_{c}"])
    return leaves.join(last, on).drop(*[f"__g_{c}" for c in levels])


def _turn(key: Column, epoch: Column, seed: int) -> Column:
    """The place of a document in the shuffled order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def _nameless(key: Column, text: Column) -> Column:
    """What stands for a null key: a digest of the text."""
    return F.when(key.isNull(), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _plan(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float] | None, *,
    text: str, key: str, tokens: Column | None, budget_share: float, max_epochs: int, seed: int,
) -> DataFrame:
    """``plan_mix`` with ``__h``, which tells documents without a key apart."""
    count = F.size(words_native(F.col(text))).cast("long") if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    names = list(levels)
    small = docs.select(F.col(key).alias("__k"), _nameless(F.col(key), F.col(text)).alias("__h"), F.struct(*[F.col(c).cast("string").alias(c) for c in names], count.alias("tokens")).alias("r"))
    small = store(small.groupBy("__k", "__h").agg(F.min("r").alias("r")).select("__k", "__h", "r.*"), "mix")
    leaves = small.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = leaf_budgets(leaves, names, weights or {}, budget_share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", F.least(epochs, F.lit(max_epochs))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = store(plan.select(*[F.col(c).alias(f"__l_{c}") for c in names], "epochs", "rest", F.ceil(F.col("docs") / SLICE).alias("slices")), "plan")
    on = F.lit(True)
    for c in names:
        on = on & small[c].eqNullSafe(plan[f"__l_{c}"])
    turn = _turn(F.coalesce(F.col("__k").cast("string"), F.col("__h")), F.col("epochs"), seed)
    place = F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = small.join(plan, on).drop(*[f"__l_{c}" for c in names]).withColumn("turn", turn)
    rows = rows.withColumn("slice", F.floor(place * F.col("slices")).cast("long"))
    ahead = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*names, "slice").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    slices = slices.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
    slices = store(slices.select(*[F.col(c).alias(f"__l_{c}") for c in names], F.col("slice").alias("__s"), "before", "sum"), "slices")
    on = F.col("slice") == F.col("__s")
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__l_{c}"))
    rows = rows.join(slices, on).drop("__s", *[f"__l_{c}" for c in names])
    cut = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum"))
    inside = Window.partitionBy(*names).orderBy("turn", "__k", "__h").rowsBetween(Window.unboundedPreceding, -1)
    sure = rows.where(~cut).withColumn("more", F.when(F.col("before") + F.col("sum") <= F.col("rest"), F.col("tokens")).otherwise(F.lit(-1)))
    edge = rows.where(cut).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    edge = edge.withColumn("more", F.when(F.col("at") < F.col("rest"), F.least(F.col("tokens"), F.col("rest") - F.col("at"))).otherwise(F.lit(-1))).drop("at")
    both = sure.unionByName(edge).withColumn("more", F.when(F.col("rest") > 0, F.col("more")).otherwise(F.lit(-1)))
    return both.select(
        F.col("__k").alias(key), "__h", *names, "tokens", (F.col("epochs") + F.when(F.col("more") >= 0, 1).otherwise(0)).cast("long").alias("copies"),
        (F.col("epochs") * F.col("tokens") + F.greatest(F.col("more"), F.lit(0))).cast("long").alias("tokens_taken"),
    )


def plan_mix(
    docs: DataFrame, levels: Sequence[str] = ("domain", "lang", "source"), weights: Mapping[tuple, float] | None = None, *,
    text: str = "text", key: str = "doc_id", tokens: Column | None = None, budget_share: float = 0.6, max_epochs: int = 2, seed: int = 17,
) -> DataFrame:
    """One row per document: key, levels, tokens, copies (how often it is taken) and tokens_taken.

    ``budget_share`` is the budget as a share of all tokens; ``tokens`` counts a row's tokens (default: words). The
    document in which a leaf's budget ends is taken, and tokens_taken says how far. Null levels are nodes like any
    other. Rows that repeat a key are one document (that of the smallest levels and token count); rows with a null key
    are one document for each different text. A document without tokens has no copies unless its leaf takes a whole
    epoch. An empty table gives no rows.
    """
    options = {"text": text, "key": key, "tokens": tokens, "budget_share": budget_share, "max_epochs": max_epochs, "seed": seed}
    return _plan(docs, levels, weights, **options).drop("__h")


def mix(
    docs: DataFrame, levels: Sequence[str] = ("domain", "lang", "source"), weights: Mapping[tuple, float] | None = None, *,
    text: str = "text", key: str = "doc_id", tokens: Column | None = None, budget_share: float = 0.6, max_epochs: int = 2, seed: int = 17,
) -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, whole; columns as in ``docs``."""
    options = {"text": text, "key": key, "tokens": tokens, "budget_share": budget_share, "max_epochs": max_epochs, "seed": seed}
    taken = _plan(docs, levels, weights, **options).where("copies > 0").select(F.col(key).alias("__key"), "__h", F.col("copies").alias("__copies"))
    same = docs[key].eqNullSafe(taken["__key"]) & _nameless(docs[key], docs[text]).eqNullSafe(taken["__h"])
    out = docs.join(taken, same)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[docs[c] for c in docs.columns])
