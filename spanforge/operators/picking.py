"""Selections, splits, repeats and mixtures of rows, by hashes of a seed and a key instead of shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .selection import budget_cap, ranked, stable_order


def by_hash(rows: DataFrame, key: str, seed: str, name: str = "rank") -> DataFrame:
    """rows with their place in the order of sha256(seed:key)."""
    return ranked(rows.withColumn("_hash", stable_order(seed, F.col(key))), [F.col("_hash"), F.col(key)], name).drop("_hash")


def with_negatives(rows: DataFrame, positive: Column, key: str, ratio: float | None, seed: str) -> DataFrame:
    """Positive rows and int(n x ratio) of the others; all rows with ratio None, positives alone with 0."""
    if ratio is None:
        return rows
    good = rows.where(positive)
    return good.unionByName(by_hash(rows.where(~positive), key, seed, "_rank").where(F.col("_rank") <= int(good.count() * ratio)).drop("_rank"))


def ratio_split(rows: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """rows with `held_out`: the first int(n x ratio) by hash."""
    return by_hash(rows, key, seed, "_rank").withColumn("held_out", F.col("_rank") <= int(rows.count() * ratio)).drop("_rank")


def routed(rows: DataFrame, strategy: str, score: str, key: str, rate: float, seed: str = "0", threshold: float | None = None) -> DataFrame:
    """(key, routed) of every row. direct, reason: none or all; random, top: round(n x rate) by hash or by score.

    threshold: by score alone; top_threshold: both. Rows without a score are never routed by it.
    """
    cap = budget_cap(rows.count(), rate)
    if strategy in ("direct", "reason"):
        return rows.select(key, F.lit(strategy == "reason").alias("routed"))
    if strategy == "random":
        return by_hash(rows, key, seed).select(key, (F.col("rank") <= cap).alias("routed"))
    above = F.coalesce(F.col(score) >= F.lit(threshold), F.lit(False)) if threshold is not None else F.lit(True)
    if strategy == "threshold":
        return rows.select(key, above.alias("routed"))
    order = [F.desc_nulls_last(score), F.desc(key)]
    placed = ranked(rows.select(key, score), order)
    return placed.select(key, ((F.col("rank") <= cap) & F.col(score).isNotNull() & above).alias("routed"))


def top_score(rows: DataFrame, score: str, count: int) -> DataFrame:
    """(threshold): the count-th highest score; a count beyond the rows gives the lowest less 1e-9, none the highest more."""
    some = rows.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("v"))
    n = some.count()
    if count <= 0:
        return some.agg((F.max("v") + 1e-9).alias("threshold"))
    if count > n:
        return some.agg((F.min("v") - 1e-9).alias("threshold"))
    return ranked(some, [F.desc("v")], "at").where(F.col("at") == count).select(F.col("v").alias("threshold"))


def repeated_to(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """`count` rows with `copy` from 0 on: rows in order, over and over until there are enough; none from no rows."""
    n = rows.count()
    if not n:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    placed = ranked(rows, order, "_rank")
    copies = F.lit(count // n) + (F.col("_rank") <= count % n).cast("long")
    return placed.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>")))).drop("_rank")


def mixed(direct: DataFrame, contrast: DataFrame, direct_ratio: float, contrast_ratio: float, key: str, seed: str) -> DataFrame:
    """All direct rows and round(n x contrast_ratio / direct_ratio) contrastive ones, topped up by copies, with `origin`."""
    wanted = round(direct.count() * contrast_ratio / direct_ratio)
    more = repeated_to(contrast.withColumn("_hash", stable_order(seed, F.col(key))), [F.col("_hash"), F.col(key)], wanted).drop("_hash")
    return direct.withColumn("copy", F.lit(0).cast("long")).withColumn("origin", F.lit("direct")).unionByName(more.withColumn("origin", F.lit("contrast")))


def capped_target(sizes: dict[str, int], caps: dict[str, float], most: int) -> int:
    """The largest t up to `most` for which groups of these sizes, each at most its share of t, still give t rows."""
    return max((t for t in range(most + 1) if sum(min(n, int(caps.get(g, 1.0) * t + 1e-12)) for g, n in sizes.items()) >= t), default=0)


def capped(rows: DataFrame, group: str, caps: dict[str, float], key: str, seed: str, most: int) -> DataFrame:
    """Up to `most` rows of which no group is more than its share, by hash within groups. caps names the few groups."""
    some = rows.where(F.col(group).isin(list(caps)))
    sizes = {r[group]: r["count"] for r in some.groupBy(group).count().collect()}
    target = capped_target(sizes, caps, most)
    limit = F.create_map(*[F.lit(x) for g, c in caps.items() for x in (g, int(c * target + 1e-12))])
    place = F.row_number().over(Window.partitionBy(group).orderBy(stable_order(seed, F.col(key))))
    within = some.withColumn("_rank", place).where(F.col("_rank") <= limit[F.col(group)]).drop("_rank")
    return by_hash(within, key, seed, "_rank").where(F.col("_rank") <= target).drop("_rank")


def by_selectors(rows: DataFrame, selectors: dict[str, Column], key: str, budgets: list[float]) -> DataFrame:
    """(selector, budget, n, least_score): what each formula takes under each budget, by (score, key) descending."""
    n, out = rows.count(), None
    for name, formula in selectors.items():
        placed = ranked(rows.select(key, formula.alias("score")), [F.desc("score"), F.desc(key)])
        budget = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(budget_cap(n, b)).cast("long").alias("cap")) for b in budgets]))
        one = placed.select("score", "rank", budget.alias("b")).where(F.col("rank") <= F.col("b.cap")).groupBy("b.budget").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least_score"))
        one = one.select(F.lit(name).alias("selector"), "budget", "n", "least_score")
        out = one if out is None else out.unionByName(one)
    return out


def distractors(gold: Column, candidates: Column, hardness: Column, seed: str, key: Column) -> Column:
    """Candidates that aren't gold, hardest first; hardness is a map by type, ties are broken by hash."""
    rest = F.array_except(candidates, gold)
    tie = lambda t: F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), t), 256)
    return F.transform(F.array_sort(F.transform(rest, lambda t: F.struct((-F.coalesce(hardness[t], F.lit(0.0))).alias("h"), tie(t).alias("x"), t.alias("t")))), lambda r: r["t"])


def budget_labels(rows: DataFrame, delta: str, key: str, rate: float) -> DataFrame:
    """(key, rank, label): reason for the round(n x rate) largest (delta, key), a missing delta last; else direct."""
    placed = ranked(rows.select(key, delta), [F.desc_nulls_last(delta), F.desc(key)])
    cap = budget_cap(rows.count(), rate)
    return placed.select(key, "rank", F.when(F.col("rank") <= cap, "reason").otherwise("direct").alias("label"))


def margin_labels(rows: DataFrame, gain: str, valid: Column, key: str, rate: float, margin: float) -> DataFrame:
    """(key, label): reason for the largest (gain, key) among valid rows above the margin, at most round(all x rate)."""
    cap = budget_cap(rows.count(), rate)
    won = ranked(rows.where(valid & (F.col(gain) > margin)).select(key, gain), [F.desc(gain), F.desc(key)]).where(F.col("rank") <= cap).select(F.col(key).alias("_won"))
    return rows.join(won, F.col(key) == F.col("_won"), "left").select(key, F.when(F.col("_won").isNotNull(), "reason").otherwise("direct").alias("label"))
