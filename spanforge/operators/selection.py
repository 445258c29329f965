"""Holdouts, candidates, sampling and routing over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import written


def without_types(windows: DataFrame, types: list[str]) -> DataFrame:
    """Drops every window that holds an event of one of the types (training side of a holdout)."""
    return windows.where(~F.exists("events", lambda e: e["event_type"].isin(types)))


def only_types(windows: DataFrame, types: list[str]) -> DataFrame:
    """Keeps every window and only its events of the types (test side of a holdout)."""
    return windows.withColumn("events", F.filter("events", lambda e: e["event_type"].isin(types)))


def family(event_type: Column) -> Column:
    return F.substring_index(event_type, ":", 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def neighbours(schema: DataFrame, top: int, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Each type's `top` most confusable others by cues, roles and family; schema: t, cues, roles, fam (a small table).

    Only types that share a cue, a role or a family can score, so the pairs come from joins on these.
    """
    keyed = schema.select("*", F.explode(F.concat(F.transform("cues", lambda c: F.concat(F.lit("c:"), c)), F.transform("roles", lambda r: F.concat(F.lit("r:"), r)), F.array(F.concat(F.lit("f:"), "fam")))).alias("key"))
    pairs = keyed.select("key", F.col("t").alias("t")).join(keyed.select("key", F.col("t").alias("o")), "key").where("t <> o").select("t", "o").distinct()
    a, b = schema.alias("a"), schema.alias("b")
    j = pairs.join(a, pairs["t"] == F.col("a.t")).join(b, pairs["o"] == F.col("b.t"))
    score = weights[0] * jaccard(F.col("a.cues"), F.col("b.cues")) + weights[1] * jaccard(F.col("a.roles"), F.col("b.roles")) + weights[2] * (F.col("a.fam") == F.col("b.fam")).cast("double")
    scored = j.select(pairs["t"].alias("event_type"), pairs["o"].alias("neighbour"), F.round(score, 9).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("score"), "neighbour"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def stable_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def first_by_hash(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """The `count` rows whose sha256(seed:key) comes first."""
    return rows.orderBy(stable_order(seed, F.col(key))).limit(count)


def first_by_hash_per(rows: DataFrame, stratum: str, key: str, count: int, seed: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(stable_order(seed, F.col(key))))
    return rows.withColumn("pick", rank).where(F.col("pick") <= count).drop("pick")


def fold(key: Column, folds: int = 5) -> Column:
    """int(md5[:8], 16) mod folds."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % folds


def budget_cap(n: int, budget: float) -> int:
    """Half-even rounding of n x budget."""
    return round(n * budget)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place from 1 on in the order of all, by range partitions: no task holds more than one range.

    Rows before a partition are summed from one small row a partition. The ranges are drawn from a sample, which differs
    from plan to plan, so the rows with their partitions are written once. Ties in the whole order get any of their places.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    staged = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), low.alias("_at")))
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row a range partition, whatever the rows are: a size that the number of partitions bounds.
    placed = staged.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return placed.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_of", "_before")


def top_by_budget(rows: DataFrame, score: str, key: str, budget: float) -> DataFrame:
    """The round(n x budget) rows of largest (score, key), nulls left out; the cap counts all rows."""
    best = ranked(rows.where(F.col(score).isNotNull()), [F.desc(score), F.desc(key)], "_rank")
    return best.where(F.col("_rank") <= budget_cap(rows.count(), budget)).drop("_rank")


def order_statistics(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(q, v): the value at place round((n - 1) q), half to even, of the sorted values, for each share q; nulls don't count."""
    some = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n = some.count()
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(round((n - 1) * q) + 1).cast("long").alias("at")) for q in shares])
    named = ranked(some, [F.col("v")], "at").select("v", F.explode(F.filter(wanted, lambda w: w["at"] == F.col("at"))).alias("w"))
    return named.select(F.col("w.q").alias("q"), "v")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """(cutoff): the value at place n // 2 from 0 on; no row for no values."""
    some = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("cutoff"))
    return ranked(some, [F.col("cutoff")], "at").where(F.col("at") == some.count() // 2 + 1).select("cutoff")


def frequency_tier(n: Column, limits: tuple[int, int, int] = (10, 30, 100)) -> Column:
    """ultra_tail, tail, mid or head: under the first, second or third limit, or not."""
    return F.when(n < limits[0], "ultra_tail").when(n < limits[1], "tail").when(n < limits[2], "mid").otherwise("head")


def ranked_pairs(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(positives, negatives) at each score, for curves that handle ties."""
    return rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC, ties one half; null if a class is empty. One row a distinct score is ranked, not one a pair."""
    per = ranked_pairs(rows, label, score)
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("won", F.col("pos") * (below + F.col("neg") / 2.0))
    s = won.agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("w") / (F.col("p").cast("double") * F.col("n")), 9)).alias("auc"), F.col("p").alias("n_pos"), F.col("n").alias("n_neg"))


def average_precision(rows: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Mean over positives of hits/rank, by (score, key) descending."""
    order = [F.desc(score), F.desc(key)]
    r = ranked(rows.where(F.col(score).isNotNull()).select(F.col(label).cast("long").alias("y"), score, key), order)
    hits = ranked(r.where("y = 1"), [F.col("rank")], "hits")
    return hits.agg(F.round(F.avg(F.col("hits") / F.col("rank")), 9).alias("ap"), F.count(F.lit(1)).alias("n_pos"))


def threshold_sweep(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Routed count, hits, precision and recall at each distinct score as threshold (score >= threshold routes)."""
    per = ranked_pairs(rows, label, score)
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    out = per.select(F.col("score").alias("threshold"), F.sum(F.col("pos") + F.col("neg")).over(w).alias("routed"), F.sum("pos").over(w).alias("hits"), F.sum("pos").over(every).alias("all_pos"))
    return out.select("threshold", "routed", "hits", F.round(F.col("hits") / F.col("routed"), 9).alias("precision"), F.round(F.col("hits") / F.greatest("all_pos", F.lit(1)), 9).alias("recall"))
