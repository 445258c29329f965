"""Small models of scored rows: sums in Spark, a few numbers on the driver, scores as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANCE_FLOOR = 1e-4


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n of all rows over twice that of the class."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all")))).select(label, "n", (F.col("_all") / (2.0 * F.col("n"))).alias("weight"))


def moments(rows: DataFrame, features: list[str], floor: float = 1e-8) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a deviation below the floor becomes one."""
    row = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    spread = {f: row[f"s_{f}"] or 0.0 for f in features}
    return {f: (row[f"m_{f}"] or 0.0, spread[f] if spread[f] >= floor else 1.0) for f in features}


def standardised(features: list[str], stats: dict[str, tuple[float, float]]) -> list[Column]:
    return [((F.col(f) - stats[f][0]) / stats[f][1]) for f in features]


def ridge(rows: DataFrame, features: list[str], target: str, weight: Column, l2: float) -> np.ndarray:
    """Bias and coefficients on standardised features; the bias isn't penalised. One pass gives the Gram matrix."""
    x = [F.lit(1.0), *standardised(features, moments(rows, features))]
    k, y = len(x), F.col(target).cast("double")
    gram = [F.sum(weight * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = rows.agg(*gram, *[F.sum(weight * x[i] * y).alias(f"y{i}") for i in range(k)]).first()
    both = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    both[range(1, k), range(1, k)] += l2
    # Least squares also answers where features depend on one another and nothing is penalised.
    return np.linalg.lstsq(both, np.array([row[f"y{i}"] or 0.0 for i in range(k)]), rcond=None)[0]


def linear_score(features: list[str], stats: dict[str, tuple[float, float]], beta: np.ndarray) -> Column:
    score = F.lit(float(beta[0]))
    for x, b in zip(standardised(features, stats), beta[1:], strict=True):
        score = score + x * F.lit(float(b))
    return score


def _log_density(x: Column, mean: Column, variance: Column) -> Column:
    return -0.5 * F.log(2 * F.pi() * variance) - (x - mean) ** 2 / (2 * variance)


def naive_bayes_loo(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """rows with `loo`, the log odds under a Gaussian naive Bayes fitted without the row itself.

    Every class keeps its count, sums and sums of squares; a row's own share is subtracted, so no refit is needed.
    Values are centred first to keep the sums small. A class left with no row takes the moments of all other rows;
    zero if only one class is left.
    """
    centre = moments(rows, features)
    c = {f: F.col(f).cast("double") - centre[f][0] for f in features}
    y = F.col(label).cast("int")
    sums = [F.sum(F.when(y == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (0, 1)]
    sums += [F.sum(F.when(y == k, c[f] ** p).otherwise(0.0)).alias(f"s{k}_{p}_{f}") for k in (0, 1) for p in (1, 2) for f in features]
    total = rows.agg(*sums).first()
    if total["n0"] is None:
        return rows.withColumn("loo", F.lit(0.0))
    out, n = {}, {}
    for k in (0, 1):
        mine = (y == k).cast("double")
        n[k] = F.lit(total[f"n{k}"]) - mine
        score = F.log((n[k] + 1.0) / (total["n0"] + total["n1"] - 1.0 + 2.0))
        for f in features:
            s = {p: F.lit(total[f"s{k}_{p}_{f}"]) - mine * c[f] ** p for p in (1, 2)}
            rest = {p: F.lit(total[f"s0_{p}_{f}"] + total[f"s1_{p}_{f}"]) - c[f] ** p for p in (1, 2)}
            size = F.when(n[k] > 0, n[k]).otherwise(F.greatest(F.lit(total["n0"] + total["n1"] - 1.0), F.lit(1.0)))
            mean, square = (F.when(n[k] > 0, s[p]).otherwise(rest[p]) / size for p in (1, 2))
            score = score + _log_density(c[f], mean, F.greatest(square - mean**2, F.lit(VARIANCE_FLOOR)))
        out[k] = score
    return rows.withColumn("loo", F.when((n[0] > 0) & (n[1] > 0), out[1] - out[0]).otherwise(0.0))


def rule_table(rows: DataFrame, rules: DataFrame, score: str, gain: str) -> DataFrame:
    """Each rule (rule, threshold; a few rows, checked) on all rows: routed, helpful, harmful, mean gain, precision, recall."""
    if rules.count() > 1000:
        raise ValueError("more than 1,000 rules")
    on = F.col(score) >= F.col("threshold")
    count = lambda c: F.sum(c.cast("long"))
    got = rows.select(score, gain).crossJoin(F.broadcast(rules)).groupBy("rule").agg(count(on).alias("routed"), count(on & (F.col(gain) > 0)).alias("helpful"), count(on & (F.col(gain) < 0)).alias("harmful"), count(F.col(gain) > 0).alias("_all"), F.avg(F.when(on, F.col(gain)).otherwise(0)).alias("mean_gain"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return got.select("rule", "routed", "helpful", "harmful", "mean_gain", safe(F.col("helpful"), F.col("routed")).alias("precision"), safe(F.col("helpful"), F.col("_all")).alias("recall"))
