"""Scorers over event structures. A mention is a row (wnd_id, event_type, s, e, a): type, trigger span, argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"trigger": ["event_type", "s", "e"], "argument": ["event_type", "s", "e", "a"]}


def zero_safe(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num.cast("double") / den)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def item_sets(mentions: DataFrame, level: str, name: str) -> DataFrame:
    """(wnd_id, name): the set of a window's items."""
    return mentions.groupBy("wnd_id").agg(F.collect_set(F.struct(*LEVELS[level])).alias(name))


def window_f1(gold: DataFrame, predicted: DataFrame, level: str = "trigger") -> DataFrame:
    """S1: set F1 of each window; one if both sides are empty, zero if one is."""
    both = item_sets(gold, level, "g").join(item_sets(predicted, level, "p"), "wnd_id", "full")
    empty = F.array().cast(both.schema["g"].dataType)
    both = both.select("wnd_id", F.coalesce("g", empty).alias("g"), F.coalesce("p", empty).alias("p"))
    hit = F.size(F.array_intersect("g", "p"))
    p, r = zero_safe(hit, F.size("p")), zero_safe(hit, F.size("g"))
    score = F.when((F.size("g") == 0) & (F.size("p") == 0), F.lit(1.0)).otherwise(f1(p, r))
    return both.select("wnd_id", hit.cast("long").alias("tp"), F.size("p").cast("long").alias("n_pred"), F.size("g").cast("long").alias("n_gold"), F.round(score, 9).alias("f1"))


def bag_counts(gold: DataFrame, predicted: DataFrame, level: str = "trigger", by: list[str] | None = None) -> DataFrame:
    """S2: multiset matches summed over windows: tp, n_pred, n_gold (by further columns of the items)."""
    keys = ["wnd_id", *LEVELS[level]]
    items = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    per = items.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    sums = [F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold")]
    return per.groupBy(*by).agg(*sums) if by else per.agg(*sums)


def micro(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 from counts, denominators at least one."""
    p, r = F.col("tp").cast("double") / F.greatest("n_pred", F.lit(1)), F.col("tp").cast("double") / F.greatest("n_gold", F.lit(1))
    return counts.select(*(keep or []), "tp", "n_pred", "n_gold", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1(p, r), 9).alias("f1"))


def list_counts(gold: DataFrame, predicted: DataFrame, level: str = "trigger") -> DataFrame:
    """S3: only the first of equal predictions can hit; every gold item that is predicted at all counts as found."""
    keys = ["wnd_id", *LEVELS[level]]
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("ng"))
    p = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("np"))
    both = g.join(p, keys, "full").fillna(0, ["ng", "np"])
    hit = ((F.col("ng") > 0) & (F.col("np") > 0)).cast("long")
    return both.agg(F.sum(hit).alias("tp"), F.sum(F.col("np") - hit).alias("fp"), F.sum(F.when(F.col("np") > 0, 0).otherwise(F.col("ng"))).alias("fn"))


def pooled_counts(gold: DataFrame, predicted: DataFrame, types: list[str], level: str = "trigger") -> DataFrame:
    """S4: one set over all windows, items of `types` only."""
    keys = ["wnd_id", *LEVELS[level]]
    g, p = (x.where(F.col("event_type").isin(types)).select(*keys).distinct() for x in (gold, predicted))
    tp = g.intersect(p).select(F.lit("tp").alias("k"))
    rows = tp.unionAll(g.select(F.lit("g").alias("k"))).unionAll(p.select(F.lit("p").alias("k")))
    n = lambda k: F.count_if(F.col("k") == k)
    return rows.agg(n("tp").alias("tp"), n("p").alias("n_pred"), n("g").alias("n_gold"))


def exact_windows(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(wnd_id, bucket): exact, both, gold_only or pred_only by trigger sets."""
    w = window_f1(gold, predicted)
    exact = (F.col("tp") == F.col("n_pred")) & (F.col("tp") == F.col("n_gold"))
    bucket = F.when(exact, "exact").when(F.col("n_pred") == 0, "gold_only").when(F.col("n_gold") == 0, "pred_only").otherwise("both")
    return w.select("wnd_id", bucket.alias("bucket"))


def gold_errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(wnd_id, event_type, s, e, a, error) of every gold mention, by the first class that holds."""
    g = gold.select("wnd_id", "event_type", "s", "e", "a")
    p = predicted.groupBy("wnd_id").agg(F.collect_set(F.struct("event_type", "s", "e", "a")).alias("preds"))
    j = g.join(p, "wnd_id", "left")
    has = lambda test: F.coalesce(F.exists("preds", test), F.lit(False))
    frame = lambda x: (x["event_type"] == F.col("event_type")) & (x["s"] == F.col("s")) & (x["e"] == F.col("e"))
    error = (
        F.when(has(lambda x: frame(x) & (x["a"] == F.col("a"))), "exact")
        .when(has(frame), "frame_match_arg_mismatch")
        .when(has(lambda x: (x["s"] == F.col("s")) & (x["e"] == F.col("e"))), "same_trigger_wrong_type")
        .when(has(lambda x: x["event_type"] == F.col("event_type")), "same_type_wrong_trigger")
        .otherwise("missing_frame")
    )
    return j.select("wnd_id", "event_type", "s", "e", "a", error.alias("error"))


def vote(samples: DataFrame, least: int) -> DataFrame:
    """Mentions that at least `least` samples hold; of equal mentions in one sample the first counts. samples: k, items."""
    return samples.groupBy("wnd_id", *LEVELS["argument"]).agg(F.count_distinct("k").alias("votes")).where(F.col("votes") >= least)


def consensus(signatures: DataFrame, by: str, sig: str) -> DataFrame:
    """Share of the commonest signature and of different signatures among a group's samples."""
    per = signatures.groupBy(by, sig).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(F.round(F.max("n") / F.sum("n"), 9).alias("consensus"), F.round(F.count(F.lit(1)) / F.sum("n"), 9).alias("unique_rate"))


def predicted_errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The mirror of gold_errors(): every predicted mention by the first class that holds; extra_frame if none does."""
    mirrored = gold_errors(predicted, gold)
    return mirrored.withColumn("error", F.when(F.col("error") == "missing_frame", "extra_frame").otherwise(F.col("error")))


def row_buckets(windows: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(wnd_id, bucket) of every window: has_exact, both_no_exact, gold_only, pred_only or empty_both."""
    f = window_f1(gold, predicted, "argument")
    both = windows.select("wnd_id").join(f, "wnd_id", "left").fillna(0, ["tp", "n_pred", "n_gold"])
    tp, p, g = F.col("tp") > 0, F.col("n_pred") > 0, F.col("n_gold") > 0
    return both.select("wnd_id", F.when(tp, "has_exact").when(p & g, "both_no_exact").when(g, "gold_only").when(p, "pred_only").otherwise("empty_both").alias("bucket"))


def weighted_quality(gold: DataFrame, predicted: DataFrame, trigger: float, argument: float) -> DataFrame:
    """(wnd_id, quality): weighted S1 scores of a window."""
    t = window_f1(gold, predicted).select("wnd_id", F.col("f1").alias("t"))
    a = window_f1(gold, predicted, "argument").select("wnd_id", F.col("f1").alias("a"))
    return t.join(a, "wnd_id").select("wnd_id", F.round(F.lit(trigger) * F.col("t") + F.lit(argument) * F.col("a"), 7).alias("quality"))


def window_errors(gold: DataFrame, predicted: DataFrame, tolerance: int = 2) -> DataFrame:
    """(wnd_id, error): exact, or the one kind of error that tells a window's prediction from its gold; null if several.

    wrong_type: equal spans under other types. trigger_drift: one trigger moved nearby. argument_omission and
    event_omission: only something left out. extra_frame: only events added.
    """
    sides = None
    for name, rows in (("g", gold), ("p", predicted)):
        one = rows.groupBy("wnd_id").agg(*[F.collect_set(F.struct(*LEVELS[k])).alias(f"{name}_{k}") for k in LEVELS])
        sides = one if sides is None else sides.join(one, "wnd_id", "full")
    kinds = {c: F.array().cast(sides.schema[c].dataType) for c in sides.columns if c != "wnd_id"}
    sides = sides.select("wnd_id", *[F.coalesce(c, none).alias(c) for c, none in kinds.items()])
    gt, pt, ga, pa = (F.col(c) for c in ("g_trigger", "p_trigger", "g_argument", "p_argument"))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    same = lambda a, b: within(a, b) & within(b, a)
    spans = lambda x: F.array_distinct(F.transform(x, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"))))
    types = lambda x: F.array_sort(F.transform(x, lambda t: t["event_type"]))
    only_p, only_g = F.array_except(pt, gt), F.array_except(gt, pt)
    p, g = F.get(only_p, F.lit(0)), F.get(only_g, F.lit(0))
    near = ((p["s"] < g["e"]) & (g["s"] < p["e"])) | (F.abs(p["s"] - g["s"]) + F.abs(p["e"] - g["e"]) <= tolerance)
    moved = (F.size(only_p) == 1) & (F.size(only_g) == 1) & (p["event_type"] == g["event_type"]) & near
    error = (
        F.when(same(pt, gt) & same(pa, ga), "exact")
        .when(same(spans(pt), spans(gt)) & (F.size(pt) == F.size(gt)) & ~same(pt, gt), "wrong_type")
        .when((types(pt) == types(gt)) & moved, "trigger_drift")
        .when(same(pt, gt) & within(pa, ga), "argument_omission")
        .when(within(pt, gt) & ~within(gt, pt) & within(pa, ga), "event_omission")
        .when(within(gt, pt) & ~within(pt, gt) & within(ga, pa), "extra_frame")
    )
    return sides.select("wnd_id", error.alias("error"))


def suppression(windows: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Over the windows (wnd_id, valid) without gold events: how many predictions are valid, empty, and both."""
    n = predicted.groupBy("wnd_id").agg(F.count(F.lit(1)).alias("n"))
    rows = windows.join(gold.select("wnd_id").distinct(), "wnd_id", "left_anti").join(n, "wnd_id", "left").fillna(0, ["n"])
    rate = lambda test: F.round(F.count_if(test) / F.count(F.lit(1)), 9)
    empty = F.col("n") == 0
    return rows.agg(F.count(F.lit(1)).alias("negative_rows"), F.count_if("valid").alias("valid_rows"), rate(F.col("valid")).alias("valid_rate"), rate(empty).alias("empty_rate"), rate(F.col("valid") & empty).alias("strict_empty_rate"), F.round(F.avg("n"), 9).alias("mean_predicted"))


def argument_changes(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Arguments that one of two systems has: removes_extra, recovers_missing, loses_correct or adds_extra."""
    keys = ["wnd_id", *LEVELS["argument"]]
    rows = None
    for name, df in (("g", gold), ("b", before), ("c", after)):
        one = df.select(*keys, *[F.lit(int(name == k)).alias(k) for k in "gbc"])
        rows = one if rows is None else rows.unionByName(one)
    u = rows.groupBy(*keys).agg(*[F.max(k).alias(k) for k in "gbc"]).where("b <> c")
    right, had = F.col("g") == 1, F.col("b") == 1
    return u.select(*keys, F.when(~right & had, "removes_extra").when(right & ~had, "recovers_missing").when(right, "loses_correct").otherwise("adds_extra").alias("mechanism"))
