"""Votes, spreads and carriers of several samples a window, gates on them, and assignments of exact quotas."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import checks

# What a proposal that no sample shows costs more, the highest frequency that counts, its weight.
FALLBACK, MOST_FREQUENT, FREQUENCY_WEIGHT = 10_000_000, 999, 1000

EVENT = ["wnd_id", "event_type", "s", "e"]


def event_votes(samples: DataFrame, least: int) -> DataFrame:
    """(wnd_id, event_type, s, e, votes, arguments): events of at least `least` samples, with the arguments of as many.

    samples: wnd_id, k (the sample), event (its place in the sample), event_type, s, e, a (null: no argument). Of equal
    events in one sample only the first counts, with its arguments. arguments is sorted and may be empty.
    """
    once = samples.groupBy(*EVENT, "k", "event").agg(F.collect_set("a").alias("a"))
    first = once.groupBy(*EVENT, "k").agg(F.min_by("a", "event").alias("a"))
    # A list holds an argument once for each sample, and samples are few.
    held = first.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("votes"), F.flatten(F.collect_list("a")).alias("a")).where(F.col("votes") >= least)
    enough = F.filter(F.array_distinct("a"), lambda x: F.size(F.filter("a", lambda y: x == y)) >= least)
    return held.select(*EVENT, "votes", F.array_sort(enough).alias("arguments"))


def structures(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, structure): the canonical text of a group's events (event_type, s, e, arguments), in no order of their own."""
    event = F.concat_ws("|", "event_type", "s", "e", F.array_join(F.array_sort(F.col("arguments")), ","))
    return events.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(event)), ";").alias("structure"))


def carriers(voted: DataFrame, samples: DataFrame, key: str, structure: str, valid: Column) -> DataFrame:
    """The valid samples whose structure is the voted one of their key. voted holds a key once; nulls match nothing."""
    target = voted.select(F.col(key).alias("_key"), F.col(structure).alias("_structure"))
    return samples.where(valid).join(target, (F.col(key) == F.col("_key")) & (F.col(structure) == F.col("_structure")), "left_semi")


def spread(samples: DataFrame, by: str, numbers: list[str], signatures: list[str]) -> DataFrame:
    """Mean and standard deviation of a group's numbers; share of the commonest and of the different signatures.

    One row a group from one shuffle; a group is the few samples of a window. Null and non-finite numbers don't count,
    a group without any has 0 for both; a null signature is one like any other.
    """
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    stats = [f(finite(c)).alias(f"{c}_{name}") for c in numbers for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    lists = [F.collect_list(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))).alias(c) for c in signatures]
    rows = samples.groupBy(by).agg(*stats, *lists)
    zero = [F.round(F.coalesce(f"{c}_{x}", F.lit(0.0)), 9).alias(f"{c}_{x}") for c in numbers for x in ("mean", "std")]

    def shares(c: str) -> list[Column]:
        kinds = F.array_distinct(c)
        most = F.array_max(F.transform(kinds, lambda x: F.size(F.filter(c, lambda y: x == y))))
        return [F.round(most / F.size(c), 9).alias(f"{c}_consensus"), F.round(F.size(kinds) / F.size(c), 9).alias(f"{c}_unique_rate")]

    return rows.select(by, *zero, *[s for c in signatures for s in shares(c)])


def early_exit_gate(scores: DataFrame, mean_paths: float, most_paths: float, retention: float, tolerance: float, regression: float) -> DataFrame:
    """(metric, criterion, reference_pass, floor_pass, passed) of scores (metric, greedy, full, adaptive), and a row `all`.

    Where all samples beat one, the early exit must retain that share of the gain; where not, it may lie `tolerance`
    below all samples. It may lie `regression` below one sample. `all` also asks for mean_paths <= most_paths.
    """
    slack, gain = F.lit(1e-12), F.col("full") - F.col("greedy")
    kept = F.when(gain > 0, F.col("adaptive") - F.col("greedy") + slack >= retention * gain).otherwise(F.col("adaptive") + slack >= F.col("full") - tolerance)
    floor = F.col("adaptive") + slack >= F.col("greedy") - regression
    criterion = F.when(gain > 0, "retain_positive_full_sc_gain").otherwise("match_nonpositive_full_sc")
    each = scores.select("metric", criterion.alias("criterion"), kept.alias("reference_pass"), floor.alias("floor_pass"), (kept & floor).alias("passed"))
    every = lambda c: F.coalesce(F.every(c), F.lit(True)).alias(c)
    total = each.agg(every("reference_pass"), every("floor_pass"), every("passed"))
    cheap = F.lit(mean_paths <= most_paths)
    return each.unionByName(total.select(F.lit("all").alias("metric"), F.lit("cost").alias("criterion"), "reference_pass", "floor_pass", (F.col("passed") & cheap).alias("passed")))


def protocol_checks(rows: DataFrame, run: str, key: str, protocol: str, cap: str, golds: str, expected: dict) -> DataFrame:
    """(check, passed), and `all`: whether the runs in rows are what `expected` says.

    expected: runs, examples (of every run), protocol, cap (of tokens), keys (different ones of a run, none null), golds
    (gold events of a run). No rows fail all.
    """
    per = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count(key).alias("present"), F.sum(golds).alias("golds"),
        F.count_if(F.col(protocol).eqNullSafe(F.lit(expected["protocol"]))).alias("same"), F.count_if(F.col(cap).eqNullSafe(F.lit(expected["cap"]))).alias("capped"),
    )
    of = {"examples": F.col("n") == expected["examples"], "protocol": F.col("same") == F.col("n"), "cap": F.col("capped") == F.col("n"), "keys_present": F.col("present") == F.col("n"), "keys_unique": (F.col("keys") == expected["keys"]) & (F.col("keys") == F.col("n")), "golds": F.coalesce(F.col("golds") == expected["golds"], F.lit(False))}
    one = per.agg(F.count(F.lit(1)).alias("runs"), *[F.coalesce(F.every(c), F.lit(False)).alias(name) for name, c in of.items()])
    return checks(one, {"runs": F.col("runs") == expected["runs"], **{name: F.col(name) for name in of}})


def proposal_cost(observed: Column, frequency: Column, seed: str, key: Column, category: Column) -> Column:
    """The cost of a proposal: observed ones first, then frequent ones, then by sha256(seed:key:category)."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string"), category), 256)
    tie = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000
    rare = FREQUENCY_WEIGHT - F.least(F.coalesce(frequency, F.lit(1)), F.lit(MOST_FREQUENT))
    return F.when(F.coalesce(observed, F.lit(False)), 0).otherwise(FALLBACK) + rare.cast("long") * 1000 + tie


def _assigned(options: dict[str, dict], quotas: dict[str, int]) -> dict:
    """{key: category} of the least total cost that meets the quotas. options: {category: {key: cost}}.

    One key is added at a time: it enters a category, which may hand one of its own on to another, and so on to one
    with room. The cheapest such chain over the few categories is found by relaxing them until nothing changes.
    """
    names = sorted(quotas)
    held: dict[str, set] = {c: set() for c in names}
    home: dict = {}
    for _ in range(sum(quotas.values())):
        reach: dict[str, tuple] = {}
        for c in names:
            free = min(((cost, key) for key, cost in options[c].items() if key not in home), default=None)
            if free:
                reach[c] = (free[0], free[1], None)
        moves = {}
        for c in names:
            for d in names:
                if c != d:
                    move = min(((options[d][key] - options[c][key], key) for key in held[c] if key in options[d]), default=None)
                    if move:
                        moves[c, d] = move
        changed = True
        while changed:
            changed = False
            for (c, d), (more, key) in moves.items():
                if c in reach and (d not in reach or reach[c][0] + more < reach[d][0]):
                    reach[d], changed = (reach[c][0] + more, key, c), True
        ends = [(reach[c][0], c) for c in names if c in reach and len(held[c]) < quotas[c]]
        if not ends:
            raise ValueError(f"quotas are infeasible: {len(home)} of {sum(quotas.values())} assigned, supplies {({c: len(options[c]) for c in names})}")
        at = min(ends)[1]
        while at is not None:
            _, key, source = reach[at]
            if source is not None:
                held[source].discard(key)
            held[at].add(key)
            home[key] = at
            at = source
    return home


def exact_quotas(options: DataFrame, key: str, category: str, cost: str, quotas: dict[str, int]) -> DataFrame:
    """The options that give each category its quota and no key twice, at the least total cost; an error if none do.

    With Q the sum of the quotas, each category's Q cheapest keys hold such a choice: a dearer one can be exchanged for
    a cheaper key that no category uses. So the driver gets Q rows a category at most, however many options there are.
    Of repeated options one counts; null keys, categories or costs don't.
    """
    rows = options.where(F.col(category).isin(list(quotas)) & F.col(key).isNotNull()).groupBy(key, category).agg(F.min(F.col(cost).cast("long")).alias(cost)).where(F.col(cost).isNotNull())
    place = F.row_number().over(Window.partitionBy(category).orderBy(cost, key))
    cheap = rows.withColumn("_place", place).where(F.col("_place") <= sum(quotas.values())).drop("_place")
    by: dict[str, dict] = {c: {} for c in quotas}
    for r in cheap.collect():
        by[r[category]][r[key]] = r[cost]
    chosen = [(k, c, by[c][k]) for k, c in sorted(_assigned(by, quotas).items())]
    return options.sparkSession.createDataFrame(chosen, rows.schema)


def token_differences(chosen: str, rejected: str, context: int = 1) -> Column:
    """A struct of the places in two token lists that differ, `context` tokens around included.

    Null if a list is null or empty, or if one side has no such place.
    """
    if context < 0:
        raise ValueError("context must not be negative")

    def places(a: list, b: list) -> tuple[list[int], list[int]] | None:
        keep: tuple[set, set] = set(), set()
        for kind, *ends in SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
            if kind != "equal":
                for side, size, (start, end) in zip(keep, (len(a), len(b)), (ends[:2], ends[2:]), strict=True):
                    side.update(range(max(0, start - context), min(size, end + context)))
        return (sorted(keep[0]), sorted(keep[1])) if keep[0] and keep[1] else None

    @F.pandas_udf("struct<pair:struct<chosen:array<int>,rejected:array<int>>>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            both = [places(list(a), list(b)) if a is not None and b is not None and len(a) and len(b) else None for a, b in zip(left, right, strict=True)]
            yield pd.DataFrame({"pair": [p and {"chosen": p[0], "rejected": p[1]} for p in both]})

    return found(F.col(chosen), F.col(rejected))["pair"]
