"""Joins of the reference's kinds: strict, positional, by interval, by sample, and merges by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import ranked


def key_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys that only one side has, and keys that a side holds more than once."""
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("r")), key, "full")
    return n.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l") > 1).alias("repeated_left"), F.count_if(F.col("r") > 1).alias("repeated_right"))


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of two tables that hold the same keys, each once; anything else is an error that says how many."""
    problems = key_problems(left, right, key).first().asDict()
    if any(problems.values()):
        raise ValueError(f"keys don't match: {problems}")
    return left.join(right, key)


def by_position(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], digest: Column) -> DataFrame:
    """(position, left_digest, right_digest): rows at the same place from 0 on whose digests differ, or that have no partner."""
    a = ranked(left, left_order, "at").select(F.col("at").alias("i"), digest.alias("left_digest"))
    b = ranked(right, right_order, "at").select(F.col("at").alias("j"), digest.alias("right_digest"))
    both = a.join(b, F.col("i") == F.col("j"), "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
    return both.select((F.coalesce("i", "j") - 1).alias("position"), "left_digest", "right_digest")


def contained(items: DataFrame, spans: DataFrame, group: str, width: int) -> DataFrame:
    """items (group, start, end, ...) with `span`, the smallest span id whose [s, e] holds them, or null.

    spans: group, span, s, e. Both sides meet in cells of `width` positions: an item in that of its start, a span in
    each that it touches, so a group of many items and spans isn't compared in pairs.
    """
    cells = spans.select(F.col(group).alias("_g"), "span", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("_cell"))
    keyed = items.withColumn("_item", F.struct(*items.columns))
    near = keyed.join(cells, (F.col(group) == F.col("_g")) & (F.floor(F.col("start") / width) == F.col("_cell")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")), "left")
    first = near.groupBy("_item").agg(F.min("span").alias("span"), F.count_distinct("span").alias("_n"))
    copies = items.groupBy(F.struct(*items.columns).alias("_same")).agg(F.count(F.lit(1)).alias("_copies"))
    out = first.join(copies, F.col("_item") == F.col("_same")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select("_item.*", "span")


def both_within(relations: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Relations (group, a, b, ...) whose two ends lie in one span, with that span. members: group, member, span."""
    left = members.select(F.col(group).alias("_g1"), F.col("member").alias("_m1"), F.col("span").alias("_s1"))
    right = members.select(F.col(group).alias("_g2"), F.col("member").alias("_m2"), F.col("span").alias("_s2"))
    one = relations.join(left, (F.col(group) == F.col("_g1")) & (F.col("a") == F.col("_m1")))
    two = one.join(right, (F.col(group) == F.col("_g2")) & (F.col("b") == F.col("_m2")) & (F.col("_s1") == F.col("_s2")))
    return two.select(*relations.columns, F.col("_s1").alias("span"))


def token_offsets(items: DataFrame, tokens: DataFrame, group: str) -> DataFrame:
    """items (group, start, end in characters, ...) with first and last token: those that begin and end there, or null.

    tokens: group, i, s, e. Of several tokens at one place the last counts. Tokens outnumber what the planner expects
    of exploded rows, so neither join sends them to every task.
    """
    begin = tokens.groupBy(F.col(group).alias("_gs"), F.col("s").alias("_s")).agg(F.max("i").alias("first_token"))
    stop = tokens.groupBy(F.col(group).alias("_ge"), F.col("e").alias("_e")).agg(F.max("i").alias("last_token"))
    out = items.join(begin.hint("merge"), (F.col(group) == F.col("_gs")) & (F.col("start") == F.col("_s")), "left").join(stop.hint("merge"), (F.col(group) == F.col("_ge")) & (F.col("end") == F.col("_e")), "left")
    return out.select(*items.columns, "first_token", "last_token")


def sample_wins(direct: DataFrame, reason: DataFrame, key: str, score: str, margin: float) -> DataFrame:
    """(key, n_pairs, p_win): over all pairs of a reason and a direct sample, how often the first is ahead by `margin`.

    A key has K samples a side, so the pairs of a key are K x K; the lists are folded in place, not joined.
    """
    a = direct.groupBy(key).agg(F.collect_list(score).alias("d"))
    b = reason.groupBy(key).agg(F.collect_list(score).alias("r"))
    won = F.aggregate("r", F.lit(0), lambda n, r: n + F.size(F.filter("d", lambda x: r >= x + margin)))
    pairs = F.size("r") * F.size("d")
    return a.join(b, key).select(key, pairs.cast("long").alias("n_pairs"), F.round(won / pairs, 9).alias("p_win"))


def sample_disagreement(direct: DataFrame, reason: DataFrame, key: str, sample: str, sig: str) -> DataFrame:
    """(key, disagreement): the share of samples that both sides have under one number and whose signatures differ."""
    b = reason.select(F.col(key).alias("_k"), F.col(sample).alias("_s"), F.col(sig).alias("_sig"))
    both = direct.join(b, (F.col(key) == F.col("_k")) & (F.col(sample) == F.col("_s")))
    return both.groupBy(key).agg(F.round(F.avg((~F.col(sig).eqNullSafe(F.col("_sig"))).cast("int")), 9).alias("disagreement"))


def retry_merge(parents: DataFrame, retries: DataFrame, key: str) -> DataFrame:
    """(key, chosen, value): parents (accepted, parse_error, value) unless a retry wins.

    Accepted parents stay; an accepted retry wins; a retry without parse error replaces a parent with one.
    """
    r = retries.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("accepted", "parse_error", "value")])
    both = parents.join(r, F.col(key) == F.col("_k"), "left")
    wins = ~F.col("accepted") & F.col("_k").isNotNull() & (F.col("_accepted") | (F.col("parse_error") & ~F.col("_parse_error")))
    return both.select(key, F.when(wins, "retry").otherwise("parent").alias("chosen"), F.when(wins, F.col("_value")).otherwise(F.col("value")).alias("value"))


def pair_prior(rows: DataFrame, pair: list[str], better: Column, least: int) -> DataFrame:
    """(pair, n, rate, prior): how often `better` holds, and how far above the rate of all rows; zero under `least` rows.

    Rows without a pair (nulls) count in the rate of all.
    """
    every = rows.agg(F.avg(better.cast("double")).alias("rate_all"))
    some = rows.where(F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull())
    per = some.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.avg(better.cast("double")).alias("rate"))
    lift = F.greatest(F.lit(0.0), (F.col("rate") - F.col("rate_all")) / F.greatest(F.lit(1e-8), 1 - F.col("rate_all")))
    out = per.join(F.broadcast(every), F.lit(True))
    return out.select(*pair, "n", F.round("rate", 9).alias("rate"), F.round(F.when(F.col("n") >= least, lift).otherwise(0.0), 9).alias("prior"))


def with_prior(rows: DataFrame, priors: DataFrame, pair: list[str]) -> DataFrame:
    """rows with the prior of their pair, zero where there is none."""
    p = priors.select(*[F.col(c).alias(f"_{c}") for c in pair], F.col("prior").alias("_prior"))
    on = [F.col(c) == F.col(f"_{c}") for c in pair]
    return rows.join(p, on, "left").select(*rows.columns, F.coalesce("_prior", F.lit(0.0)).alias("prior"))


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail (or are null), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def pooled(rows: DataFrame, key: str, split: str, signature: Column, order: Column) -> DataFrame:
    """(key, signature, splits, conflict) of each key: its first row's signature, its splits, whether signatures differ."""
    return rows.groupBy(key).agg(F.min_by(signature, order).alias("signature"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), (F.count_distinct(signature) > 1).alias("conflict"))


def seed_gaps(pairs: DataFrame, key: str, seed: str, seeds: int) -> DataFrame:
    """(key, n_seeds): the keys that don't stand once under each of `seeds` seeds."""
    per = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(seed).alias("n_seeds"))
    return per.where((F.col("n") != seeds) | (F.col("n_seeds") != seeds)).select(key, "n_seeds")


def unseen_family(candidates: Column, seen: list[str]) -> Column:
    """Whether a candidate's family (before the first colon) has no seen type: such rows take the direct answer."""
    families = lambda types: F.array_distinct(F.transform(types, lambda t: F.substring_index(t, ":", 1)))
    return F.size(F.array_except(families(candidates), families(F.array(*map(F.lit, seen))))) > 0
