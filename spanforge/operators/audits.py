"""Audits over rows: exposure of terms, factors, conjunctions of rules, lexicons and cardinalities."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exposure(rows: DataFrame, surfaces: dict[str, Column], terms: list[str]) -> DataFrame:
    """(surface, term, n): in how many rows each surface holds each term; any stands for all surfaces and for all terms."""
    has = {(s, t): F.coalesce(F.contains(c, F.lit(t)), F.lit(False)) for s, c in surfaces.items() for t in terms}
    any_of = lambda tests: F.array_max(F.array(*tests))
    every = dict(has)
    every |= {("any", t): any_of([has[s, t] for s in surfaces]) for t in terms}
    every |= {(s, "any"): any_of([has[s, t] for t in terms]) for s in surfaces}
    every["any", "any"] = any_of(list(has.values()))
    held = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("surface"), F.lit(t).alias("term"))) for (s, t), c in every.items()])))
    return rows.select(held.alias("x")).groupBy("x.surface", "x.term").agg(F.count(F.lit(1)).alias("n"))


def factors(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """(key, factor): every factor whose test holds for a row."""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).alias("factor"))


def conjunctions(atoms: dict[str, Column], most: int, apart: list[tuple[str, str]] | None = None) -> dict[str, Column]:
    """All conjunctions of one to `most` atoms by name, but those that hold a pair of which one implies the other."""
    out = {}
    for size in range(1, most + 1):
        for names in combinations(atoms, size):
            if not any(set(pair) <= set(names) for pair in apart or []):
                test = atoms[names[0]]
                for n in names[1:]:
                    test = test & atoms[n]
                out[" & ".join(names)] = test
    return out


def rule_results(rows: DataFrame, rules: dict[str, Column], gain: str) -> DataFrame:
    """(rule, n, gain, harm_rate) of every rule in one pass: rows taken, their summed gain, the share that loses."""
    met = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return rows.select(met.alias("rule"), gain).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum(gain).alias("gain"), F.round(F.avg((F.col(gain) < 0).cast("int")), 9).alias("harm_rate"))


def lexicon(rows: DataFrame, by: str, window: str, cue: str, least: int, top: int) -> DataFrame:
    """(by, cue, n, n_windows, rank): each type's `top` cues that occur `least` times or more, by (count desc, cue)."""
    n = rows.groupBy(by, cue).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(window).alias("n_windows")).where(F.col("n") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), cue)).cast("long")).where(F.col("rank") <= top)


def leaking_rows(rows: DataFrame, key: str, texts: list[Column], terms: list[str], most: int = 20) -> DataFrame:
    """(key, term): up to `most` rows in which a text holds a held-out term, whatever its case."""
    whole = F.lower(F.concat_ws("\n", *texts))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(whole, F.lower(t)))
    return rows.select(key, F.explode(found).alias("term")).orderBy(key, "term").limit(most)


def assert_none(rows: DataFrame, what: str) -> None:
    """An error that names what there should be none of, with a few of them."""
    some = rows.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def cardinality_problems(rows: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """(by, expected, n): groups that don't hold as many rows as they should, missing and unknown ones too."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"_by string, expected long")
    both = n.join(want, F.col(by) == F.col("_by"), "full")
    return both.select(F.coalesce(by, "_by").alias(by), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n")).where("expected <> n")


def semantic_pass(scores: dict[str, Column], consistency: str, errors: Column) -> Column:
    """Whether all scores are 4 or more, the named one 5, and there is no error; nulls fail."""
    ok = F.size(errors) == 0
    for name, c in scores.items():
        ok = ok & (c >= (5 if name == consistency else 4))
    return F.coalesce(ok, F.lit(False))
