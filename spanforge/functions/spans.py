"""From the surface of a mention to its token span."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find_spans, norm_token

SPANS = "array<struct<s:int,e:int>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: inside lambdas every mention of an expression is computed again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compact_spans(tokens: Column, phrase: Column) -> Column:
    """Spans of tokens that read as the phrase, by equal words or else with punctuation and splits left aside.

    The letters and digits of all tokens are one string; a span is a place in it that begins with a token and
    ends with one. So no pairs of starts and ends are tried. Made for windows: its lengths are summed per token.
    """
    words = F.filter(F.split(F.lower(F.trim(phrase)), r"\s+"), lambda w: w != "")
    norms, target = F.transform(tokens, norm_token), norm_token(phrase)

    def exact(v: Column) -> Column:
        return F.transform(find_spans(v["low"], v["words"]), lambda i: F.struct(i.cast("int").alias("s"), (i + F.size(v["words"])).cast("int").alias("e"))).cast(SPANS)

    def loose(v: Column) -> Column:
        ends, size = v["ends"], F.length(v["target"])
        starts = F.filter(F.sequence(F.lit(0), F.size(v["norms"]) - 1), lambda i: (F.length(F.get(v["norms"], i)) > 0) & (F.substring(v["joined"], F.get(ends, i) + 1, size) == v["target"]) & F.array_contains(ends, F.get(ends, i) + size))
        spans = F.transform(starts, lambda i: F.struct(i.alias("s"), (F.array_position(ends, F.get(ends, i) + size) - 1).cast("int").alias("e")))
        return F.when((size > 0) & (F.size(v["norms"]) > 0), spans.cast(SPANS)).otherwise(F.array().cast(SPANS))

    def ended(v: Column) -> Column:
        ends = F.aggregate(v["norms"], F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
        return F.struct(v["norms"].alias("norms"), v["target"].alias("target"), F.array_join(v["norms"], "").alias("joined"), ends.alias("ends"))

    inexact = once(F.struct(norms.alias("norms"), target.alias("target")), lambda v: once(ended(v), loose))
    equal = once(F.struct(F.transform(tokens, F.lower).alias("low"), words.alias("words")), exact)
    return once(equal, lambda x: F.when(F.size(x) > 0, x).otherwise(inexact))


def chosen_span(surface: Column, evidence: Column) -> Column:
    """struct(s, e, method) out of candidate spans: inside evidence, else nearest to it, else the first."""
    return once(F.struct(surface.alias("surface"), evidence.alias("evidence")), lambda v: _chosen(v["surface"], v["evidence"]))


def _chosen(surface: Column, evidence: Column) -> Column:
    middle = lambda x: (x["s"] + x["e"]) / 2
    inside = F.filter(surface, lambda x: F.exists(evidence, lambda v: (x["s"] >= v["s"]) & (x["e"] <= v["e"])))
    near = F.array_min(F.transform(surface, lambda x, i: F.struct(F.abs(middle(x) - middle(F.get(evidence, F.lit(0)))).alias("far"), i.alias("i"), x.alias("x"))))["x"]
    first = F.get(surface, F.lit(0))
    pick = lambda x, how: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(how).alias("method"))
    nothing = F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.lit("none").alias("method"))
    return (
        F.when(F.size(surface) <= 0, nothing)
        .when(F.size(inside) > 0, pick(F.get(inside, F.lit(0)), "surface_inside_evidence"))
        .when(F.size(evidence) > 0, pick(near, "nearest_surface_to_evidence"))
        .when(F.size(surface) == 1, pick(first, "unique_surface"))
        .otherwise(pick(first, "first_surface_fallback"))
    )
