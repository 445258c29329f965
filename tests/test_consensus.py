"""Votes, spreads, carriers, gates, quotas and differences on literal cases and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import consensus

SAMPLES = "wnd_id long, k long, event long, event_type string, s long, e long, a long"


def test_events_are_voted_first_and_then_their_arguments(spark):
    rows = [(1, 1, 0, "A", 0, 1, 5), (1, 1, 0, "A", 0, 1, 6), (1, 1, 1, "A", 0, 1, 7), (1, 2, 0, "A", 0, 1, 5), (1, 2, 0, "A", 0, 1, 7), (1, 3, 0, "B", 0, 1, None), (1, 2, 1, "B", 0, 1, 9), (1, 3, 1, "C", 0, 1, 1)]
    out = {r["event_type"]: (r["votes"], r["arguments"]) for r in consensus.event_votes(spark.createDataFrame(rows, SAMPLES), 2).collect()}
    # Sample 1 holds A twice: its second, with argument 7, doesn't count.
    assert out == {"A": (2, [5]), "B": (2, [])}
    assert consensus.event_votes(spark.createDataFrame([], SAMPLES), 1).count() == 0


def test_carriers_are_valid_samples_of_the_voted_structure(spark):
    voted = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    samples = spark.createDataFrame([(1, 1, "x", True), (1, 2, "x", False), (1, 3, "y", True), (1, 4, "x", None), (2, 1, None, True), (None, 1, "x", True)], "id long, k long, t string, ok boolean")
    assert [(r["id"], r["k"]) for r in consensus.carriers(voted, samples, "id", "t", F.col("ok")).collect()] == [(1, 1)]


def test_spread_of_nulls_ties_and_non_finite_numbers(spark):
    rows = [(1, 2.0, "a"), (1, 4.0, "a"), (1, float("nan"), None), (1, float("inf"), "b"), (2, None, None)]
    out = {r["id"]: tuple(r)[1:] for r in consensus.spread(spark.createDataFrame(rows, "id long, n double, t string"), "id", ["n"], ["t"]).collect()}
    assert out == {1: (3.0, 1.0, 0.5, 0.75), 2: (0.0, 0.0, 1.0, 1.0)}


@pytest.mark.parametrize("paths, adaptive, passed", [(4.0, 0.58, True), (6.0, 0.58, False), (4.0, 0.57, False)])
def test_gate_of_the_early_exit(spark, paths, adaptive, passed):
    scores = spark.createDataFrame([("f1", 0.5, 0.6, adaptive), ("em", 0.5, 0.4, 0.5)], "metric string, greedy double, full double, adaptive double")
    out = {r["metric"]: r["passed"] for r in consensus.early_exit_gate(scores, paths, 5.0, 0.8, 0.0, 0.0).collect()}
    assert out == {"f1": adaptive == 0.58, "em": True, "all": passed}


def test_protocol_checks_of_runs(spark):
    rows = [(run, key, "p", 8, 2) for run in (1, 2) for key in (1, 2)]
    kinds, expected = "run long, key long, protocol string, cap long, golds long", {"runs": 2, "examples": 2, "protocol": "p", "cap": 8, "keys": 2, "golds": 4}
    wrong = lambda some: {r["check"] for r in consensus.protocol_checks(spark.createDataFrame(some, kinds), "run", "key", "protocol", "cap", "golds", expected).collect() if not r["passed"]}
    assert wrong(rows) == set()
    assert wrong([*rows[:-1], (2, None, "q", None, 2)]) == {"protocol", "cap", "keys_present", "keys_unique", "all"}
    assert wrong([]) == {"runs", "examples", "protocol", "cap", "keys_present", "keys_unique", "golds", "all"}


@pytest.mark.parametrize("seed", range(6))
def test_quotas_are_met_at_the_least_cost(spark, seed):
    draw = random.Random(seed)
    quotas = {"a": 2, "b": 1, "c": 1}
    options = [(w, c, draw.randrange(12)) for w in range(7) for c in "abcd" if draw.random() < 0.6]
    cost = {(w, c): x for w, c, x in options}
    slots = [c for c, n in quotas.items() for _ in range(n)]
    totals = [sum(cost[p] for p in zip(ws, slots, strict=True)) for ws in itertools.permutations(range(7), 4) if all(p in cost for p in zip(ws, slots, strict=True))]
    frame = spark.createDataFrame([*options, *options[:3], (None, "a", 0), (9, "a", None)], "w long, c string, x long")
    if not totals:
        with pytest.raises(ValueError, match="infeasible"):
            consensus.exact_quotas(frame, "w", "c", "x", quotas)
        return
    got = consensus.exact_quotas(frame, "w", "c", "x", quotas).collect()
    assert sum(r["x"] for r in got) == min(totals) and len({r["w"] for r in got}) == 4
    assert {c: sum(r["c"] == c for r in got) for c in quotas} == quotas


def test_quotas_that_cannot_be_met_are_an_error(spark):
    with pytest.raises(ValueError, match="infeasible"):
        consensus.exact_quotas(spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "w long, c string, x long"), "w", "c", "x", {"a": 1, "b": 1})


def test_observed_and_frequent_proposals_cost_less(spark):
    rows = spark.createDataFrame([(1, True, 2), (2, True, 1), (3, False, 5000), (4, None, None)], "w long, o boolean, n int")
    cost = [r["c"] for r in rows.select("w", consensus.proposal_cost(F.col("o"), F.col("n"), "7", F.col("w"), F.lit("x")).alias("c")).orderBy("w").collect()]
    assert cost == sorted(cost) and [c // 1000 for c in cost] == [998, 999, 10001, 10999]


def test_differing_tokens_with_context(spark):
    rows = [([1, 2, 3, 4, 5], [1, 2, 9, 4, 5]), ([1, 2], [1, 2]), ([], [1]), (None, [1]), ([1, 2, 3], [1, 3])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a array<int>, b array<int>")
    out = [r["x"] and (r["x"]["chosen"], r["x"]["rejected"]) for r in df.select("i", consensus.token_differences("a", "b").alias("x")).orderBy("i").collect()]
    assert out == [([1, 2, 3], [1, 2, 3]), None, None, None, ([0, 1, 2], [0, 1])]
    with pytest.raises(ValueError, match="context"):
        consensus.token_differences("a", "b", -1)
