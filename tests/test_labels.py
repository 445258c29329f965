"""Small models and labels against direct computation, and on empty tables and nulls."""

import numpy as np
from pyspark.sql import functions as F

from spanforge.operators import labels, learning

SCHEMA = "id long, x double, z double, y long"


def test_ridge_solves_the_normal_equations(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 2))
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x[:, 0], x[:, 1], y, strict=True))], SCHEMA)
    z = np.column_stack([np.ones(60), (x - x.mean(0)) / x.std(0)])
    want = np.linalg.solve(z.T @ z + np.diag([0, 2.0, 2.0]), z.T @ y)
    assert np.allclose(learning.ridge(df, ["x", "z"], "y", F.lit(1.0), 2.0), want)


def test_leave_one_out_equals_refits(spark):
    rows = [(i, float(i % 5) + (i % 2), float(i * i % 7), i % 2) for i in range(12)]
    got = {r["id"]: r["loo"] for r in learning.naive_bayes_loo(spark.createDataFrame(rows, SCHEMA), ["x", "z"], "y").collect()}
    for row in rows:
        rest, s = [o for o in rows if o is not row], {}
        for k in (0, 1):
            mine = [o for o in rest if o[3] == k]
            s[k] = np.log((len(mine) + 1) / (len(rest) + 2))
            for f in (1, 2):
                v = np.array([o[f] for o in mine])
                var = max(v.var(), learning.VARIANCE_FLOOR)
                s[k] += -0.5 * np.log(2 * np.pi * var) - (row[f] - v.mean()) ** 2 / (2 * var)
        assert abs(got[row[0]] - (s[1] - s[0])) < 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert learning.naive_bayes_loo(none, ["x"], "y").count() == 0
    assert labels.route_labels(none, "x", "id", 0.5, F.lit(True)).count() == 0
    assert learning.class_weights(none, "y").count() == 0


def test_route_labels_break_ties_by_key_and_cap_all_rows(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 4 else None, 0.0, 0) for i in range(6)], SCHEMA)
    got = {r["id"]: r["rank"] for r in labels.route_labels(rows, "x", "id", 0.5, F.col("x").isNotNull()).collect()}
    assert got == {3: 1, 2: 2, 1: 3, 0: None, 4: None, 5: None}


def test_evidence_errors(spark):
    long = " ".join(["w"] * 46)
    rows = [("a b c", None, "b"), ("a b c", "B", "a  b"), ("a b c", "d", "a b"), ("a b c", "b", "b d"), (long, "w", long)]
    df = spark.createDataFrame(rows, "t string, s string, e string").select(labels.evidence_error(F.col("t"), F.col("s"), F.col("e")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["missing_surface_or_evidence", None, "surface_not_in_evidence", "evidence_not_in_text", "evidence_too_long"]


def test_a_null_check_fails_the_gate(spark):
    row = spark.createDataFrame([(1, None)], "a int, b int")
    got = {r["check"]: r["passed"] for r in labels.checks(row, {"one": F.col("a") == 1, "two": F.col("b") > 0}).collect()}
    assert got == {"one": True, "two": False, "all": False}
