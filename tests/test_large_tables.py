"""What tells queries from their SQL twins, or stops them, on tables larger than the tests' own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spanforge.functions import spans
from spanforge.operators import evidence, matching
from spanforge.queries import ORACLES, QUERIES

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = str(folder / f"{table}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    ours = QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in ours.columns)
    return sorted(map(tuple, ours.collect())), sorted(con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())


def test_last_row_with_part_keys_over_a_million(spark, tmp_path):
    rows = [(1, 1_900_000, 1, 1, "N", "O"), (1, 10, 1, 2, "N", "O"), (2, 5, 1, 1, "N", "O"), (2, 4, 1, 2, "N", "O"), (3, None, 1, 3, "N", "O"), (3, 7, 1, 1, "N", "O"), (4, None, 1, 3, "N", "O")]
    ours, theirs = both(spark, tmp_path, "join_last_row_wins", lineitem=(rows, LINE))
    assert ours == theirs and ours[0] == (1, 2, 1_900_000)


@pytest.mark.parametrize("name", ["candidate_coverage", "recall_at_k"])
def test_window_without_candidates(spark, tmp_path, name):
    # No hash of window 70921 with a type is high enough.
    rows = [(k, 1, 1, 1, flag, status) for k in (70921, 1, 2, 3) for flag, status in (("A", "F"), ("N", "F"), ("N", "O"), ("R", "F"))]
    ours, theirs = both(spark, tmp_path, name, lineitem=(rows, LINE))
    assert ours == theirs


def test_wins_in_a_large_group_and_with_nulls(spark):
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") % 1000).cast("double").alias("b"), (F.col("id") % 1000 + F.when(F.col("id") < n // 2, 1).otherwise(0)).cast("double").alias("c"))
    small = spark.createDataFrame([(2, 1.0, None), (2, None, 3.0), (2, 2.0, 2.0), (None, 1.0, 5.0), (3, 1.0, 1.0)], "g int, b double, c double")
    got = {r["g"]: r["win_rate"] for r in evidence.pairwise_wins(rows.union(small), "g", "b", "c").collect()}
    # Of 1,000 values each candidate is ahead of its own number of lower ones, half of them one up.
    assert got == {1: pytest.approx((499.5 + 500.5) / 2 / 1000, abs=1e-9), 2: round(3 / 9, 9), 3: 0.0}


def test_tokens_are_not_sent_to_every_task(spark):
    doc = spark.range(10).select(F.col("id").alias("doc"))
    tokens = doc.select("doc", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")).select("doc", "i", (F.col("i") * 3).alias("s"), (F.col("i") * 3 + 3).alias("e"))
    items = doc.select("doc", F.lit(3).alias("start"), F.lit(9).alias("end"))
    out = matching.token_offsets(items, tokens, "doc")
    assert {tuple(r)[1:] for r in out.collect()} == {(3, 9, 1, 2)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_span_search_computes_its_parts_once(spark):
    df = spark.createDataFrame([(["a", "-", "b"], "a-b", "b")], "t array<string>, x string, v string")
    out = df.select(spans.chosen_span(spans.compact_spans(F.col("t"), F.col("x")), spans.compact_spans(F.col("t"), F.col("v"))).alias("f"))
    assert tuple(out.first()["f"]) == (0, 3, "nearest_surface_to_evidence")
    # One running sum of lengths for the surface and one for the evidence.
    assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2
