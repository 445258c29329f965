"""Shards, mixtures and vectors: the same result in other layouts, other scales and with clashing names."""

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import descent, mixing, sharding


def places(df, **more):
    return {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shard_table(df, **more).collect()}


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i, "t" * (i % 50), "s") for i in range(700)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, before = places(df), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert places(df.repartition(5)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = sharding.shard_table(df).toPandas()
    n = found.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert len(found) == 701 and len(n) == 24 and n["count"].max() - n["count"].min() <= 1
    assert (n["max"] + 1 == n["count"]).all() and (n["nunique"] == n["count"]).all()
    # One more copy of a row walks its bucket anew and shifts the others by one at most.
    few, more = (places(x, bucket_bytes=700) for x in (df, df.unionByName(df.where("doc_id = 5"))))
    assert sum(few[k][0] != more[k][0] for k in few) <= 24 + 50


def test_a_walk_is_a_permutation_and_none_is_preferred(spark):
    at = spark.range(4000).select(sharding.walk(F.lit(4), F.col("id"), 1).alias("w")).toPandas().w.map(tuple).value_counts()
    assert len(at) == 24 and at.min() > 110 and at.max() < 230 and all(sorted(w) == [0, 1, 2, 3] for w in at.index)


def test_written_shards_hold_the_rows_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", i) for i in range(100)], "doc_id long, text string, shard int")
    back = sharding.write_shards(df, str(tmp_path / "out"), shards=3).toPandas()
    assert sorted(r["doc_id"] for r in back.row) == list(range(100)) and all(r["shard"] == r["doc_id"] for r in back.row)
    assert back.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all() and back["shard"].nunique() == 3


def test_mixture_ignores_a_column_called_topic_unless_named(spark):
    rows = [(i, "a b c " * (1 + i % 40), f"s{i % 3}", "en", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    plain = {r.doc_id: tuple(r) for r in mixing.mix(df.drop("topic")).collect()}
    assert {r.doc_id: tuple(r) for r in mixing.mix(df).collect()} == plain
    assert {r.topic for r in mixing.mix(df, topic="topic").collect()} == {"0", "1"}
    assert mixing.sampled(df).columns == df.columns and {r.doc_id for r in mixing.sampled(df).collect()} == {k for k, v in plain.items() if v[-1]}


def test_mixture_fits_its_marginals(spark):
    r = np.random.default_rng(0)
    rows = [(i, "w " * int(r.integers(1, 3000)), f"s{r.integers(4)}", f"l{r.integers(3)}") for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).toPandas()
    cells = out.drop_duplicates(["source", "lang", "topic"])
    for d in mixing.DIMENSIONS:
        share = out.groupby(d).tokens.sum() ** mixing.TEMPER
        assert np.allclose(cells.groupby(d).target_weight.sum(), share / share.sum(), atol=1e-4)
    assert abs((out.tokens * out.probability).sum() / out.tokens.sum() - mixing.BUDGET) < 1e-6


def test_vectors_of_any_scale_in_double_precision(spark):
    v = np.random.default_rng(1).standard_normal(8)
    rows = [(i, [float(x) for x in v * s]) for i, s in enumerate((1.0, 1e-60, 1e60, -1.0, 1e-310, 1e300))] + [(9, [float("inf")] + [0.0] * 7), (10, [float("-inf")] + [1.0] * 7)]
    got = {r.vec_id: r for r in descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in (0, 1, 2, 3, 4, 5, 9, 10)] == [4, 4, 4, 0, 4, 4, 0, 0]
    assert got[5].component_id == 0 and got[3].kept and got[0].recall == 1.0
