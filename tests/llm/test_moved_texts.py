"""Joins of whole texts with a table about few of them move few texts, whatever the planner's limit for broadcasts."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.llm import chaining, kneserney, sieve, simhash


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _text(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.getrandbits(60):x}" for _ in range(n))


def _shuffled(spark, df) -> tuple[int, list]:
    """Bytes of shuffle files that df writes, and its rows."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        each = sc.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = total()
    rows = df.collect()
    return total() - before, rows


def test_a_sieve_loses_no_key(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.where("id % 10 = 3").select("h").union(spark.createDataFrame([(None,)], "h long"))
    passed = {r["id"] for r in sieve.sieved(rows, F.col("h"), keys).where(sieve.NAME).collect()}
    own = set(range(3, 20_000, 10))
    assert own <= passed and len(passed - own) < 1_800
    assert sieve.sieved(rows, F.col("h"), keys.limit(0)).where(sieve.NAME).count() == 0


def test_only_near_copies_are_moved(spark, no_broadcast):
    rng = random.Random(4)
    rows = [(i, _text(rng, 300)) for i in range(300)]
    rows += [(300, rows[7][1]), (8, rows[8][1]), (None, rows[9][1]), (None, None), (301, ""), (302, rows[10][1] + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    moved, kept = _shuffled(spark, simhash.drop_near_copies(docs.localCheckpoint()))
    assert sorted(r["doc_id"] for r in kept) == [*range(300), 301]
    assert moved < sum(len(t or "") for _, t in rows) // 5


def test_only_texts_with_passages_are_moved(spark, no_broadcast):
    rng = random.Random(5)
    shared = _text(rng, 60)
    rows = [(i, f"{_text(rng, 300)} {shared} {_text(rng, 5)}" if i % 100 == 0 else _text(rng, 300)) for i in range(300)]
    rows += [(300, shared), (301, None), (None, rows[1][1] + "\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    moved, kept = _shuffled(spark, chaining.without_passages(docs.localCheckpoint()))
    texts = {r["doc_id"]: r["text"] for r in kept}
    assert texts.keys() == {*range(300), 301}
    assert all(texts[i] == (t if i == 0 else t.replace(shared + " ", "")) for i, t in rows[:300])
    assert texts[301] is None
    assert moved < sum(len(t or "") for _, t in rows) // 5


def test_only_texts_over_a_limit_are_moved(spark, no_broadcast, monkeypatch):
    rng = random.Random(6)
    rows = [(i, _text(rng, 300), "xy"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).localCheckpoint()
    scores = docs.select(kneserney.text_hash(docs).alias("text_hash"), F.when(F.col("doc_id") % 50 < 2, 9.0).otherwise(1.0).alias("perplexity"))
    monkeypatch.setattr(kneserney, "scored", lambda *_: ({"x": 5.0, "y": 9.0, None: 9.0}, scores))
    moved, kept = _shuffled(spark, kneserney.accepted(docs, docs))
    assert sorted(r["doc_id"] for r in kept) == [i for i in range(300) if i % 50 != 0]
    assert moved < sum(len(t) for _, t, _ in rows) // 5
