import hashlib

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import scoring, selection
from spanforge.sources import files
from spanforge.streaming import ingest


def value(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("<Final> a </FINAL> b", "a"), ("x<final>rest", "rest"), ("none", None), ("<final></final>", "")])
def test_tags(spark, text, want):
    assert value(spark, tx.extract_tag(F.col("t"), "final"), t=text) == want


def test_sections_and_json(spark):
    assert value(spark, tx.section(F.col("t"), "A:", "B:"), t="x A: one B: two") == "one"
    assert value(spark, tx.section(F.col("t"), "A:", "B:"), t="x A: one") == "one"
    assert value(spark, tx.is_json_object(F.col("t")), t='{"a": [1]}') is True
    assert value(spark, tx.is_json_object(F.col("t")), t="[1]") is False
    assert value(spark, tx.is_json_object(F.col("t")), t="{") is False
    assert value(spark, tx.balanced_objects(F.col("t")), t='[{"a": "}"}, {"b": {"c": 1}}, {"d"') == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert value(spark, tx.repair_json_prefix(F.col("t")), t='{"a": 1} trailing') == '{"a": 1}'
    assert value(spark, tx.humanize(F.col("t")), t="Start-OrgUnit") == "Start Org Unit"
    assert value(spark, tx.unescape(F.col("t")), t="a &lt;b&gt; &amp;\nc") == "a <b> & c"
    assert value(spark, tx.find_spans(F.split("t", " "), F.split(F.lit("a b"), " ")), t="a b a b a") == [0, 2]


def test_window_score_edges(spark):
    g = spark.createDataFrame([(1, "A", 0, 1, 1), (1, "A", 0, 1, 1), (2, "B", 0, 1, 2)], "wnd_id long, event_type string, s long, e long, a long")
    p = spark.createDataFrame([(1, "A", 0, 1, 1), (3, "C", 0, 1, 2)], g.schema)
    got = {r["wnd_id"]: r["f1"] for r in scoring.window_f1(g, p).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    counts = scoring.bag_counts(g, p).first()
    assert (counts["tp"], counts["n_pred"], counts["n_gold"]) == (1, 2, 3)
    listed = scoring.list_counts(g, p).first()
    assert (listed["tp"], listed["fp"], listed["fn"]) == (1, 1, 1)


def test_budget_rounds_half_to_even_and_auc_of_one_class_is_null(spark):
    assert selection.budget_cap(5, 0.5) == 2
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y long, score double")
    assert selection.auc(rows, "y", "score").first()["auc"] is None


def test_sources(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1}\n\n{"id": 2}\n{bad\n')
    rows = files.read_jsonl(spark, str(path), "id long").collect()
    assert [r["id"] for r in rows] == [1, 2, None] and rows[2]["_corrupt"] == "{bad"
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), "id long", strict=True).collect()
    found = files.manifest(spark, str(path))
    assert found.first()["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    before = files.manifest_digest(found).first()[0]
    old = spark.createDataFrame(found.collect(), found.schema)
    path.write_text("{}")
    after = files.manifest(spark, str(path))
    assert files.manifest_digest(after).first()[0] != before
    assert [r["change"] for r in files.manifest_changes(old, after).collect()] == ["changed"]
    (tmp_path / "b.xml").write_text("<doc><e id='1'><x>one</x></e><e id='2'><x>two</x></e></doc>")
    assert sorted(r["x"] for r in files.read_annotations(spark, str(tmp_path / "b.xml"), "e").collect()) == ["one", "two"]
    (tmp_path / "c.txt").write_text("<a>drop</HEADLINE><p>keep one</p><p>keep two</p>")
    assert [r["body"] for r in files.read_tagged_text(spark, str(tmp_path / "c.txt"), "</HEADLINE>").orderBy("at").collect()] == ["keep one", "keep two"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', 'x'), (1, timestamp'2024-01-01 00:01:00', 'x'), (2, timestamp'2024-01-01 02:00:00', 'y') AS t(id, ts, kind)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id int, ts timestamp, kind string").parquet(src)
    q = ingest.deduplicated(stream, "id", "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


def test_compact_and_chosen_spans(spark):
    from spanforge.functions import spans

    rows = [
        (["The", "anti", "-", "tank", "gun", "fired", "."], "anti-tank", "gun fired", (1, 4, "nearest_surface_to_evidence")),
        (["a", "b", "a", "b"], "A b", "", (0, 2, "first_surface_fallback")),
        (["a", "b", "a", "b", "c"], "a", "a b c", (2, 3, "surface_inside_evidence")),
        (["x"], "?", "x", (None, None, "none")),
        ([], "x", "x", (None, None, "none")),
        (["one", ".", "two"], "Two", "none here", (2, 3, "unique_surface")),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "t array<string>, x string, v string").coalesce(1)
    got = df.select(spans.chosen_span(spans.compact_spans(F.col("t"), F.col("x")), spans.compact_spans(F.col("t"), F.col("v"))).alias("f")).collect()
    assert [tuple(r.f) for r in got] == [r[3] for r in rows]


def test_line_target_and_missing_card(spark):
    from spanforge.functions import render

    df = spark.sql("SELECT array(named_struct('event_type', 'Life:Die', 'trigger', 'died', 'arguments', array(named_struct('role', 'Victim', 'text', 'he')))) AS e UNION ALL SELECT null")
    assert {r.t for r in df.select(render.line_target(F.col("e")).alias("t")).collect()} == {"Life:Die || trigger: died || Victim: he", "NONE"}
    schema = spark.sql("SELECT 'A' AS event_type, 'card' AS document")
    asked = spark.sql("SELECT 'x' AS text, array('x') AS tokens, array('B') AS candidates")
    with pytest.raises(Exception, match="no card for B"):
        render.prompts(asked, schema).collect()


def test_windows_are_counted_once_they_are_over(spark, tmp_path):
    from datetime import datetime

    (tmp_path / "in").mkdir()
    rows = [(1, "a", datetime(2024, 1, 1, 0, 5)), (2, "a", datetime(2024, 1, 1, 0, 50)), (3, "b", datetime(2024, 1, 1, 0, 59)), (4, "a", datetime(2024, 1, 1, 1, 30))]
    spark.createDataFrame(rows, "id long, kind string, ts timestamp").write.parquet(str(tmp_path / "in" / "one"))
    stream = spark.readStream.schema("id long, kind string, ts timestamp").parquet(str(tmp_path / "in" / "*"))
    q = ingest.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = sorted((r["start"].hour, r["kind"], r["n"]) for r in spark.table("counted").collect())
    assert got == [(0, "a", 2), (0, "b", 1)]
