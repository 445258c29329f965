"""Payloads, responses, joins, picks and files on literal cases, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import payload, responses, targets
from spanforge.operators import audits, evidence, matching, picking, scoring, selection
from spanforge.sources import files

MENTIONS = "wnd_id long, event_type string, s long, e long, a long"


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], kinds).select(column.alias("x")).first()["x"]


def test_strict_parser_names_the_first_broken_rule(spark):
    cases = {"<thinking>a</thinking><final>{\"events\": []}</final>": None, "<thinking>a</thinking><thinking>b</thinking><final>{}</final>": "tag_count", "<thinking>a</thinking> x <final>{\"events\": []}</final>": "tag_structure", "<thinking>\n</thinking><final>{\"events\": []}</final>": "empty_thinking", "<thinking>a</thinking><final>nope</final>": "final_json", "<thinking>a</thinking><final>[]</final>": "final_schema"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", responses.strict_error(F.col("t")).alias("e"))
    assert {r["t"]: r["e"] for r in df.collect()} == cases


def test_payloads_of_all_shapes(spark):
    df = spark.createDataFrame([('{"events": [{"type": "A", "trigger": "w", "arguments": null}, 5, {"event_type": "B", "trigger": [{"text": "v", "start": 1, "end": 2}], "arguments": [{"role": "r", "start": 3, "end": 4}]}]}',), ("[1]",), (None,), ('{"events": "x"}',)], "t string")
    got = [r["e"] for r in df.select(payload.events(F.col("t")).alias("e")).collect()]
    assert [(e.event_type, e.trigger.text, e.trigger.start, len(e.arguments)) for e in got[0]] == [("A", "w", None, 0), ("B", "v", 1, 1)] and not any(got[1:])


def test_order_does_not_change_a_structure(spark):
    a, b = ('{"events": [%s, %s]}' % p for p in (('{"type": "A", "trigger": {"start": 1, "end": 2}}', '{"type": "B", "trigger": {"start": 0, "end": 1}}'), ('{"event_type": "B", "trigger": {"end": 1, "start": 0, "text": "z"}}', '{"event_type": "A", "trigger": {"start": 1, "end": 2}}')))
    df = spark.createDataFrame([(a,), (b,)], "t string").select(payload.digest(payload.events(F.col("t"))).alias("d"))
    assert len({r["d"] for r in df.collect()}) == 1


def test_single_errors_in_order(spark):
    g = [(1, "A", 1, 2, 1), (2, "A", 1, 2, 1), (3, "A", 1, 2, 1), (4, "A", 1, 2, 1), (4, "B", 5, 6, 2), (5, "A", 1, 2, 1), (6, "A", 1, 2, 1), (7, "A", 1, 2, 1), (7, "A", 1, 2, 9)]
    p = [(1, "A", 1, 2, 1), (2, "B", 1, 2, 1), (3, "A", 2, 3, 1), (4, "A", 1, 2, 1), (5, "A", 1, 2, 1), (5, "C", 8, 9, 3), (6, "C", 8, 9, 3), (7, "A", 1, 2, 1), (8, "A", 1, 2, 1)]
    got = {r["wnd_id"]: r["error"] for r in scoring.window_errors(spark.createDataFrame(g, MENTIONS), spark.createDataFrame(p, MENTIONS)).collect()}
    assert got == {1: "exact", 2: "wrong_type", 3: "trigger_drift", 4: "event_omission", 5: "extra_frame", 6: None, 7: "argument_omission", 8: "extra_frame"}


def test_offsets_spans_and_lengths(spark):
    assert one(spark, payload.nearby(F.col("a"), F.col("b"), F.lit(3), F.lit(4)), a=("int", 1), b=("int", 2)) is False
    assert one(spark, payload.nearby(F.col("a"), F.col("b"), F.lit(2), F.lit(3)), a=("int", 1), b=("int", 2)) is True
    assert one(spark, payload.nearby(F.col("a"), F.lit(2), F.lit(1), F.lit(2)), a=("int", None)) is False
    for chosen, total, want in ((10, 50, True), (6, 50, False), (14, 50, False), (10, 200, False), (None, 50, False)):
        assert one(spark, payload.valid_length_pair(F.col("c"), F.lit(10), F.col("t"), F.lit(50), 100), c=("int", chosen), t=("int", total)) is want
    assert one(spark, payload.span_text(F.col("t"), F.lit(1), F.lit(9)), t=("array<string>", ["a", "b"])) is None


def test_lemmas(spark):
    want = {"carried": "carry", "running": "run", "telling": "tell", "creating": "create", "agreed": "agree", "stopped": "stop", "cities": "city", "churches": "church", "bus": "bus", "class": "class", "dogs": "dog", "is": "is", "sing": "sing"}
    df = spark.createDataFrame([(w,) for w in want], "w string").select("w", targets.lemma(F.col("w")).alias("l"))
    assert {r["w"]: r["l"] for r in df.collect()} == want


def test_strict_joins_fail_loudly(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "id int, x int"), spark.createDataFrame([(1, 5), (2, 6)], "id int, y int")
    assert matching.strict_join(a, b, "id").count() == 2
    for bad in (b.limit(1), b.unionByName(b), spark.createDataFrame([(1, 5), (3, 6)], "id int, y int")):
        with pytest.raises(ValueError, match="keys"):
            matching.strict_join(a, bad, "id")


def test_containment_with_spans_of_any_length_and_copies(spark):
    spans = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 90, 95), (2, 0, 0, 5)], "doc int, span int, s int, e int")
    items = spark.createDataFrame([(1, 91, 94), (1, 91, 94), (1, 99, 101), (2, 0, 5), (3, 0, 1)], "doc int, start int, end int")
    got = sorted((r.doc, r.start, r.span) for r in matching.contained(items, spans, "doc", 7).fillna(-1, ["span"]).collect())
    assert got == [(1, 91, 0), (1, 91, 0), (1, 99, -1), (2, 0, 0), (3, 0, -1)]


def test_ranks_are_the_same_in_any_layout(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    for parts in (1, 5):
        got = selection.ranked(df.repartition(parts), [F.desc("v"), F.col("id")]).toPandas().sort_values("rank")
        want = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
        assert got["rank"].tolist() == list(range(1, 5001)) and got["id"].tolist() == want["id"].tolist()
    assert selection.ranked(df.limit(0), [F.col("v")]).count() == 0


def test_quotas_and_repeats(spark):
    assert picking.capped_target({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, 1000) == 20
    assert picking.capped_target({}, {}, 10) == 0
    rows = spark.createDataFrame([(i,) for i in range(3)], "id int")
    assert sorted((r.id, r.copy) for r in picking.repeated_to(rows, [F.col("id")], 7).collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert picking.repeated_to(rows.limit(0), [F.col("id")], 7).count() == 0
    assert picking.with_negatives(rows, F.col("id") == 0, "id", 2.0, "1").count() == 3


def test_bootstrap_of_equal_systems_is_zero_and_errors_are_raised(spark):
    c = spark.createDataFrame([(i, 0, 1, 2, 2, 1, 2, 2) for i in range(20)], "wnd_id int, seed int, b_tp int, b_n_pred int, b_n_gold int, c_tp int, c_n_pred int, c_n_gold int")
    assert tuple(evidence.bootstrap(c, "wnd_id", 30).first()) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="finite"):
        evidence.least_loss(spark.createDataFrame([(1, float("nan"))], "step int, loss double"), "loss", "step")
    with pytest.raises(ValueError, match="leak"):
        audits.assert_none(spark.createDataFrame([(1,)], "id int"), "leak")


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "round": 0}\n\nnot json\n{"id": 2, "round": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "round": 0}\n')
    rows = files.read_jsonl_lines(spark, str(tmp_path / "a.jsonl"), "id int, round int")
    assert [(r.line, r.value and r.value.id) for r in rows.orderBy("line").collect()] == [(1, 1), (3, None), (4, 2)]
    assert files.bad_lines(rows).first()["place"].endswith("a.jsonl:3")
    assert [(r.id, r.round) for r in files.read_many(spark, str(tmp_path / "*.jsonl"), "id int, round int", ["id"], 2).where("id IS NOT NULL").collect()] == [(1, 0)]
    (tmp_path / "list.txt").write_text("b\na\n")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert [r.doc_id for r in files.read_split(spark, docs, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="no such"):
        files.read_split(spark, docs.limit(1), str(tmp_path / "list.txt"))
    assert files.markdown(spark.createDataFrame([("x|y", 0.5)], "a string, b double")) == "| a | b |\n|---|---|\n| x\\|y | 0.5000 |"
    asked = []

    def answer(fresh):
        asked.append(fresh.count())
        return fresh.select("key", F.upper("q").alias("response"))

    q = spark.createDataFrame([("a",), ("a",), ("b",)], "q string")
    for _ in range(2):
        assert sorted((r.q, r.response) for r in files.cached(q, str(tmp_path / "cache"), answer).collect()) == [("a", "A"), ("a", "A"), ("b", "B")]
    assert asked == [2, 0]
