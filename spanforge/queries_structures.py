"""Queries over payloads, generated responses and structural errors, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import payload, responses
from .operators import scoring
from .plans.roles import GOLD_SQL, gold, predicted, predicted_sql, read
from .queries import query, s1_sql

# A generated response of each kind, by the order's key.
FULL = """{"events": [{"event_type": "A:X", "trigger": {"text": "w", "start": 1, "end": 2}, "arguments": [{"role": "R", "text": "x", "start": 5, "end": 6}, {"text": "y"}, 3]}]}"""
KINDS = [
    f"<thinking>because</thinking>\n<final>{FULL}</final>",
    '<thinking>b</thinking><final>{"events": [{"type": "B:X", "trigger": "w"}]}</final>',
    '<thinking>b</thinking><final>{"events": [{"event_type": "", "type": "A:X", "trigger": ["w"]}, "junk", {"event_type": "A:Y"}]}</final>',
    '<thinking> </thinking><final>{"events": []}</final>',
    '<thinking>b</thinking><final>{"events": [</final>',
    '<thinking>b</thinking><final>{"events": {}}</final>',
    '<final>{"events": []}</final>',
    '<final>{"events": []}</final><thinking>b</thinking>',
    '<ROUTE>Reason</ROUTE><thinking>b</thinking><final>{"events": [',
    None,
    '<BUDGET>none</BUDGET><PLAN>\nTYPE A\n\nROLE r present\nROLE q absent CONTRAST\n</PLAN>{"role": ' + '"role" ' * 20,
    "<think>no answer",
]


def responses_of(spark, d):
    kind = F.col("o_orderkey") % len(KINDS)
    text = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (kind + 1).cast("int"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


def by_kind(**columns: dict) -> str:
    """SQL that says for each kind of response what must come out; a missing kind has the column's value under None."""
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    case = lambda c, v: f"CASE o_orderkey % {len(KINDS)} " + " ".join(f"WHEN {k} THEN {shown(x)}" for k, x in v.items() if k is not None) + f" ELSE {shown(v.get(None))} END AS {c}"
    return f"SELECT o_orderkey AS id, {', '.join(case(c, v) for c, v in columns.items())} FROM orders"


ERRORS = {0: None, 1: None, 2: None, 3: "empty_thinking", 4: "final_json", 5: "final_schema", 9: "not_string", 7: "tag_structure", None: "tag_count"} | {8: "tag_count"}


@query("response_strict_errors", by_kind(error={k: v for k, v in ERRORS.items()}))
def _(spark, d):
    return responses_of(spark, d).select("id", responses.strict_error(F.col("text")).alias("error"))


@query("payload_events", by_kind(n_events={0: 1, 1: 1, 2: 2, None: 0}, first_type={0: "A:X", 1: "B:X", 2: "A:X"}, first_trigger={0: "w", 1: "w", 2: "w"}, n_args={0: 2, None: 0}, complete={0: False, 1: False, 2: False, None: True}, missing={0: 1, 1: 1, 2: 2, None: 0}))
def _(spark, d):
    e = payload.events(responses.final_object(F.col("text")))
    rows = responses_of(spark, d).select("id", F.coalesce(e, F.array().cast(payload.EVENTS)).alias("e"))
    one = F.get("e", F.lit(0))
    n_args = F.aggregate("e", F.lit(0), lambda n, x: n + F.size(x["arguments"]))
    return rows.select("id", F.size("e").alias("n_events"), one["event_type"].alias("first_type"), one["trigger"]["text"].alias("first_trigger"), n_args.alias("n_args"), payload.offsets_complete(F.col("e")).alias("complete"), payload.missing_offsets(F.col("e")).alias("missing"))


@query("payload_types_within", by_kind(within={1: False, 2: False, None: True}, n_kept={0: 1, 2: 1, None: 0}))
def _(spark, d):
    allowed = F.array(F.lit("A:X"))
    rows = responses_of(spark, d).select("id", F.coalesce(payload.events(responses.final_object(F.col("text"))), F.array().cast(payload.EVENTS)).alias("e"))
    return rows.select("id", payload.types_within(F.col("e"), allowed).alias("within"), F.size(payload.of_type(F.col("e"), F.lit("A:X"))).alias("n_kept"))


@query("response_tags", by_kind(final_complete={8: False, 9: False, 10: False, 11: False, None: True}, whole={0: True, 1: True, 2: True, 3: True, 4: True, 5: True, None: False}, route={8: "reason", 10: "direct", None: "unknown"}))
def _(spark, d):
    t = F.col("text")
    return responses_of(spark, d).select("id", responses.complete_tag(t, "final").alias("final_complete"), responses.whole_response(t).alias("whole"), responses.route(t).alias("route"))


@query("response_plan_lines", by_kind(lines={10: 3, None: 0}, contrasts={10: 1, None: 0}, present={10: 1, None: 0}, absent={10: 1, None: 0}, types={10: 1, None: 0}))
def _(spark, d):
    return responses_of(spark, d).select("id", *[F.coalesce(c, F.lit(0)).alias(k) for k, c in responses.plan_lines(F.col("text")).items()])


@query("response_failures", by_kind(reason={0: "valid", 4: "truncated_json", 8: "truncated_json", 10: "runaway_truncated_json", 11: "prefix_think_only", None: "other_invalid"}, roles={0: 1, 10: 21, 9: None, None: 0}, chars={k: None if v is None else len(v) for k, v in enumerate(KINDS)}))
def _(spark, d):
    f = responses.failure_features(F.col("text"))
    rows = responses_of(spark, d)
    reason = responses.failure_reason(F.coalesce("text", F.lit("")), F.col("id") % len(KINDS) == 0)
    return rows.select("id", reason.alias("reason"), f["role_mentions"].alias("roles"), f["generated_chars"].alias("chars"))


@query("response_burden", by_kind(has_events={4: False, 8: False, 9: False, 10: False, 11: False, None: True}, n_events={0: 1, 1: 1, 2: 3, None: 0}))
def _(spark, d):
    b = responses.burden(responses.final_object(F.col("text")), F.col("text"))
    return responses_of(spark, d).select("id", F.coalesce(b["has_events"], F.lit(False)).alias("has_events"), b["n_events"].alias("n_events"))


@query("payload_canonical_digests", "SELECT count(*) AS n_windows, count(DISTINCT k) AS n_structures, count(*) FILTER (k = 0) AS same_as_first FROM (SELECT CASE WHEN o_orderkey % 12 IN (0, 1, 2) THEN o_orderkey % 12 ELSE 3 END AS k FROM orders)")
def _(spark, d):
    rows = responses_of(spark, d).select(payload.digest(F.coalesce(payload.events(responses.final_object(F.col("text"))), F.array().cast(payload.EVENTS))).alias("k"))
    other = payload.digest(F.from_json(F.lit('{"e": [{"arguments": [{"text": "q"}, {"text": "z", "end": 6, "start": 5, "role": "R"}], "trigger": {"end": 2, "start": 1}, "event_type": "A:X"}]}'), f"e {payload.EVENTS}")["e"])
    return rows.agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct("k").alias("n_structures"), F.count_if(F.col("k") == other).alias("same_as_first"))


@query("completion_tokens", "SELECT o_orderkey AS id, least(o_orderkey % 9, 6) AS generated, o_orderkey % 9 < 6 AS ended, o_orderkey % 9 >= 6 AS hit_cap FROM orders")
def _(spark, d):
    k = (F.col("o_orderkey") % 9).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i == k, F.lit(2)).when(i > k, F.lit(3)).otherwise(F.lit(7)))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in responses.completion(ids, [2, 5], 6).items()])


@query("valid_length_pairs", "SELECT count(*) AS n, count(*) FILTER (a > 0 AND b > 0 AND CAST(a AS DOUBLE) / b BETWEEN 0.7::DOUBLE AND 1.3::DOUBLE AND a * 10 <= 400 AND b * 10 <= 400) AS n_valid FROM (SELECT l_quantity AS a, l_partkey % 60 AS b FROM lineitem)")
def _(spark, d):
    a, b = F.col("l_quantity"), F.col("l_partkey") % 60
    ok = payload.valid_length_pair(a, b, a * 10, b * 10, 400)
    return read(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"))


@query("text_leak_terms", r"SELECT doc_id, list_aggregate(list_filter(['the', 'und', 'les'], lambda t: regexp_matches(lower(coalesce(text, '')), concat('\b', t, '\b')) AND NOT regexp_matches(lower(coalesce(source, '')), concat('\b', t, '\b'))), 'string_agg', ',') AS terms FROM documents")
def _(spark, d):
    found = responses.leaks(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), ["the", "und", "les"])
    return read(spark, d, "documents").select("doc_id", F.nullif(F.array_join(found, ","), F.lit("")).alias("terms"))


@query("insertions_and_shifts", "SELECT o_orderkey AS id, concat_ws(' ', 'a', CASE WHEN o_orderkey % 3 = 1 THEN 'x y' END, 'b', CASE WHEN o_orderkey % 3 = 2 THEN 'x y' END, 'c') AS tokens, CASE WHEN o_orderkey % 3 = 1 THEN 3 ELSE 1 END AS b_start, CASE WHEN o_orderkey % 3 = 1 THEN 4 ELSE 2 END AS b_end, 'b' AS b_text FROM orders WHERE o_orderkey % 3 > 0")
def _(spark, d):
    at = (F.col("o_orderkey") % 3).cast("int")
    rows = read(spark, d, "orders").where(at > 0).select(F.col("o_orderkey").alias("id"), payload.inserted(F.array(F.lit("a"), F.lit("b"), F.lit("c")), at, F.array(F.lit("x"), F.lit("y"))).alias("t"), payload.shifted(F.lit(1), at, F.lit(2), False).alias("b_start"), payload.shifted(F.lit(2), at, F.lit(2), True).alias("b_end"))
    return rows.select("id", F.array_join("t", " ").alias("tokens"), "b_start", "b_end", payload.span_text(F.col("t"), F.col("b_start"), F.col("b_end")).alias("b_text"))


# Errors of whole windows

ERROR_SQL = f"""WITH g AS ({GOLD_SQL}), p AS ({predicted_sql(40)}), gt AS (SELECT DISTINCT wnd_id, event_type, s, e FROM g), pt AS (SELECT DISTINCT wnd_id, event_type, s, e FROM p),
  ga AS (SELECT DISTINCT wnd_id, event_type, s, e, a FROM g), pa AS (SELECT DISTINCT wnd_id, event_type, s, e, a FROM p),
  n AS (SELECT wnd_id, count(*) FILTER (k = 'gt') AS gt, count(*) FILTER (k = 'pt') AS pt, count(*) FILTER (k = 'bt') AS bt, count(*) FILTER (k = 'ga') AS ga, count(*) FILTER (k = 'pa') AS pa, count(*) FILTER (k = 'ba') AS ba, count(*) FILTER (k = 'gu') AS gu, count(*) FILTER (k = 'pu') AS pu, count(*) FILTER (k = 'bu') AS bu FROM (
    SELECT wnd_id, 'gt' AS k FROM gt UNION ALL SELECT wnd_id, 'pt' FROM pt UNION ALL SELECT wnd_id, 'bt' FROM (SELECT * FROM gt INTERSECT SELECT * FROM pt) UNION ALL SELECT wnd_id, 'ga' FROM ga UNION ALL SELECT wnd_id, 'pa' FROM pa
    UNION ALL SELECT wnd_id, 'ba' FROM (SELECT * FROM ga INTERSECT SELECT * FROM pa) UNION ALL SELECT wnd_id, 'gu' FROM (SELECT DISTINCT wnd_id, s, e FROM gt) UNION ALL SELECT wnd_id, 'pu' FROM (SELECT DISTINCT wnd_id, s, e FROM pt)
    UNION ALL SELECT wnd_id, 'bu' FROM (SELECT wnd_id, s, e FROM gt INTERSECT SELECT wnd_id, s, e FROM pt)) GROUP BY wnd_id),
  types AS (SELECT wnd_id, string_agg(event_type, '|' ORDER BY event_type) FILTER (k = 0) AS g, string_agg(event_type, '|' ORDER BY event_type) FILTER (k = 1) AS p FROM (SELECT wnd_id, event_type, 0 AS k FROM gt UNION ALL SELECT wnd_id, event_type, 1 FROM pt) GROUP BY wnd_id),
  near AS (SELECT x.wnd_id FROM (SELECT * FROM pt EXCEPT SELECT * FROM gt) x JOIN (SELECT * FROM gt EXCEPT SELECT * FROM pt) y USING (wnd_id, event_type) WHERE (x.s < y.e AND y.s < x.e) OR abs(x.s - y.s) + abs(x.e - y.e) <= 2),
  c AS (SELECT n.wnd_id, CASE WHEN gt = pt AND bt = gt AND ga = pa AND ba = ga THEN 'exact' WHEN gu = pu AND bu = gu AND gt = pt AND bt < gt THEN 'wrong_type'
    WHEN types.g = types.p AND gt = pt AND bt = gt - 1 AND n.wnd_id IN (SELECT wnd_id FROM near) THEN 'trigger_drift' WHEN gt = pt AND bt = gt AND ba = pa AND pa < ga THEN 'argument_omission'
    WHEN bt = pt AND pt < gt AND ba = pa THEN 'event_omission' WHEN bt = gt AND gt < pt AND ba = ga THEN 'extra_frame' END AS error FROM n JOIN types USING (wnd_id))"""


@query("window_error_classes", f"{ERROR_SQL} SELECT coalesce(error, 'several') AS error, count(*) AS n FROM c GROUP BY 1")
def _(spark, d):
    c = scoring.window_errors(gold(spark, d), predicted(spark, d, 40))
    return c.groupBy(F.coalesce("error", F.lit("several")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("diagnose_predicted_errors", f"""WITH g AS ({GOLD_SQL}), p AS ({predicted_sql()}), j AS (SELECT p.wnd_id, p.event_type, p.s, p.e, p.a, p.rid,
    coalesce(max(CASE WHEN p.event_type = g.event_type AND p.s = g.s AND p.e = g.e AND p.a = g.a THEN 1 END), 0) AS x1, coalesce(max(CASE WHEN p.event_type = g.event_type AND p.s = g.s AND p.e = g.e THEN 1 END), 0) AS x2,
    coalesce(max(CASE WHEN p.s = g.s AND p.e = g.e THEN 1 END), 0) AS x3, coalesce(max(CASE WHEN p.event_type = g.event_type THEN 1 END), 0) AS x4
    FROM (SELECT *, row_number() OVER () AS rid FROM p) p LEFT JOIN g ON p.wnd_id = g.wnd_id GROUP BY ALL)
  SELECT event_type, CASE WHEN x1 = 1 THEN 'exact' WHEN x2 = 1 THEN 'frame_match_arg_mismatch' WHEN x3 = 1 THEN 'same_trigger_wrong_type' WHEN x4 = 1 THEN 'same_type_wrong_trigger' ELSE 'extra_frame' END AS error, count(*) AS n FROM j GROUP BY ALL""")
def _(spark, d):
    return scoring.predicted_errors(gold(spark, d), predicted(spark, d)).groupBy("event_type", "error").agg(F.count(F.lit(1)).alias("n"))


@query("diagnose_row_buckets", f"""WITH f AS ({s1_sql('event_type, s, e, a')}) SELECT CASE WHEN tp > 0 THEN 'has_exact' WHEN n_pred > 0 AND n_gold > 0 THEN 'both_no_exact' WHEN n_gold > 0 THEN 'gold_only' WHEN n_pred > 0 THEN 'pred_only' ELSE 'empty_both' END AS bucket, count(*) AS n
  FROM (SELECT o_orderkey, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold FROM orders LEFT JOIN f ON wnd_id = o_orderkey) GROUP BY 1""")
def _(spark, d):
    every = read(spark, d, "orders").select(F.col("o_orderkey").alias("wnd_id"))
    return scoring.row_buckets(every, gold(spark, d), predicted(spark, d)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("score_weighted_quality", f"WITH t AS ({s1_sql('event_type, s, e')}), a AS ({s1_sql('event_type, s, e, a')}) SELECT wnd_id, round(0.40::DOUBLE * t.f1 + 0.60::DOUBLE * a.f1, 7) AS quality FROM t JOIN a USING (wnd_id)")
def _(spark, d):
    return scoring.weighted_quality(gold(spark, d), predicted(spark, d), 0.40, 0.60)


@query("score_s5_s6_conventions", f"""WITH f AS ({s1_sql('event_type, s, e')}) SELECT wnd_id, round(CASE WHEN n_pred = 0 THEN 1.0::DOUBLE ELSE CAST(tp AS DOUBLE) / n_pred END, 9) AS p5, round(CASE WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE CAST(tp AS DOUBLE) / n_gold END, 9) AS r5,
  round(CASE WHEN n_pred = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / n_pred END, 9) AS p6, round(CASE WHEN n_gold = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / n_gold END, 9) AS r6 FROM f""")
def _(spark, d):
    f = scoring.window_f1(gold(spark, d), predicted(spark, d))
    one = lambda n, empty: F.round(scoring.zero_safe(F.col("tp"), F.col(n), empty), 9)
    return f.select("wnd_id", one("n_pred", 1.0).alias("p5"), one("n_gold", 1.0).alias("r5"), one("n_pred", 0.0).alias("p6"), one("n_gold", 0.0).alias("r6"))


@query("event_free_suppression", f"""WITH g AS (SELECT * FROM ({GOLD_SQL}) WHERE event_type = 'R:F'), p AS (SELECT wnd_id, count(*) AS n FROM ({predicted_sql()}) WHERE event_type = 'R:F' GROUP BY wnd_id),
  n AS (SELECT o_orderkey AS wnd_id, o_orderkey % 5 <> 0 AS valid, coalesce(p.n, 0) AS n FROM orders LEFT JOIN p ON p.wnd_id = o_orderkey WHERE o_orderkey NOT IN (SELECT wnd_id FROM g))
  SELECT count(*) AS negative_rows, count(*) FILTER (valid) AS valid_rows, round(count(*) FILTER (valid) / CAST(count(*) AS DOUBLE), 9) AS valid_rate, round(count(*) FILTER (n = 0) / CAST(count(*) AS DOUBLE), 9) AS empty_rate, round(count(*) FILTER (valid AND n = 0) / CAST(count(*) AS DOUBLE), 9) AS strict_empty_rate, round(avg(n), 9) AS mean_predicted FROM n""")
def _(spark, d):
    every = read(spark, d, "orders").select(F.col("o_orderkey").alias("wnd_id"), (F.col("o_orderkey") % 5 != 0).alias("valid"))
    one = lambda df: df.where("event_type = 'R:F'")
    return scoring.suppression(every, one(gold(spark, d)), one(predicted(spark, d)))


@query("argument_change_mechanisms", f"""WITH g AS (SELECT DISTINCT wnd_id, event_type, s, e, a FROM ({GOLD_SQL})), b AS (SELECT DISTINCT wnd_id, event_type, s, e, a FROM ({predicted_sql(5)})), c AS (SELECT DISTINCT wnd_id, event_type, s, e, a FROM ({predicted_sql(3)})),
  u AS (SELECT wnd_id, event_type, s, e, a, max(g) AS g, max(b) AS b, max(c) AS c FROM (SELECT *, 1 AS g, 0 AS b, 0 AS c FROM g UNION ALL SELECT *, 0, 1, 0 FROM b UNION ALL SELECT *, 0, 0, 1 FROM c) GROUP BY ALL)
  SELECT CASE WHEN g = 0 AND b = 1 THEN 'removes_extra' WHEN g = 1 AND b = 0 THEN 'recovers_missing' WHEN g = 1 AND c = 0 THEN 'loses_correct' ELSE 'adds_extra' END AS mechanism, count(*) AS n FROM u WHERE b <> c GROUP BY 1""")
def _(spark, d):
    return scoring.argument_changes(gold(spark, d), predicted(spark, d, 5), predicted(spark, d, 3)).groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"))
