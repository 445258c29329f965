"""Queries over joins, selections and mixtures, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import matching, picking, selection
from .plans.roles import GOLD_SQL, dealt, gold, predicted, predicted_sql, read
from .queries import RUN_SQL, query, run_table

# Characters: an item of a document begins and ends at some character, sentences are 20 characters long.
ITEM_SQL = "SELECT l_orderkey AS doc, l_linenumber AS item, l_linenumber * 10 + l_partkey % 7 AS start, l_linenumber * 10 + l_partkey % 7 + 1 + l_suppkey % 9 AS \"end\" FROM lineitem"
SPAN_SQL = "SELECT o_orderkey AS doc, k AS span, k * 20 AS s, k * 20 + 20 AS e FROM orders, generate_series(0, 2) t(k)"


def items(spark, d):
    start = F.col("l_linenumber") * 10 + F.col("l_partkey") % 7
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item"), start.alias("start"), (start + 1 + F.col("l_suppkey") % 9).alias("end"))


def spans(spark, d):
    k = F.col("span")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("span")).select("doc", "span", (k * 20).alias("s"), (k * 20 + 20).alias("e"))


@query("interval_containment", f'WITH i AS ({ITEM_SQL}), s AS ({SPAN_SQL}) SELECT i.doc, i.item, min(s.span) AS span, count(*) OVER (PARTITION BY i.doc) AS n FROM i LEFT JOIN s ON s.doc = i.doc AND s.s <= i.start AND i."end" <= s.e GROUP BY i.doc, i.item, i.start, i."end", i.rowid'.replace(", i.rowid", ""))
def _(spark, d):
    found = matching.contained(items(spark, d), spans(spark, d), "doc", 20).select("doc", "item", "start", "end", "span").distinct()
    n = found.groupBy(F.col("doc").alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, F.col("doc") == F.col("_d")).select("doc", "item", "span", "n")


@query("relations_within_a_span", f'WITH i AS (SELECT DISTINCT doc, item, start, "end" FROM ({ITEM_SQL})), m AS (SELECT i.doc, i.item, s.span FROM i JOIN ({SPAN_SQL}) s ON s.doc = i.doc AND s.s <= i.start AND i."end" <= s.e), r AS (SELECT DISTINCT doc, item AS a, item + 1 AS b FROM ({ITEM_SQL})) SELECT DISTINCT r.doc, r.a, r.b, x.span FROM r JOIN m x ON x.doc = r.doc AND x.item = r.a JOIN m y ON y.doc = r.doc AND y.item = r.b AND x.span = y.span')
def _(spark, d):
    members = matching.contained(items(spark, d).distinct(), spans(spark, d), "doc", 20).where("span IS NOT NULL").select("doc", F.col("item").alias("member"), "span")
    relations = items(spark, d).select("doc", F.col("item").alias("a"), (F.col("item") + 1).alias("b")).distinct()
    return matching.both_within(relations, members, "doc").distinct()


@query("char_to_token_offsets", f'WITH i AS ({ITEM_SQL}), t AS (SELECT o_orderkey AS doc, k AS i, k * 3 AS s, k * 3 + 3 AS e FROM orders, generate_series(0, 24) t(k)) SELECT i.doc, i.item, i.start, i."end", a.i AS first_token, b.i AS last_token FROM i LEFT JOIN t a ON a.doc = i.doc AND a.s = i.start LEFT JOIN t b ON b.doc = i.doc AND b.e = i."end"')
def _(spark, d):
    k = F.col("i")
    tokens = dealt(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")).select("doc", "i", (k * 3).alias("s"), (k * 3 + 3).alias("e"))
    return matching.token_offsets(items(spark, d), tokens, "doc")


@query("join_key_problems", f"WITH a AS (SELECT o_orderkey AS id FROM orders), b AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber < 3), n AS (SELECT id, max(l) AS l, max(r) AS r FROM (SELECT id, count(*) AS l, 0 AS r FROM a GROUP BY id UNION ALL SELECT id, 0, count(*) FROM b GROUP BY id) GROUP BY id) SELECT count(*) FILTER (r = 0) AS only_left, count(*) FILTER (l = 0) AS only_right, count(*) FILTER (l > 1) AS repeated_left, count(*) FILTER (r > 1) AS repeated_right FROM n")
def _(spark, d):
    b = read(spark, d, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("id"))
    return matching.key_problems(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), b, "id")


@query("join_by_position", "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS x FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 9 = 0 THEN 'Z' ELSE o_orderstatus END AS x FROM orders WHERE o_orderkey >= 0) SELECT i AS position, a.x AS left_digest, b.x AS right_digest FROM a FULL JOIN b USING (i) WHERE a.x IS DISTINCT FROM b.x")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("x"))
    other = o.withColumn("x", F.when(F.col("k") % 9 == 0, "Z").otherwise(F.col("x")))
    return matching.by_position(o, other, [F.col("k")], [F.col("k")], F.col("x"))


@query("sample_pair_wins", f"WITH g AS ({RUN_SQL}) SELECT a.doc, count(*) AS n_pairs, round(avg(CASE WHEN b.gain >= a.score * 2 + 0.5 THEN 1.0 ELSE 0.0 END), 9) AS p_win FROM g a JOIN g b ON a.doc = b.doc GROUP BY a.doc")
def _(spark, d):
    r = run_table(spark, d).select("doc", F.col("gain").cast("double").alias("s"))
    return matching.sample_wins(run_table(spark, d).select("doc", (F.col("score") * 2).alias("s")), r, "doc", "s", 0.5)


@query("sample_disagreement", f"WITH a AS (SELECT wnd_id, s, string_agg(event_type, '|' ORDER BY event_type) AS sig FROM ({GOLD_SQL}) GROUP BY ALL), b AS (SELECT wnd_id, s, string_agg(event_type, '|' ORDER BY event_type) AS sig FROM ({predicted_sql()}) GROUP BY ALL) SELECT wnd_id, round(avg(CASE WHEN a.sig <> b.sig THEN 1.0 ELSE 0.0 END), 9) AS disagreement FROM a JOIN b USING (wnd_id, s) GROUP BY wnd_id")
def _(spark, d):
    sig = lambda m: m.groupBy("wnd_id", "s").agg(F.array_join(F.array_sort(F.collect_list("event_type")), "|").alias("sig"))
    return matching.sample_disagreement(sig(gold(spark, d)), sig(predicted(spark, d)), "wnd_id", "s", "sig")


@query("retry_merge", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1 AND (o_orderkey % 5 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0)) THEN 'retry' ELSE 'parent' END AS chosen, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1 AND (o_orderkey % 5 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0)) THEN o_custkey ELSE -o_custkey END AS value FROM orders")
def _(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    row = lambda ok, bad, v: (k.alias("id"), ok.alias("accepted"), bad.alias("parse_error"), v.alias("value"))
    return matching.retry_merge(o.select(*row(k % 3 == 0, k % 2 == 0, -F.col("o_custkey"))), o.where(k % 4 != 1).select(*row(k % 5 == 0, k % 7 == 0, F.col("o_custkey"))), "id")


PRIOR_SQL = f"WITH r AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE id % 4 END AS a, id % 6 AS b, gain > 0 AS better FROM ({RUN_SQL})), e AS (SELECT avg(CASE WHEN better THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS g FROM r), p AS (SELECT a, b, count(*) AS n, avg(CASE WHEN better THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM r WHERE a IS NOT NULL GROUP BY a, b), q AS (SELECT a, b, n, round(rate, 9) AS rate, round(CASE WHEN n >= 110 THEN greatest(0.0::DOUBLE, (rate - g) / greatest(1e-8, 1 - g)) ELSE 0.0::DOUBLE END, 9) AS prior FROM p, e)"


def pairs(spark, d):
    i = F.col("id")
    return run_table(spark, d).select("id", F.when(i % 11 != 0, i % 4).alias("a"), (i % 6).alias("b"), (F.col("gain") > 0).alias("better"))


@query("pair_prior", f"{PRIOR_SQL} SELECT * FROM q")
def _(spark, d):
    return matching.pair_prior(pairs(spark, d), ["a", "b"], F.col("better"), 110)


@query("pair_prior_lookup", f"{PRIOR_SQL} SELECT id, coalesce(prior, 0) AS prior FROM r LEFT JOIN q USING (a, b)")
def _(spark, d):
    rows = pairs(spark, d)
    return matching.with_prior(rows, matching.pair_prior(rows, ["a", "b"], F.col("better"), 110), ["a", "b"]).select("id", "prior")


@query("row_problem_audit", "SELECT l_orderkey AS id, l_linenumber AS line, concat_ws(',', CASE WHEN l_quantity < 3 THEN 'quantity' END, CASE WHEN l_returnflag = 'R' THEN 'flag' END) AS problems, l_partkey AS part FROM lineitem WHERE l_quantity < 3 OR l_returnflag = 'R'")
def _(spark, d):
    found = matching.problems({"quantity": F.col("l_quantity") >= 3, "flag": F.col("l_returnflag") != "R"})
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array_join(found, ",").alias("problems"), F.col("l_partkey").alias("part"))
    return rows.where("problems <> ''")


@query("pooled_windows", "SELECT l_orderkey AS id, first(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS signature, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS splits, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linestatus", "l_returnflag", "l_linenumber", "l_partkey")
    return matching.pooled(rows, "id", "l_linestatus", F.col("l_returnflag"), F.struct("l_linenumber", "l_partkey", "l_returnflag"))


@query("seed_gaps", "SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n_seeds FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(*) <> 3 OR count(DISTINCT l_linenumber) <> 3")
def _(spark, d):
    return matching.seed_gaps(read(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("id"), "l_linenumber"), "id", "l_linenumber", 3)


@query("sibling_gate", f"SELECT wnd_id, bool_or(split_part(event_type, ':', 1) = 'N') AS take_direct FROM ({GOLD_SQL}) GROUP BY wnd_id")
def _(spark, d):
    c = gold(spark, d).groupBy("wnd_id").agg(F.collect_set("event_type").alias("c"))
    return c.select("wnd_id", matching.unseen_family(F.col("c"), ["A:F", "R:O"]).alias("take_direct"))


# Selections and mixtures

HASHED = "row_number() OVER (ORDER BY sha256('{seed}:' || CAST(o_orderkey AS VARCHAR)))"


@query("select_with_negatives", f"WITH p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT o_orderkey AS id, {HASHED.format(seed='5')} AS r FROM orders WHERE o_orderstatus <> 'F') SELECT id FROM p UNION ALL SELECT id FROM n WHERE r <= (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM p)")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"))
    return picking.with_negatives(o, F.col("st") == "F", "id", 0.25, "5").select("id")


@query("ratio_holdout", f"SELECT o_orderkey AS id, {HASHED.format(seed='8')} <= floor((SELECT count(*) FROM orders) * 0.1) AS held_out FROM orders")
def _(spark, d):
    return picking.ratio_split(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.1, "8")


@query("route_strategies", f"WITH r AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE score END AS score FROM ({RUN_SQL})), n AS (SELECT CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS cap FROM r), t AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, id DESC) AS k, row_number() OVER (ORDER BY sha256('0:' || CAST(id AS VARCHAR))) AS h FROM r) SELECT id, k <= cap AND score IS NOT NULL AS top, coalesce(score >= 0.9, false) AS threshold, k <= cap AND coalesce(score >= 0.9, false) AS top_threshold, h <= cap AS random FROM t, n")
def _(spark, d):
    r = run_table(spark, d).select("id", F.when(F.col("id") % 13 != 0, F.col("score")).alias("score"))
    out = r.select("id")
    for name, threshold in (("top", None), ("threshold", 0.9), ("top_threshold", 0.9), ("random", None)):
        one = picking.routed(r, name, "score", "id", 0.2, "0", threshold).select(F.col("id").alias("_id"), F.col("routed").alias(name))
        out = out.join(one, F.col("id") == F.col("_id")).drop("_id")
    return out


@query("threshold_for_count", f"SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM ({RUN_SQL})) WHERE r = 40")
def _(spark, d):
    return picking.top_score(run_table(spark, d), "score", 40)


@query("repeat_to_quota", "WITH s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), k AS (SELECT CAST(floor(2.5 * n) AS BIGINT) AS want, n FROM s LIMIT 1) SELECT s.id, t.c AS copy FROM s, k, generate_series(0, 2) t(c) WHERE t.c * s.n + s.i < k.want")
def _(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return picking.repeated_to(s, [F.col("id")], int(2.5 * s.count()))


@query("mix_direct_contrast", "WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY sha256('2:' || CAST(o_orderkey AS VARCHAR))) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'P'), w AS (SELECT CAST(round_even(count(*) * 3.0 / 2.0, 0) AS BIGINT) AS want FROM a) SELECT id, 0 AS copy, 'direct' AS origin FROM a UNION ALL SELECT id, c, 'contrast' FROM b, w, generate_series(0, 999) t(c) WHERE c * n + i < want")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"))
    return picking.mixed(o.where("st = 'F'").select("id"), o.where("st = 'P'").select("id"), 2.0, 3.0, "id", "2")


@query("category_caps", "WITH s AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT max(t) AS t FROM (SELECT t.t, sum(least(n, floor(CASE g WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.4 ELSE 0.2 END * t.t + 1e-12))) AS got FROM s, generate_series(0, 900) t(t) GROUP BY t.t) WHERE got >= t), w AS (SELECT o_orderkey AS id, o_orderstatus AS g FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('4:' || CAST(o_orderkey AS VARCHAR))) AS r FROM orders), t WHERE r <= floor(CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.4 ELSE 0.2 END * t + 1e-12)) SELECT id, g FROM (SELECT *, row_number() OVER (ORDER BY sha256('4:' || CAST(id AS VARCHAR))) AS r FROM w), t WHERE r <= t")
def _(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("g"))
    return picking.capped(o, "g", {"F": 0.5, "O": 0.4, "P": 0.2}, "id", "4", 900)


@query("selector_budgets", f"WITH s AS (SELECT 'score' AS selector, score AS v, id FROM ({RUN_SQL}) UNION ALL SELECT 'gain', CAST(gain AS DOUBLE), id FROM ({RUN_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY v DESC, id DESC) AS k, count(*) OVER (PARTITION BY selector) AS n FROM s) SELECT selector, b AS budget, count(*) AS n, min(v) AS least_score FROM r, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(b) WHERE k <= round_even(n * b, 0) GROUP BY ALL")
def _(spark, d):
    return picking.by_selectors(run_table(spark, d), {"score": F.col("score"), "gain": F.col("gain").cast("double")}, "id", [0.05, 0.1, 0.2])


@query("hard_distractors", "WITH c AS (SELECT o_orderkey AS id, t, CASE t WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.5 ELSE 0.9 END AS h FROM orders, (VALUES ('F'), ('O'), ('P'), ('Q')) x(t) WHERE t <> o_orderstatus) SELECT id, string_agg(t, ',' ORDER BY h DESC, sha256(concat('6:', id, ':', t))) AS ranked FROM c GROUP BY id")
def _(spark, d):
    hard = F.create_map(*[F.lit(x) for x in ("F", 0.5, "O", 0.5, "P", 0.9, "Q", 0.9)])
    every = F.array(*map(F.lit, "FOPQ"))
    ranked = picking.distractors(F.array("o_orderstatus"), every, hard, "6", F.col("o_orderkey"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(ranked, ",").alias("ranked"))


@query("nll_budget_labels", f"WITH r AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE score END AS delta FROM ({RUN_SQL})), k AS (SELECT id, row_number() OVER (ORDER BY delta DESC NULLS LAST, id DESC) AS rank, count(*) OVER () AS n FROM r) SELECT id, rank, CASE WHEN rank <= round_even(n * 0.15, 0) THEN 'reason' ELSE 'direct' END AS label FROM k")
def _(spark, d):
    return picking.budget_labels(run_table(spark, d).select("id", F.when(F.col("id") % 13 != 0, F.col("score")).alias("delta")), "delta", "id", 0.15)


@query("outcome_margin_labels", f"WITH r AS ({RUN_SQL}), k AS (SELECT id, row_number() OVER (ORDER BY gain DESC, id DESC) AS k FROM r WHERE y = 1 AND gain > 1) SELECT r.id, CASE WHEN k.k <= (SELECT round_even(count(*) * 0.05, 0) FROM r) THEN 'reason' ELSE 'direct' END AS label FROM r LEFT JOIN k USING (id)")
def _(spark, d):
    return picking.margin_labels(run_table(spark, d), "gain", F.col("y") == 1, "id", 0.05, 1)


@query("type_universe", f"WITH g AS (SELECT DISTINCT event_type, wnd_id % 10 < 8 AS train FROM ({GOLD_SQL})), a AS (SELECT DISTINCT event_type AS t FROM g) SELECT (SELECT string_agg(t, ',' ORDER BY t) FROM a) AS all_types, (SELECT string_agg(t, ',' ORDER BY t) FROM a WHERE t <> 'R:F') AS seen, concat_ws(',', (SELECT string_agg(t, ',' ORDER BY t) FROM a WHERE t <> 'R:F'), 'R:F') AS candidates")
def _(spark, d):
    types = gold(spark, d).select("event_type").union(predicted(spark, d).select("event_type")).distinct().agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    unseen = F.array(F.lit("R:F"))
    seen = F.array_except("t", unseen)
    return types.select(F.array_join("t", ",").alias("all_types"), F.array_join(seen, ",").alias("seen"), F.array_join(F.concat(seen, F.array_sort(unseen)), ",").alias("candidates"))


@query("type_frequency_tiers", f"SELECT event_type, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'ultra_tail' WHEN count(*) < 5000 THEN 'tail' WHEN count(*) < 20000 THEN 'mid' ELSE 'head' END AS tier FROM ({GOLD_SQL}) GROUP BY event_type")
def _(spark, d):
    n = gold(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("tier", selection.frequency_tier(F.col("n"), (1000, 5000, 20000)))
