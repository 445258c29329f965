"""Queries over votes, spreads, carriers, gates and quotas, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import consensus
from .plans.roles import read, samples, samples_sql
from .queries import query

KEY = "wnd_id, event_type, s, e"
VOTES_SQL = f"""r AS (SELECT *, a % 2 AS event FROM ({samples_sql()})), f AS (SELECT *, min(event) OVER (PARTITION BY {KEY}, k) AS first FROM r),
  u AS (SELECT DISTINCT {KEY}, k, a FROM f WHERE event = first), v AS (SELECT {KEY}, count(DISTINCT k) AS votes FROM u GROUP BY ALL HAVING count(DISTINCT k) >= 2),
  x AS (SELECT {KEY}, a FROM u GROUP BY ALL HAVING count(DISTINCT k) >= 2),
  w AS (SELECT {KEY}, votes, coalesce(string_agg(a, ',' ORDER BY a), '') AS arguments FROM v LEFT JOIN x USING ({KEY}) GROUP BY ALL)"""


def sampled(spark, d):
    return samples(spark, d).withColumn("event", F.col("a") % 2)


@query("vote_events_then_arguments", f"WITH {VOTES_SQL} SELECT * FROM w")
def _(spark, d):
    return consensus.event_votes(sampled(spark, d), 2).withColumn("arguments", F.array_join("arguments", ","))


@query("vote_carriers", f"""WITH {VOTES_SQL}, t AS (SELECT wnd_id, string_agg(concat(event_type, '|', s, '|', e, '|', arguments), ';' ORDER BY concat(event_type, '|', s, '|', e, '|', arguments)) AS structure FROM w GROUP BY wnd_id),
  y AS (SELECT {KEY}, k, string_agg(a, ',' ORDER BY a) AS arguments FROM (SELECT DISTINCT {KEY}, k, a FROM r) GROUP BY ALL),
  z AS (SELECT wnd_id, k, string_agg(concat(event_type, '|', s, '|', e, '|', arguments), ';' ORDER BY concat(event_type, '|', s, '|', e, '|', arguments)) AS structure FROM y GROUP BY ALL)
  SELECT wnd_id, k FROM z JOIN t USING (wnd_id, structure) WHERE (wnd_id + k) % 5 <> 0""")
def _(spark, d):
    voted = consensus.structures(consensus.event_votes(sampled(spark, d), 2), ["wnd_id"])
    events = samples(spark, d).groupBy(*consensus.EVENT, "k").agg(F.collect_set("a").alias("arguments"))
    return consensus.carriers(voted, consensus.structures(events, ["wnd_id", "k"]), "wnd_id", "structure", (F.col("wnd_id") + F.col("k")) % 5 != 0).select("wnd_id", "k")


@query("sample_spread", f"""WITH p AS (SELECT wnd_id, k, count(*) AS mentions, sum(e - s + a) AS length, string_agg(event_type, ',' ORDER BY event_type) AS types FROM ({samples_sql()}) GROUP BY ALL),
  c AS (SELECT wnd_id, max(n) / sum(n) AS consensus, count(*) / sum(n) AS u FROM (SELECT wnd_id, types, count(*) AS n FROM p GROUP BY ALL) GROUP BY wnd_id)
  SELECT wnd_id, round(avg(mentions), 9) AS mentions_mean, round(stddev_pop(mentions), 9) AS mentions_std, round(avg(length), 9) AS length_mean, round(stddev_pop(length), 9) AS length_std, round(any_value(consensus), 9) AS types_consensus, round(any_value(u), 9) AS types_unique_rate FROM p JOIN c USING (wnd_id) GROUP BY wnd_id""")
def _(spark, d):
    per = samples(spark, d).groupBy("wnd_id", "k").agg(F.count(F.lit(1)).alias("mentions"), F.sum(F.expr("e - s + a")).alias("length"), F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("types"))
    return consensus.spread(per, "wnd_id", ["mentions", "length"], ["types"])


@query("early_exit_gate", """WITH m AS (SELECT o_orderpriority AS metric, avg((o_orderkey % 7)::DOUBLE) AS greedy, avg((o_custkey % 7)::DOUBLE) AS "full", avg((o_orderkey % 7 + o_custkey % 7)::DOUBLE) / 2 AS adaptive FROM orders GROUP BY 1),
  c AS (SELECT metric, CASE WHEN "full" > greedy THEN 'retain_positive_full_sc_gain' ELSE 'match_nonpositive_full_sc' END AS criterion,
    CASE WHEN "full" > greedy THEN adaptive - greedy + 1e-12 >= 0.4 * ("full" - greedy) ELSE adaptive + 1e-12 >= "full" - 0.01 END AS reference_pass, adaptive + 1e-12 >= greedy - 0.02 AS floor_pass FROM m)
  SELECT *, reference_pass AND floor_pass AS passed FROM c UNION ALL SELECT 'all', 'cost', bool_and(reference_pass), bool_and(floor_pass), bool_and(reference_pass AND floor_pass) AND 4 <= 5 FROM c""")
def _(spark, d):
    mean = lambda c: F.avg(F.expr(c).cast("double"))
    scores = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(mean("o_orderkey % 7").alias("greedy"), mean("o_custkey % 7").alias("full"), (mean("o_orderkey % 7 + o_custkey % 7") / 2).alias("adaptive"))
    return consensus.early_exit_gate(scores, 4.0, 5.0, 0.4, 0.01, 0.02)


@query("protocol_integrity", """WITH p AS (SELECT o_orderkey % 3 AS run, count(*) AS n, count(DISTINCT o_custkey) AS keys, count(o_custkey) AS present, sum(o_orderkey % 5) AS golds, count(*) FILTER (o_orderstatus = 'O') AS same FROM orders GROUP BY 1),
  c AS (SELECT count(*) = 3 AS runs, bool_and(n = 500) AS examples, bool_and(same = n) AS protocol, true AS cap, bool_and(present = n) AS keys_present, bool_and(keys = 500 AND keys = n) AS keys_unique, bool_and(golds = 1000) AS golds FROM p)
  SELECT unnest(['runs', 'examples', 'protocol', 'cap', 'keys_present', 'keys_unique', 'golds', 'all']) AS "check", unnest([runs, examples, protocol, cap, keys_present, keys_unique, golds, runs AND examples AND protocol AND cap AND keys_present AND keys_unique AND golds]) AS passed FROM c""")
def _(spark, d):
    k = F.col("o_orderkey")
    runs = read(spark, d, "orders").select((k % 3).alias("run"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("protocol"), F.lit(512).alias("cap"), (k % 5).alias("golds"))
    return consensus.protocol_checks(runs, "run", "key", "protocol", "cap", "golds", {"runs": 3, "examples": 500, "protocol": "O", "cap": 512, "keys": 500, "golds": 1000})


@query("exact_quota_matching")
def _(spark, d):
    n, flag = F.col("l_linenumber"), F.concat("l_returnflag", F.lit(":"), "l_linestatus")
    options = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("wnd_id"), flag.alias("category"), consensus.proposal_cost(n < 3, F.col("l_quantity").cast("int"), "1140", F.col("l_orderkey"), flag).alias("cost"))
    return consensus.exact_quotas(options, "wnd_id", "category", "cost", {"A:F": 12, "N:O": 20, "R:F": 8})


@query("token_difference_mask", "SELECT p_partkey AS id, array_to_string(range(0, least(3, len(string_split(p_name, ' ')))), ',') AS chosen FROM part WHERE len(string_split(p_name, ' ')) > 1")
def _(spark, d):
    words = F.split("p_name", " ")
    pairs = read(spark, d, "part").select(F.col("p_partkey").alias("id"), words.alias("a"), F.transform(words, lambda w, i: F.when(i == 1, "#").otherwise(w)).alias("b")).where(F.size("a") > 1)
    return pairs.select("id", consensus.token_differences("a", "b").alias("at")).select("id", F.array_join("at.chosen", ",").alias("chosen"))
