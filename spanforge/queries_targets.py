"""Queries over training targets, schema features, lexicons and audits, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import targets
from .operators import audits
from .plans.roles import GOLD_SQL, gold, read
from .queries import RUN_SQL, query, run_table

SCHEMA = {"A:F": (["r0", "r1"], ["t1", "t2"]), "A:O": (["r1"], ["t2"]), "N:O": (["r0", "r2"], ["t3"]), "N:F": (["r2"], ["t4"]), "R:F": (["r1", "r2"], ["t1", "t5"]), "R:O": (["r0"], ["t5"]), "Q:X": (["r0", "r1", "r2"], ["t9"])}
CANDIDATES = ["A:F", "N:O", "R:F", "Q:X"]
SCHEMA_SQL = "(VALUES " + ", ".join(f"('{t}', {r}, {c})" for t, (r, c) in SCHEMA.items()) + ") s(t, roles, cues)"
E_SQL = """concat('{"event_type":"', event_type, '","trigger":', tr, ',"arguments":[{"role":"r', a % 3, '","text":"p', a, '","start":', a, ',"end":', a + 1, '}]}')"""
G_SQL = f"""SELECT *, {E_SQL} AS ev, row_number() OVER (PARTITION BY wnd_id ORDER BY s, event_type, a) - 1 AS i FROM (SELECT *, concat('{{"text":"t', s, '","start":', s, ',"end":', e, '}}') AS tr FROM ({GOLD_SQL}))"""


def schema():
    one = lambda r, c: F.struct(F.array(*map(F.lit, r)).alias("roles"), F.array(*map(F.lit, c)).alias("cues"))
    return F.create_map(*[x for t, (r, c) in SCHEMA.items() for x in (F.lit(t), one(r, c))])


def nested(spark, d):
    """Gold windows with their events in order of (s, type, argument)."""
    role, a = F.concat(F.lit("r"), (F.col("a") % 3).cast("string")), F.col("a").cast("int")
    argument = F.struct(role.alias("role"), F.concat(F.lit("p"), F.col("a").cast("string")).alias("text"), a.alias("start"), (a + 1).alias("end"))
    trigger = F.struct(F.concat(F.lit("t"), F.col("s").cast("string")).alias("text"), F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"))
    rows = gold(spark, d).select("wnd_id", F.struct("s", "event_type", "a", F.struct("event_type", trigger.alias("trigger"), F.array(argument).alias("arguments")).alias("ev")).alias("x"))
    return rows.groupBy("wnd_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ev"]).alias("events"))


def target_sql(**lists: str) -> str:
    parts = ", ',', ".join(f"""'"{n}":[', string_agg({x}, ',' ORDER BY i), ']'""" for n, x in {**lists, "events": "ev"}.items())
    return f"SELECT wnd_id, concat('{{', {parts}, '}}') AS target FROM ({G_SQL}) GROUP BY wnd_id"


def target(spark, d, f):
    return nested(spark, d).select("wnd_id", f(F.col("events")).alias("target"))


@query("target_minimal_plan", target_sql(plans="""concat('{"event_type":"', event_type, '","trigger":', tr, '}')"""))
def _(spark, d):
    return target(spark, d, targets.minimal_plan)


@query("target_pointer_plan", target_sql(plans=f"""concat('{{"candidate_id":', coalesce(list_position({CANDIDATES}, event_type), 0), ',"trigger":', tr, '}}')"""))
def _(spark, d):
    return target(spark, d, lambda e: targets.pointer_plan(e, F.array(*map(F.lit, CANDIDATES))))


@query("target_checklist", target_sql(clues="tr", decisions="""concat('{"clue_id":', i, ',"event_type":"', event_type, '","status":"supported"}')"""))
def _(spark, d):
    return target(spark, d, targets.checklist)


@query("target_hybrid", target_sql(clues="tr", decisions="""concat('{"clue_id":', i, ',"event_type":"', event_type, '","reason":"trigger and roles support this type","status":"supported"}')"""))
def _(spark, d):
    return target(spark, d, lambda e: targets.checklist(e, reasons=True))


@query("target_structured_short", target_sql(reasoning="""concat('{"trigger":', tr, ',"event_type":"', event_type, '","focus_roles":["r', a % 3, '"],"status":"supported"}')"""))
def _(spark, d):
    return target(spark, d, targets.structured_short)


ROLES = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{', '.join(r)}'" for t, (r, _) in SCHEMA.items()) + " END"


@query("target_structured", target_sql(reasoning=rf"""concat('{{"trigger_clue":"The phrase \"t', s, '\" at tokens [', s, ', ', e, ') is an event clue.","type_decision":"Among the candidate types, this clue best matches ', event_type, '.","schema_focus":"For ', event_type, ', focus on core roles: ', {ROLES}, '.","argument_reasoning":"The text supports r', a % 3, ' = \"p', a, '\" at tokens [', a, ', ', a + 1, ').","schema_check":"The trigger and extracted arguments are consistent with the ', event_type, ' schema."}}')"""))
def _(spark, d):
    return target(spark, d, lambda e: targets.structured(e, schema()))


J = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"
SEEN, CUE = "[concat('r', g.a % 3)]", "[concat('t', g.s)]"
EVENT_SQL = f"g AS (SELECT *, split_part(event_type, ':', 1) AS fam FROM ({G_SQL})), c AS (SELECT t, roles, cues, split_part(t, ':', 1) AS fam FROM {SCHEMA_SQL}), o AS (SELECT * FROM c WHERE list_contains({CANDIDATES}, t))"


@query("target_contrast_codes", f"""WITH {EVENT_SQL}, x AS (SELECT g.wnd_id, g.i, g.event_type, g.fam, o.t, own.roles AS own_roles, own.cues AS own_cues, g.a, g.s, o.fam AS ofam,
    CAST(o.fam = g.fam AS INT) * 10.0::DOUBLE + {J.format(SEEN, 'o.roles')} * 4 + {J.format(CUE, 'o.cues')} * 2 + {J.format('own.roles', 'o.roles')} + {J.format('own.cues', 'o.cues')} AS score FROM g JOIN c own ON own.t = g.event_type JOIN o ON o.t <> g.event_type),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wnd_id, i ORDER BY score DESC, t DESC) AS k FROM x) WHERE k = 1)
  SELECT wnd_id, i, CASE WHEN score > 0 THEN t ELSE '' END AS contrast_type, CASE WHEN score > 0 AND ofam = g.fam THEN 'family_boundary' WHEN {J.format(SEEN, 'own_roles')} > 0 AND {J.format(SEEN, 'own_roles')} >= {J.format(CUE, 'own_cues')} THEN 'role_signature' WHEN {J.format(CUE, 'own_cues')} > 0 THEN 'trigger_signature' ELSE 'context_support' END AS reason_code FROM b g""")
def _(spark, d):
    cand = F.array(*map(F.lit, CANDIDATES))
    rows = target(spark, d, lambda e: targets.contrastive(e, cand, schema()))
    parsed = F.from_json("target", "decisions array<struct<contrast_type:string,reason_code:string>>")["decisions"]
    return rows.select("wnd_id", F.posexplode(parsed).alias("i", "x")).select("wnd_id", "i", "x.contrast_type", "x.reason_code")


@query("target_candidate_reviews", f"""WITH {EVENT_SQL}, x AS (SELECT g.wnd_id, g.i, g.event_type, o.t, o.fam = g.fam OR {J.format('o.roles', 'own.roles')} >= 0.5 AS better, {J.format('o.cues', CUE)} > 0 OR {J.format('o.cues', 'own.cues')} > 0 OR {J.format('o.roles', SEEN)} > 0 AS near,
    CAST(o.fam = g.fam AS INT) * 10.0::DOUBLE + {J.format('o.roles', SEEN)} * 4 + {J.format('o.roles', 'own.roles')} * 2 + greatest({J.format('o.cues', CUE)}, {J.format('o.cues', 'own.cues')}) AS score FROM g JOIN c own ON own.t = g.event_type JOIN o ON true),
  b AS (SELECT *, row_number() OVER (PARTITION BY wnd_id, t ORDER BY score DESC, i) AS k, bool_or(event_type = t) OVER (PARTITION BY wnd_id, t) AS have FROM x)
  SELECT wnd_id, t AS event_type, CASE WHEN have THEN 'supported' ELSE 'rejected' END AS status, CASE WHEN have THEN 'supported' WHEN better THEN 'better_type_match' WHEN near THEN 'role_mismatch' ELSE 'trigger_mismatch' END AS reason_code, CASE WHEN NOT have AND (better OR near) THEN event_type ELSE '' END AS contrast_type FROM b WHERE k = 1""".replace("SELECT wnd_id, t AS event_type, CASE", "SELECT wnd_id, t AS event_type, CASE", 1))
def _(spark, d):
    cand = F.array(*map(F.lit, CANDIDATES))
    return nested(spark, d).select("wnd_id", F.inline(targets.candidate_reviews(F.col("events"), cand, schema())))


@query("target_role_checks", f"""WITH {EVENT_SQL}, w AS (SELECT g.wnd_id, g.i, g.event_type, list_position(own.roles, r.r) AS k, r.r AS role, CASE WHEN r.r = concat('r', g.a % 3) THEN 'present' ELSE 'absent' END AS status FROM g JOIN c own ON own.t = g.event_type, unnest(own.roles) r(r)
    UNION ALL SELECT g.wnd_id, g.i, g.event_type, 99, concat('r', g.a % 3), 'present' FROM g JOIN c own ON own.t = g.event_type WHERE NOT list_contains(own.roles, concat('r', g.a % 3)))
  SELECT wnd_id, n, event_type, role, status FROM (SELECT *, row_number() OVER (PARTITION BY wnd_id ORDER BY i, k) - 1 AS n FROM w) WHERE n < 8""")
def _(spark, d):
    rows = nested(spark, d).select("wnd_id", F.posexplode(targets.role_checks(F.col("events"), schema(), 8)).alias("n", "x"))
    return rows.select("wnd_id", "n", "x.event_type", "x.role", "x.status")


@query("schema_ambiguity", f"""WITH c AS (SELECT t, roles, cues, split_part(t, ':', 1) AS fam FROM {SCHEMA_SQL}), w AS (SELECT DISTINCT wnd_id, event_type AS t FROM ({GOLD_SQL})), p AS (SELECT x.wnd_id, 0.5::DOUBLE * CAST(a.fam = b.fam AS INT) + 0.3::DOUBLE * {J.format('a.roles', 'b.roles')} + 0.2::DOUBLE * {J.format('a.cues', 'b.cues')} AS s FROM w x JOIN w y ON x.wnd_id = y.wnd_id AND x.t < y.t JOIN c a ON a.t = x.t JOIN c b ON b.t = y.t),
  k AS (SELECT *, row_number() OVER (PARTITION BY wnd_id ORDER BY s DESC) AS k FROM p), z AS (SELECT wnd_id, 0.7::DOUBLE * max(s) + 0.3::DOUBLE * avg(s) AS v FROM k WHERE k <= 2 GROUP BY wnd_id) SELECT DISTINCT w.wnd_id, round(coalesce(v, 0), 9) AS ambiguity FROM w LEFT JOIN z USING (wnd_id)""")
def _(spark, d):
    types = gold(spark, d).groupBy("wnd_id").agg(F.array_sort(F.collect_set("event_type")).alias("c"))
    return types.select("wnd_id", F.round(targets.schema_ambiguity(F.col("c"), schema()), 9).alias("ambiguity"))


@query("cue_ambiguity", f"""WITH c AS (SELECT t, cues FROM {SCHEMA_SQL}), w AS (SELECT wnd_id, list_distinct(list(concat('t', s))) AS k FROM ({GOLD_SQL}) GROUP BY wnd_id), m AS (SELECT wnd_id, {J.format('w.k', 'c.cues')} AS s FROM w, c), r AS (SELECT *, row_number() OVER (PARTITION BY wnd_id ORDER BY s DESC) AS n FROM m)
  SELECT wnd_id, round(1 - (max(s) FILTER (n = 1) - max(s) FILTER (n = 2)), 9) AS ambiguity FROM r GROUP BY wnd_id""")
def _(spark, d):
    tokens = gold(spark, d).groupBy("wnd_id").agg(F.collect_set(F.concat(F.lit("t"), F.col("s").cast("string"))).alias("k"))
    return tokens.select("wnd_id", F.round(targets.cue_ambiguity(F.col("k"), F.array(*map(F.lit, SCHEMA)), schema()), 9).alias("ambiguity"))


STEM = "CASE WHEN length({b}) > 2 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) AND right({b}, 1) NOT IN ('l', 's', 'z') THEN left({b}, length({b}) - 1) ELSE {b} END"


def stem_sql(k: int) -> str:
    b = STEM.format(b=f"left(w, length(w) - {k})")
    return f"CASE WHEN regexp_matches({b}, '(at|bl|iz)$') THEN concat({b}, 'e') ELSE {b} END"


LEMMA = f"""CASE WHEN length(w) > 4 AND (w LIKE '%ied' OR w LIKE '%ies') THEN concat(left(w, length(w) - 3), 'y') WHEN length(w) > 5 AND w LIKE '%ing' THEN {stem_sql(3)} WHEN length(w) > 4 AND w LIKE '%eed' THEN left(w, length(w) - 1) WHEN length(w) > 4 AND w LIKE '%ed' THEN {stem_sql(2)}
  WHEN length(w) > 4 AND regexp_matches(w, '(sses|shes|ches|xes|zes|oes)$') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END"""


@query("trigger_lexicon", f"WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), n AS (SELECT role, {LEMMA} AS cue, count(*) AS n, count(DISTINCT conv_id) AS n_windows FROM w GROUP BY ALL HAVING count(*) >= 3) SELECT role, cue, n, n_windows, rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, cue) AS rank FROM n) WHERE rank <= 200")
def _(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")))
    rows = read(spark, d, "conversations").select("conv_id", "role", words.alias("w")).select("conv_id", "role", targets.lemma(F.col("w")).alias("cue"))
    return audits.lexicon(rows, "role", "conv_id", "cue", 3, 200)


@query("phrase_lemmas", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'run the city , stop !' WHEN 1 THEN 'fry create' WHEN 2 THEN 'class agree' WHEN 3 THEN 'box bus' ELSE 'go' END AS lemma FROM part")
def _(spark, d):
    phrases = F.array(*map(F.lit, ("Running  the cities, stopped!", "fried creating", "classes agreed", "boxes bus", "went")))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), targets.phrase_lemma(F.element_at(phrases, (F.col("p_partkey") % 5 + 1).cast("int")), {"went": "go"}).alias("lemma"))


EXPOSED = {"text": "text", "lang": "lang", "source": "source", "head": "substr(text, 1, 40)"}
TERMS = ["the", "de", "web", "zz"]


@query("exposure_counts", " UNION ALL ".join(f"SELECT '{s}' AS surface, '{t}' AS term, count(*) AS n FROM documents WHERE ({' OR '.join(f'coalesce(contains({c}, {chr(39)}{u}{chr(39)}), false)' for x, c in EXPOSED.items() if s in (x, 'any') for u in TERMS if t in (u, 'any'))}) HAVING count(*) > 0" for s in (*EXPOSED, "any") for t in (*TERMS, "any")))
def _(spark, d):
    surfaces = {"text": F.col("text"), "lang": F.col("lang"), "source": F.col("source"), "head": F.substring("text", 1, 40)}
    return audits.exposure(read(spark, d, "documents"), surfaces, TERMS)


@query("row_factors", "SELECT l_returnflag AS flag, factor, count(*) AS n FROM (SELECT *, unnest(list_filter([CASE WHEN l_quantity > 30 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'full_price' END, CASE WHEN l_linenumber = 1 THEN 'first' END], lambda x: x IS NOT NULL)) AS factor FROM lineitem) GROUP BY ALL")
def _(spark, d):
    tests = {"large": F.col("l_quantity") > 30, "full_price": F.col("l_discount") == 0, "first": F.col("l_linenumber") == 1}
    return audits.factors(read(spark, d, "lineitem").withColumn("flag", F.col("l_returnflag")), "flag", tests).groupBy("flag", "factor").agg(F.count(F.lit(1)).alias("n"))


ATOMS = {"high": "score > 0.7", "mid": "score > 0.4", "even": "id % 2 = 0", "won": "y = 1"}


@query("rule_conjunctions", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n, sum(gain) AS gain, round(avg(CAST(gain < 0 AS INT)), 9) AS harm_rate FROM ({RUN_SQL}) WHERE {' AND '.join(ATOMS[a] for a in n.split(' & '))} HAVING count(*) > 0" for n in ("high", "mid", "even", "won", "high & even", "high & won", "mid & even", "mid & won", "even & won", "high & even & won", "mid & even & won")))
def _(spark, d):
    atoms = {n: F.expr(a) for n, a in ATOMS.items()}
    return audits.rule_results(run_table(spark, d), audits.conjunctions(atoms, 3, [("high", "mid")]), "gain")


@query("leak_scan", "SELECT conv_id, turn, term FROM (SELECT conv_id, turn, unnest(list_filter(['the an', 'QUE', 'nosuch'], lambda t: contains(lower(text), lower(t)))) AS term FROM conversations)")
def _(spark, d):
    c = read(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    rows = audits.leaking_rows(c, "key", [F.col("text")], ["the an", "QUE", "nosuch"], 1 << 30)
    return rows.select("key.conv_id", "key.turn", "term")


@query("cardinality_problems", "WITH n AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT * FROM (VALUES ('F', 1), ('X', 5)) t(status, expected)) SELECT coalesce(n.status, e.status) AS status, coalesce(expected, 0) AS expected, coalesce(n, 0) AS n FROM n FULL JOIN e USING (status) WHERE coalesce(expected, 0) <> coalesce(n, 0)")
def _(spark, d):
    return audits.cardinality_problems(read(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status", {"F": 1, "X": 5})


@query("semantic_pass", "SELECT l_orderkey AS id, l_linenumber AS line, l_linenumber >= 4 AND l_quantity >= 5 AND l_tax < 0.05 AS passed FROM lineitem")
def _(spark, d):
    bad = F.array_compact(F.array(F.when(F.col("l_tax") >= 0.05, "tax")))
    ok = audits.semantic_pass({"a": F.col("l_linenumber"), "consistency": F.col("l_quantity")}, "consistency", bad)
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), ok.alias("passed"))
