"""Route labels, output comparison, balancing and checks of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .selection import budget_cap, jaccard, stable_order

#: Limits of the complexity buckets, longest evidence in words.
HIGH, MEDIUM = (3, 6), (2, 3)
MOST_EVIDENCE = 45


def route_labels(rows: DataFrame, score: str, key: str, rate: float, eligible: Column) -> DataFrame:
    """rows with `route` and `rank`: the round(n x rate) eligible rows of largest (score, key) are `reason`, from rank 1.

    The cap counts all rows. Only the rows within the cap are ranked: a limited sort, never one sort of all rows.
    """
    top = rows.where(eligible).orderBy(F.desc(score), F.desc(key)).limit(budget_cap(rows.count(), rate)).select(F.col(key).alias("_key"), F.col(score).alias("_score"))
    ranked = top.select("_key", F.row_number().over(Window.orderBy(F.desc("_score"), F.desc("_key"))).cast("long").alias("rank"))
    return rows.join(ranked, rows[key] == ranked["_key"], "left").drop("_key").withColumn("route", F.when(F.col("rank").isNotNull(), "reason").otherwise("direct"))


def improvement(direct: str, reason: str) -> Column:
    """Argument and event gain plus a quarter of the trigger gain; both columns are structs (argument, event, trigger)."""
    gain = lambda m: F.col(f"{reason}.{m}") - F.col(f"{direct}.{m}")
    return gain("argument") + gain("event") + 0.25 * gain("trigger")


def output_sets(mentions: DataFrame, role: Column) -> DataFrame:
    """Sets of types, triggers, roles, argument texts and (type, role) of each window, and its number of mentions."""
    m = mentions.withColumn("role", role)
    sets = {"types": F.col("event_type"), "triggers": F.col("s"), "roles": F.col("role"), "texts": F.col("a"), "type_roles": F.concat_ws("|", "event_type", "role")}
    return m.groupBy("wnd_id").agg(F.count(F.lit(1)).alias("n"), *[F.collect_set(c).alias(k) for k, c in sets.items()])


def output_changes(direct: DataFrame, reason: DataFrame) -> DataFrame:
    """What the second output changes against the first, for windows of either; two empty sets are alike (1)."""
    d = direct.select("wnd_id", F.struct(*[c for c in direct.columns if c != "wnd_id"]).alias("d"))
    r = reason.select("wnd_id", F.struct(*[c for c in reason.columns if c != "wnd_id"]).alias("r"))
    j = d.join(r, "wnd_id", "full")
    sets = [c for c in direct.columns if c not in ("wnd_id", "n")]
    j = j.select("wnd_id", *[F.coalesce(f"{t}.n", F.lit(0)).alias(f"{t}_n") for t in "dr"], *[F.coalesce(f"{t}.{c}", F.array().cast(direct.schema[c].dataType)).alias(f"{t}_{c}") for t in "dr" for c in sets])
    alike = [F.when((F.size(f"d_{c}") == 0) & (F.size(f"r_{c}") == 0), 1.0).otherwise(jaccard(F.col(f"d_{c}"), F.col(f"r_{c}"))).alias(f"{c}_jaccard") for c in sets]
    new = [F.size(F.array_except(f"r_{c}", f"d_{c}")).cast("long").alias(f"new_{c}") for c in sets]
    dropped = [F.size(F.array_except(f"d_{c}", f"r_{c}")).cast("long").alias(f"dropped_{c}") for c in sets]
    kept = [F.when(F.size(f"d_{c}") > 0, F.size(F.array_intersect(f"r_{c}", f"d_{c}")) / F.size(f"d_{c}")).otherwise(0.0).alias(f"{c}_retention") for c in ("types", "texts")]
    return j.select("wnd_id", (F.col("r_n") - F.col("d_n")).alias("n_delta"), *alike, *new, *dropped, *kept)


def complexity_bucket(events: Column, arguments: Column) -> Column:
    at = lambda limits: (events >= limits[0]) | (arguments >= limits[1])
    return F.when(at(HIGH), "high").when(at(MEDIUM), "medium").otherwise("low")


def type_deficits(mentions: DataFrame, cap: int) -> DataFrame:
    """(event_type, deficit) of types held by fewer than `cap` windows."""
    counts = mentions.select("wnd_id", "event_type").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") < cap).select("event_type", (F.lit(cap) - F.col("n")).alias("deficit"))


def tail_first(mentions: DataFrame, cap: int, count: int) -> DataFrame:
    """(wnd_id, deficit): `count` windows by largest deficit of their types, then id; windows without one fill the rest."""
    each = mentions.join(type_deficits(mentions, cap), "event_type", "left").groupBy("wnd_id").agg(F.coalesce(F.max("deficit"), F.lit(0)).alias("deficit"))
    return each.orderBy(F.desc("deficit"), "wnd_id").limit(count)


def one_per_document(rows: DataFrame, category: str, doc: str, key: str, per_category: int, seed: str) -> DataFrame:
    """One row of each (category, document) by the hash of its key, then the first documents of each category by hash."""
    first = rows.groupBy(category, doc).agg(F.min(F.struct(stable_order(f"{seed}:row", F.col(key)).alias("h"), F.col(key).alias("k"))).alias("m"))
    order = F.row_number().over(Window.partitionBy(category).orderBy(stable_order(f"{seed}:doc", F.col(doc)), doc))
    return first.select(category, doc, F.col("m.k").alias(key), order.alias("pick")).where(F.col("pick") <= per_category).drop("pick")


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def evidence_error(text: Column, surface: Column, evidence: Column) -> Column:
    """Null if the evidence quotes the text and holds the surface; else what is wrong. Null columns count as empty."""
    t, s, e = (F.coalesce(c, F.lit("")) for c in (text, surface, evidence))
    return (
        F.when((s == "") | (e == ""), "missing_surface_or_evidence")
        .when(~F.contains(_plain(e), _plain(s)), "surface_not_in_evidence")
        .when(~F.contains(_plain(t), _plain(e)), "evidence_not_in_text")
        .when(F.size(F.split(_plain(e), " ")) > MOST_EVIDENCE, "evidence_too_long")
    )


def checks(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A registered gate: one row a check of a one-row table, and `all`, which passes only if every check does."""
    every = F.lit(True)
    for c in rules.values():
        every = every & F.coalesce(c, F.lit(False))
    listed = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for name, c in {**rules, "all": every}.items()])
    return row.select(F.explode(listed).alias("x")).select("x.check", "x.passed")
