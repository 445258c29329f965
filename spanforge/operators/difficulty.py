"""How hard a window is: confusable types, rare types and role signatures, dense or missing roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of the scores and the greatest confusion.
MOST_CONFUSION = 14.0
CONFROLE = {"confusion_norm": 0.65, "signature_rarity": 0.35}
ROLECONF = {"confusion_norm": 0.35, "signature_rarity": 0.30, "core_density": 0.20, "multi": 0.15}
HARDCONF = {"confusion_norm": 0.35, "signature_rarity": 0.20, "role_density": 0.20, "multi": 0.15, "core_absence": 0.10}


def confusable_types(schema: DataFrame) -> DataFrame:
    """(event_type, other, confusion) of types that share family, core roles or cues; 10, 3 and 1 at most for each.

    Joined through the shared values, so types with nothing in common never meet. schema: event_type, roles, cues.
    """
    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"), F.size(values).alias("n")))

    trait = F.concat(of("family", F.array(F.substring_index("event_type", ":", 1))), of("role", F.array_distinct("roles")), of("cue", F.array_distinct("cues")))
    traits = schema.select("event_type", F.inline(trait))
    others = traits.withColumnsRenamed({"event_type": "other", "n": "m"})
    shared = traits.join(others, ["kind", "value"]).where("event_type <> other").groupBy("event_type", "other", "kind", "n", "m").agg(F.count(F.lit(1)).alias("both"))
    weight = F.when(F.col("kind") == "family", 10.0).when(F.col("kind") == "role", 3.0).otherwise(1.0)
    return shared.groupBy("event_type", "other").agg(F.sum(weight * F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("confusion"))


def rarity(n: Column, most: Column) -> Column:
    """1 for what never is repeated down to 0 for the most frequent, on a log scale; 0 where nothing was counted."""
    return F.when((n > 0) & (most > 0), 1 - F.log1p(n) / F.log1p(most)).otherwise(0.0)


def with_rarity(events: DataFrame, key: str, name: str) -> DataFrame:
    """events with the rarity of their key; counts are summed before they are joined, and the maximum is one row."""
    counts = events.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    rare = counts.join(F.broadcast(most), F.lit(True)).select("_key", rarity(F.col("_n"), F.col("_most")).alias(name))
    return events.join(rare, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def signature(event_type: Column, roles: Column) -> Column:
    held = F.array_sort(F.array_distinct(roles))
    return F.concat(event_type, F.lit("::"), F.when(F.size(held) > 0, F.array_join(held, "|")).otherwise("NO_ROLES"))


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))


def window_difficulty(events: DataFrame, candidates: DataFrame, schema: DataFrame) -> DataFrame:
    """Features and the three scores of each window of `candidates` (wnd_id, candidates); 0 without events.

    events: wnd_id, event_type, s, e, roles (one entry an argument). Types outside the schema have no core roles.
    """
    core = schema.select("event_type", F.array_distinct("roles").alias("core"))
    rows = with_rarity(with_rarity(events.withColumn("sig", signature(F.col("event_type"), F.col("roles"))), "event_type", "_type"), "sig", "_sig")
    rows = rows.join(core, "event_type", "left").withColumn("core", F.coalesce("core", F.array().cast("array<string>")))
    per = rows.groupBy("wnd_id").agg(
        F.max("_type").alias("type_rarity"),
        F.max("_sig").alias("signature_rarity"),
        F.sum(F.size(F.array_intersect("roles", "core"))).alias("seen"),
        F.sum(F.size(F.array_except("core", "roles"))).alias("missing"),
        F.sum(F.size("core")).alias("possible"),
        F.least(F.sum(F.size("roles")) / 6.0, F.lit(1.0)).alias("role_density"),
        (F.count(F.lit(1)) > 1).cast("double").alias("multi"),
        F.collect_set("event_type").alias("_types"),
    )
    asked = candidates.select("wnd_id", "candidates").join(per.select("wnd_id", F.explode("_types").alias("event_type")), "wnd_id")
    worst = asked.join(confusable_types(schema), "event_type").where(F.array_contains("candidates", F.col("other"))).groupBy("wnd_id").agg(F.max("confusion").alias("confusion"))
    share = lambda c: F.when(F.col("possible") > 0, F.col(c) / F.col("possible")).otherwise(0.0)
    out = candidates.select("wnd_id").join(per.drop("_types"), "wnd_id", "left").join(worst, "wnd_id", "left")
    out = out.withColumns({"core_density": share("seen"), "core_absence": share("missing")}).drop("seen", "missing", "possible").fillna(0.0)
    out = out.withColumn("confusion_norm", F.col("confusion") / MOST_CONFUSION)
    return out.withColumns({"confrole": weighted(CONFROLE), "roleconf": weighted(ROLECONF), "hardconf": weighted(HARDCONF)}).drop("confusion_norm")
