"""Text of schema cards, prompts and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A schema with more types is no configuration table; prompts() then fails instead of sending it to every task.
MAX_TYPES = 10_000


def card(event_type: Column, definition: Column, cues: Column, roles: Column) -> Column:
    """Type and definition, then the cues and roles that there are, a line each."""
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}: "), F.array_join(xs, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("Event type: "), event_type), F.concat(F.lit("Definition: "), definition), listed("Trigger cues", cues), listed("Core roles", roles))


def numbered(cards: Column) -> Column:
    return F.array_join(F.transform(cards, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def prompts(rows: DataFrame, schema: DataFrame, text: str = "text", tokens: str = "tokens", candidates: str = "candidates") -> DataFrame:
    """rows with `prompt`; schema holds event_type and document. A candidate without a card raises an error.

    The schema travels as one map of at most MAX_TYPES cards, so rows are neither exploded nor shuffled.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("event_type", "document")))
    cards = schema.agg(F.when(F.count(F.lit(1)) <= MAX_TYPES, entries).otherwise(F.raise_error(F.lit("too many types for a schema"))).alias("_cards"))
    found = F.transform(candidates, lambda t: F.coalesce(F.col("_cards")[t], F.raise_error(F.concat(F.lit("no card for "), t)).cast("string")))
    parts = {"Text": F.col(text), "Tokens": F.array_join(tokens, " "), "Candidate event types": F.array_join(candidates, ", "), "Schema cards": numbered(found)}
    body = [F.concat(F.lit(f"{k}:\n"), v) for k, v in parts.items()]
    return rows.join(F.broadcast(cards), F.lit(True)).withColumn("prompt", F.concat_ws("\n\n", *body, F.lit("Return JSON only."))).drop("_cards")


def line_target(events: Column) -> Column:
    """A line per event: type, trigger and role fields between double pipes; NONE without events.

    events: array of struct(event_type, trigger, arguments: array of struct(role, text)).
    """
    fields = lambda e: F.transform(e["arguments"], lambda a: F.concat(a["role"], F.lit(": "), a["text"]))
    line = lambda e: F.array_join(F.concat(F.array(e["event_type"], F.concat(F.lit("trigger: "), F.coalesce(e["trigger"], F.lit("")))), F.coalesce(fields(e), F.array().cast("array<string>"))), " || ")
    return F.when(F.coalesce(F.size(events), F.lit(0)) <= 0, "NONE").otherwise(F.array_join(F.transform(events, line), "\n"))
