"""Payloads of events as JSON text or nested columns: parsing, canonical order, checks and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARGUMENT = "struct<role:string,text:string,start:int,end:int>"
EVENTS = f"array<struct<event_type:string,trigger:struct<text:string,start:int,end:int>,arguments:array<{ARGUMENT}>>>"


def _objects(items: Column) -> Column:
    """The JSON objects of a JSON array's text, as texts; none for anything else."""
    parsed = F.from_json(items, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.startswith("{")), F.array().cast("array<string>"))


def _trigger(raw: Column) -> Column:
    """From an object, a list (its first item counts) or a plain surface."""
    head = F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)
    plain = F.struct(head.alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return F.when(head.startswith("{"), F.from_json(head, "struct<text:string,start:int,end:int>")).otherwise(plain)


def events(payload: Column) -> Column:
    """The events of a payload's text in one shape; an empty array where there are none or the text isn't an object.

    A type may be called event_type or type, a trigger may be an object, a list or a surface; what isn't an object among
    events and arguments is left out.
    """
    whole = F.from_json(payload, "events string")["events"]
    wide = F.transform(_objects(whole), lambda e: F.from_json(e, "event_type string, type string, trigger string, arguments string"))
    named = lambda e: F.coalesce(F.nullif(e["event_type"], F.lit("")), e["type"])
    arguments = lambda e: F.transform(_objects(e["arguments"]), lambda a: F.from_json(a, ARGUMENT))
    return F.transform(wide, lambda e: F.struct(named(e).alias("event_type"), _trigger(e["trigger"]).alias("trigger"), arguments(e).alias("arguments"))).cast(EVENTS)


def canonical(events: Column) -> Column:
    """Events without regard to order: sorted (start, end, type, sorted (start, end, role)); missing offsets are -1."""
    off = lambda x: F.coalesce(x, F.lit(-1))
    args = lambda e: F.array_sort(F.transform(e["arguments"], lambda a: F.struct(off(a["start"]).alias("start"), off(a["end"]).alias("end"), F.coalesce(a["role"], F.lit("")).alias("role"))))
    return F.array_sort(F.transform(events, lambda e: F.struct(off(e["trigger"]["start"]).alias("start"), off(e["trigger"]["end"]).alias("end"), e["event_type"].alias("event_type"), args(e).alias("arguments"))))


def surface(events: Column) -> Column:
    """JSON of types, trigger texts and sorted (role, text) arguments, offsets aside."""
    args = lambda e: F.array_sort(F.transform(e["arguments"], lambda a: F.struct(a["role"].alias("role"), a["text"].alias("text"))))
    rows = F.array_sort(F.transform(events, lambda e: F.struct(e["event_type"].alias("event_type"), e["trigger"]["text"].alias("trigger"), args(e).alias("arguments"))))
    return F.to_json(F.struct(rows.alias("events")))


def digest(events: Column) -> Column:
    return F.sha2(F.to_json(F.struct(canonical(events).alias("e"))), 256)


def offsets_complete(events: Column) -> Column:
    """Whether every trigger and argument has both offsets."""
    whole = lambda x: x["start"].isNotNull() & x["end"].isNotNull()
    return F.forall(events, lambda e: whole(e["trigger"]) & F.forall(e["arguments"], whole))


def types_within(events: Column, candidates: Column) -> Column:
    """Whether every event's type is one of the candidates (a missing type isn't)."""
    return F.forall(events, lambda e: F.coalesce(F.array_contains(candidates, e["event_type"]), F.lit(False)))


def of_type(events: Column, event_type: Column) -> Column:
    return F.filter(events, lambda e: e["event_type"] == event_type)


def mentions(events: Column) -> Column:
    """Type and trigger of each event."""
    return F.transform(events, lambda e: F.struct(e["event_type"].alias("event_type"), e["trigger"].alias("trigger")))


def span_text(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens of a half-open range joined by blanks; null out of bounds."""
    inside = (start >= 0) & (start < end) & (end <= F.size(tokens))
    return F.when(inside, F.array_join(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), " "))


def located(events: Column, spans: Column) -> Column:
    """Events with the offsets that a map from surface to struct(start, end) gives; those it lacks stay null."""
    at = lambda x, *more: F.struct(*more, x["text"].alias("text"), spans[x["text"]]["start"].alias("start"), spans[x["text"]]["end"].alias("end"))
    return F.transform(events, lambda e: F.struct(e["event_type"].alias("event_type"), at(e["trigger"]).alias("trigger"), F.transform(e["arguments"], lambda a: at(a, a["role"].alias("role"))).alias("arguments")))


def missing_offsets(events: Column) -> Column:
    """How many triggers and arguments have no start."""
    gone = lambda e: e["trigger"]["start"].isNull().cast("int") + F.size(F.filter(e["arguments"], lambda a: a["start"].isNull()))
    return F.aggregate(events, F.lit(0), lambda n, e: n + gone(e))


def nearby(p0: Column, p1: Column, g0: Column, g1: Column, tolerance: int = 2) -> Column:
    """Whether two spans overlap or their ends are at most `tolerance` apart in all; false with a null."""
    near = ((p0 < g1) & (g0 < p1)) | (F.abs(p0 - g0) + F.abs(p1 - g1) <= tolerance)
    return F.coalesce(near, F.lit(False))


def valid_length_pair(chosen: Column, rejected: Column, chosen_total: Column, rejected_total: Column, cutoff: int, low: float = 0.7, high: float = 1.3) -> Column:
    """Whether the lengths' ratio lies within bounds and both totals within the cutoff; false for lengths under one."""
    ratio = chosen.cast("double") / F.nullif(rejected, F.lit(0))
    return F.coalesce((chosen > 0) & (rejected > 0) & ratio.between(low, high) & (chosen_total <= cutoff) & (rejected_total <= cutoff), F.lit(False))


def inserted(tokens: Column, at: Column, more: Column) -> Column:
    """tokens with the array `more` put in before position `at`."""
    return F.concat(F.slice(tokens, F.lit(1), at), more, F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0))))


def shifted(index: Column, at: Column, size: Column, is_end: bool) -> Column:
    """Where an offset lies after an insertion: starts at the place move, ends there stay."""
    return index + F.when(index > at if is_end else index >= at, size).otherwise(0)
