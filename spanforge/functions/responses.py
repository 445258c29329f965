"""Checks of generated responses: tags, strict parsing, failure classes, plan lines and output burden."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes of the strict parser and classes of failure, and their limits.
TAGS = ("<thinking>", "</thinking>", "<final>", "</final>")
MANY_ROLES, MANY_EVENTS = 20, 8
ECHOES = ("Return JSON only.\nassistant", "Output requirements:\n", "`decisions` and `events`.", "contains `event_type`, `trigger`, and `arguments`.")
ECHO_STARTS = ("`decisions`", "contains `event_type`")


def occurrences(text: Column, literal: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / F.lit(len(literal))


def count_of(text: Column, literal: str) -> Column:
    return occurrences(text, literal).cast("int")


def final_text(text: Column) -> Column:
    """What stands in the final tag: to the end of the text if the tag isn't closed, null without it."""
    tail = F.substring_index(text, "<final>", -1)
    return F.when(F.contains(text, F.lit("<final>")), F.substring_index(tail, "</final>", 1))


def final_object(text: Column) -> Column:
    """From the first { to the last } of the final text; null if that isn't a JSON object."""
    inner = F.regexp_extract(final_text(text), r"(?s)\{.*\}", 0)
    return F.when(is_object(inner), inner)


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def strict_error(text: Column) -> Column:
    """The first rule that a response breaks, null if it keeps all: each tag once, in order, thinking, a list of events."""
    once = F.lit(True)
    for tag in TAGS:
        once = once & (count_of(text, tag) == 1)
    shape = r"(?s)^\s*<thinking>(.*)</thinking>\s*<final>(.*)</final>\s*$"
    thinking, final = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    parsed = F.try_parse_json(final)
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.events", "variant")).startswith("ARRAY"), F.lit(False))
    return (
        F.when(text.isNull(), "not_string")
        .when(~once, "tag_count")
        .when(~F.regexp_like(text, F.lit(shape)), "tag_structure")
        .when(F.regexp_like(thinking, F.lit(r"(?s)^\s*$")), "empty_thinking")
        .when(parsed.isNull(), "final_json")
        .when(~(is_object(final) & listed), "final_schema")
    )


def complete_tag(text: Column, tag: str) -> Column:
    """Whether the tag opens and closes later on."""
    at = F.instr(text, f"<{tag}>")
    return F.coalesce((at > 0) & F.contains(F.substring(text, at + len(tag) + 2, F.length(text)), F.lit(f"</{tag}>")), F.lit(False))


def whole_response(text: Column) -> Column:
    """Whether the text is thinking, then final, and nothing else but white space."""
    return F.coalesce(F.regexp_like(text, F.lit(r"(?s)^\s*<thinking>.*</thinking>\s*<final>.*</final>\s*$")), F.lit(False))


def route(text: Column) -> Column:
    """The route tag's word; else that of a budget tag (none is direct, others reason); else unknown."""
    named = F.lower(F.regexp_extract(text, r"(?i)<ROUTE>\s*(direct|reason)\s*</ROUTE>", 1))
    budget = F.lower(F.regexp_extract(text, r"(?i)<BUDGET>\s*(\w+)\s*</BUDGET>", 1))
    return F.when(named != "", named).when(budget == "none", "direct").when(budget != "", "reason").otherwise("unknown")


def failure_features(text: Column) -> dict[str, Column]:
    """Counts and flags of a generated text that tell why it isn't valid JSON."""
    start = F.ltrim(text)
    echo = F.lit(False)
    for marker in ECHOES:
        echo = echo | F.contains(text, F.lit(marker))
    for marker in ECHO_STARTS:
        echo = echo | start.startswith(marker)
    n = {c: count_of(text, c) for c in "{}[]"}
    roles, events = count_of(text, '"role"'), count_of(text, '"event_type"')
    return {
        "generated_chars": F.length(text), "starts_with_think": start.startswith("<think>"), "instruction_echo": echo,
        "unclosed_brace": n["{"] > n["}"], "unclosed_bracket": n["["] > n["]"], "role_mentions": roles, "event_mentions": events,
        "runaway_roles": roles >= MANY_ROLES, "runaway_events": events >= MANY_EVENTS,
    }


def failure_reason(text: Column, valid: Column) -> Column:
    f = failure_features(text)
    cut_off, runaway = f["unclosed_brace"] | f["unclosed_bracket"], f["runaway_roles"] | f["runaway_events"]
    return F.when(valid, "valid").when(cut_off & runaway, "runaway_truncated_json").when(cut_off, "truncated_json").when(f["instruction_echo"], "instruction_echo").when(f["starts_with_think"], "prefix_think_only").otherwise("other_invalid")


def plan_lines(text: Column) -> dict[str, Column]:
    """How many lines of the plan there are, and how many name a contrast, a present or absent role, and a type."""
    inner = F.substring_index(F.substring(text, F.instr(text, "<PLAN>") + 6, F.length(text)), "</PLAN>", 1)
    whole = F.contains(text, F.lit("<PLAN>")) & F.contains(text, F.lit("</PLAN>"))
    lines = F.when(whole, F.filter(F.split(inner, r"\r?\n"), lambda x: F.trim(x) != "")).otherwise(F.array().cast("array<string>"))
    some = lambda pattern: F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(pattern))))
    return {"lines": F.size(lines), "contrasts": some("CONTRAST"), "present": some(r"\bROLE\b.*\bpresent\b"), "absent": some(r"\bROLE\b.*\babsent\b"), "types": some(r"\bTYPE\b")}


def completion(ids: Column, ends: list[int], most: int) -> dict[str, Column]:
    """Tokens before the first end token, whether there is one, and whether the cap was hit without."""
    at = F.array_min(F.transform(F.array(*map(F.lit, ends)), lambda e: F.nullif(F.array_position(ids, e), F.lit(0).cast("long"))))
    return {"generated": F.coalesce(at - 1, F.size(ids).cast("long")), "ended": at.isNotNull(), "hit_cap": at.isNull() & (F.size(ids) >= most)}


def burden(payload: Column, generated: Column) -> dict[str, Column]:
    """Which keys a predicted object has, how many items, and the characters beyond its events alone."""
    keys = ("events", "clues", "decisions")
    parsed = F.from_json(payload, ", ".join(f"{k} string" for k in keys))
    size = lambda k: F.coalesce(F.size(F.from_json(parsed[k], "array<string>")), F.lit(0))
    alone = F.when(parsed["events"].isNotNull(), F.length(F.concat(F.lit('{"events":'), parsed["events"], F.lit("}")))).otherwise(0)
    out = {f"has_{k}": parsed[k].isNotNull() for k in keys} | {f"n_{k}": size(k) for k in keys}
    return out | {"events_only_chars": alone, "overhead_chars": F.greatest(F.lit(0), F.length(generated) - alone)}


def leaks(response: Column, source: Column, terms: list[str]) -> Column:
    """The terms that stand in the response as whole words and not in the source."""
    has = lambda text, t: F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.lower(t), F.lit(r"\E(?![a-z0-9_])")))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: has(response, t) & ~has(source, t))


def without_sentences(text: Column, marker: str) -> Column:
    """The text without the sentences that hold the marker."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    return F.array_join(F.filter(sentences, lambda s: ~F.contains(s, F.lit(marker))), " ")
