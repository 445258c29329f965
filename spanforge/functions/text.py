"""Column functions over model output and prompts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def extract_tag(text: Column, tag: str) -> Column:
    """Text of <tag>...</tag>, any case, trimmed; to the end if it isn't closed; null without the tag."""
    found = F.regexp_extract(text, f"(?is)<{tag}>(.*?)(?:</{tag}>|$(?!.))", 1)
    return F.when(F.regexp_like(text, F.lit(f"(?i)<{tag}>")), F.trim(found))


def section(text: Column, start: str, end: str) -> Column:
    """Between two literal markers; to the end without the second; null without the first; trimmed."""
    at = F.instr(text, start)
    tail = F.substring(text, at + F.lit(len(start)), F.length(text))
    stop = F.instr(tail, end)
    return F.when(at > 0, F.trim(F.when(stop > 0, F.substring(tail, F.lit(1), stop - 1)).otherwise(tail)))


def tokens(text: Column) -> Column:
    """Set of [a-z0-9]+ runs of the lower-cased text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))))


def norm_token(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]", "")


def humanize(name: Column) -> Column:
    """Hyphens to spaces, a space before each capital but the first character, runs of white space to one."""
    spaced = F.regexp_replace(F.replace(name, F.lit("-"), F.lit(" ")), "([A-Z])", " $1")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_json_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def balanced_objects(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The complete top-level {...} objects of a text, brackets in strings aside: what a truncated output still holds."""

    def scan(text: str | None) -> list[str]:
        out, depth, start, quoted, escaped = [], 0, 0, False, False
        for i, c in enumerate(text or ""):
            if quoted:
                quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
            elif c == '"':
                quoted, escaped = depth > 0, False
            elif c == "{":
                depth, start = depth + 1, i if not depth else start
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    out.append(text[start : i + 1])
        return out

    for s in texts:
        yield s.map(scan)


@F.pandas_udf(StringType())
def repair_json_prefix(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The longest prefix, at most 3,000 characters shorter, that parses as JSON; null if none does."""

    def trim(text: str | None) -> str | None:
        for end in range(len(text or ""), max(0, len(text or "") - 3000), -1):
            if text[end - 1] in "}]\"0123456789el":
                try:
                    json.loads(text[:end])
                    return text[:end]
                except ValueError:
                    pass
        return None

    for s in texts:
        yield s.map(trim)


def find_spans(haystack: Column, needle: Column) -> Column:
    """Starts of every occurrence of one token array in another; none for an empty needle."""
    n, m = F.size(haystack), F.size(needle)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(haystack, i + 1, m) == needle)
