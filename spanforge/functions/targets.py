"""Training targets of a window's events as compact JSON. schema: a map from type to struct(roles, cues)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.selection import family, jaccard


def trigger_of(e: Column) -> Column:
    t = e["trigger"]
    return F.struct(t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"))


def plain(events: Column) -> Column:
    argument = lambda a: F.struct(*[a[c].alias(c) for c in ("role", "text", "start", "end")])
    return F.transform(events, lambda e: F.struct(e["event_type"].alias("event_type"), trigger_of(e).alias("trigger"), F.transform(e["arguments"], argument).alias("arguments")))


def _target(**lists: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in lists.items()]))


def roles_of(e: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(e["arguments"], lambda a: a["role"])))


def minimal_plan(events: Column) -> Column:
    """plans: type and trigger of each event."""
    return _target(plans=F.transform(events, lambda e: F.struct(e["event_type"].alias("event_type"), trigger_of(e).alias("trigger"))), events=plain(events))


def pointer_plan(events: Column, candidates: Column) -> Column:
    """plans: the place of the type among the candidates from 1 on, 0 if it is none, and the trigger."""
    at = lambda e: F.array_position(candidates, e["event_type"]).cast("int")
    return _target(plans=F.transform(events, lambda e: F.struct(at(e).alias("candidate_id"), trigger_of(e).alias("trigger"))), events=plain(events))


def checklist(events: Column, reasons: bool = False) -> Column:
    """clues: triggers; decisions: a supported type for each clue by its number, with a short reason if asked for."""
    reason = lambda e: F.when(F.size(e["arguments"]) > 0, "trigger and roles support this type").otherwise("trigger supports this type")
    more = lambda e: [reason(e).alias("reason")] if reasons else []
    decisions = F.transform(events, lambda e, i: F.struct(i.alias("clue_id"), e["event_type"].alias("event_type"), *more(e), F.lit("supported").alias("status")))
    return _target(clues=F.transform(events, trigger_of), decisions=decisions, events=plain(events))


def structured_short(events: Column) -> Column:
    """reasoning: trigger, type, the roles filled and the status of each event."""
    one = lambda e: F.struct(trigger_of(e).alias("trigger"), e["event_type"].alias("event_type"), roles_of(e).alias("focus_roles"), F.lit("supported").alias("status"))
    return _target(reasoning=F.transform(events, one), events=plain(events))


def structured(events: Column, schema: Column) -> Column:
    """reasoning: five sentences on each event's trigger, type, core roles, arguments and schema."""

    def one(e: Column) -> Column:
        t, kind = e["trigger"], e["event_type"]
        bit = lambda a: F.concat(a["role"], F.lit(' = "'), a["text"], F.lit('" at tokens ['), a["start"].cast("string"), F.lit(", "), a["end"].cast("string"), F.lit(")"))
        found = F.concat(F.lit("The text supports "), F.array_join(F.transform(e["arguments"], bit), "; "), F.lit("."))
        return F.struct(
            F.concat(F.lit('The phrase "'), t["text"], F.lit('" at tokens ['), t["start"].cast("string"), F.lit(", "), t["end"].cast("string"), F.lit(") is an event clue.")).alias("trigger_clue"),
            F.concat(F.lit("Among the candidate types, this clue best matches "), kind, F.lit(".")).alias("type_decision"),
            F.concat(F.lit("For "), kind, F.lit(", focus on core roles: "), F.array_join(schema[kind]["roles"], ", "), F.lit(".")).alias("schema_focus"),
            F.when(F.size(e["arguments"]) > 0, found).otherwise("No explicit arguments are confidently supported for this event.").alias("argument_reasoning"),
            F.concat(F.lit("The trigger and extracted arguments are consistent with the "), kind, F.lit(" schema.")).alias("schema_check"),
        )

    return _target(reasoning=F.transform(events, one), events=plain(events))


def cue_tokens(text: Column) -> Column:
    """The set of lower-cased words, with hyphens and slashes as blanks."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(text), "-/", "  "), r"\s+"), lambda w: w != ""))


def _best(candidates: Column, score) -> Column:
    """The candidate with the largest (score, name)."""
    return F.array_max(F.transform(candidates, lambda c: F.struct(score(c).alias("score"), c.alias("name"))))


def contrast_type(e: Column, candidates: Column, schema: Column) -> Column:
    """The candidate that the event's type is most easily taken for, empty if none scores above zero."""
    own, kind = schema[e["event_type"]], e["event_type"]
    same = lambda c: (family(c) == family(kind)).cast("double")
    score = lambda c: same(c) * 10 + jaccard(roles_of(e), schema[c]["roles"]) * 4 + jaccard(cue_tokens(e["trigger"]["text"]), schema[c]["cues"]) * 2 + jaccard(own["roles"], schema[c]["roles"]) + jaccard(own["cues"], schema[c]["cues"])
    best = _best(F.filter(candidates, lambda c: c != kind), score)
    return F.when(best["score"] > 0, best["name"]).otherwise("")


def reason_code(e: Column, contrast: Column, schema: Column) -> Column:
    """What speaks for the event's type: its family against the contrast, its roles, its trigger or the context."""
    own = schema[e["event_type"]]
    roles, cues = jaccard(roles_of(e), own["roles"]), jaccard(cue_tokens(e["trigger"]["text"]), own["cues"])
    return F.when((contrast != "") & (family(contrast) == family(e["event_type"])), "family_boundary").when((roles > 0) & (roles >= cues), "role_signature").when(cues > 0, "trigger_signature").otherwise("context_support")


def contrastive(events: Column, candidates: Column, schema: Column) -> Column:
    """decisions: type, trigger, contrast type and reason code of each event."""

    # Two steps, so that a contrast is found once and not once for each use.
    found = F.transform(events, lambda e: F.struct(e.alias("event"), contrast_type(e, candidates, schema).alias("other")))

    def one(x: Column) -> Column:
        e, other = x["event"], x["other"]
        return F.struct(e["event_type"].alias("event_type"), trigger_of(e).alias("trigger"), other.alias("contrast_type"), reason_code(e, other, schema).alias("reason_code"))

    return _target(decisions=F.transform(found, one), events=plain(events))


def candidate_reviews(events: Column, candidates: Column, schema: Column) -> Column:
    """One review a candidate as an array of (event_type, status, reason_code, contrast_type).

    Candidates without an event are rejected: better_type_match if the nearest gold event is of their family or shares
    half of the core roles, role_mismatch if it shares a cue or an observed role, else trigger_mismatch.
    """

    def overlaps(c: Column, e: Column, i: Column) -> Column:
        own, gold = schema[c], schema[e["event_type"]]
        cue = F.greatest(jaccard(own["cues"], cue_tokens(e["trigger"]["text"])), jaccard(own["cues"], gold["cues"]))
        kin = (family(c) == family(e["event_type"])).cast("double")
        return F.struct(kin.alias("kin"), jaccard(own["roles"], gold["roles"]).alias("core"), jaccard(own["roles"], roles_of(e)).alias("seen"), cue.alias("cue"), e["event_type"].alias("gold"), (-i).alias("first"))

    def scored(x: Column) -> Column:
        better, near = (x["kin"] > 0) | (x["core"] >= 0.5), (x["cue"] > 0) | (x["seen"] > 0)
        return F.struct((x["kin"] * 10 + x["seen"] * 4 + x["core"] * 2 + x["cue"]).alias("score"), x["first"], x["gold"], better.alias("better"), near.alias("near"))

    # Steps of their own, so that each overlap and each nearest event is found once and not once for each use.
    nearest = lambda c: F.array_max(F.transform(F.transform(events, lambda e, i: overlaps(c, e, i)), scored))
    have = lambda c: F.exists(events, lambda e: e["event_type"] == c)
    found = F.transform(candidates, lambda c: F.struct(c.alias("type"), have(c).alias("have"), nearest(c).alias("best")))

    def review(x: Column) -> Column:
        have, best = x["have"], x["best"]
        code = F.when(have, "supported").when(best["better"], "better_type_match").when(best["near"], "role_mismatch").otherwise("trigger_mismatch")
        return F.struct(x["type"].alias("event_type"), F.when(have, "supported").otherwise("rejected").alias("status"), code.alias("reason_code"), F.when(~have & (best["better"] | best["near"]), best["gold"]).otherwise("").alias("contrast_type"))

    return F.transform(found, review)


def role_checks(events: Column, schema: Column, most: int) -> Column:
    """(event_type, role, status) for the core roles of each event in order, then its further roles; the first `most`."""

    def one(e: Column) -> Column:
        core = schema[e["event_type"]]["roles"]
        have = F.transform(e["arguments"], lambda a: a["role"])
        row = lambda r, s: F.struct(e["event_type"].alias("event_type"), r.alias("role"), F.lit(s).alias("status"))
        of_role = lambda r: F.when(F.array_contains(have, r), F.transform(F.filter(have, lambda h: h == r), lambda h: row(h, "present"))).otherwise(F.array(row(r, "absent")))
        return F.concat(F.flatten(F.transform(core, of_role)), F.transform(F.filter(have, lambda r: ~F.array_contains(core, r)), lambda r: row(r, "present")))

    return F.slice(F.flatten(F.transform(events, one)), 1, most)


def cue_ambiguity(tokens: Column, candidates: Column, schema: Column) -> Column:
    """One less the lead of the best cue match over the second; zero without candidates."""
    scores = F.sort_array(F.transform(candidates, lambda c: jaccard(tokens, schema[c]["cues"])), False)
    lead = F.get(scores, F.lit(0)) - F.coalesce(F.get(scores, F.lit(1)), F.lit(0.0))
    return F.when(F.size(candidates) == 0, 0.0).otherwise(1 - F.greatest(F.lit(0.0), lead))


def schema_ambiguity(candidates: Column, schema: Column) -> Column:
    """0.7 of the most confusable pair of candidates and 0.3 of the mean of the two most; zero for under two."""
    pair = lambda a, b: 0.5 * (family(a) == family(b)).cast("double") + 0.3 * jaccard(schema[a]["roles"], schema[b]["roles"]) + 0.2 * jaccard(schema[a]["cues"], schema[b]["cues"])
    pairs = F.flatten(F.transform(candidates, lambda a, i: F.transform(F.slice(candidates, i + 2, F.size(candidates)), lambda b: pair(a, b))))
    top = F.slice(F.sort_array(pairs, False), 1, 2)
    mean = F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(top), F.lit(1))
    return F.when(F.size(pairs) > 0, 0.7 * F.get(top, F.lit(0)) + 0.3 * mean).otherwise(0.0)


def lemma(token: Column, irregular: dict[str, str] | None = None) -> Column:
    """A lower-case English word without its inflection, by its ending; `irregular` names exceptions.

    ied and ies become y; ing and ed go, a doubled consonant but l, s, z is made single and at, bl, iz get their e back;
    eed keeps ee; es goes behind ss, sh, ch, x, z, o; any other s but in ss, us, is.
    """
    n = F.length(token)
    stem = lambda k: F.regexp_replace(F.regexp_replace(F.substring(token, F.lit(1), n - k), r"^(.+)([^lsz])\2$", "$1$2"), r"(at|bl|iz)$", "$1e")
    less = lambda k, tail="": F.concat(F.substring(token, F.lit(1), n - k), F.lit(tail))
    ends = lambda pattern: F.regexp_like(token, F.lit(f"(?:{pattern})$"))
    out = F.when((n > 4) & ends("ied|ies"), less(3, "y")).when((n > 5) & ends("ing"), stem(3)).when((n > 4) & ends("eed"), less(1)).when((n > 4) & ends("ed"), stem(2))
    out = out.when((n > 4) & ends("sses|shes|ches|xes|zes|oes"), less(2)).when((n > 3) & ends("s") & ~ends("ss|us|is"), less(1)).otherwise(token)
    if irregular:
        out = F.coalesce(F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])[token], out)
    return out


def surface_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def phrase_lemma(text: Column, irregular: dict[str, str] | None = None) -> Column:
    """The lemmas of a phrase's words and its signs, joined by blanks."""
    return F.array_join(F.transform(F.regexp_extract_all(surface_form(text), F.lit(r"([a-z0-9]+|[^a-z0-9\s]+)")), lambda t: lemma(t, irregular)), " ")
