"""Substring dedup against a search of all runs of equal words, and on the cases that hide a passage."""

import numpy as np
import pytest

from spanforge.llm import chaining

SCHEMA = "doc_id long, text string"


def fresh(r, n):
    return [f"w{i}" for i in r.integers(0, 10**9, n)]


def reported(spark, rows):
    out = {}
    for x in chaining.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], SCHEMA)).collect():
        out.setdefault(x.doc_id, []).append((x.start, x.end))
    return out


def equal_runs(a, b, least):
    """Ends and lengths in b of the longest runs of `least` or more words that a and b share."""
    before, found = {}, []
    at = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    for j, w in enumerate(b):
        now = {i: before.get(i - 1, 0) + 1 for i in at.get(w, [])}
        found += [(j - n, j) for i, n in before.items() if n >= least and i + 1 not in now]
        before = now
    return found + [(len(b) - n, len(b)) for n in before.values() if n >= least]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_shared_runs_are_found(spark, seed):
    r = np.random.default_rng(seed)
    shared = [fresh(r, int(n)) for n in r.integers(50, 180, 12)]
    rows = []
    for i in range(60):
        body = fresh(r, int(r.integers(5, 60)))
        for _ in range(int(r.integers(0, 4))):
            p = shared[int(r.integers(len(shared)))]
            a = int(r.integers(0, max(1, len(p) - 55)))
            body += p[a:] + fresh(r, int(r.integers(1, 50)))
        rows.append((i, body))
    got, checked = reported(spark, rows), 0
    for k, (i, b) in enumerate(rows):
        cover = np.zeros(len(b), bool)
        for s, e in got.get(i, []):
            cover[s:e] = True
        for _, a in rows[:k]:
            for s, e in equal_runs(a, b, chaining.LEAST_WORDS):
                checked += 1
                edge = chaining.WINDOW - 1
                assert cover[s + edge : e - edge].all(), (i, s, e)
        # What is reported shares at least 0.8 of its words with an earlier document.
        if not any(equal_runs(a, b, 30) for _, a in rows[:k]):
            assert i not in got
    assert checked > 50


@pytest.mark.parametrize("seed", [3, 4])
def test_holders_of_parts_hide_no_passage(spark, seed):
    """Earlier documents hold 43 to 49 words around every long seed; each run of 50 that one holds whole is covered whole."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(8):
        common = fresh(r, 110)
        if r.random() < 0.4:
            common[30:55] = fresh(r, 1) * 25  # a run of one word, which passages may begin or end in
        for a in range(0, 110 - 49, 5):
            rows.append(fresh(r, 30) + common[a : a + 49] + fresh(r, 30))
        for _ in range(5):
            a, n = int(r.integers(0, 60)), int(r.integers(50, 61))
            rows.append(fresh(r, 20) + common[a : a + n] + fresh(r, int(r.integers(0, 20))))
    word = fresh(r, 1)
    rows += [fresh(r, 5) + word * 60 + fresh(r, 5), fresh(r, 9) + word * 203 + fresh(r, 5)]
    rows = list(enumerate(rows))
    got, checked = reported(spark, rows), 0
    for k, (i, b) in enumerate(rows):
        cover = np.zeros(len(b), bool)
        for s, e in got.get(i, []):
            cover[s:e] = True
        for _, a in rows[:k]:
            for s, e in equal_runs(a, b, chaining.LEAST_WORDS):
                checked += 1
                assert cover[s:e].all(), (i, s, e)
    assert checked > 50


def test_cycles_drift_and_repeats(spark):
    r = np.random.default_rng(5)
    cycle = fresh(r, 3) * 40
    long = fresh(r, 1200)
    drifted = long[:400] + fresh(r, 90) + long[400:800] + long[890:]
    rows = [(1, cycle), (2, fresh(r, 20) + cycle), (3, long), (4, drifted), (5, fresh(r, 60) * 4)]
    got = reported(spark, rows)
    assert set(got) == {2, 4}
    assert min(s for s, _ in got[2]) <= 20 and max(e for _, e in got[2]) == 140
    cover = np.zeros(len(drifted), bool)
    for s, e in got[4]:
        cover[s:e] = True
    assert cover[:400].all() and cover[490:].all()


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    r = np.random.default_rng(6)
    passage, other = fresh(r, 80), fresh(r, 200)
    copy = fresh(r, 10) + passage + fresh(r, 10)
    rows = [(1, " ".join(passage + fresh(r, 10))), (2, " ".join(copy)), (2, " ".join(other)), (None, " ".join(copy + ["end"])), (None, None), (3, ""), (3, " ".join(passage))]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "body")
    left = {(x.doc_id, x.body) for x in chaining.without_passages(df, text="body").collect()}
    ends = " ".join([*copy[:10], *copy[90:]])
    assert left == {(1, rows[0][1]), (2, ends), (2, " ".join(other)), (None, "end"), (None, None), (3, "")}


def test_bit_edits_equal_the_full_table():
    r = np.random.default_rng(7)
    for _ in range(300):
        a = r.integers(0, 4, r.integers(0, 30))
        b = np.delete(a, r.integers(0, len(a), 3)) if len(a) and r.random() < 0.5 else r.integers(0, 4, r.integers(0, 30))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(x != y)))
            row = new
        most = int(r.integers(0, 12))
        assert min(chaining._distance(a, b, most), most + 1) == min(row[-1], most + 1)
