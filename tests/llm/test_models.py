"""The models of op2, op3, op5 and op10 against plain Python that counts and sums every case."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from spanforge.llm import kneserney, langid, lattice, marginal, simhash, spmodel
from tests.llm.test_operators import prose

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TEXTS = ["the cat sat on the mat", "The CAT\tran\n\n to the   mat", "", None, "zebra café naïve", "the the the the", "a b c d e f g", "cat zebra qux"] + [prose(i, 20) for i in range(12)]


def words(text):
    return SPACE.findall((text or "").encode().translate(LOWER))


def test_lattice_scores_against_all_segmentations(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "the cat")]
    got = {(r.doc_id, r.n_tokens, round(r.score, 6), round(r.base_score, 6), r.n_known, r.held_out, r.train_tokens) for r in marginal.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    held = {i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    learn = [words(t) for i, t in rows if not held[i]]
    c, ends = Counter(w for ws in learn for w in ws), len(learn)
    n, v = sum(c.values()) + ends, len(c) + 1
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos)
    m = marginal.starting_pieces(spmodel.default_model_path())
    score = dict(zip(m.pieces, m.scores, strict=True))

    def spelled(w):
        unit = spmodel.MARK.tobytes() + w
        total = [1.0] + [0.0] * len(unit)
        for p in range(len(unit)):
            if unit[p] & 0xC0 == 0x80:
                continue
            width = 1 if unit[p] < 0x80 else 2 if unit[p] < 0xE0 else 3 if unit[p] < 0xF0 else 4
            for q in range(p + 1, len(unit) + 1):
                if unit[p:q] in score:
                    total[q] += total[p] * math.exp(score[unit[p:q]])
            if unit[p : p + width] not in score:
                total[p + width] += total[p] * math.exp(sum(m.byte_scores[b] for b in unit[p : p + width]))
        return total[-1]

    want = set()
    for i, t in rows:
        ws = words(t)
        value = math.log10(ends / n) + sum(math.log10(max(c[w] - d, 0) / n + d * len(c) / n * spelled(w)) for w in ws)
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in ws), ends])
        want.add((i, len(ws) + 1, round(value, 6), round(base, 6), 1 + sum(c[w] > 0 for w in ws), held[i], n))
    assert got == want


def test_a_text_without_words_has_the_probability_of_an_end(spark):
    rows = [(i, "x") for i in range(9)] + [(9, None)]
    out = {r.doc_id: r for r in marginal.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[9].n_tokens == 1 and out[9].score > out[0].score


def test_language_scores_against_plain_counts(spark):
    train = [("en", "the cat sat"), ("en", "a cat, the dog"), ("fr", "le chat été"), ("fr", "la mer et le"), ("de", "der hund und")]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.fit(df, per_lang=10**6)
    split = lambda t: ["".join(g) for g in re.findall(r"[^\W\d_]+", t.lower())]
    grams = lambda w, k: [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]
    tables = {k: defaultdict(Counter) for k in (0, *langid.ORDERS)}
    for g, t in train:
        for w in split(t):
            tables[0][w][g] += 1
            for k in langid.ORDERS:
                for x in grams(w, k):
                    tables[k][x][g] += 1
    langs = sorted({g for g, _ in train})
    total = {k: {g: sum(x[g] for x in t.values()) for g in langs} for k, t in tables.items()}
    log = lambda k, x, g: math.log((tables[k][x][g] + langid.SMOOTHING) / (total[k][g] + langid.SMOOTHING * (len(tables[k]) + 1)))
    sizes = Counter(g for g, _ in train)

    def scores(w):
        if w in tables[0]:
            return [log(0, w, g) for g in langs]
        for k in langid.ORDERS:
            known = [x for x in grams(w, k) if x in tables[k]]
            if known:
                return [sum(log(k, x, g) for x in known) / len(known) for g in langs]
        return [0.0] * len(langs)

    for text in ("the chat", "hunde", "catx lez étés", "12 ##", "", "qqqq"):
        lang, p = model.predict([text])
        sums = np.sum([scores(w) for w in split(text)], axis=0) + [math.log(sizes[g] / len(train)) for g in langs] if split(text) else None
        if sums is None:
            assert lang == ["und"] and p[0] == 0
        else:
            odds = np.exp(sums - sums.max())
            assert lang == [langs[int(sums.argmax())]] and abs(p[0] - odds.max() / odds.sum()) < 1e-5


def test_fingerprint_bits_against_counts():
    texts = [*TEXTS, "one two", "one two three four", "w " * 300]
    got = simhash.fingerprints(pa.array(texts))
    for t, bits in zip(texts, got.tolist(), strict=True):
        ws = words(t)
        shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
        h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        assert bits == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_kneser_ney_against_plain_counts(spark):
    texts = [prose(i, 40) + " spam spam" for i in range(25)] + ["rare1 rare2 " + prose(40, 5)]
    sample = spark.createDataFrame([(i, t, "en", False) for i, t in enumerate(texts)], "doc_id long, text string, lang string, apart boolean")
    model = kneserney.fit(sample, least=3)
    raw = [SPACE.findall(t.encode()) for t in texts]
    seen = Counter(w for ws in raw for w in ws)
    kind = lambda w: np.bitwise_or.reduce(kneserney._KIND[np.frombuffer(w, np.uint8)])

    def tokens(ws):
        out = [("repeat", kind(w)) if i and ws[i - 1] == w else w if seen[w] >= 3 else ("class", kind(w)) for i, w in enumerate(ws)]
        return ["<", "<", *out, ">"]

    c3 = Counter()
    for ws in raw:
        t = tokens(ws)
        c3.update(x for x in zip(t, t[1:], t[2:], strict=False) if x[2][0] != "repeat")
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def discount(counts):
        n = Counter(counts.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        d = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]
        return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))

    d1, d2, d3 = map(discount, (c1, c2, c3))
    off = lambda d, n: d[min(n, 3) - 1]
    kinds = sum(n >= 3 for n in seen.values()) + kneserney.CLASSES + 1
    all1 = sum(c1.values())
    free1 = sum(off(d1, n) for n in c1.values()) / all1

    def level(counts, d, context, token, lower):
        of = {k: n for k, n in counts.items() if k[:-1] == context}
        if not of:
            return lower
        total = sum(of.values())
        n = of.get((*context, token), 0)
        return (max(n - off(d, n), 0) / total if n else 0) + sum(off(d, x) for x in of.values()) / total * lower

    def p(a, b, c):
        p1 = (max(c1[c] - off(d1, c1[c]), 0) / all1 if c1[c] else 0) + free1 / kinds
        return level(c3, d3, (a, b), c, level(c2, d2, (b,), c, p1))

    for text in (texts[0], texts[25], "nothing known HERE 42", "spam spam spam", ""):
        t = tokens(SPACE.findall(text.encode()))
        want = math.exp(-sum(math.log(p(*x)) for x in zip(t, t[1:], t[2:], strict=False)) / (len(t) - 2))
        assert abs(model.perplexity(pa.array([text]))[0][0] / want - 1) < 1e-4
