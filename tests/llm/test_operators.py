"""The operators on hand-made rows with nulls, repeats and clashing names, and against brute force."""

import os
import pickle

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanforge.llm import chaining, components, descent, kneserney, langid, lattice, marginal, mixing, sharding, simhash, spmodel, textcore, topk

WORDS = "the of and to in tion er an re ha on st en nd or it ed".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(WORDS, r.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 200)
    texts = [None, "", "   ", base, base, base.replace(" the ", " xx ", 1), "x" * 6000, "Été ▁ mixed\n\ttext  here", prose(2, 120), prose(3, 60) + " " + " ".join(base.split()[20:90]), "a", "a a a a a a"]
    rows = [(i, t, [None, "en", "fr"][i % 3], ["s0", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base, "en", "s0"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("row", "shard", "slot", "label", "component", "_text", "fingerprint", "kept", "tokens", "weight", "words", "key", "n"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 3 else 0) for i in range(12)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def cases(docs, labels):
    return {
        "op1": lambda d: topk.bm25_top(d, d),
        "op2": marginal.score,
        "op3": langid.identify,
        "op5": simhash.simhash_components,
        "op6": sharding.shard_table,
        "op7": lambda d: spmodel.encoded(d.sparkSession, d, ["doc_id"]),
        "op8": chaining.passages,
        "op9": mixing.mix,
        "op10": lambda d: kneserney.judged(d, labels, ["doc_id", "lang"]),
        "drop": simhash.drop_near_copies,
        "cut": chaining.without_passages,
        "sample": mixing.sampled,
        "accept": lambda d: kneserney.accepted(d, labels),
    }


EACH_ROW = {"op2", "op3", "op5", "op6", "op7", "op9", "op10"}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10", "drop", "cut", "sample", "accept"])
def test_odd_rows_and_empty_tables(docs, labels, name):
    op = cases(docs, labels)[name]
    found = op(docs).toPandas()
    if name in EACH_ROW:
        assert len(found) == docs.count()
    if name == "op6":
        n = found.groupby("shard").slot.agg(["count", "max"])
        assert n["count"].max() <= 1 + (len(found) // 24) and (n["max"] + 1 == n["count"]).all()
    if name == "op7":
        assert found.exact.isin([True, None]).all() and found.exact.notna().sum() == docs.where("text is not null").count()
    if name == "cut":
        assert found.text[found.doc_id == 9].iloc[0].split()[:60] == prose(3, 60).split()
    if name in ("drop", "cut", "sample", "accept"):
        assert list(found.columns) == docs.columns
    assert op(docs.limit(0)).count() == 0


def test_labels_without_a_trusted_row_keep_all(docs, labels):
    out = kneserney.judged(docs, labels.limit(0), ["doc_id", "lang"])
    assert out.where("kept").count() == docs.count()


def test_xxh64_and_words():
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts, sizes = r.integers(0, 4000, 800), r.integers(0, 150, 800)
    got = textcore.xxh64_spans(data, starts, sizes, 42)
    assert all(int(h) == xxhash.xxh64(data[s : s + n].tobytes(), seed=42).intdigest() for h, s, n in zip(got, starts, sizes, strict=True))
    keys = r.permutation(np.unique(r.integers(0, 2**62, 5000).astype(np.uint64)))
    index = pickle.loads(pickle.dumps(textcore.U64Map(keys)))
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1 << 63)) == -1).all()


def test_simhash_links_against_all_pairs(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 40).astype(np.uint64)
    bits = np.unique(np.concatenate([centres] + [centres ^ sum(np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64) for _ in range(k)) for k in (1, 2, 3, 4, 5)]))
    want = {i: i for i in range(len(bits))}
    for _ in range(10):
        for i in range(len(bits)):
            for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4):
                want[i] = min(want[i], want[int(j)])
    for block in (4096, 3):
        links = simhash.near_links(spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "fingerprint_bits long"), block=block)
        at = {int(b): i for i, b in enumerate(bits.view(np.int64))}
        rows = spark.createDataFrame([(at[x["a"]], at[x["b"]]) for x in links.collect()], "a long, b long")
        got = {x["node"]: x["component"] for x in components.components(rows).collect()}
        assert {i: got.get(i, i) for i in range(len(bits))} == want


def test_lattice_against_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    logs = np.log([0.2, 0.2, 0.2, 0.1, 0.1])
    m = lattice.Pieces(pieces, logs, np.arange(5), np.arange(5, 261), np.log(1e-3))

    def every(s):
        if not s:
            return [[]]
        out = [[i, *r] for i, p in enumerate(pieces) if s.startswith(p) for r in every(s[len(p) :])]
        return out + ([[5 + s[0], *r] for r in every(s[1:])] if s[:1] not in pieces else [])

    weight = lambda w: sum(logs[i] if i < 5 else np.log(1e-3) for i in w)
    units = [b"ababa", b"bbaab", b"acab", b"a", b""]
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units])
    starts = np.cumsum(sizes) - sizes
    total = lattice.forward(m, data, starts, sizes)
    ids, cuts = lattice.viterbi(m, data, starts, sizes)
    uses, byte_uses = lattice.expected(m, data, starts, sizes, np.ones(len(units)))
    want_uses = np.zeros(5)
    for k, u in enumerate(units):
        ways = every(u)
        p = np.exp([weight(w) for w in ways])
        assert np.isclose(total[k], np.log(p.sum()))
        assert np.isclose(weight(ids[cuts[k] : cuts[k + 1]]), max(map(weight, ways)) if u else 0)
        want_uses += sum((np.bincount([i for i in w if i < 5], minlength=5) * x for w, x in zip(ways, p / p.sum(), strict=True)), np.zeros(5))
    assert np.allclose(uses, want_uses) and np.isclose(byte_uses[ord("c")], 1)
    assert np.isclose(lattice._forward_one(m, data[:5]), total[0]) and lattice._viterbi_one(m, data[:5]).tolist() == ids[: cuts[1]].tolist()


def test_ids_decode_with_the_library_too():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spmodel.default_model_path())
    texts = [*(prose(i, 40) for i in range(30)), "  two  spaces ", "tab\tline\n", "日本 😀"]
    codec = spmodel.codec(spmodel.default_model_path())
    ids, cuts = codec.encode(pa.array(texts))
    assert [sp.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == texts
    assert codec.decode(ids, cuts).to_pylist() == texts
    total = lambda x: sum(sp.get_score(int(i)) for i in x)  # noqa: E731  byte-pair merges are never better under the scores
    assert all(total(ids[a:b]) >= total(sp.encode(t)) for a, b, t in zip(cuts[:-1], cuts[1:], texts[:30], strict=False))


def test_search_against_full_scores():
    r = np.random.default_rng(2)
    column = pa.array([" ".join(r.choice(WORDS, r.integers(5, 60))) for _ in range(900)])
    from spanforge.llm.wordstats import Tokens

    t = Tokens(column)
    doc, key, tf = topk.term_counts(t)
    index = topk.opened(topk.build(np.arange(900), doc, key, tf, np.diff(t.offsets)), float(np.diff(t.offsets).mean()))
    for q in range(0, 900, 90):
        terms, w = key[doc == q], r.random((doc == q).sum())
        norm = topk.K1 * (1 - topk.B + topk.B * np.diff(t.offsets) / np.diff(t.offsets).mean())
        full = np.zeros(900)
        for k, x in zip(terms, w, strict=True):
            full[doc[key == k]] += x * tf[key == k] * (topk.K1 + 1) / (tf[key == k] + norm[doc[key == k]])
        full = np.round(full, topk.DIGITS)
        ids, scores, _ = topk.search(index, terms, w)
        assert ids.tolist() == np.lexsort((np.arange(900), -full))[:10].tolist() and np.allclose(scores, full[ids], atol=1e-5)


def test_descent_against_all_pairs(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 16)).astype(np.float32)
    x[50:90] = x[50] + 0.2 * r.standard_normal((40, 16))
    x[90:95] = x[90]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 16), (302, [None] * 16), (303, [float("nan")] * 16), (304, [1.0]), (305, [])]
    got = descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1))).toPandas().set_index("vec_id")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert (got.n_links.reindex(range(300)) == linked.sum(1)).all() and (got.n_links.reindex(range(300, 306)) == 0).all()
    label = np.arange(300)
    for _ in range(20):
        label = np.array([min(label[i], label[linked[i]].min() if linked[i].any() else i) for i in range(300)])
    assert (got.component_id.reindex(range(300)) == label).all() and len(got) == 306
    assert descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_descent_links_saturated_groups(spark):
    r = np.random.default_rng(4)
    centres = np.zeros((2, 32))
    centres[0, 0] = 1
    centres[1, :2] = 0.93, np.sqrt(1 - 0.93**2)
    x = (np.repeat(centres, 14, axis=0) + 0.004 * r.standard_normal((28, 32))).astype(np.float32)
    got = descent.near_duplicates(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(28)], "vec_id long, embedding array<float>")).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert (u @ u.T).min() >= 0.9 and (u[:14] @ u[:14].T).min() > (u[:14] @ u[14:].T).max()
    assert (got.n_links == 27).all() and (got.component_id == 0).all() and got.kept.sum() == 1


def test_thresholds_come_from_all_trusted_documents_not_fitted(spark):
    docs = spark.createDataFrame([(i, prose(100 + i, 30 + i % 40), "en") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = kneserney.fitted(docs, labels, 60)
    sample = kneserney.trusted_sample(docs, labels, 60)
    used = {r.doc_id for r in sample.where("NOT apart").collect()}
    rest = sorted(r.perplexity for r in kneserney.perplexities(docs, model, ["doc_id"]).collect() if r.doc_id not in used)
    assert len(rest) > 200 and np.isclose(model.limits["en"], rest[int(np.ceil(0.99 * len(rest))) - 1] * kneserney.SLACK)


def test_long_units_are_counted_by_pieces_and_alone():
    m = lattice.Pieces([b"a", b"b", b"ab"], np.log([0.3, 0.3, 0.4]), np.arange(3), np.arange(3, 259), np.log(1e-3))
    units = [b"ab" * 30, b"abc", b"ab" * 250]
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units])
    starts = np.cumsum(sizes) - sizes
    each = [lattice.expected(m, data, starts[[i]], sizes[[i]], np.ones(1)) for i in range(3)]
    together = lattice.expected(m, data, starts, sizes, np.ones(3))
    assert np.allclose(together[0], sum(e[0] for e in each)) and np.allclose(together[1], sum(e[1] for e in each))
    assert np.allclose(each[2][0], each[0][0] * 250 / 30) and each[2][1].sum() == 0 and np.isclose(together[1].sum(), 1)


def test_near_copies_are_dropped_by_text_and_not_by_id(spark):
    texts = [prose(i, 80) for i in range(5)]
    rows = [(1, texts[0]), (2, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4])]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), texts.index(r.text)) for r in got) == [(0, 1), (0, 2), (1, 0), (7, 3), (7, 4)]


def test_chains_skip_and_align():
    q0, r0 = np.array([0, 10, 40, 90]), np.array([100, 112, 20, 190])
    best = chaining.chain(q0, q0 + 8, r0, r0 + 8, 0.01)[0]
    assert best.tolist() == [0, 1, 3]
    a = np.arange(80)
    b = np.delete(a, [10, 30])
    assert chaining.edits(a, b, 16) == 2
    assert chaining.align(a, b, (20, 19), (28, 27), 50, 0.8) is None or chaining.align(a, b, (0, 0), (80, 78), 50, 0.8)[4] == 1 - 2 / 80


def words_of(seed: int, n: int) -> list[str]:
    return [f"w{i}" for i in np.random.default_rng(seed).integers(0, 10**9, n)]


def repeats(spark, texts: dict[int, list[str]]) -> list[tuple]:
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    return sorted((r.doc_id, r.start, r.end, r.holder_id) for r in chaining.passages(rows).collect())


def test_passages_on_both_sides_of_a_gap(spark):
    one, two, body = words_of(1, 60), words_of(2, 60), words_of(3, 130)
    texts = {1: one + words_of(4, 50) + two, 2: one + words_of(5, 50) + two, 3: one + two, 4: words_of(6, 200) + words_of(7, 200), 5: words_of(6, 200) + body + words_of(7, 200)}
    texts[4][200:200] = words_of(8, 130)
    assert repeats(spark, texts) == [(2, 0, 60, 1), (2, 110, 170, 1), (3, 0, 60, 1), (3, 60, 120, 1), (5, 0, 200, 4), (5, 330, 530, 4)]


def test_passage_whose_lines_stood_elsewhere_before(spark):
    one, two = words_of(1, 30), words_of(2, 30)
    texts = {i: words_of(10 + i, 40) + part + words_of(50 + i, 40) for i, part in {1: one, 2: two, 10: one + two, 15: one, 16: two, 20: one + two}.items()}
    assert repeats(spark, texts) == [(20, 40, 100, 10)]


def test_edits_up_to_the_similarity_and_edges():
    r = np.random.default_rng(9)
    a = r.integers(0, 10**6, 1000)
    b = np.concatenate([a[:200], a[380:], r.integers(0, 10**6, 180)])
    assert chaining._distance(a[:800], b[:620], 200) == 180 and chaining._distance(a, r.integers(0, 10**6, 1000), 200) > 200
    c = a.copy()
    c[[18, 30]] = -1
    assert chaining.align(a[:60], c[:60], (19, 19), (30, 30), 50, 0.8)[:4] == (0, 60, 0, 60)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(os.path.join(d, "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, d)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert 0 < corpus_pipeline.STAGES[-1][1](spark, docs, d).where("exact").count() == docs.count()


def test_near_copies_against_shingle_sets(spark):
    r = np.random.default_rng(8)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in r.integers(0, 5000, 150)]
        texts.append(" ".join(words))
        for changes in (1, 2, 5, 12):
            new = list(words)
            for at in r.choice(150, changes, replace=False):
                new[at] = f"x{r.integers(0, 5000)}"
            texts.append(" ".join(new))
    texts += ["", " ", "one two", "one two", "one three"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set() for t in texts]
    label = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if (a or b) and len(a & b) >= 0.8 * len(a | b) or not (a or b):
                    label[j] = min(label[i], label[j])
    got = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = set(label)
    # Nothing goes that isn't near another; what stays beyond that are pairs that no key of the index holds.
    assert want <= got and len(got - want) <= 3


def test_closest_links_span_what_links_span():
    r = np.random.default_rng(9)
    a, b = r.integers(0, 60, 400), r.integers(0, 60, 400)
    bits = r.integers(0, 20, 400).astype(np.int16)
    kept = simhash._closest(60, a, b, bits)
    for bound in range(20):
        every, few = bits <= bound, bits[kept] <= bound
        assert (simhash._forest(60, a[every], b[every]) == simhash._forest(60, a[kept][few], b[kept][few])).all()
    assert len(kept) < 60
