"""Links that the closest pair of two groups hasn't, and groups of which very many pairs are doubtful."""

import numpy as np
import pyarrow as pa

from spanforge.llm import simhash


def _texts(seed: int) -> list[str]:
    """a and its near copy b, and c, of which b has one replaced word more than a: Jaccard 0.774 with a, 0.815 with b."""
    rng = np.random.default_rng(seed)
    a = [f"w{x}" for x in rng.integers(0, 10**9, 200)]
    b, c = a.copy(), a.copy()
    b[20] = c[20] = f"v{seed}"
    for at in (50, 80, 110, 140):
        c[at] = f"u{at}"
    return [" ".join(x) for x in (a, b, c)]


def test_a_failed_closest_pair_hides_no_other_link(spark):
    sure, most = simhash.bit_bounds(0.8)

    def fits(texts: list[str]) -> bool:
        prints = np.stack(simhash.wide_fingerprints(pa.array(texts), 5))
        bits = lambda i, j: int(np.bitwise_count(prints[:, i] ^ prints[:, j]).sum())
        octets = [prints[:, i].copy().view(np.uint8) for i in (1, 2)]
        meet = any(all(octets[0][p] == octets[1][p] for p in key) for key in simhash.WIDE_KEYS)
        return bits(0, 1) <= sure < bits(0, 2) < bits(1, 2) <= most and meet

    cases = [t for t in map(_texts, range(300)) if fits(t)][:5]
    assert len(cases) == 5
    rows = [(3 * i + j, t) for i, texts in enumerate(cases) for j, t in enumerate(texts)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 6, 9, 12]


def test_doubtful_pairs_are_not_written(spark, monkeypatch):
    """300 versions of one text, most pairs of them doubtful and too far apart: kept rows as by brute force, no table of pairs."""
    rng = np.random.default_rng(3)
    base = np.array([f"w{x}" for x in rng.integers(0, 10**9, 220)], object)
    texts = []
    for i in range(300):
        x = base.copy()
        for at in rng.choice(220, 4 + i % 3, replace=False).tolist():
            x[at] = f"v{i}-{at}"
        texts.append(x)
    sets = [{" ".join(x[j : j + 5]) for j in range(len(x) - 4)} for x in texts]
    label = list(range(300))
    for i in range(300):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    written, settled = [], simhash.settled

    def counted(df):
        out = settled(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(simhash, "settled", counted)
    kept = simhash.drop_near_copies(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string"))
    ids = {r["doc_id"] for r in kept.collect()}
    # A pair that shares no key can be missed, so a class of brute force may fall in parts, but none joins another.
    assert ids >= set(label) and len(ids) <= 1.1 * len(set(label)) + 1
    first = next(i for i, (columns, _) in enumerate(written) if "home" in columns)
    assert all(n <= 2 * 300 for _, n in written[first:]), written


def test_rounds_carry_one_link_a_copy(spark, monkeypatch):
    """Copies share many lists and have a link of each; what goes through the rounds of components is a forest of them."""
    rng = np.random.default_rng(4)
    base = np.array([f"w{x}" for x in rng.integers(0, 10**9, 220)], object)
    rows = []
    for i in range(200):
        x = base.copy()
        x[rng.choice(220, 3, replace=False)] = [f"v{i}-{j}" for j in range(3)]
        rows.append((i, " ".join(x)))
    given, components = [], simhash.components

    def counted(links):
        given.append(links.count())
        return components(links)

    monkeypatch.setattr(simhash, "components", counted)
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() < 20
    assert given and max(given) < 200, given


def test_a_forest_in_parts_connects_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINKS", 50)
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-300, 300, 400) for _ in range(2))
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long").repartition(8)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = simhash._forest(len(nodes), at[:400], at[400:])
    want = {(int(n), int(nodes[x])) for n, x in zip(nodes, label, strict=True) if (label == x).sum() > 1}
    assert {tuple(r) for r in simhash.components(simhash._connecting(links)).collect()} == want
