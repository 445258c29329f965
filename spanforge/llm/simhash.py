"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, seen as eight positional bytes (p, value). Two fingerprints that differ in at most four
bits differ in at most four bytes, so at least four of their eight positional bytes are equal: that is the guaranteed
minimum of the count filter. Of any seven positions at least three then match, so the index is keyed by three
positional bytes out of the first seven (35 keys a fingerprint, 24 bits each): every pair that can pass the filter
meets under a key, and lists are 65,536 times shorter than those of single bytes. Within a list the shared
positional bytes are tallied, pairs under the minimum go, the rest are verified bit by bit.

Copies share a fingerprint and are one entry of the index. A list passes on a spanning forest of its links, never all
its pairs. Lists longer than BLOCK are dealt by the hash of the fingerprint to pairs of blocks, each a group of its
own, so the work of a list spreads over tasks and a task's memory stays bounded.

Four bits of 64 are a shingle cosine of about 0.98. Copies down to a Jaccard similarity of 0.8 differ in more bits than
positions could guarantee a match for, so `drop_near_copies` takes 256 bits (32 positional bytes) of the distinct
shingles and 96 keys of three positions, asks for the three shared bytes of a key, and verifies: pairs well below the
bits expected at the threshold are links, pairs around it are compared by their shingles. A pair is found if one of the
96 keys is equal, which is likely and not certain; the README gives the measured recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .components import components
from .session import cut, settled
from .sieve import NAME, sieved
from .textcore import LOWER, U64, mix, one_spaced, ragged, segment_sums, slices, text_bytes, words, xxh64_spans

WIDTH = 4
MOST_BITS = 4
LEAST_BYTES = 8 - MOST_BITS
BLOCK = 4096
KEYS = list(combinations(range(7), LEAST_BYTES - 1))
WIDE = [f"w{k}" for k in range(4)]
WIDE_BITS = 64 * len(WIDE)
WIDE_STEPS = [(1, 4), (2, 9), (5, 13)]
#: No two positions share more than one key: the steps' differences are all distinct.
WIDE_KEYS = [tuple((k + step) % (8 * len(WIDE)) for step in (0, *steps)) for steps in WIDE_STEPS for k in range(8 * len(WIDE))]
PAIRS = 500_000
LINKS = 1_000_000
SIDE, SIDES = 128, 32


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' word shingles, repeats kept, one text after the other, and the number of each text."""
    data, offsets = text_bytes(column)
    starts, lengths, word_at = words(LOWER[data], offsets)
    text, at = one_spaced(LOWER[data], starts, lengths)
    ends = at + lengths
    n = np.diff(word_at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    cum = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(cum[-1]) + np.repeat(word_at[:-1] - cum[:-1], count)
    last = np.minimum(first + width - 1, np.repeat(word_at[1:] - 1, count))
    return xxh64_spans(text, at[first], ends[last] - at[first]) if cum[-1] else np.zeros(0, U64), count


def _distinct(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without a text's repeats."""
    owner = np.repeat(np.arange(len(count)), count)
    h = h[np.lexsort((h, owner))]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(count))


def _majorities(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half its hashes."""
    out = np.zeros(len(count), U64)
    if not len(h):
        return out
    cum = np.concatenate([[0], np.cumsum(count)])
    # Four counters of 16 bits to a word: a run of at most 65,535 shingles can't overflow them.
    runs = [np.arange(a, b, 65535) for a, b in zip(cum[:-1].tolist(), cum[1:].tolist(), strict=True) if b > a]
    begin = np.concatenate(runs)
    owner = np.repeat(np.flatnonzero(count), [len(x) for x in runs])
    lane = U64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((h >> U64(k)) & lane, begin)
        for j in range(4):
            ones = np.bincount(owner, ((sums >> U64(16 * j)) & U64(0xFFFF)).astype(np.float64), len(count))
            out |= (ones * 2 > count).astype(U64) << U64(16 * j + k)
    return out


def fingerprints(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if it is in over half the hashes of the word shingles.

    Words are lower-cased (A-Z only) and shingles keep repeats. Fewer words than `width` make one shingle of them
    all; no word (or a null) gives zero.
    """
    return _majorities(*_shingles(column, width))


def wide_fingerprints(column: pa.Array, width: int) -> list[np.ndarray]:
    """The 256-bit SimHash of each text's distinct shingles, as four words; no word (or a null) gives zeros."""
    h, count = _distinct(*_shingles(column, width))
    return [_majorities(h if k == 0 else mix(h + U64(k)), count) for k in range(len(WIDE))]


def _folded(prints: list[np.ndarray]) -> np.ndarray:
    """One word that stands for a fingerprint: itself if it has one word, else a hash of its words."""
    out = prints[0]
    for x in prints[1:]:
        out = mix(out) ^ x
    return out


def _appended(docs: DataFrame, keep: list[str], text: str, fields: list[StructField], made: Callable[[pa.Array], list]) -> DataFrame:
    """The columns `keep` of docs and `fields`, whose arrays `made` gives for a column of texts."""
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    names = [*keep, *[f.name for f in fields]]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made(batch.column(len(keep)))], names=names)

    return rows.mapInArrow(go, StructType([*[docs.schema[c] for c in keep], *fields]))


def _longs(arrays: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(x.view(np.int64)) for x in arrays]


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH) -> DataFrame:
    """The columns `keep` of docs and `fingerprint_bits`, a long."""
    return _appended(docs, keep, text, [StructField("fingerprint_bits", LongType())], lambda c: _longs([fingerprints(c, width)]))


def with_wide_fingerprint(docs: DataFrame, keep: list[str], text: str, width: int) -> DataFrame:
    """The columns `keep` of docs, the longs of the wide fingerprint and `node`, the long that stands for it."""

    def made(column: pa.Array) -> list[pa.Array]:
        prints = wide_fingerprints(column, width)
        return _longs([*prints, _folded(prints)])

    return _appended(docs, keep, text, [StructField(c, LongType()) for c in [*WIDE, "node"]], made)


def with_shingles(docs: DataFrame, keep: list[str], text: str, width: int) -> DataFrame:
    """The columns `keep` of docs and `shingles`, the hashes of the distinct shingles."""

    def made(column: pa.Array) -> list[pa.Array]:
        h, count = _distinct(*_shingles(column, width))
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(h.view(np.int64)))]

    return _appended(docs, keep, text, [StructField("shingles", ArrayType(LongType()))], made)


def _forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches by the links a[i] - b[i]."""
    label = np.arange(nodes)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def _closest(nodes: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the links a[i] - b[i] form a spanning forest of least bits: each round, every tree takes its closest link."""
    label, left, taken = np.arange(nodes), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.concatenate(taken)
        # The place of a link breaks ties, so that no round closes a ring.
        rank = bits[left].astype(np.int64) * len(a) + left
        least = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(least, label[a[left]], rank)
        np.minimum.at(least, label[b[left]], rank)
        best = np.unique(least[least < np.iinfo(np.int64).max]) % len(a)
        taken.append(best)
        label = _forest(nodes, label[a[best]], label[b[best]])[label]


def _links_in_lists(key: np.ndarray, prints: list[np.ndarray], most: int, least: int, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key: places a and b of linked rows and their differing bits.

    They connect all that the lists' links connect, at every bound from `sure` to `most`: a spanning forest of least
    bits. Rows that `sure` links connect already aren't compared again.
    """
    nodes, held, new, check = len(key), [], 0, 1
    label = np.arange(nodes)

    def shortened() -> list[tuple[np.ndarray, ...]]:
        a, b, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        kept = _closest(nodes, a, b, bits)
        return [(a[kept], b[kept], bits[kept])]

    at, step = np.arange(max(nodes - 1, 0)), 1
    while len(at):
        at = at[at + step < nodes]
        at = at[key[at] == key[at + step]]
        a = at[label[at] != label[at + step]]
        bits = sum(np.bitwise_count(w[a] ^ w[a + step]).astype(np.int16) for w in prints)
        a, bits = a[bits <= most], bits[bits <= most]
        same = sum((((w[a] ^ w[a + step]) >> U64(8 * p)) & U64(0xFF)) == 0 for w in prints for p in range(8))
        a, bits = a[same >= least], bits[same >= least]
        held.append((a, a + step, bits))
        new += len(a)
        if new > PAIRS or (step == check and new):
            held, new = shortened(), 0
            a, b, bits = held[0]
            label = _forest(nodes, a[bits <= sure], b[bits <= sure])
        check = 2 * check if step == check else check
        step += 1
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    return shortened()[0]


def _pairs_apart(key: np.ndarray, prints: list[np.ndarray], home: np.ndarray, most: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As _links_in_lists(), but every pair between rows of different homes, in parts of about PAIRS."""
    at, step, held, new = np.arange(max(len(key) - 1, 0)), 1, [], 0
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        a = at[home[at] != home[at + step]]
        bits = sum(np.bitwise_count(w[a] ^ w[a + step]).astype(np.int16) for w in prints)
        a, bits = a[bits <= most], bits[bits <= most]
        same = sum((((w[a] ^ w[a + step]) >> U64(8 * p)) & U64(0xFF)) == 0 for w in prints for p in range(8))
        a, bits = a[same >= least], bits[same >= least]
        held.append((a, a + step, bits))
        new, step = new + len(a), step + 1
        if new > PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, new = [], 0
    if new:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _linker(most: int, least: int, sure: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            group, *prints = (np.concatenate(x) for x in zip(*rows, strict=True))
            prints = [w.view(U64) for w in prints]
            a, b, bits = _links_in_lists(group, prints, most, least, sure)
            ends = [_folded([w[x] for w in prints]).view(np.int64) for x in (a, b)]
            links = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends), bits.astype(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], names=["a", "b", "bits"])

        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            group = part[0]
            if not len(group):
                continue
            cutoff = int(np.searchsorted(group, group[-1])) if group[-1] != group[0] else 0
            if cutoff or (held and held[-1][0][-1] != group[0]):
                if not cutoff:
                    yield from out(held)
                    held, size = [part], len(group)
                    continue
                if size + cutoff >= 200_000:
                    yield from out([*held, [x[:cutoff] for x in part]])
                    held, size = [[x[cutoff:] for x in part]], len(group) - cutoff
                    continue
            held.append(part)
            size += len(group)
        if held:
            yield from out(held)

    return go


def near_links(
    classes: DataFrame,
    prints: list[str] | None = None,
    keys: list[tuple[int, ...]] = KEYS,
    most: int = MOST_BITS,
    least: int = LEAST_BYTES,
    sure: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(a, b, bits): pairs of different fingerprints that share a key, have `least` positional bytes and all but `most` bits equal.

    The pairs connect all that such pairs connect, for every bound from `sure` (`most`) to `most`. `classes` holds each
    fingerprint once, as the longs `prints` (fingerprint_bits); a and b are _folded() ones, of one long that itself.
    `keys` are the positions that must be equal; the default finds every pair within four of 64 bits.
    """
    prints = prints or ["fingerprint_bits"]
    names = [f"f{k}" for k in range(len(prints))]
    classes = classes.select(*[classes[c].alias(n) for c, n in zip(prints, names, strict=True)])

    def key(k: int, positions: tuple[int, ...]) -> str:
        parts = [f"(shiftright(f{p // 8}, {8 * (p % 8)}) & 255L) << {8 * i}" for i, p in enumerate(positions)]
        return f"({' | '.join([f'{k}L << 40', *(f'({x})' for x in parts)])})"

    listed = classes.selectExpr(*names, f"explode(array({', '.join(key(k, c) for k, c in enumerate(keys))})) as list")
    # As a table of its own the few long lists meet the rows without a shuffle, as far as the planner sees that they are few.
    long = settled(listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(F.col("list").alias("hot"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = listed.join(long, listed["list"] == long["hot"], "left")
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)))
    # The group is the hash of a list and a pair of blocks; what a collision adds is verified like the rest.
    groups = dealt.select(*names, "list", F.explode(pairs).alias("pair")).select(F.xxhash64("list", "pair").alias("group"), *names)
    groups = groups.repartition("group").sortWithinPartitions("group", names[0])
    return groups.mapInArrow(_linker(most, least, most if sure is None else sure), "a long, b long, bits long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id that a row reaches by fingerprints at
    `most` or fewer differing bits, itself included. A null or wordless text has fingerprint zero and links like any
    other. Repeated rows give repeated rows; a row with a null doc_id takes part and gets the component of its
    fingerprint (null if no row there has an id); a fingerprint that only rows without an id hold links no others. An empty table gives no rows; further columns are ignored.
    """
    prints = cut(with_fingerprint(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), ["doc_id"], "text", width))
    classes = cut(prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least")))
    links = near_links(classes, most=most)
    a, b = (classes.select(F.col("fingerprint_bits").alias(f"f{x}"), F.col("least").alias(f"l{x}")) for x in "ab")
    linked = links.join(a, links["a"] == a["fa"]).join(b, links["b"] == b["fb"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    groups = components(linked)
    # Only the classes in a component of several need more than their own smallest id.
    moved = classes.join(groups, classes["least"] == groups["node"]).select(F.col("fingerprint_bits").alias("bits"), "component")
    home = classes.join(moved, classes["fingerprint_bits"] == moved["bits"], "left").select(F.col("fingerprint_bits").alias("bits"), F.coalesce("component", "least").alias("component_id"))
    # As a table of its own it meets the rows in a plain join, which splits a fingerprint that very many rows share.
    home = settled(home)
    return prints.join(home, prints["fingerprint_bits"] == home["bits"]).select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


def bit_bounds(similarity: float) -> tuple[int, int]:
    """Of the wide fingerprint: the bits up to which a pair surely has a Jaccard similarity, and above which it hasn't.

    The expected share of differing bits is the angle over pi; the bounds lie 3 standard deviations below and 2.5 above.
    """
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    spread = math.sqrt(WIDE_BITS * share * (1 - share))
    return max(0, math.floor(WIDE_BITS * share - 3 * spread)), math.ceil(WIDE_BITS * share + 2.5 * spread)


def _sets(hashed: DataFrame, prints: DataFrame, ends: DataFrame, text: str, width: int, same: Callable) -> DataFrame:
    """(end, shingles) of the classes `end`: the hashes of their distinct shingles, in order."""
    held = prints.join(ends, prints["node"] == ends["end"])
    held = held.groupBy("end").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_hash")).alias("row"))
    held = held.select(F.col("end").alias("_end"), F.col("row.doc_id").alias("_kept"), F.col("row._text_hash").alias("_kept_hash"))
    held = settled(held)
    few = sieved(hashed, hashed["_text_hash"], held.select("_kept_hash")).where(NAME)
    texts = few.join(held, same(few, held)).select(held["_end"].alias("end"), few[text].alias("text")).dropDuplicates(["end"])
    return settled(with_shingles(texts, ["end"], "text", width))


def _verified(doubtful: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those links of doubtful whose ends' distinct shingles have the Jaccard similarity."""
    a, b = (sets.select(F.col("end").alias(f"end_{x}"), F.col("shingles").alias(f"shingles_{x}")) for x in "ab")
    both = doubtful.join(a, doubtful["a"] == a["end_a"]).join(b, doubtful["b"] == b["end_b"])
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    either = F.size("shingles_a") + F.size("shingles_b") - shared
    return both.where(shared + F.lit(1e-9) >= either * F.lit(similarity)).select("a", "b")


def _still_apart(classes: DataFrame, loose: DataFrame, groups: DataFrame) -> DataFrame:
    """Of classes (with node) those whose component `loose` under all links holds several groups; home is the group."""
    loose = loose.select(F.col("node").alias("_node"), F.col("component").alias("loose"))
    groups = groups.select(F.col("node").alias("_in"), F.col("component").alias("_group"))
    homes = settled(loose.join(groups, F.col("_node") == F.col("_in"), "left").select("_node", "loose", F.coalesce("_group", "_node").alias("home")))
    mixed = homes.groupBy("loose").agg(F.min("home").alias("_low"), F.max("home").alias("_high")).where("_low < _high").select(F.col("loose").alias("_mixed"))
    homes = homes.join(mixed, F.col("loose") == F.col("_mixed"), "left_semi")
    return settled(classes.join(homes, F.col("node") == F.col("_node")).select(*WIDE, "node", "home", "loose"))


def _similar_apart(prints: list[np.ndarray], home: np.ndarray, side: np.ndarray, within: bool, flat: np.ndarray, at: np.ndarray, most: int, similarity: float) -> list[tuple[int, int]]:
    """Rows of different homes that are similar: of the pairs that share a wide key as many as connect all that these connect.

    Row i holds the hashes flat[at[i] : at[i + 1]], in order. Unless `within`, only pairs of different sides are compared.
    """
    m, size, out = len(home), np.diff(at), []
    label = np.unique(home, return_inverse=True)[1]
    octets = np.stack(prints, axis=1).astype("<u8").view(np.uint8)
    key = np.concatenate([sum((octets[:, p].astype(np.int64) << 8 * i for i, p in enumerate(c)), np.full(m, k << 40)) for k, c in enumerate(WIDE_KEYS)])
    order = np.argsort(key, kind="stable")
    row = order % m
    for a, b, _ in _pairs_apart(key[order], [w[row] for w in prints], home[row], most, 3):
        a, b = np.minimum(row[a], row[b]), np.maximum(row[a], row[b])
        pairs = np.unique((a * m + b)[within | (side[a] != side[b])])
        a, b = pairs // m, pairs % m
        begin = np.flatnonzero(np.diff(a, prepend=-1))
        for i, others in zip(a[begin].tolist(), np.split(b, begin[1:]) if len(begin) else [], strict=True):
            others = others[label[others] != label[i]]
            own, theirs = flat[at[i] : at[i + 1]], flat[ragged(at[others], size[others])]
            if not len(own) or not len(theirs):
                continue
            found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            shared = segment_sums(found.astype(np.int64), np.concatenate([[0], np.cumsum(size[others])]))
            others = others[shared + 1e-9 >= (len(own) + size[others] - shared) * similarity]
            met, first = np.unique(label[others], return_index=True)
            out += [(i, j) for j in others[first].tolist()]
            label[np.isin(label, met)] = label[i]
    return out


def _links_apart(rest: DataFrame, sets: DataFrame, most: int, similarity: float) -> DataFrame:
    """(a, b): verified links that connect the homes of `rest` (of _still_apart()) as all of them together would.

    Pairs are compared where they meet and only links leave the task, so what is written grows with the rows and not with
    their pairs. The classes of a loose component are dealt by hash to blocks of about SIDE, at most SIDES, and every two
    blocks are a group: a class goes to at most SIDES of these, whatever the component's size.
    """
    blocks = F.least(F.ceil(F.col("n") / SIDE), F.lit(SIDES)).cast("int")
    dealt = rest.groupBy("loose").agg(F.count(F.lit(1)).alias("n")).select(F.col("loose").alias("_loose"), blocks.alias("blocks"))
    rows = rest.join(dealt, F.col("loose") == F.col("_loose")).join(sets, F.col("node") == F.col("end"))
    rows = rows.select(*WIDE, "node", "home", "loose", "shingles", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("side", j).alias("low"), F.greatest("side", j).alias("high")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("loose", "pair.low", "pair.high", *WIDE, "node", "home", "side", "shingles")

    def go(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).combine_chunks() for c in group.column_names}
        number = lambda c: column[c].to_numpy(zero_copy_only=False)
        lists = column["shingles"]
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
        found = _similar_apart([number(c).view(U64) for c in WIDE], number("home"), number("side"), number("low")[0] == number("high")[0], flat, at, most, similarity)
        ends = number("node")[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    return rows.groupBy("loose", "low", "high").applyInArrow(go, "a long, b long")


def _connecting(links: DataFrame) -> DataFrame:
    """(a, b): as few links as connect what those of a settled table connect, in parts of about LINKS of them.

    A part gives each of its nodes one link, to the smallest node that it reaches there. So rounds over links don't carry
    the up to 96 links that a near copy has, one of each list.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            ends = np.concatenate(held, axis=1)
            nodes, at = np.unique(ends, return_inverse=True)
            at = at.reshape(ends.shape)
            label = _forest(len(nodes), at[0], at[1])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size >= LINKS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    parts = -(-links.count() // LINKS)
    return links.select("a", "b").coalesce(max(1, parts)).mapInArrow(go, "a long, b long")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component of near copies: that with the smallest doc_id, a null counting as largest.

    Texts link if their distinct shingles have the Jaccard similarity: pairs that share a key of the wide fingerprint
    and lie under the lower of bit_bounds() are linked, those up to the upper one are compared by their shingles: first
    the closest pair of each two groups, then, where some of these fail, every pair of groups that are still apart, in
    tasks that write the links alone.
    Wordless and null texts are copies of one another. Ids don't link rows: rows with
    a null doc_id, and rows that share one but hold texts that aren't near, each stay for their own component.
    Repeated rows leave one; an empty table gives no rows; further columns are kept.
    """
    hashed = docs.withColumn("_text_hash", F.xxhash64(docs[text]))

    def same(rows: DataFrame, kept: DataFrame):
        return rows[doc_id].eqNullSafe(kept["_kept"]) & (rows["_text_hash"] == kept["_kept_hash"])

    prints = cut(with_wide_fingerprint(hashed.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), "_text_hash"), ["doc_id", "_text_hash"], "text", width))
    sure, most = bit_bounds(similarity)
    classes = cut(prints.select(*WIDE, "node").distinct())
    links = near_links(classes, WIDE, WIDE_KEYS, most, 3, sure)
    links = settled(links.groupBy("a", "b").agg(F.min("bits").alias("bits")))
    certain = links.where(F.col("bits") <= sure).select("a", "b")
    first = settled(components(_connecting(certain)))
    x, y = (first.select(F.col("node").alias(f"node_{c}"), F.col("component").alias(f"group_{c}")) for c in "ab")
    apart = links.where(F.col("bits") > sure).join(x, F.col("a") == x["node_a"], "left").join(y, F.col("b") == y["node_b"], "left")
    apart = apart.select("bits", "a", "b", F.coalesce("group_a", "a").alias("x"), F.coalesce("group_b", "b").alias("y")).where("x <> y")
    closest = apart.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("bits", "a", "b")).alias("link"))
    doubtful = settled(closest.select("link.a", "link.b"))
    ends = settled(doubtful.select("a").union(doubtful.select("b")).distinct().withColumnRenamed("a", "end"))
    verified = _verified(doubtful, _sets(hashed, prints, ends, text, width, same), similarity)
    joined = settled(certain.union(verified))
    rest = _still_apart(classes, components(_connecting(links)), components(_connecting(joined)))
    sets = _sets(hashed, prints, rest.select(F.col("node").alias("end")), text, width, same)
    found = settled(_links_apart(rest, sets, most, similarity))
    groups = settled(components(_connecting(joined.union(found))))
    homes = prints.join(groups, prints["node"] == groups["node"], "left").select(F.coalesce("component", prints["node"]).alias("home"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_hash").alias("row"))
    kept = homes.groupBy("home").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("_kept"), F.col("row._text_hash").alias("_kept_hash"))
    kept = settled(kept)
    # Only rows that go, or of which there are several, need to move: a key that is kept and occurs once stays where it is.
    keyed = prints.groupBy("doc_id", "_text_hash").agg(F.count(F.lit(1)).alias("n"))
    several = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_kept"]) & (keyed["_text_hash"] == kept["_kept_hash"]), "left").where((F.col("n") > 1) | F.col("_kept_hash").isNull())
    rows = sieved(hashed, hashed["_text_hash"], settled(several.select(F.col("_text_hash").alias("_moved"))))
    moved = rows.where(NAME).drop(NAME)
    moved = moved.join(kept, same(moved, kept), "left_semi").dropDuplicates([doc_id, "_text_hash"])
    return rows.where(~F.col(NAME)).drop(NAME).union(moved).drop("_text_hash")
