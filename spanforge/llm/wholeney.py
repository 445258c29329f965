"""The Kneser-Ney model of kneserney.py over all trusted text, its tables sharded by the middle word of a trigram.

Everything that the probability of a trigram (a, b, c) needs holds b: the counts of a b c, of what follows a b, of b c and
of b. Only the lowest order, one number a word, goes to every task. Training text is packed into sorted trigram counts by
shard, which a first pass merges; from these come the discounts and the lowest order. Documents are then packed the same
way, in batches of about BATCH_BYTES of text, each distinct trigram of a batch once with the documents that hold it; a
shard's task builds its tables and sums the logs of each batch's documents. Texts are asked for in WAVES parts, by their
hash, since packed trigrams take about as much disk as the input; what a part has shuffled goes with it. No text moves, and no table is held whole
anywhere but the words that occur `least` times or more. What a text gets depends on the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneserney import BEGIN, CLASSES, FIRST_WORD, LEAST, Lookup, _discounts, _steady, token_ids, trusted_ids
from .langid import held_out
from .session import forget, settled
from .textcore import U8, U64, U64Map, mix, slices
from .wordstats import Tokens

BATCH_BYTES = 8 << 20
SHARDS, SHARD_BYTES = 24, 100 << 20
WAVES = 4
SEPARATE = 5
ROWS = 1_000_000


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays by compressed byte planes."""
    planes = [(x.dtype.str, len(x), np.ascontiguousarray(np.ascontiguousarray(x).view(U8).reshape(len(x), x.itemsize).T).tobytes()) for x in arrays]
    return pickle.dumps([(kind, n, pa.compress(x, codec="zstd", asbytes=True), len(x)) for kind, n, x in planes], 5)


def opened(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, x, size in pickle.loads(data):
        planes = np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), U8)
        out.append(np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
    return out


def _stored(b: np.ndarray, ac: np.ndarray, *more: np.ndarray) -> bytes:
    return squeezed(np.diff(b, prepend=np.int32(0)), np.diff(ac.view(U64), prepend=U64(0)), *more)


def _loaded(data: bytes) -> list[np.ndarray]:
    b, ac, *more = opened(data)
    return [np.cumsum(b, dtype=np.int32), np.cumsum(ac, dtype=U64).view(np.int64), *more]


def _around(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the one before it, and itself with the one before that as a << 32 | c; texts begin with two BEGIN."""
    b, a = np.full_like(ids, BEGIN), np.full_like(ids, BEGIN)
    b[1:], a[2:] = ids[:-1], ids[:-2]
    starts = offsets[:-1]
    b[starts] = a[starts] = BEGIN
    second = starts + 1
    a[second[second < offsets[1:]]] = BEGIN
    return b.astype(np.int32), (a << 32) | ids


def _by_shard(b: np.ndarray, ac: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by shard, b and ac, where there each distinct trigram begins, and where among these each shard does."""
    shard = b % shards
    order = np.lexsort((ac, (shard.astype(np.int64) << 32) | b))
    x, y = b[order], ac[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    return order, first, np.searchsorted(shard[order[first]], np.arange(shards + 1))


def _summed(b: np.ndarray, ac: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (b, ac) and the sum of their n."""
    order, first, _ = _by_shard(b, ac, 1)
    return b[order[first]], ac[order[first]], np.add.reduceat(n[order].astype(np.int64), first) if len(first) else n.astype(np.int64)


def _lower(b: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct (b, ac): the distinct (b, c), in how many trigrams each is, and the place of every trigram's."""
    rank = np.cumsum(np.diff(b, prepend=b[:1]) != 0)
    pair, place, n = np.unique((rank << 32) | (ac & 0xFFFFFFFF), return_inverse=True, return_counts=True)
    names = b[np.searchsorted(rank, pair >> 32)]
    return names, pair & 0xFFFFFFFF, n, place


def _key(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (mix(x.astype(np.int64).view(U64)) ^ mix(b.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15))).view(np.int64)


def _level(n: np.ndarray, of: np.ndarray, discounts: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The discounted share of counts n within runs of equal `of`, the mass that each run leaves, and where runs begin."""
    begin = np.flatnonzero(np.diff(of, prepend=of[:1] - 1) != 0)
    off = np.array(discounts)[np.minimum(n, 3) - 1]
    total = np.add.reduceat(n.astype(np.float64), begin)
    size = np.diff(np.append(begin, len(n)))
    return (n - off) / np.repeat(total, size), np.add.reduceat(off, begin) / total, begin


class Shard:
    """The tables of the trigrams whose middle words are one shard's."""

    def __init__(self, b: np.ndarray, ac: np.ndarray, n: np.ndarray, one: np.ndarray, d2: tuple, d3: tuple):
        self.one, empty = np.log(one), (np.zeros(0, np.int64), np.zeros(0))
        self.three = self.two = self.gamma3 = self.gamma2 = Lookup(*empty)
        if not len(b):
            return
        b2, c2, n2, place = _lower(b, ac)
        own, free, begin = _level(n2, b2.astype(np.int64), d2)
        p2 = own + np.repeat(free, np.diff(np.append(begin, len(b2)))) * one[c2]
        self.two, self.gamma2 = Lookup(_key(b2, c2), np.log(p2)), Lookup(_key(b2[begin], np.zeros(len(begin), np.int64)), np.log(free))
        context = np.cumsum((np.diff(b, prepend=b[:1]) != 0) | (np.diff(ac >> 32, prepend=ac[:1] >> 32) != 0))
        own, free, begin = _level(n, context, d3)
        p3 = own + np.repeat(free, np.diff(np.append(begin, len(b)))) * p2[place]
        self.three, self.gamma3 = Lookup(_key(b, ac), np.log(p3)), Lookup(_key(b[begin], ac[begin] >> 32), np.log(free))

    def logs(self, b: np.ndarray, ac: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each trigram's last token."""
        found, out = self.three(_key(b, ac))
        out = out.astype(np.float64)
        left = np.flatnonzero(~found)
        b, a, c = b[left], ac[left] >> 32, ac[left] & 0xFFFFFFFF
        has, two = self.two(_key(b, c))
        known, back = self.gamma2(_key(b, np.zeros(len(b), np.int64)))
        two = np.where(has, two, self.one[c] + np.where(known, back, 0))
        known, back = self.gamma3(_key(b, a))
        out[left] = two + np.where(known, back, 0)
        return out


def perplexities(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame | None:
    """(text_hash, n_tokens, perplexity, steady) of each distinct text of docs; None without a trusted document to learn from.

    text_hash is xxhash64 of the text, a null being empty. The model learns from all trusted documents that are steady
    and not among the fifth that held_out(doc_id, SEPARATE, 0) keeps for the thresholds.
    """
    spark = docs.sparkSession
    good = settled(trusted_ids(labels))
    body = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"], SEPARATE, 0)).select("doc_id", "text")
    # One number a trusted document goes to every task, so that no text moves to meet it.
    body = body.join(F.broadcast(good), body["doc_id"] == good["_id"], "left_semi").select("text")

    def steady(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
        for batch in slices(batches, "text", BATCH_BYTES):
            t = Tokens(batch.column(0), lower=False)
            keep = _steady(t)
            yield t if keep.all() else Tokens(batch.column(0).filter(pa.array(keep)), lower=False)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steady(batches):
            key, n = np.unique(t.keys, return_counts=True)
            # A row without a word tells that there is a text, which may be an empty one.
            texts = [len(t.offsets) - 1]
            yield pa.RecordBatch.from_arrays([pa.array([*key.view(np.int64), None], pa.int64()), pa.array([*n, *texts], pa.int64())], names=["key", "n"])

    counted = settled(body.mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    if not (counted.where("key IS NULL").agg(F.sum("n")).first()[0] or 0):
        return None
    held = counted.where((F.col("n") >= least) & F.col("key").isNotNull()).select("key").toArrow()
    index = U64Map(np.sort(held.column("key").to_numpy().view(U64)))
    shared = spark.sparkContext.broadcast(index)
    taught = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-taught // SHARD_BYTES))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steady(batches):
            ids, offsets = token_ids(t, shared.value)
            b, ac = _around(ids, offsets)
            once = ~((ids >= 2) & (ids < FIRST_WORD) & (((ids - 2) & 32) > 0))
            b, ac = b[once], ac[once]
            order, first, cuts = _by_shard(b, ac, shards)
            n = np.diff(np.append(first, len(order))).astype(np.int32)
            at = order[first]
            rows = [(s, _stored(b[at[x:y]], ac[at[x:y]], n[x:y])) for s, x, y in zip(range(shards), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "data"])

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        """Rows of (shard, data), sorted by shard, one row at a time."""
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By shard: its counts (kind 0), in how many (b, c) each c is (1), and how many of these and of the trigrams occur once to four times (2)."""
        names = ["shard", "kind", "id", "n", "data"]

        def out(shard: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            b, ac, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            _, c2, n2, _ = _lower(b, ac)
            for at in range(0, len(b), ROWS):
                s = slice(at, at + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([0], pa.int32()), pa.array([at]), pa.array([0]), pa.array([_stored(b[s], ac[s], n[s])], pa.binary())], names=names)
            c, n1 = np.unique(c2, return_counts=True)
            ids = np.concatenate([c, np.arange(1, 5), np.arange(11, 15)])
            n = np.concatenate([n1, np.bincount(np.minimum(n2, 5), minlength=6)[1:5], np.bincount(np.minimum(n, 5), minlength=6)[1:5]])
            kind = np.concatenate([np.full(len(c), 1), np.full(8, 2)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, np.int32)), pa.array(kind.astype(np.int32)), pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.binary())], names=names)

        now, parts, size = None, [], 0
        for shard, data in by_shard(batches):
            if shard != now and parts:
                yield from out(now, parts)
                parts, size = [], 0
            now, part = shard, _loaded(data)
            parts.append(tuple(part))
            size += len(part[0])
            if len(parts) > 1 and size > 4 * ROWS and size > 2 * len(parts[0][0]):
                parts = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                size = len(parts[0][0])
        if parts:
            yield from out(now, parts)

    pieces = body.mapInArrow(learned, "shard int, data binary").repartition("shard").sortWithinPartitions("shard")
    model = settled(pieces.mapInArrow(merged, "shard int, kind int, id long, n long, data binary"))
    seen = {r["id"]: r["n"] for r in model.where("kind = 2").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    d2, d3 = (_discounts({k: seen.get(k + base, 0) for k in range(1, 5)}) for base in (0, 10))
    ones = model.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    c, n = ones.column("id").to_numpy(), ones.column("n").to_numpy()
    d1 = _discounts({k: int((n == k).sum()) for k in range(1, 5)})
    off, kinds = np.array(d1)[np.minimum(n, 3) - 1], index.size + CLASSES + 1
    one = np.full(FIRST_WORD + index.size, off.sum() / n.sum() / kinds if len(n) else 1 / kinds)
    one[c] += (n - off) / n.sum()
    lowest = spark.sparkContext.broadcast((one, d2, d3))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number = ["part", "kind", "id", "data"], TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BATCH_BYTES):
            t = Tokens(batch.column(0), lower=False)
            ids, offsets = token_ids(t, shared.value)
            b, ac = _around(ids, offsets)
            order, first, cuts = _by_shard(b, ac, shards)
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(offsets))[order]
            edge = np.append(first, len(order))
            rows = [(number % shards, 2, squeezed(batch.column(1).to_numpy(), np.diff(offsets), _steady(t)))]
            for s, x, y in zip(range(shards), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y > x:
                    at = order[first[x:y]]
                    rows.append((s, 1, _stored(b[at], ac[at], np.diff(edge[x : y + 1]).astype(np.int32), doc[edge[x] : edge[y]])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(np.full(len(rows), number)), pa.array([r[2] for r in rows], pa.binary())], names=names)
            number += 1

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                part, kind, number, data = (batch.column(j)[i].as_py() for j in range(4))
                if part != now:
                    now, parts, tables = part, [], None
                if kind == 0:
                    parts.append(_loaded(data))
                    continue
                if kind == 1:
                    if tables is None:
                        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                        tables, parts = Shard(*joined, *lowest.value), []
                    b, ac, n, doc = _loaded(data)
                    logs = np.repeat(tables.logs(b, ac), n)
                    docs_, place = np.unique(doc, return_inverse=True)
                    data = squeezed(docs_, np.bincount(place, logs))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1 if kind == 2 else part], pa.int32()), pa.array([data], pa.binary())], names=["number", "shard", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, head, sums = ["text_hash", "n_tokens", "perplexity", "steady"], None, None, None

        def out() -> pa.RecordBatch:
            key, n, steady_ = head
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.exp(-sums / n)), pa.array(steady_.astype(bool))], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                number, data = batch.column(0)[i].as_py(), opened(batch.column(2)[i].as_py())
                if number != now:
                    if head is not None:
                        yield out()
                    now, head = number, data
                    sums = np.zeros(len(head[0]))
                else:
                    sums[data[0]] += data[1]
        if head is not None:
            yield out()

    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("text_hash"))
    tables = model.where("kind = 0").select(F.col("shard").alias("part"), "kind", "id", "data")
    out = None
    for wave in range(WAVES):
        part = texts.where(F.pmod("text_hash", F.lit(WAVES)) == wave)
        both = tables.union(part.mapInArrow(asked, "part int, kind int, id long, data binary")).repartition("part").sortWithinPartitions("part", "kind", "id")
        sums = both.mapInArrow(answered, "number long, shard int, data binary").repartition("number").sortWithinPartitions("number", "shard")
        each = sums.mapInArrow(added, "text_hash long, n_tokens long, perplexity double, steady boolean")
        done = settled(each.groupBy("text_hash").agg(F.max("n_tokens").alias("n_tokens"), F.max("perplexity").alias("perplexity"), F.max("steady").alias("steady")))
        out = done if out is None else out.union(done)
    forget(model, counted)
    return out
