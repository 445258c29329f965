"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted text is that of documents labelled quality 1 and not toxic. judged() and accepted() learn from all of it, less a
fifth that is kept apart for the thresholds, with the sharded tables of wholeney.py. fitted() gives a model that one
process can hold: of about `per_lang` documents a language, drawn by the hash of the id, less a fifth; its thresholds come
from all trusted documents that it wasn't fitted on.

Words that the text learned from holds LEAST times or more are tokens of their own; any other word becomes the class of its
shape (upper, lower, digit, stop, symbol bytes, and whether it repeats the word before it), so junk is improbable
although its words are new. Counting and the count joins (n-gram with context, n-gram with its lower order) run on
the executors, sharded by the hash of the context as their joins shuffle it. A document is rejected if its perplexity is above the `quantile`
of the trusted documents of its language that the fit didn't use, times `slack`. That quantile is a distributed sketch's,
within a rank of 1 / ACCURACY of the documents. Documents of which over MOST_REPEATS of the words repeat the word before
them are left out of the fit and of the thresholds, and a repeated word is never counted: labels are noisy, and runs
of one word would else become cheap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .langid import held_out
from .session import cut, settled
from .sieve import NAME, sieved
from .textcore import U64, U64Map, segment_sums, slices
from .wordstats import Tokens

PER_LANG = 1000
LEAST = 3
QUANTILE = 0.99
SLACK = 1.5
MOST_REPEATS = 0.2
ACCURACY = 100_000
BEGIN, END, CLASSES = 0, 1, 64
FIRST_WORD = 2 + CLASSES
BITS = 21

_KIND = np.zeros(256, np.uint8)
_KIND[0x30:0x3A] = 4
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 2
_KIND[0x80:] = 2
for _c in range(0x21, 0x7F):
    if not _KIND[_c]:
        _KIND[_c] = 8 if chr(_c) in ".,;:?!'\"()-" else 16


def token_ids(t: Tokens, index: U64Map) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of each text, then END, and the offsets between texts."""
    n = len(t.starts)
    ids = np.zeros(n, np.int64)
    if n:
        at = index.find(t.keys)
        shape = np.bitwise_or.reduceat(_KIND[t.data], t.starts).astype(np.int64)
        again = np.zeros(n, bool)
        again[1:] = t.keys[1:] == t.keys[:-1]
        first = t.offsets[:-1]
        again[first[first < n]] = False
        ids = np.where(again, 2 + (shape | 32), np.where(at >= 0, FIRST_WORD + at, 2 + shape))
    count = np.diff(t.offsets)
    out = np.full(n + len(count), END, np.int64)
    ends = t.offsets[1:] + np.arange(len(count))
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = ids
    return out, np.concatenate([[0], ends + 1])


def trigrams(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token the key of itself after the two before it; texts begin with two BEGIN."""
    b, a = np.zeros_like(ids), np.zeros_like(ids)
    b[1:], a[2:] = ids[:-1], ids[:-2]
    starts = offsets[:-1]
    b[starts] = BEGIN
    a[starts] = BEGIN
    second = starts + 1
    a[second[second < offsets[1:]]] = BEGIN
    return (a << 2 * BITS) | (b << BITS) | ids


class Lookup:
    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.map, self.logs = U64Map(keys[order].astype(np.int64).view(U64)), logs[order].astype(np.float32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.map.find(np.ascontiguousarray(keys, np.int64).view(U64))
        return at >= 0, self.logs[at] if len(self.logs) else np.zeros(len(at), np.float32)


class Model:
    """Finished tables: log probabilities of seen n-grams, log back-off weights of seen contexts, a floor for the rest."""

    def __init__(self, index: U64Map, p3: Lookup, g3: Lookup, p2: Lookup, g2: Lookup, p1: Lookup, floor: float):
        self.index, self.p3, self.g3, self.p2, self.g2, self.p1, self.floor = index, p3, g3, p2, g2, p1, floor
        self.limits: dict[str | None, float] = {}
        self._sent: Broadcast | None = None

    def shared(self, spark: SparkSession) -> Broadcast:
        """The tables as one broadcast, however often documents are scored; limits set later aren't in it."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each trigram's last token."""
        low = (1 << BITS) - 1
        found, out = self.p3(keys)
        left = np.flatnonzero(~found)
        if len(left):
            key = keys[left]
            has2, two = self.p2(key & ((1 << 2 * BITS) - 1))
            has1, one = self.p1(key & low)
            known, back = self.g2((key >> BITS) & low)
            two = np.where(has2, two, np.where(has1, one, self.floor) + np.where(known, back, 0))
            known, back = self.g3(key >> BITS)
            out[left] = two + np.where(known, back, 0)
        return out

    def perplexity(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's perplexity, number of tokens and whether it is _steady()."""
        t = Tokens(column, lower=False)
        ids, offsets = token_ids(t, self.index)
        n = np.diff(offsets)
        return np.exp(-segment_sums(self.logs(trigrams(ids, offsets)).astype(np.float64), offsets) / n), n, _steady(t)


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times; 0.5, 0.75 and 0.9 if one of these is zero."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _fit_order(grams: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """grams (context, c, n) with `own`, the discounted share, and the contexts with `gamma`, the mass left over."""
    seen = {r["n"]: r["k"] for r in grams.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    d1, d2, d3 = _discounts(seen)
    off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    sums = grams.groupBy(*context).agg(F.sum("n").alias("total"), F.sum(off).alias("freed")) if context else grams.agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
    sums = settled(sums.select(*context, "total", (F.col("freed") / F.col("total")).alias("gamma")))
    if context:
        sharded = grams.join(sums.withColumnsRenamed({c: f"_{c}" for c in context}), [F.col(c) == F.col(f"_{c}") for c in context]).drop(*[f"_{c}" for c in context])
    else:
        sharded = grams.withColumn("_one", F.lit(1)).join(sums.withColumn("_uno", F.lit(1)), F.col("_one") == F.col("_uno")).drop("_one", "_uno")
    return sharded.withColumn("own", (F.col("n") - off) / F.col("total")), sums


def _steady(t: Tokens) -> np.ndarray:
    """Whether MOST_REPEATS of a text's words or fewer repeat the word before them."""
    again = np.zeros(len(t.keys), np.int64)
    again[1:] = t.keys[1:] == t.keys[:-1]
    again[t.offsets[:-1][t.offsets[:-1] < len(again)]] = 0  # the word before a text's first is another text's
    return segment_sums(again, t.offsets) <= MOST_REPEATS * np.diff(t.offsets)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((labels["quality"] == 1) & (F.coalesce(labels["toxic"], F.lit(0)) == 0)).select(labels["doc_id"].alias("_id")).where("_id IS NOT NULL").distinct()


def trusted_sample(docs: DataFrame, labels: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, text, lang, apart): about per_lang trusted documents of each language, by the hash of their id."""
    good = trusted_ids(labels)
    rows = docs.select("doc_id", "lang").where(F.col("doc_id").isNotNull())
    named = settled(rows.join(good, rows["doc_id"] == good["_id"], "left_semi").distinct())
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    if not sizes:
        return docs.select("doc_id", "text", "lang", F.lit(False).alias("apart")).limit(0)
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang").eqNullSafe(F.lit(lang)), per_lang / n).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("trusted"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # About per_lang ids a language: a size that the parameter bounds, so the texts needn't move to meet them.
    chosen = F.broadcast(named.where(u < share).select(F.col("doc_id").alias("_id")).distinct())
    body = docs.select("doc_id", "text", "lang")
    sample = body.join(chosen, body["doc_id"] == chosen["_id"], "left_semi").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 5, 0).alias("apart"))

    def steady(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_steady(Tokens(batch.column(1), lower=False))))

    return cut(sample.mapInArrow(steady, sample.schema))


def fit(sample: DataFrame, least: int = LEAST) -> Model | None:
    """The model of a trusted sample, without limits; None if there is nothing to learn from."""
    spark = sample.sparkSession
    body = sample.where(~F.col("apart") & F.col("text").isNotNull()).select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, n = np.unique(Tokens(batch.column(0), lower=False).keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    held = body.mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    if not body.limit(1).count():
        return None
    index = U64Map(np.sort(held.column("key").to_numpy().view(U64)))
    if index.size >= (1 << BITS) - FIRST_WORD:
        raise ValueError("the trusted sample holds too many words; lower per_lang or raise least")
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, offsets = token_ids(Tokens(batch.column(0), lower=False), shared.value)
            runs = (ids >= 2) & (ids < FIRST_WORD) & (((ids - 2) & 32) > 0)
            key, n = np.unique(trigrams(ids, offsets)[~runs], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    low = (1 << BITS) - 1
    c3 = body.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    c3 = settled(c3.select(F.expr(f"key >> {BITS}").alias("ab"), F.expr(f"(key >> {BITS}) & {low}L").alias("b"), F.expr(f"key & {low}L").alias("c"), "n"))
    c2 = settled(c3.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")))
    c1 = settled(c2.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    own1, all1 = _fit_order(c1, [])
    kinds = index.size + CLASSES + 1
    gamma1 = all1.first()["gamma"]
    p1 = settled(own1.select(F.col("c").alias("c1"), (F.col("own") + F.lit(gamma1 / kinds)).alias("p1")))
    own2, g2 = _fit_order(c2, ["b"])
    p2 = settled(own2.join(p1, F.col("c") == F.col("c1")).select(F.col("b").alias("b2"), F.col("c").alias("c2"), (F.col("own") + F.col("gamma") * F.col("p1")).alias("p2")))
    own3, g3 = _fit_order(c3, ["ab"])
    p3 = own3.join(p2, (F.col("b") == F.col("b2")) & (F.col("c") == F.col("c2"))).select(F.expr(f"(ab << {BITS}) | c").alias("k"), F.log(F.col("own") + F.col("gamma") * F.col("p2")).alias("v"))

    def lookup(df: DataFrame) -> Lookup:
        out = df.toArrow()
        return Lookup(out.column(0).to_numpy(), out.column(1).to_numpy())

    return Model(index, lookup(p3), lookup(g3.select("ab", F.log("gamma"))), lookup(p2.select(F.expr(f"(b2 << {BITS}) | c2"), F.log("p2"))), lookup(g2.select("b", F.log("gamma"))), lookup(p1.select("c1", F.log("p1"))), float(np.log(gamma1 / kinds)))


def _limits(judges: DataFrame, quantile: float, slack: float) -> dict[str | None, float]:
    """The limit of each language of judges (lang, perplexity) with 20 rows or more, and under None that of all rows."""
    sketch = F.percentile_approx("perplexity", quantile, ACCURACY).alias("q")
    found = settled(judges.select("lang", "perplexity"))
    limits = found.groupBy("lang").agg(sketch, F.count(F.lit(1)).alias("n")).collect()
    pooled = found.agg(sketch).first()["q"]
    return {r["lang"]: r["q"] * slack for r in limits if r["lang"] is not None and r["n"] >= 20} | {None: pooled * slack if pooled is not None else np.inf}


def fitted(docs: DataFrame, labels: DataFrame, per_lang: int = PER_LANG, quantile: float = QUANTILE, slack: float = SLACK) -> Model | None:
    """The model of a trusted sample with the limits that all other trusted documents set; None without a sample."""
    sample = trusted_sample(docs, labels, per_lang)
    model = fit(sample)
    if model is None:
        return None
    good, used = trusted_ids(labels), F.broadcast(sample.where(~F.col("apart") & F.col("text").isNotNull()).select(F.col("doc_id").alias("_used")).distinct())
    rows = perplexities(docs, model, ["doc_id", "lang"]).where("doc_id IS NOT NULL AND steady")
    judges = rows.join(good, rows["doc_id"] == good["_id"], "left_semi").join(used, F.col("doc_id") == F.col("_used"), "left_anti")
    model.limits = _limits(judges, quantile, slack)
    return model


def scored(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> tuple[dict[str | None, float], DataFrame] | None:
    """The limits and (text_hash, n_tokens, perplexity, steady) of each distinct text, under the model of all trusted text.

    None without a trusted document to learn from.
    """
    from . import wholeney

    found = wholeney.perplexities(docs, labels)
    if found is None:
        return None
    good = trusted_ids(labels)
    apart = docs.where(docs["doc_id"].isNotNull() & held_out(docs["doc_id"], wholeney.SEPARATE, 0)).select("doc_id", "lang", text_hash(docs).alias("_hash"))
    judges = apart.join(good, apart["doc_id"] == good["_id"], "left_semi").join(found.where("steady"), F.col("_hash") == F.col("text_hash"))
    return _limits(judges, quantile, slack), found


def text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def threshold(limits: dict[str | None, float], lang: str = "lang"):
    """The limit of a language; the pooled one where it has none."""
    pooled = F.lit(float(limits.get(None, math.inf)))
    named = [F.lit(x) for pair in limits.items() if pair[0] is not None for x in pair]
    return F.coalesce(F.create_map(*named)[F.col(lang)], pooled) if named else pooled


def perplexities(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, n_tokens, perplexity and steady of every row."""
    shared = model.shared(docs.sparkSession)
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    k = len(keep)
    schema = StructType([*[docs.schema[c] for c in keep], StructField("n_tokens", LongType()), StructField("perplexity", DoubleType()), StructField("steady", BooleanType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            value, n, steady = shared.value.perplexity(batch.column(k))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n.astype(np.int64)), pa.array(value), pa.array(steady)], names=schema.names)

    return rows.mapInArrow(go, schema)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, n_tokens, perplexity, threshold and kept of every row of docs.

    A language with under 20 trusted documents that the fit didn't use, and a null language, take the pooled limit. With no
    trusted document every perplexity and threshold is null and every row is kept. A null text counts as empty: its
    only token is the end. Repeated rows give repeated rows; ties with the threshold are kept; an empty table gives
    no rows.
    """
    found = scored(docs, labels)
    if found is None:
        none = F.lit(None).cast("double")
        n = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
        return docs.select(*[docs[c] for c in keep], n.alias("n_tokens"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    limits, scores = found
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["lang"].alias("lang"), text_hash(docs).alias("_hash"))
    limit = threshold(limits)
    return rows.join(scores, F.col("_hash") == F.col("text_hash")).select("row.*", "n_tokens", "perplexity", limit.alias("threshold"), (F.col("perplexity") <= limit).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns, whatever these are called."""
    found = scored(docs, labels)
    if found is None:
        return docs
    limits, scores = found
    # Only texts over the lowest limit can be rejected: the other rows needn't move to meet them.
    over = settled(scores.where(F.col("perplexity") > min(limits.values())).select("text_hash", "perplexity"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["lang"].alias("lang"), text_hash(docs).alias("_hash"))
    rows = sieved(rows, F.col("_hash"), over.select("text_hash"))
    doubtful = rows.where(NAME).join(over, F.col("_hash") == F.col("text_hash"), "left")
    doubtful = doubtful.where(F.col("perplexity").isNull() | (F.col("perplexity") <= threshold(limits)))
    return rows.where(~F.col(NAME)).select("row.*").union(doubtful.select("row.*"))
