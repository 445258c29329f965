"""Subword lattice likelihood: the probability of a text, summed over all segmentations of its words.

The vocabulary is an existing one and is never changed; its scores rank its pieces, and a piece of rank r starts with
probability proportional to 1 / (r + RANK_OFFSET). The training documents then reweight these scores (expected uses
over all segmentations of all different training words, forward-backward), which trains the model, not the tokenizer.

A word's lattice has two kinds of arcs: its pieces (and bytes where no piece fits), and one arc for the whole word if
training has seen it, worth its discounted relative frequency. The mass that discounting frees is spread over
spellings by the piece lattice. A text is its words and one end, so its probability is

    P(w) = (c(w) - D) / N + g P_lattice(w)    P(end) = documents / N    P(text) = P(end) prod P(w)

with N all training tokens, g = D x (different words) / N, and D = n1 / (n1 + 2 n2) from the counts of counts.

Counts cover all training documents. Words above a fixed share of all tokens (at most 1 / HOT_SHARE of them exist)
are known to every task; all other words meet their counts in a join on the word's 64-bit key, as lists of the
documents of one batch, so a word has a row a batch and no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .langid import held_out
from .session import cut
from .spmodel import MARK, default_model_path
from .textcore import U8, U64, U64Map, ragged, slices
from .wordstats import Tokens

RANK_OFFSET = 50.0
HOT_SHARE = 1 / 500_000
ROUNDS = 2
PART = 8 << 20
LN10 = float(np.log(10.0))


def starting_pieces(path: str) -> lattice.Pieces:
    pieces, scores, ids, byte_ids, _ = lattice.read_pieces(path)
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    p = 1.0 / (rank + RANK_OFFSET)
    byte = 1.0 / (len(rank) + RANK_OFFSET)
    total = p.sum() + 256 * byte
    return lattice.Pieces(pieces, np.log(p / total), ids, byte_ids, np.log(byte / total))


def _marked(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with the white-space marker in front."""
    size = lengths + 3
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), U8)
    for k in range(3):
        out[at + k] = MARK[k]
    out[ragged(at + 3, lengths)] = data[ragged(starts, lengths)]
    return out, at, size


def _distinct(keys: np.ndarray, weight: np.ndarray):
    key, one, row = np.unique(keys, return_index=True, return_inverse=True)
    return key, one, np.bincount(row, weight, len(key)).astype(np.int64), row


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, word, c): every different word of docs (text, learns) and how often the learning rows hold it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART):
            t = Tokens(batch.column(0))
            learns = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            key, one, c, _ = _distinct(t.keys, np.repeat(learns, np.diff(t.offsets)).astype(np.float64))
            begin, size = t.starts[one], t.lengths[one]
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(t.data[ragged(begin, size)].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), words, pa.array(c)], names=["key", "word", "c"])

    return docs.mapInArrow(go, "key long, word binary, c long").groupBy("key", "word").agg(F.sum("c").alias("c"))


def _spelled(column: pa.Array):
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, U8) if data is not None else np.zeros(0, U8)
    return _marked(raw, offsets[:-1], np.diff(offsets))


def reweighted(model: lattice.Pieces, words: DataFrame, rounds: int = ROUNDS) -> lattice.Pieces:
    """The pieces with probabilities by their expected uses over the different training words, each word once."""
    shown = len(model.pieces)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(model)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shown + 256)
            for batch in batches:
                if batch.num_rows:
                    text, at, size = _spelled(batch.column(0))
                    uses, byte_uses = lattice.expected(shared.value, text, at, size, np.ones(len(at)))
                    total += np.concatenate([uses, byte_uses])
            used = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

        rows = words.select("word").mapInArrow(go, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(shown + 256)
        uses[rows.column("piece").to_numpy()] = np.round(rows.column("uses").to_numpy(), 3)
        # A tenth of a use, spread by the starting probabilities, keeps every piece possible.
        before = np.exp(np.concatenate([model.scores, model.byte_scores]))
        uses += 0.1 + before * 10
        logs = np.log(uses / uses.sum())
        model = model.with_scores(logs[:shown], logs[shown:])
    return model


def score(docs: DataFrame, model_path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    score: log10 of the text's probability as above; base_score: the add-half unigram of the contract. A null text is
    an empty one: its only token is the end. Repeated rows give repeated rows with the same values. With nothing to
    learn from, N is zero, every word is spelled by the lattice alone and base_score takes N = V = 0 (an add-half
    model of nothing gives each token probability one). An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"), (~held_out(docs["doc_id"], 5, 1)).alias("learns"), docs["doc_id"].alias("doc_id"))
    counted = cut(word_counts(rows.select("text", "learns")))
    facts = counted.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    ends = rows.where("learns").count()
    tokens, kinds = (facts["n"] or 0) + ends, (facts["v"] or 0) + (ends > 0)
    n1, n2 = facts["n1"] or 0, facts["n2"] or 0
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    free = discount * (kinds - (ends > 0)) / tokens if tokens else 1.0
    model = reweighted(starting_pieces(model_path or default_model_path()), counted.where("c > 0"), rounds if kinds > 1 else 0)
    shared = spark.sparkContext.broadcast(model)
    below = tokens + 0.5 * (kinds + 1) if tokens else 0.5

    def base_of(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / below)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, at, size = _spelled(batch.column(1))
            c = batch.column(2).to_numpy()
            spelled = lattice.forward(shared.value, text, at, size)
            seen = np.maximum(c - discount, 0) / tokens if tokens else np.zeros(len(c))
            with np.errstate(divide="ignore"):
                value = np.logaddexp(np.log(seen), np.log(max(free, 1e-300)) + spelled) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c), pa.array(value)], names=["key", "c", "value"])

    valued = cut(counted.mapInArrow(spell, "key long, c long, value double"))
    least_hot = max(2, int(np.ceil(tokens * HOT_SHARE)))
    hot_rows = valued.where(F.col("c") >= least_hot).toArrow()
    hot_key = hot_rows.column("key").to_numpy().view(U64)
    order = np.argsort(hot_key)
    hot = spark.sparkContext.broadcast((U64Map(hot_key[order]), hot_rows.column("c").to_numpy()[order], hot_rows.column("value").to_numpy()[order]))
    end_base, end_score = float(base_of(np.array([ends]))[0]), float(np.log10(ends / tokens)) if ends else 0.0

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its tokens and what the hot words and the end give."""
        index, hot_c, hot_value = hot.value
        for batch in slices(batches, "text", PART):
            t = Tokens(batch.column(0))
            n = batch.num_rows
            at = index.find(t.keys)
            found = at >= 0
            doc = t.docs()[found]
            sums = [np.bincount(doc, w, n) for w in (base_of(hot_c[at[found]]), hot_value[at[found]])]
            n_known = np.bincount(doc, minlength=n) + (ends > 0)
            columns = (np.ones(n, np.int64), np.diff(t.offsets) + 1, n_known.astype(np.int64), sums[0] + end_base, sums[1] + end_score)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(_short(t)), *map(pa.array, columns)], names=SUMS)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each other word of a batch its texts and uses."""
        index = hot.value[0]
        for batch in slices(batches, "text", PART):
            t = Tokens(batch.column(0))
            cold = index.find(t.keys) < 0
            if not cold.any():
                continue
            n = batch.num_rows
            key, where = np.unique(t.keys[cold], return_inverse=True)
            pair, uses = np.unique(where.astype(np.int64) * n + t.docs()[cold], return_counts=True)
            text = pa.array(pair % n)
            cuts = pa.array(np.searchsorted(pair // n, np.arange(len(key) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (batch.column(1).take(text), pa.array(_short(t)).take(text), pa.array(uses.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *lists], names=["key", "ids", "text_keys", "uses"])

    # The texts are read once for each of the two: that costs less than keeping the lists would.
    read = rows.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    warm = read.mapInArrow(known, "doc_id long, text_key int, rows long, n_tokens long, n_known long, base double, value double")
    words = read.mapInArrow(unknown, "key long, ids array<long>, text_keys array<int>, uses array<int>")
    listed = words.join(valued.select(F.col("key").alias("of"), "c", "value"), F.col("key") == F.col("of"))
    base = F.log10((F.col("c") + F.lit(0.5)) / F.lit(below))
    one = listed.select(F.explode(F.arrays_zip("ids", "text_keys", "uses")).alias("x"), base.alias("b"), "value", (F.col("c") > 0).cast("long").alias("k"))
    use = F.col("x.uses")
    cold = one.select(F.col("x.ids").alias("doc_id"), F.col("x.text_keys").alias("text_key"), (F.col("k") * use).alias("n_known"), (F.col("b") * use).alias("base"), (F.col("value") * use).alias("value"))
    cold = cold.groupBy("doc_id", "text_key").agg(*[F.sum(c).alias(c) for c in ("n_known", "base", "value")])
    cold = cold.select("doc_id", "text_key", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"), "n_known", "base", "value")
    # Rows with one id and one text are summed together and dealt out again.
    sums = warm.unionByName(cold).groupBy("doc_id", "text_key").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base", "value")])
    again = sums.withColumn("copy", F.explode(F.when(F.col("rows") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("rows")))))
    kind = docs.schema["doc_id"].dataType
    return again.select(F.col("doc_id").cast(kind).alias("doc_id"), held_out(F.col("doc_id"), 5, 1).alias("held_out"), F.expr("n_tokens div rows").alias("n_tokens"), F.expr("n_known div rows").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("value") / F.col("rows")).alias("score"))


SUMS = ["doc_id", "text_key", "rows", "n_tokens", "n_known", "base", "value"]


def _short(t: Tokens) -> np.ndarray:
    """32 bits of each text's hash: enough to tell apart texts that share an id."""
    return (t.text_keys >> U64(32)).astype(np.uint32).view(np.int32)
