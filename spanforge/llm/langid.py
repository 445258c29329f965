"""Language identification by word-first backoff.

A word (a run of letters, lower-cased) that the training sample holds scores each language by its log frequency
there. A word that no language knows falls back to its character n-grams, with a blank before and after it: the
longest order of which any n-gram is known scores it, by the mean log frequency of the known ones.

The model is fitted on a sample of labelled rows: at most about `per_lang` documents a language, drawn by the hash of
their id, and that parameter is the bound on its size. Prediction reads the whole of every text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import U64, U64Map, mix, ragged, segment_sums

ORDERS = (5, 4, 3, 2, 1)
PER_LANG = 1200
SMOOTHING = 0.1
NO_LANGUAGE = "und"
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


class Words:
    """The words of a list of texts, as code points with one blank before and after each."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) for t in low])
        letter = _is_letter()[points]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(points))] if len(texts) else ends
        first[cuts] = letter[cuts]
        last[cuts - 1] = letter[cuts - 1]
        start = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - start
        self.offsets = np.searchsorted(start, np.concatenate([[0], ends]))
        self.points, self.start, self.size = points, start, size

    def keys(self) -> np.ndarray:
        out = mix(self.size.astype(U64) + U64(77))
        live, at = np.arange(len(self.size)), 0
        points = np.append(self.points, np.zeros(2, np.uint32)).astype(U64)
        while len(live):  # two characters a step
            i = self.start[live] + at
            second = np.where(self.size[live] > at + 1, points[i + 1], U64(0))
            out[live] = mix(out[live] ^ (points[i] | (second << U64(32)))) + U64(0x9E3779B97F4A7C15)
            at += 2
            live = live[self.size[live] > at]
        return out

    def ngrams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of the words `which`, and for each the word's place in `which`."""
        size = self.size[which]
        padded = np.zeros(int((size + 2).sum()), U64)
        begin = np.cumsum(size + 2) - (size + 2)
        padded[ragged(begin + 1, size)] = self.points[ragged(self.start[which], size)]
        count = np.maximum(size + 3 - order, 0)
        at = ragged(begin, count)
        out = np.full(len(at), U64(order))
        for k in range(order):
            out = mix(out ^ padded[at + k]) + U64(k + 1)
        return out, np.repeat(np.arange(len(which)), count)


class Model:
    """Log frequencies of words and n-grams by language, bounded by the sample it was fitted on."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], prior: np.ndarray):
        """tables: for order 0 (words) and each n-gram order, keys and counts (keys x languages)."""
        self.langs = langs
        self.prior = np.log(np.maximum(prior, 1e-9) / np.maximum(prior, 1e-9).sum()) if len(langs) else prior
        self.maps, self.scores = {}, {}
        for order, (keys, counts) in tables.items():
            total = counts.sum(0)
            self.maps[order] = U64Map(keys)
            self.scores[order] = np.log((counts + SMOOTHING) / (total + SMOOTHING * (len(keys) + 1))).astype(np.float32)

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the different words, one row each, and the row of every word."""
        keys, one, row = np.unique(words.keys(), return_index=True, return_inverse=True)
        at = self.maps[0].find(keys)
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        out[at >= 0] = self.scores[0][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for order in ORDERS:
            if not len(left):
                break
            grams, owner = words.ngrams(one[left], order)
            found = self.maps[order].find(grams)
            hit = found >= 0
            n = np.bincount(owner[hit], minlength=len(left))
            sums = np.stack([np.bincount(owner[hit], self.scores[order][found[hit], j], len(left)) for j in range(len(self.langs))], 1)
            some = n > 0
            out[left[some]] = (sums[some] / n[some, None]).astype(np.float32)
            left = left[~some]
        return out, row

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and its probability for each text; `und` and zero where there is no letter or no model."""
        words = Words([t or "" for t in texts])
        if not self.langs or not len(words.start):
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        rows, row = self.word_scores(words)
        sums = segment_sums(rows[row].astype(np.float64), words.offsets) + self.prior
        best = sums.argmax(1)
        odds = np.exp(sums - sums.max(1, keepdims=True))
        some = np.diff(words.offsets) > 0
        return [self.langs[b] if s else NO_LANGUAGE for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, odds.max(1) / odds.sum(1), 0.0)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is part; a null id counts as the text null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(parts)) == part


def _by_text_size(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), np.float64))
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def sample_of(rows: DataFrame, group: str, doc_id: str, per_group: int, seed: str) -> DataFrame:
    """About `per_group` rows of each group, drawn by the hash of the id; all of a group that has no more."""
    sizes = rows.groupBy(group).count().select(F.col(group).alias("_group"), (F.lit(float(per_group)) / F.col("count")).alias("_share"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(sizes, rows[group] == sizes["_group"]).where(u < F.col("_share")).drop("_group", "_share")


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """labelled: doc_id, text, lang. The counts are summed on the executors; the driver gets the finished tables."""
    ids = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {k: (np.zeros(0, U64), np.zeros((0, 0))) for k in (0, *ORDERS)}, np.zeros(0))
    langs = sorted(sizes)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(per_lang / sizes[k]))])
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = ids.where(u < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_text_size(batches, 1):
            lang = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
            words = Words(batch.column(1).to_pylist())
            of = np.repeat(lang, np.diff(words.offsets)).astype(U64)
            keys = words.keys()
            every = np.arange(len(keys))
            for order in (0, *ORDERS):
                key, owner = (keys, every) if order == 0 else words.ngrams(every, order)
                pair = np.stack([key, of[owner]])
                order_by = np.lexsort(pair[::-1])
                pair = pair[:, order_by]
                new = np.ones(pair.shape[1], bool)
                new[1:] = (pair[:, 1:] != pair[:, :-1]).any(0)
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, pair.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), order, np.int32)), pa.array(pair[0][at].view(np.int64)), pa.array(pair[1][at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["o", "k", "l", "n"])

    counts = sample.mapInArrow(count, "o int, k long, l int, n long").groupBy("o", "k", "l").agg(F.sum("n").alias("n")).toArrow()
    tables = {}
    o, k, lang, n = (counts.column(c).to_numpy() for c in ("o", "k", "l", "n"))
    for order in (0, *ORDERS):
        mine = o == order
        keys, row = np.unique(k[mine].view(U64), return_inverse=True)
        matrix = np.zeros((len(keys), len(langs)), np.float32)
        matrix[row, lang[mine]] = n[mine]
        tables[order] = (keys, matrix)
    return Model(langs, tables, np.array([sizes[x] for x in langs], np.float64))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    k = len(keep)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_text_size(batches, k):
            lang, score = shared.value.predict(batch.column(k).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return rows.mapInArrow(go, StructType([*[docs.schema[c] for c in keep], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from rows whose crc32(doc_id) mod 4 isn't 2.

    lang_pred: a language of the training rows, or `und` with score 0 for a text that is null or has no letter (and
    for every text where no row can be learned from). score: the probability of lang_pred among the languages. Ties
    go to the first language by name. Repeated rows give repeated rows; an empty table none; further columns are
    ignored.
    """
    rows = docs.select(docs["doc_id"], docs["text"], docs["lang"], held_out(docs["doc_id"], 4, 2).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"), per_lang)
    return predict(rows, model, ["doc_id", "held_out"])
