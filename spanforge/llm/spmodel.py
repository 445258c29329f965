"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space markers.

Encoding: a text that isn't empty gets one space in front, each space becomes the marker U+2581, and the best-scoring
sequence of pieces is taken. No piece of the vocabulary holds a marker behind another character, so no piece crosses
from a word into the next run of spaces: the best segmentation of a text is that of its units (a run of spaces and
the characters up to the next space), and each different unit of a batch is segmented once. A character that is no
piece becomes its UTF-8 bytes' pieces. A marker that stands in the text itself is encoded as bytes, so decoding gives
every text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .lattice import MARKER, Pieces, read_pieces, viterbi
from .textcore import U8, hash_spans, ragged, slices, text_bytes

MARK = np.frombuffer(MARKER.encode(), U8)
#: Below the worst ordinary score, so that bytes are taken only where no piece fits.
BYTE_PENALTY = 10.0


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """The arrays of a vocabulary, as they are sent to the executors (a few MB, set by the vocabulary alone)."""

    def __init__(self, path: str):
        pieces, scores, ids, byte_ids, names = read_pieces(path)
        for p in pieces:
            if MARKER in p.decode().lstrip(MARKER):
                raise ValueError("a piece holds a marker behind another character; units can't be segmented alone")
        ordinary = scores[scores > -1e6]
        low = float(ordinary.min()) if len(ordinary) else -1e6
        self.model = Pieces(pieces, scores, ids, byte_ids, low - BYTE_PENALTY)
        self.vocabulary = len(names)
        shown = {int(i): p.replace(MARK.tobytes(), b" ") for i, p in zip(ids, pieces, strict=True)} | {int(i): bytes([b]) for b, i in enumerate(byte_ids) if i >= 0}
        parts = [shown.get(i, b"") for i in range(len(names))]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), U8)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets between texts."""
        data, offsets = text_bytes(column)
        n = np.diff(offsets)
        # One space in front of each text that isn't empty.
        full = (n > 0).astype(np.int64)
        starts = np.cumsum(n + full) - (n + full)
        text = np.full(int((n + full).sum()), 0x20, U8)
        text[ragged(starts + full, n)] = data
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
        space = text == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[starts[n > 0]] = True
        unit = np.flatnonzero(first)
        length = np.diff(np.append(unit, len(text)))
        keys, one, which = np.unique(hash_spans(text, unit, length), return_index=True, return_inverse=True)
        marked, at, sizes, literal = self._marked(text, unit[one], length[one])
        ids, cuts = viterbi(self.model, marked, at, sizes)
        for u in literal:
            parts = bytes(text[unit[one[u]] : unit[one[u]] + length[one[u]]]).split(MARK.tobytes())
            out: list[int] = []
            for k, part in enumerate(parts):
                if k:
                    out += self.model.byte_ids[MARK].tolist()
                piece = np.frombuffer(part.replace(b" ", MARK.tobytes()), U8)
                out += viterbi(self.model, piece, np.zeros(1, np.int64), np.array([len(piece)]))[0].tolist() if len(piece) else []
            ids = np.concatenate([ids[: cuts[u]], out, ids[cuts[u + 1] :]]).astype(np.int64)
            cuts = np.concatenate([cuts[: u + 1], cuts[u + 1 :] + len(out) - (cuts[u + 1] - cuts[u])])
        count = np.diff(cuts)[which]
        every = ids[ragged(cuts[:-1][which], count)]
        ends = np.searchsorted(unit, np.append(starts, len(text)))
        return every, np.concatenate([[0], np.cumsum(count)])[ends]

    def _marked(self, text: np.ndarray, unit: np.ndarray, length: np.ndarray):
        """The units with markers for spaces; and the units that hold a marker of their own, left empty here."""
        body = text[ragged(unit, length)]
        of = np.repeat(np.arange(len(unit)), length)
        hit = np.flatnonzero((body[:-2] == MARK[0]) & (body[1:-1] == MARK[1]) & (body[2:] == MARK[2])) if len(body) > 2 else []
        literal = sorted({int(of[i]) for i in hit if of[i] == of[i + 2]})
        if literal:
            keep = ~np.isin(of, literal)
            body, of = body[keep], of[keep]
        wide = np.where(body == 0x20, 3, 1)
        at = np.cumsum(wide) - wide
        out = np.empty(int(wide.sum()), U8)
        out[at] = body
        spaces = at[body == 0x20]
        for k in range(3):
            out[spaces + k] = MARK[k]
        sizes = np.bincount(of, wide, len(unit)).astype(np.int64)
        return out, np.cumsum(sizes) - sizes, sizes, literal

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids. Bytes that aren't UTF-8 together become U+FFFD; unknown ids give nothing."""
        ids = np.where((ids >= 0) & (ids < self.vocabulary), ids, 0)
        size = self.sizes[ids]
        body = self.bytes[ragged(self.at[ids], size)]
        cuts = np.concatenate([[0], np.cumsum(size)])[offsets]
        lead = (np.diff(cuts) > 0) & (body[np.minimum(cuts[:-1], max(len(body) - 1, 0))] == 0x20) if len(body) else np.zeros(len(cuts) - 1, bool)
        begin, n = cuts[:-1] + lead, np.diff(cuts) - lead
        flat = body[ragged(begin, n)]
        at = np.concatenate([[0], np.cumsum(n)])
        out = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = flat.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.large_string())
        return out.cast(pa.string())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(spark: SparkSession, docs: DataFrame, keep: list[str], text: str = "text", model_path: str | None = None, with_text: bool = False, part: int = 4 << 20) -> DataFrame:
    """The columns `keep`, `ids`, `n_tokens` and `exact` (decoding gives the text back); `decoded` too, if with_text.

    A null text has null ids and no tokens, and its exactness is null; an empty text has no ids and is exact.
    """
    shared = spark.sparkContext.broadcast(codec(model_path or default_model_path()))
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    k = len(keep)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in slices(batches, "_text", part):
            column = batch.column(k)
            ids, offsets = codec.encode(column)
            back = codec.decode(ids, offsets)
            null = column.is_null()
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null if column.null_count else None)
            same = pc.equal(back, column.cast(pa.string()))
            fields = [*batch.columns[:k], lists, pa.array(np.diff(offsets).astype(np.int32)), same]
            if with_text:
                fields.append(pc.if_else(null, pa.scalar(None, pa.string()), back))
            yield pa.RecordBatch.from_arrays(fields, names=[f.name for f in schema])

    fields = [*[docs.schema[c] for c in keep], StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", IntegerType()), StructField("exact", BooleanType())]
    schema = StructType([*fields, StructField("decoded", StringType())] if with_text else fields)
    return rows.mapInArrow(go, schema)


def decoded(spark: SparkSession, rows: DataFrame, keep: list[str], ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """The columns `keep` and `text`, decoded from the lists `ids`; null ids give a null text."""
    shared = spark.sparkContext.broadcast(codec(model_path or default_model_path()))
    picked = rows.select(*[rows[c] for c in keep], rows[ids].alias("_ids"))
    k = len(keep)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            column = batch.column(k)
            plain = column.fill_null([]) if column.null_count else column
            flat = plain.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = plain.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            back = codec.decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pc.if_else(column.is_null(), pa.scalar(None, pa.string()), back)], names=[*keep, "text"])

    return picked.mapInArrow(go, StructType([*[rows.schema[c] for c in keep], StructField("text", StringType())]))
