"""Substring dedup by collinear chaining of shared k-mer seeds.

1. Seeds. Of the hashes of all runs of K words, winnowing keeps the smallest of every W in a row: any passage of
   K + W - 1 equal words shares a seed wherever it stands. A long seed, the hash of the LONG words from there on, begins
   at each of them: `least` equal words hold one, since LONG is least - W + 1.
2. Seed join. A first pass finds the seeds that several documents hold, which leaves most behind. A seed's holder is
   its first occurrence by (document, position); every occurrence in another document is joined to it. That is one
   row an occurrence, never the pairs of a seed, and both sides of each join on a seed are plain shuffles, so that a
   seed that very many documents hold is split over tasks. Short seeds of one passage may have different first
   holders; a long one's holds LONG words of it.
3. Chaining. The anchors of a document with one holder are merged along diagonals, then chained: the best chain up to
   an anchor is its words plus the best of the chains that end before it in both documents, less a cost for each word
   skipped in either. The cost is linear, so a Fenwick tree over the holder's positions finds that maximum.
4. Alignment. The words of both passages of a chain are aligned in a band as wide as the edits allowed; a passage
   counts if it has `least` words or more and a similarity (1 - edits / longer side) of `similar` or more. A chain that
   fails is split at its largest gap, a segment that fails at its unequal words, and every part is tried again. Edges
   grow through unequal words where the equal ones beyond make up for them.
5. Whole windows. The holder of a long seed may hold only these LONG words of a passage and so hide a document that holds
   it all. So the runs of `least` words around the long seeds that no passage found so far covers are joined, chained and
   aligned in the same way, each with its own first holder. A run of `least` words holds a long seed, so every one that
   an earlier document holds lies in passages, be there whatever holders of its parts; of a run of one word that is
   longer than its holder's, a part may stay outside.

A document is an id with a text: rows that share an id are documents of their own, unless their texts are equal too.
The work on a chain is that of its two passages; a document that many others copy from is read once for each
different range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .session import cut, forget, settled
from .sieve import NAME, sieved
from .textcore import U64, mix, ragged, slices
from .wordstats import Tokens

K = 5
WINDOW = 8
LEAST_WORDS = 50
SIMILAR = 0.8
SKIP_COST = 0.25
FLANK = 24
CYCLE = 10
#: Texts up to this many words are compared by bits of whole numbers, longer ones in bands: the result is the same.
WIDE = 1 << 15


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[i : i + width] for every i up to len - width, by doubling; width is a power of two."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _runs(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each position `at` on, by doubling."""
    out, done, step = np.full(len(at), U64(size)), 0, 1
    while step <= size:
        if size & step:
            out = mix(out ^ h[at + done]) + U64(step)
            done += step
        step *= 2
        if step <= size:
            h = mix(np.concatenate([h[: -(step // 2)] ^ mix(h[step // 2 :] + U64(step)), h[-(step // 2) :]]))
    return out


def _thinned(text: np.ndarray, h: np.ndarray, place: np.ndarray, size: int, every: int = CYCLE, ends: bool = False) -> np.ndarray:
    """Which seeds to keep: of equal ones that overlap (words that repeat in a cycle) the first of every `every` words.

    With `ends` the last one, too.
    """
    order = np.lexsort((place, h, text))
    t, x, p = text[order], h[order], place[order]
    again = np.zeros(len(order), bool)
    meets = (t[1:] == t[:-1]) & (x[1:] == x[:-1]) & (p[1:] - p[:-1] <= size)
    again[1:] = meets & (p[1:] // every == p[:-1] // every)
    if ends:
        again[:-1] &= meets
        again[-1:] = False
    out = np.ones(len(order), bool)
    out[order[again]] = False
    return out


def seeds(t: Tokens, k: int = K, window: int = WINDOW, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed seeds of texts of at least `least` words: hash, text, word position. `window` is a power of two.

    The lowest bit of a hash is set for a long seed, of least - window + 1 words (but k at least), and else clear.
    """
    n = np.diff(t.offsets)
    count = np.where(n >= max(least, k + window - 1), n - k + 1, 0)
    if not count.sum():
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = ragged(t.offsets[:-1], count)
    h = np.full(len(at), U64(k))
    for j in range(k):
        h = mix(h ^ t.keys[at + j]) + U64(j + 1)
    text = np.repeat(np.arange(len(n)), count)
    start = np.cumsum(count) - count
    place = np.arange(len(at)) - start[text]
    low = np.zeros(len(h), U64)
    low[: len(h) - window + 1] = _sliding(h, window, np.minimum)
    low[place + window > count[text]] = 0  # a window that runs into the next text
    padded = np.concatenate([np.zeros(window - 1, U64), low])
    taken = (_sliding(padded, window, np.maximum) == h) & (h > 0)
    # Windows that began in the text before are of no matter: their low belongs to other hashes or is zero.
    again = np.append(False, (h[1:] == h[:-1]) & (text[1:] == text[:-1]))
    size = max(k, least - window + 1)
    # Of a run of one word the first; long seeds that go past its end begin at every window-th place from the end back,
    # too: a passage may begin inside the run, and then only its end is shared.
    order = np.arange(len(h))
    back = np.minimum.accumulate(np.where(np.append(again[1:], False), len(h), order)[::-1])[::-1] - order
    far = np.flatnonzero(taken & (~again | ((back % window == 0) & (back < size - k))))
    taken &= ~again
    keep = np.flatnonzero(taken)
    far = far[place[far] + size <= n[text[far]]]
    long = _runs(t.keys, at[far], size)
    first = _thinned(text[far], long, place[far], size)
    far, long = far[first], long[first]
    keep = keep[_thinned(text[keep], h[keep], place[keep], k)]
    one = U64(1)
    return np.concatenate([h[keep] & ~one, long | one]), np.concatenate([text[keep], text[far]]), np.concatenate([place[keep], place[far]])


def _inside(of: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether low[i]:high[i] of text of[i] lies in one of the ranges start:end of the texts `owner`."""
    if not len(owner):
        return np.zeros(len(of), bool)
    start, end = (owner << 32) + start, (owner << 32) + end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    at = np.searchsorted(start, (of << 32) + low, "right") - 1
    return (at >= 0) & (reach[at] >= (of << 32) + high)


def chain(q0: np.ndarray, q1: np.ndarray, r0: np.ndarray, r1: np.ndarray, skip: float = SKIP_COST) -> list[np.ndarray]:
    """Collinear chains of segments (half-open word ranges in both texts), best first; each segment is in one chain.

    A segment may follow one that it overlaps by less than its own length in either text; the overlap isn't counted
    again.
    """
    n = len(q0)
    order = np.lexsort((r0, q0))
    ranks = np.unique(np.concatenate([r0, r1]))
    size = len(ranks)
    tree_value, tree_at = [-np.inf] * (size + 1), [-1] * (size + 1)
    gain = (np.minimum(q1 - q0, r1 - r0)).astype(float)
    begin = np.searchsorted(ranks, r0) + 1
    end = np.searchsorted(ranks, r1) + 1
    best, back = np.zeros(n), np.full(n, -1)
    done = sorted(range(n), key=lambda i: q1[i])
    ready = 0
    for i in order.tolist():
        while ready < n and q1[done[ready]] <= q0[i]:
            j = done[ready]
            value = best[j] + skip * (q1[j] + r1[j])
            p = int(end[j])
            while p <= size:
                if value > tree_value[p]:
                    tree_value[p], tree_at[p] = value, j
                p += p & -p
            ready += 1
        p, value, j = int(begin[i]), -np.inf, -1
        while p:
            if tree_value[p] > value:
                value, j = tree_value[p], tree_at[p]
            p -= p & -p
        value -= skip * (q0[i] + r0[i])
        best[i] = gain[i] + max(value, 0)
        back[i] = j if value > 0 else -1
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-best, kind="stable").tolist():
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = int(back[i])
        if links:
            out.append(np.array(links[::-1]))
    return out


PAIR = ["doc", "copy", "holder", "holder_copy"]


def _chains_of(rows: tuple[np.ndarray, ...], k: int, window: int, least_span: int) -> list[tuple[tuple, np.ndarray]]:
    """Candidate passages (pair, segments) of anchors sorted by PAIR and pos; a segment is q0, q1, r0, r1."""
    pair, (pos, at, size) = rows[:4], rows[4:]
    n = len(pos)
    if not n:
        return []
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in pair], axis=0)
    of = lambda i: tuple(int(c[i]) for c in pair)
    # Merge along diagonals first: the next anchor of a segment is on its diagonal and touches or nearly touches it.
    order = np.lexsort((pos, pos - at, np.cumsum(new)))
    pos, at, size = pos[order], at[order], size[order]
    line = np.cumsum(new | np.append(True, pos[1:] - at[1:] != pos[:-1] - at[:-1]))
    far = int((pos + size).max()) + k + window + 1
    ends = np.maximum.accumulate(pos + size + line * far)
    same = np.zeros(n, bool)
    same[1:] = (line[1:] == line[:-1]) & (pos[1:] + line[1:] * far <= ends[:-1] + window)
    first = np.flatnonzero(~same)
    last = np.append(first[1:], n) - 1
    q0, q1, r0 = pos[first], ends[last] - line[last] * far, at[first]
    r1 = r0 + q1 - q0
    group = np.cumsum(new)[first]
    cut_at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(cut_at, len(first)))
    parts = np.stack([q0, q1, r0, r1], axis=1).astype(np.int32)
    one = cut_at[sizes == 1]
    one = one[q1[one] - q0[one] >= least_span]
    out = [(of(first[i]), parts[i : i + 1]) for i in one.tolist()]
    many = np.flatnonzero(sizes > 1)
    span = np.maximum.reduceat(q1, cut_at) - np.minimum.reduceat(q0, cut_at) if len(cut_at) else np.zeros(0)
    for g in many[span[many] >= least_span].tolist():
        s = slice(cut_at[g], cut_at[g] + sizes[g])
        for c in chain(q0[s], q1[s], r0[s], r1[s]):
            if q1[s][c[-1]] - q0[s][c[0]] >= least_span:
                out.append((of(first[cut_at[g]]), parts[s][c]))
    return out


def _chainer(k: int, window: int, least_span: int):
    names = [*PAIR, "q0", "q1", "r0", "r1", "parts"]

    def out(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        found = _chains_of(tuple(np.concatenate([w[i] for w in rows]) for i in range(len(rows[0]))), k, window, least_span)
        hulls = np.array([(*pair, p[0, 0], p[-1, 1], p[0, 2], p[-1, 3]) for pair, p in found], np.int64).reshape(-1, 8)
        return pa.RecordBatch.from_arrays([*(pa.array(v) for v in hulls.T), pa.array([p.tobytes() for _, p in found], pa.binary())], names=names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not batch.num_rows:
                continue
            # The last pair may go on in the next batch.
            other = np.flatnonzero(np.any([c != c[-1] for c in rows[:4]], axis=0))
            cutoff = int(other[-1]) + 1 if len(other) else 0
            if not cutoff and held and all(h[-1] == c[0] for h, c in zip(held[-1][:4], rows[:4], strict=True)):
                held.append(rows)
                continue
            yield out([*held, tuple(x[:cutoff] for x in rows)])
            held = [tuple(x[cutoff:] for x in rows)]
        if held:
            yield out(held)

    return go


def edits(a: np.ndarray, b: np.ndarray, band: int, most: int | None = None) -> int:
    """Word edits between a and b within `band` of the diagonal from corner to corner; past `most` some number over it."""
    if len(a) == len(b) and (differ := int((a != b).sum())) <= 1:
        return differ
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    band += abs(n - m)
    far = n + m + 1
    steps = np.arange(m + 1)
    row, new = np.where(steps <= band, steps, far), np.full(m + 1, far)
    for i in range(1, n + 1):
        low, high = max(0, i - band), min(m, i + band)
        lo = max(low, 1)
        new[lo : high + 1] = np.minimum(row[lo - 1 : high] + (b[lo - 1 : high] != a[i - 1]), row[lo : high + 1] + 1)
        if low == 0:
            new[0] = i
        window = slice(low, high + 1)
        new[window] = np.minimum.accumulate(new[window] - steps[window]) + steps[window]
        if most is not None and new[window].min() > most:
            return most + 1
        row, new = new, row
    return int(row[m])


def _bit_edits(x: list[int], y: list[int], most: int) -> int:
    """Word edits by bit-parallel columns: bits of whole numbers tell where a column of the edit table rises and falls."""
    n, at = len(x), {}
    for i, word in enumerate(x):
        at[word] = at.get(word, 0) | (1 << i)
    every, top = (1 << n) - 1, 1 << (n - 1)
    rise, fall, score = every, 0, n
    for left, word in zip(range(len(y) - 1, -1, -1), y, strict=True):
        equal = at.get(word, 0)
        down = equal | fall
        across = (((equal & rise) + rise) ^ rise) | equal
        up, less = fall | (every & ~(across | rise)), rise & across
        if up & top:
            score += 1
        elif less & top:
            score -= 1
        if score - left > most:
            return most + 1
        up, less = ((up << 1) | 1) & every, (less << 1) & every
        rise, fall = less | (every & ~(down | up)), up & down
    return score


def _distance(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """Exact word edits if these are `most` or fewer, else some number over it."""
    n = min(len(x), len(y))
    front = int(np.append(x[:n] != y[:n], True).argmax())
    x, y, n = x[front:], y[front:], n - front
    back = int(np.append(x[::-1][:n] != y[::-1][:n], True).argmax())
    x, y = x[: len(x) - back], y[: len(y) - back]
    if not len(x) or not len(y) or abs(len(x) - len(y)) > most:
        return max(len(x), len(y))
    if len(x) == len(y) == 1:
        return 1
    words, n = np.unique(x, return_counts=True)
    others, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(words, others, True, True)
    if max(len(x), len(y)) - int(np.minimum(n[i], m[j]).sum()) > most:
        return most + 1
    if len(x) + len(y) <= 2 * WIDE:
        return _bit_edits(x.tolist(), y.tolist(), most)
    band = 16
    while (found := edits(x, y, min(band, most), most)) > min(band, most) and band < most:
        band *= 4
    return found


def _reach(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[int, int]:
    """How far a and b are worth following: an edit costs as much as `cost` equal words bring in."""
    a, b = a[:FLANK], b[:FLANK]
    if not len(a) or not len(b):
        return 0, 0
    # The first words differ, so there is an edit; it takes more than cost - 1 equal words to be worth it.
    there = set(b.tolist())
    if sum(x in there for x in a.tolist()) <= cost - 1:
        return 0, 0
    steps = np.arange(len(b) + 1)
    rows = [steps]
    for i, x in enumerate(a, 1):
        new = np.empty(len(b) + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(rows[-1][:-1] + (b != x), rows[-1][1:] + 1)
        rows.append(np.minimum.accumulate(new - steps) + steps)
    worth = np.minimum(np.arange(len(a) + 1)[:, None], steps) - cost * np.array(rows)
    i, j = np.unravel_index(int(worth.argmax()), worth.shape)
    return int(i), int(j)


def align(a: np.ndarray, b: np.ndarray, left: tuple[int, int], right: tuple[int, int], least: int, similar: float) -> tuple[int, int, int, int, float] | None:
    """Grows the chain a[left0:right0], b[left1:right1] on both sides and checks length and similarity."""
    (a0, b0), (a1, b1) = left, right

    def equal():
        nonlocal a0, b0, a1, b1
        while a0 and b0 and a[a0 - 1] == b[b0 - 1]:
            a0, b0 = a0 - 1, b0 - 1
        while a1 < len(a) and b1 < len(b) and a[a1] == b[b1]:
            a1, b1 = a1 + 1, b1 + 1

    def checked() -> tuple[int, int, int, int, float] | None:
        longer = max(a1 - a0, b1 - b0)
        most = int(longer * (1 - similar) + 1e-9)
        if longer < least or abs((a1 - a0) - (b1 - b0)) > most:
            return None
        distance = _distance(a[a0:a1], b[b0:b1], most)
        return (a0, a1, b0, b1, 1 - distance / longer) if distance <= most else None

    equal()
    if max(a1 - a0, b1 - b0) + 2 * FLANK < least:
        return None
    exact = (a0, a1, b0, b1)
    # Edits are paid for at the similarity asked for; a passage that stays too short goes on at half that price.
    for cost in (1 / (1 - similar), 0.5 / (1 - similar)) if similar < 1 else ():
        while True:
            i, j = _reach(a[max(a0 - FLANK, 0) : a0][::-1], b[max(b0 - FLANK, 0) : b0][::-1], cost)
            k, m = _reach(a[a1 : a1 + FLANK], b[b1 : b1 + FLANK], cost)
            a0, b0, a1, b1 = a0 - i, b0 - j, a1 + k, b1 + m
            equal()
            if not (i or j or k or m):
                break
        if max(a1 - a0, b1 - b0) >= least:
            break
    if (got := checked()) or (a0, a1, b0, b1) == exact:
        return got
    a0, a1, b0, b1 = exact
    return checked()


def aligned(a: np.ndarray, b: np.ndarray, parts: np.ndarray, least: int, similar: float) -> list[tuple[int, int, int, int, float]]:
    """The passages of a chain of segments (rows q0, q1, r0, r1): its whole hull, or those of its parts that hold."""
    todo, out = [parts], []
    while todo:
        s = todo.pop()
        got = align(a, b, (int(s[0, 0]), int(s[0, 2])), (int(s[-1, 1]), int(s[-1, 3])), least, similar)
        if got:
            out.append(got)
        elif len(s) > 1:
            at = int(np.maximum(s[1:, 0] - s[:-1, 1], s[1:, 2] - s[:-1, 3]).argmax()) + 1
            todo += [s[:at], s[at:]]
        else:
            q0, q1, r0, r1 = s[0].tolist()
            same = a[q0:q1] == b[r0:r1]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            runs = np.stack([edge[::2], edge[1::2]], axis=1)
            runs = runs[runs[:, 1] - runs[:, 0] >= K]
            if not same.all() and len(runs):
                todo.append(np.concatenate([q0 + runs, r0 + runs], axis=1))
    return out


NO_ID = 2**63 - 1


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text, doc, copy): a null id becomes the largest long, a null text the empty one; copy is the text's hash."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(body.alias("text"), F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("copy"))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, least: int = LEAST_WORDS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, start, end, holder_id, holder_start, holder_end, n_words, similarity): passages found again.

    start and end are word positions (half open) of words split at white space, compared with A-Z lower-cased. The
    holder is always the earlier document by (doc_id, text hash), so a passage of many documents stays in one; a null
    doc_id counts as the largest. Rows that share a doc_id and the text are one document, those with other texts are
    documents of their own. A passage that one document alone repeats isn't reported. Null, empty and short texts
    (under `least` words) hold no passage; an empty table gives no rows; further columns are ignored.
    """
    found = _passages(docs, doc_id, text, k, window, least, similar)
    kind = docs.schema[doc_id].dataType
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    return found.select(given("doc").alias("doc_id"), "start", "end", given("holder").alias("holder_id"), "holder_start", "holder_end", "n_words", "similarity").distinct()


def _passages(docs: DataFrame, doc_id: str, text: str, k: int, window: int, least: int, similar: float) -> DataFrame:
    rows = _identified(docs, doc_id, text)
    long = max(k, least - window + 1)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, of, _ = seeds(Tokens(batch.column(0)), k, window, least)
            doc, copy = (batch.column(i).to_numpy(zero_copy_only=False).view(U64) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(mix(mix(doc) ^ copy)[of].view(np.int64))], names=["seed", "owner"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, of, pos = seeds(Tokens(batch.column(0)), k, window, least)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1).take(of), batch.column(2).take(of), pa.array(pos.astype(np.int32))], names=["seed", "doc", "copy", "pos"])

    # Seeds are found twice: that costs less than keeping them would.
    owners = rows.mapInArrow(owned, "seed long, owner long").groupBy("seed").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    shared = settled(owners.where("low < high").select(F.col("seed").alias("of")))
    spread = rows.mapInArrow(placed, "seed long, doc long, copy long, pos int")
    held = settled(spread.join(shared, F.col("seed") == F.col("of")).select("seed", "doc", "copy", "pos"))
    heads = settled(held.groupBy("seed").agg(F.min(F.struct("doc", "copy", "pos")).alias("head")).select(F.col("seed").alias("of"), F.col("head.doc").alias("holder"), F.col("head.copy").alias("holder_copy"), F.col("head.pos").alias("at")))
    size = F.when(F.col("seed").bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(long)).otherwise(F.lit(k)).cast("int")
    met = held.join(heads, F.col("seed") == F.col("of"))
    later = (F.col("doc") != F.col("holder")) | (F.col("copy") != F.col("holder_copy"))
    odd = F.col("seed").bitwiseAND(F.lit(1).cast("long")) == 1
    far = settled(met.where(odd).select("seed", "doc", "copy", "pos", later.alias("later")))
    anchors = met.where(later).select(*PAIR, "pos", "at", F.when(odd, F.lit(long)).otherwise(F.lit(k)).cast("int").alias("size"))
    found = settled(_confirmed(rows, anchors, k, window, least, similar))
    forget(shared, held, heads)
    wide = _open_windows(rows, far, found, window, least)
    heads = settled(wide.groupBy("seed").agg(F.min(F.struct("doc", "copy", "pos")).alias("head")).select(F.col("seed").alias("of"), F.col("head.doc").alias("holder"), F.col("head.copy").alias("holder_copy"), F.col("head.pos").alias("at")))
    anchors = wide.where("open").join(heads, F.col("seed") == F.col("of")).where(later).select(*PAIR, "pos", "at", F.lit(least).alias("size"))
    more = settled(_confirmed(rows, anchors, k, window, least, similar))
    forget(far, wide, heads)
    return found.union(more)


def _owner(doc: str = "doc", copy: str = "copy") -> Column:
    return F.xxhash64(doc, copy)


def _among(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows of _identified() whose _owner() is in owners, and few others: a join that follows moves no other text."""
    return sieved(rows, _owner(), owners).where(NAME).drop(NAME)


def _open_windows(rows: DataFrame, far: DataFrame, found: DataFrame, window: int, least: int) -> DataFrame:
    """(seed, doc, copy, pos, open): the runs of `least` words around those long seeds `far` that `found` leaves open.

    A seed is open if a document other than its holder has a run around it that no passage of that document covers; the
    runs around it are given for every document that holds it, with `open` where they aren't covered.
    """
    before, after = window - 1, CYCLE - 1  # of equal seeds the one behind may have been thinned out
    spans = settled(found.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    none = F.array().cast(spans.schema["spans"].dataType)

    def with_spans(marks: DataFrame) -> DataFrame:
        joined = marks.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("copy") == F.col("_copy")), "left")
        return joined.select("doc", "copy", "marks", F.coalesce("spans", none).alias("spans"))

    def lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        count = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        parts = [flat.field(i) for i in range(flat.type.num_fields)] if pa.types.is_struct(flat.type) else [flat]
        return np.repeat(np.arange(len(count)), count), [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in parts]

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, (seed, pos) = lists(batch.column(0))
            owner, ends = lists(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(seed[~_inside(of, np.maximum(pos - before, 0), pos + after + least, owner, *ends)]))], names=["seed"])

    marked = with_spans(far.where("later").groupBy("doc", "copy").agg(F.collect_list(F.struct("seed", "pos")).alias("marks"))).select("marks", "spans")
    opened = settled(marked.mapInArrow(left_open, "seed long").distinct())
    asked = settled(with_spans(far.join(opened, "seed", "left_semi").groupBy("doc", "copy").agg(F.collect_set("pos").alias("marks"))))
    few = _among(rows, asked.select(_owner()))
    texts = few.join(asked, (few["doc"] == asked["doc"]) & (few["copy"] == asked["copy"])).select("text", asked["doc"], asked["copy"], "marks", "spans")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Tokens(batch.column(0))
            of, (pos,) = lists(batch.column(3))
            owner, ends = lists(batch.column(4))
            # A run of one word has one long seed, which stands for all that lie in the run.
            docs = t.docs()
            last = np.flatnonzero(np.append((t.keys[1:] != t.keys[:-1]) | (docs[1:] != docs[:-1]), True))
            at = t.offsets[:-1][of] + pos
            count = before + 1 + np.maximum(after, last[np.searchsorted(last, at)] + 1 - least - at)
            of, pos = np.repeat(of, count), ragged(pos - before, count)
            keep = (pos >= 0) & (pos + least <= np.diff(t.offsets)[of])
            of, pos = np.divmod(np.unique((of[keep] << 32) + pos[keep]), 1 << 32)
            seed = _runs(t.keys, t.offsets[:-1][of] + pos, least)
            keep = _thinned(of, seed, pos, least, least // 2, True)
            of, pos, seed = of[keep], pos[keep], seed[keep]
            is_open = ~_inside(of, pos, pos + least, owner, *ends)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(1).take(of), batch.column(2).take(of), pa.array(pos.astype(np.int32)), pa.array(is_open)], names=["seed", "doc", "copy", "pos", "open"])

    out = settled(texts.mapInArrow(cut_windows, "seed long, doc long, copy long, pos int, open boolean"))
    forget(spans, opened, asked)
    return out


def _confirmed(rows: DataFrame, anchors: DataFrame, k: int, window: int, least: int, similar: float) -> DataFrame:
    """The passages (columns OUT) of the chains of anchors (PAIR, pos, at, size); rows are _identified()."""
    dealt = anchors.repartition(*PAIR).sortWithinPartitions(*PAIR, "pos", "at")
    least_span = max(k, int(least * similar) - 2 * (window - 1))
    chains = cut(dealt.mapInArrow(_chainer(k, window, least_span), "doc long, copy long, holder long, holder_copy long, q0 long, q1 long, r0 long, r1 long, parts binary"))

    low = lambda c: F.greatest(F.col(c) - FLANK, F.lit(0).cast("long"))
    mine_wanted = chains.select(F.col("doc").alias("id"), F.col("copy").alias("id_copy"), low("q0").alias("a"), (F.col("q1") + FLANK).alias("b"))
    wanted = mine_wanted.union(chains.select("holder", "holder_copy", low("r0"), F.col("r1") + FLANK)).distinct()
    asked = wanted.groupBy("id", "id_copy").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    # Equal rows are one document and are read once.
    few = _among(rows, chains.select(_owner()).union(chains.select(_owner("holder", "holder_copy"))))
    texts = few.join(asked, (few["doc"] == asked["id"]) & (few["copy"] == asked["id_copy"])).select("text", "id", "id_copy", "ranges")

    def slice_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Tokens(batch.column(0))
            short = (t.keys >> U64(32)).astype(np.uint32).view(np.int32)
            lists = batch.column(3)
            count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            of = np.repeat(np.arange(len(count)), count)
            n = np.diff(t.offsets)[of]
            start, size = t.offsets[:-1][of] + np.minimum(a, n), np.minimum(b, n) - np.minimum(a, n)
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(short[ragged(start, size)].tobytes())])
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(of), batch.column(2).take(of), pa.array(a), pa.array(b), words], names=["id", "id_copy", "a", "b", "words"])

    cutouts = settled(texts.mapInArrow(slice_words, "id long, id_copy long, a long, b long, words binary").dropDuplicates(["id", "id_copy", "a", "b"]))
    side = lambda n: cutouts.select(F.col("id").alias(f"id{n}"), F.col("id_copy").alias(f"copy{n}"), F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"), F.col("words").alias(f"w{n}"))
    first = (F.col("doc") == F.col("id1")) & (F.col("copy") == F.col("copy1")) & (low("q0") == F.col("a1")) & (F.col("q1") + FLANK == F.col("b1"))
    second = (F.col("holder") == F.col("id2")) & (F.col("holder_copy") == F.col("copy2")) & (low("r0") == F.col("a2")) & (F.col("r1") + FLANK == F.col("b2"))
    both = chains.join(side(1), first).join(side(2), second)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(11)]
            out = []
            for doc, copy, holder, holder_copy, q0, q1, r0, r1, parts, w1, w2 in zip(*columns, strict=True):
                a, b = np.frombuffer(w1, np.int32), np.frombuffer(w2, np.int32)
                qa, ra = max(q0 - FLANK, 0), max(r0 - FLANK, 0)
                segments = np.frombuffer(parts, np.int32).reshape(-1, 4).astype(np.int64) - [qa, qa, ra, ra]
                for a0, a1, b0, b1, value in aligned(a, b, segments, least, similar):
                    out.append((doc, copy, qa + a0, qa + a1, holder, holder_copy, ra + b0, ra + b1, a1 - a0, value))
            yield pa.RecordBatch.from_pylist([dict(zip(OUT, x, strict=True)) for x in out], schema=OUT_ARROW)

    return both.select(*PAIR, "q0", "q1", "r0", "r1", "parts", "w1", "w2").mapInArrow(check, OUT_SCHEMA)


OUT = ["doc", "copy", "start", "end", "holder", "holder_copy", "holder_start", "holder_end", "n_words", "similarity"]
OUT_SCHEMA = ", ".join(f"{c} {'double' if c == 'similarity' else 'long'}" for c in OUT)
OUT_ARROW = pa.schema([(c, pa.float64() if c == "similarity" else pa.int64()) for c in OUT])


def without_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with the passages cut out that an earlier document holds; a document of which nothing is left goes.

    Documents are those of passages(): an id with a text, so rows that share an id keep what is their own, rows without
    an id take part as the last ones, and equal rows lose equal parts. White space around a cut stays as it is but for
    the words' own spans; other texts, nulls too, are untouched, byte for byte, as are all other columns. An empty
    table gives no rows.
    """
    settings = {"k": K, "window": WINDOW, "least": LEAST_WORDS, "similar": SIMILAR} | more
    found = _passages(docs, doc_id, text, **settings)
    spans = settled(found.groupBy(F.col("doc").alias("_id"), F.col("copy").alias("_copy")).agg(F.collect_set(F.struct("start", "end")).alias("_spans")))
    names = docs.columns
    packed = docs.select(docs[text].alias("text"), F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("id_copy"), F.struct(*[docs[c] for c in names if c != text]).alias("row"))
    packed = sieved(packed, _owner("id", "id_copy"), spans.select(_owner("_id", "_copy")))
    whole, packed = packed.where(~F.col(NAME)), packed.where(NAME)
    joined = packed.join(spans, (packed["id"] == spans["_id"]) & (packed["id_copy"] == spans["_copy"]), "left").select("text", "_spans", "row")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = Tokens(batch.column(0), lower=False)
            raw = batch.column(0).to_pylist()
            texts, left = [], []
            first = np.concatenate([[0], np.cumsum([len((x or "").encode()) for x in raw])])
            for i, spans_ in enumerate(batch.column(1).to_pylist()):
                if spans_ is None:
                    texts.append(raw[i])
                    left.append(i)
                    continue
                body = (raw[i] or "").encode()
                starts = t.starts[t.offsets[i] : t.offsets[i + 1]] - first[i]
                ends = starts + t.lengths[t.offsets[i] : t.offsets[i + 1]]
                gone = np.zeros(len(starts) + 1, np.int64)
                for s in spans_:
                    a, b = min(s["start"], len(starts)), min(s["end"], len(starts))
                    gone[a] += 1
                    gone[b] -= 1
                cut_word = np.cumsum(gone)[:-1] > 0
                if cut_word.all():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cut_word.astype(np.int8), [0]])))
                parts, at = [], 0
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    parts.append(body[at : starts[a]])
                    at = starts[b] if b < len(starts) else int(ends[-1])
                parts.append(body[at:])
                texts.append(b"".join(parts).decode())
                left.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2).take(pa.array(left, pa.int64()))], names=["text", "row"])

    done = joined.mapInArrow(cut_out, StructType([StructField("text", StringType()), StructField("row", joined.schema["row"].dataType)]))
    unpacked = [F.col("text").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in names]
    return whole.select(*unpacked).union(done.select(*unpacked))
