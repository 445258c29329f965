"""Subword lattices over a double-array trie, for many units at once.

A unit is a short byte string (a word with its white-space marker). The trie holds the bytes of all pieces in two
arrays: the child of state s by byte c is base[s] + c if check there is s. Units are laid out as columns of a matrix
of bytes and walked together, position by position, so the cost is a few array operations a byte. Very long units
(over LONG bytes) are walked one at a time by the same arrays.
"""

from __future__ import annotations

import numpy as np

from .textcore import ragged

MARKER = "▁"
LONG = 400
LOG10 = float(np.log(10.0))


class Pieces:
    """Pieces with log scores, and bytes as a fallback for every character that is no piece of its own."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, ids: np.ndarray, byte_ids: np.ndarray, byte_score: float | np.ndarray):
        self.pieces, self.scores, self.ids = pieces, np.asarray(scores, np.float64), np.asarray(ids, np.int64)
        self.byte_ids = np.asarray(byte_ids, np.int64)
        self.byte_scores = np.broadcast_to(np.asarray(byte_score, np.float64), 256).copy()
        self.base, self.check, self.leaf = _double_array(pieces)
        self.longest = max((len(p) for p in pieces), default=1)

    def with_scores(self, scores: np.ndarray, byte_scores: np.ndarray) -> Pieces:
        out = object.__new__(Pieces)
        out.__dict__ = self.__dict__ | {"scores": np.asarray(scores, np.float64), "byte_scores": np.asarray(byte_scores, np.float64)}
        return out


def _double_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the piece that ends in each state (or -1)."""
    order = sorted(range(len(pieces)), key=lambda i: pieces[i])
    base, check, leaf = [0] * 65536, [-1] * 65536, [-1] * 65536
    used = bytearray(65536)
    used[0] = 1
    hint = 1
    todo = [(0, 0, len(order), 0)]
    while todo:
        state, low, high, depth = todo.pop()
        while low < high and len(pieces[order[low]]) == depth:
            leaf[state] = order[low]
            low += 1
        if low == high:
            continue
        groups, at = [], low
        while at < high:
            byte, begin = pieces[order[at]][depth], at
            while at < high and pieces[order[at]][depth] == byte:
                at += 1
            groups.append((byte, begin, at))
        first = groups[0][0]
        place = max(hint, first + 1)
        while True:
            place = used.find(0, place)
            if place < 0 or place + 512 >= len(used):
                grow = len(used)
                used.extend(bytes(grow))
                base.extend([0] * grow)
                check.extend([-1] * grow)
                leaf.extend([-1] * grow)
                if place < 0:
                    place = grow
            shift = place - first
            if all(not used[shift + byte] for byte, _, _ in groups):
                break
            place += 1
        if len(groups) == 1 and place - hint < 2:
            hint = place
        base[state] = shift
        for byte, begin, end in groups:
            child = shift + byte
            used[child], check[child] = 1, state
            todo.append((child, begin, end, depth + 1))
    n = len(used)
    return np.array(base[:n], np.int32), np.array(check[:n], np.int32), np.array(leaf[:n], np.int32)


def _matrix(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes of the units by position: row p is byte p of every unit, zero past its end."""
    most = int(lengths.max())
    at = starts[None, :] + np.arange(most)[:, None]
    inside = np.arange(most)[:, None] < lengths[None, :]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.int32)


def _char_lengths(first: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that begins with each byte; zero inside a character."""
    return np.where(first < 0x80, 1, np.where(first < 0xC0, 0, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))))


def _walk(m: Pieces, cells: np.ndarray, lengths: np.ndarray, p: int, live: np.ndarray):
    """For the units `live` at position p: (units, bytes taken, piece) of every match, shortest first, then fallbacks."""
    state = np.zeros(len(live), np.int32)
    units = live
    size = np.int32(len(m.check))
    alone = np.zeros(len(live), bool)
    where = np.arange(len(live))
    width = _char_lengths(cells[p, live])
    for k in range(min(m.longest, cells.shape[0] - p)):
        byte = cells[p + k, units]
        child = m.base[state] + byte
        good = (child < size) & (p + k < lengths[units])
        good[good] = m.check[child[good]] == state[good]
        units, state, where = units[good], child[good], where[good]
        if not len(units):
            break
        piece = m.leaf[state]
        hit = piece >= 0
        if hit.any():
            at = where[hit]
            alone[at[width[at] == k + 1]] = True
            yield units[hit], k + 1, piece[hit]
    bare = ~alone & (width > 0)
    for w in range(1, 5):
        if (rest := live[bare & (width == w)]).size:
            yield rest, w, None


def _blocks(lengths: np.ndarray, cells: int = 1 << 20):
    """Units in groups of like length, by index; a group's matrix has about `cells` bytes at most.

    Units over LONG bytes are in groups of their own.
    """
    order = np.argsort(lengths, kind="stable")
    long = int((lengths <= LONG).sum())
    at = 0
    while at < len(order):
        end = at + 1
        step = max(1, cells // max(1, int(lengths[order[at]])))
        end = min(len(order), at + step)
        while end - at > 1 and int(lengths[order[end - 1]]) * (end - at) > 2 * cells:
            end = at + (end - at) // 2
        if at < long:
            end = min(end, long)
        yield order[at:end]
        at = end


def _fallback(m: Pieces, cells: np.ndarray, units: np.ndarray, p: int, width: int) -> np.ndarray:
    return sum(m.byte_scores[cells[p + i, units]] for i in range(width))


def forward(m: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The natural log of the summed probability of all segmentations of each unit; zero for an empty unit."""
    out = np.zeros(len(starts))
    for block in _blocks(lengths):
        length = lengths[block]
        if not length.max():
            continue
        if length.max() > LONG:
            for u in block:
                out[u] = _forward_one(m, data[starts[u] : starts[u] + lengths[u]])
            continue
        cells = _matrix(data, starts[block], length)
        alpha = np.full((cells.shape[0] + 1, len(block)), -np.inf)
        alpha[0] = 0
        for p in range(cells.shape[0]):
            live = np.flatnonzero((length > p) & (alpha[p] > -np.inf))
            if not len(live):
                continue
            for units, k, piece in _walk(m, cells, length, p, live):
                score = _fallback(m, cells, units, p, k) if piece is None else m.scores[piece]
                alpha[p + k, units] = np.logaddexp(alpha[p + k, units], alpha[p, units] + score)
        out[block] = alpha[length, np.arange(len(block))]
    return out


def expected(m: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of each piece and each fallback byte over all segmentations, units counted by weight (forward-backward).

    Units over LONG bytes are walked one at a time.
    """
    pieces, byte_uses = np.zeros(len(m.pieces)), np.zeros(256)
    for block in _blocks(lengths):
        length = lengths[block]
        if not length.max():
            continue
        if length.max() > LONG:
            for u in block:
                _expected_one(m, data[starts[u] : starts[u] + lengths[u]], float(weight[u]), pieces, byte_uses)
            continue
        cells = _matrix(data, starts[block], length)
        alpha = np.full((cells.shape[0] + 1, len(block)), -np.inf)
        alpha[0] = 0
        arcs = []
        for p in range(cells.shape[0]):
            live = np.flatnonzero((length > p) & (alpha[p] > -np.inf))
            if not len(live):
                continue
            for units, k, piece in _walk(m, cells, length, p, live):
                score = _fallback(m, cells, units, p, k) if piece is None else m.scores[piece]
                alpha[p + k, units] = np.logaddexp(alpha[p + k, units], alpha[p, units] + score)
                arcs.append((p, k, units, piece, score))
        beta = np.full_like(alpha, -np.inf)
        beta[length, np.arange(len(block))] = 0
        total = alpha[length, np.arange(len(block))]
        share = weight[block]
        for p, k, units, piece, score in reversed(arcs):
            through = score + beta[p + k, units]
            beta[p, units] = np.logaddexp(beta[p, units], through)
            use = share[units] * np.exp(alpha[p, units] + through - total[units])
            if piece is None:
                for i in range(k):
                    byte_uses += np.bincount(cells[p + i, units], use, 256)
            else:
                pieces += np.bincount(piece, use, len(pieces))
    return pieces, byte_uses


def viterbi(m: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the best segmentation of every unit, one after the other, and the n + 1 offsets between units.

    Of equal scores the one whose last piece begins first wins.
    """
    order_of, sizes_of, ids_of = [], [], []
    for block in _blocks(lengths):
        length = lengths[block]
        order_of.append(block)
        if not length.max():
            sizes_of.append(np.zeros(len(block), np.int64))
            continue
        if length.max() > LONG:
            each = [_viterbi_one(m, data[starts[u] : starts[u] + lengths[u]]) for u in block]
            sizes_of.append(np.array([len(x) for x in each], np.int64))
            ids_of += each
            continue
        cells = _matrix(data, starts[block], length)
        best = np.full((cells.shape[0] + 1, len(block)), -np.inf)
        best[0] = 0
        took = np.zeros((cells.shape[0] + 1, len(block)), np.int16)
        piece_at = np.full((cells.shape[0] + 1, len(block)), -1, np.int32)
        for p in range(cells.shape[0]):
            live = np.flatnonzero((length > p) & (best[p] > -np.inf))
            if not len(live):
                continue
            for units, k, piece in _walk(m, cells, length, p, live):
                score = best[p, units] + (_fallback(m, cells, units, p, k) if piece is None else m.scores[piece])
                better = score > best[p + k, units]
                u = units[better]
                best[p + k, u] = score[better]
                took[p + k, u] = k
                piece_at[p + k, u] = -1 if piece is None else piece[better]
        # All units are read back together, from their ends: an id's turn counts from the end of its unit.
        at, live, turn, steps = length.copy(), np.flatnonzero(length > 0), np.zeros(len(block), np.int64), []
        while len(live):
            k, piece = took[at[live], live], piece_at[at[live], live]
            for w in range(int(k.max())):  # a fallback of several bytes gives one id a byte, from the last
                one = (piece < 0) & (k > w)
                if one.any():
                    u = live[one]
                    steps.append((u, turn[u], m.byte_ids[cells[at[u] - 1 - w, u]]))
                    turn[u] += 1
            u = live[piece >= 0]
            steps.append((u, turn[u], m.ids[piece[piece >= 0]]))
            turn[u] += 1
            at[live] -= k
            live = live[at[live] > 0]
        ends = np.cumsum(turn)
        ids = np.empty(int(ends[-1]), np.int64)
        for u, back, found in steps:
            ids[ends[u] - 1 - back] = found
        sizes_of.append(turn)
        ids_of.append(ids)
    if not order_of:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    order, size = np.concatenate(order_of), np.concatenate(sizes_of)
    ids = np.concatenate(ids_of) if ids_of else np.zeros(0, np.int64)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(size) - size
    sizes = np.empty(len(order), np.int64)
    sizes[order] = size
    return ids[ragged(at, sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _arcs_one(m: Pieces, unit: np.ndarray, p: int):
    base, check, leaf = m.base, m.check, m.leaf
    state, alone = 0, False
    width = int(_char_lengths(unit[p : p + 1])[0])
    for k in range(min(m.longest, len(unit) - p)):
        child = int(base[state]) + int(unit[p + k])
        if child >= len(check) or check[child] != state:
            break
        state = child
        if leaf[state] >= 0:
            alone |= k + 1 == width
            yield k + 1, int(leaf[state])
    if width and not alone:
        yield width, -1


def _forward_one(m: Pieces, unit: np.ndarray) -> float:
    alpha = np.full(len(unit) + 1, -np.inf)
    alpha[0] = 0
    for p in range(len(unit)):
        if alpha[p] > -np.inf:
            for k, piece in _arcs_one(m, unit, p):
                score = m.byte_scores[unit[p : p + k]].sum() if piece < 0 else m.scores[piece]
                alpha[p + k] = np.logaddexp(alpha[p + k], alpha[p] + score)
    return float(alpha[-1])


def _expected_one(m: Pieces, unit: np.ndarray, weight: float, pieces: np.ndarray, byte_uses: np.ndarray) -> None:
    """Adds the unit's expected uses to both counts. Arcs are walked again on the way back instead of being kept."""
    score = lambda p, k, piece: m.byte_scores[unit[p : p + k]].sum() if piece < 0 else m.scores[piece]
    alpha, beta = np.full(len(unit) + 1, -np.inf), np.full(len(unit) + 1, -np.inf)
    alpha[0] = beta[-1] = 0
    for p in range(len(unit)):
        if alpha[p] > -np.inf:
            for k, piece in _arcs_one(m, unit, p):
                alpha[p + k] = np.logaddexp(alpha[p + k], alpha[p] + score(p, k, piece))
    for p in range(len(unit) - 1, -1, -1):
        if alpha[p] > -np.inf:
            for k, piece in _arcs_one(m, unit, p):
                through = score(p, k, piece) + beta[p + k]
                beta[p] = np.logaddexp(beta[p], through)
                use = weight * np.exp(alpha[p] + through - alpha[-1])
                if piece < 0:
                    np.add.at(byte_uses, unit[p : p + k], use)
                else:
                    pieces[piece] += use


def _viterbi_one(m: Pieces, unit: np.ndarray) -> np.ndarray:
    best = np.full(len(unit) + 1, -np.inf)
    best[0] = 0
    took, piece_at = np.zeros(len(unit) + 1, np.int64), np.full(len(unit) + 1, -1, np.int64)
    for p in range(len(unit)):
        if best[p] > -np.inf:
            for k, piece in _arcs_one(m, unit, p):
                score = best[p] + (m.byte_scores[unit[p : p + k]].sum() if piece < 0 else m.scores[piece])
                if score > best[p + k]:
                    best[p + k], took[p + k], piece_at[p + k] = score, k, piece
    out, at = [], len(unit)
    while at:
        k, piece = int(took[at]), int(piece_at[at])
        out += [int(m.byte_ids[b]) for b in unit[at - k : at][::-1]] if piece < 0 else [int(m.ids[piece])]
        at -= k
    return np.array(out[::-1], np.int64)


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """From a SentencePiece file: bytes, scores and ids of the ordinary pieces, ids of the 256 byte pieces, all pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, ids, byte_ids, names = [], [], [], np.full(256, -1, np.int64), []
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        names.append(name)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append(name.encode())
            scores.append(sp.get_score(i))
            ids.append(i)
    return pieces, np.array(scores), np.array(ids, np.int64), byte_ids, names
