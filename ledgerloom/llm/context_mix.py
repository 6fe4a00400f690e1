"""Online logistic mixing of hashed-context bit predictors: the arithmetic on NumPy arrays.

A text is its UTF-8 bytes and a final zero byte; a byte is eight binary decisions
down a tree of 255 nodes. For each context kind a table holds, per hashed context
and node, the log-odds of a one as counted over the training texts. A text is
scored from left to right: log-odds of all kinds are added up under a set of
weights that the bit position selects; the result is refined by an adaptive table
that maps log-odds to observed frequencies; both learn from the bits just seen,
block by block (``BLOCK`` bytes), and start anew for each text. Every probability
depends on earlier bytes and the training texts only, so the score is the log
probability of the text. Many texts move in step, as lanes of the same arrays.

The eight log-odds that a byte meets under a context are stored together, so one
look-up per byte and kind finds them all.
"""

from __future__ import annotations

import numpy as np

#: (kind, bits of the hashed context); the kinds are the 1, 2 and 4 bytes before, and the current word so far.
KINDS = (("b1", 8), ("b2", 14), ("b4", 14), ("word", 14))
OFFSETS = np.cumsum([0, *[1 << bits for _, bits in KINDS]])
CONTEXTS = int(OFFSETS[-1])  # rows of the joint table
BLOCK, SPAN, HISTORY = 256, 2048, 16
_SCALE = np.float32(1 / 12)
_RATE, _FIRST_WEIGHT = np.float32(0.3), np.float32(0.3)
_BINS = 24

_BYTES = np.arange(256)
#: The nodes that a byte passes, and its bits as +1 and -1.
PATH = np.stack([(1 << d) | (_BYTES >> (8 - d)) for d in range(8)], axis=1).astype(np.int32)
SIGN = np.stack([((_BYTES >> (7 - d)) & 1) * 2 - 1 for d in range(8)], axis=1).astype(np.float32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True

_P = 0x9E3779B1
_POWERS = np.array([pow(_P, j, 1 << 32) for j in range(SPAN + HISTORY + 1)], dtype=np.uint32)
_BACK = np.array([pow(_P, -j, 1 << 32) for j in range(SPAN + HISTORY + 1)], dtype=np.uint32)


def _hash(values: np.ndarray, bits: int) -> np.ndarray:
    return (values * np.uint32(_P)) >> np.uint32(32 - bits)


def contexts(window: np.ndarray) -> np.ndarray:
    """Rows of the joint table, kinds x lanes x positions, for the bytes after the first HISTORY ones of each lane."""
    lanes, width = window.shape
    wide = window.astype(np.uint32)
    at = lambda back: wide[:, HISTORY - back : width - back]
    out = np.empty((len(KINDS), lanes, width - HISTORY), dtype=np.int64)
    out[0] = at(1)
    pair = at(1) | (at(2) << np.uint32(8))
    out[1] = _hash(pair, 14) + np.uint32(OFFSETS[1])
    four = pair | (at(3) << np.uint32(16)) | (at(4) << np.uint32(24))
    out[2] = _hash(four ^ (four >> np.uint32(15)), 14) + np.uint32(OFFSETS[2])
    sums = np.zeros((lanes, width + 1), dtype=np.uint32)
    np.cumsum((wide + np.uint32(1)) * _POWERS[:width], axis=1, dtype=np.uint32, out=sums[:, 1:])
    begin = _SPACE[window] * np.arange(1, width + 1, dtype=np.int32)
    begin = np.maximum.accumulate(begin, axis=1)[:, HISTORY - 1 : width - 1]
    before = sums.reshape(-1)[begin + (np.arange(lanes, dtype=np.int64) * (width + 1))[:, None]]
    word = (sums[:, HISTORY:width] - before) * _BACK[begin]
    out[3] = _hash(word ^ (word >> np.uint32(15)), 14) + np.uint32(OFFSETS[3])
    return out


def windows(texts: list[bytes], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes ``first - HISTORY`` to ``first + SPAN`` (or the longest's end) of each text, and how many of them are its own."""
    sizes = np.array([min(SPAN, len(t) - first) for t, first in zip(texts, firsts)])
    width = -(-int(sizes.max()) // BLOCK) * BLOCK
    out = np.zeros((len(texts), HISTORY + width), dtype=np.uint8)
    for i, (t, first) in enumerate(zip(texts, firsts)):
        low = max(0, first - HISTORY)
        shift = HISTORY - (first - low)
        part = np.frombuffer(t, dtype=np.uint8, count=min(len(t), first + width) - low, offset=low)
        out[i, shift : shift + len(part)] = part
    return out, sizes


def count(texts: list[bytes], table: np.ndarray, lanes: int = 256) -> None:
    """Adds the bytes of texts (with their final zero) to ``table``, contexts x 256."""
    flat = table.reshape(-1)
    spans = sorted(((i, first) for i, t in enumerate(texts) for first in range(0, len(t), SPAN)), key=lambda s: s[1] - len(texts[s[0]]))
    for a in range(0, len(spans), lanes):
        numbers, firsts = zip(*spans[a : a + lanes])
        window, sizes = windows([texts[i] for i in numbers], firsts)
        rows = contexts(window)
        own = np.arange(window.shape[1] - HISTORY) < sizes[:, None]
        following = window[:, HISTORY:][own].astype(np.int64)
        for k in range(len(KINDS)):
            np.add.at(flat, rows[k][own] * 256 + following, np.uint32(1))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Per context (row of 256 byte counts) and byte, the scaled log-odds of a one at the byte's eight nodes, as int8."""
    out = np.zeros(counts.shape, dtype=np.int8)
    level = counts.astype(np.float32)
    for d in range(7, -1, -1):
        zero, one = level[:, 0::2], level[:, 1::2]
        odds = np.log((one + 0.4) / (zero + 0.4)) * 12
        out[:, 1 << d : 2 << d] = np.clip(np.rint(odds), -127, 127)
        level = zero + one
    return out[:, PATH]


class Scorer:
    """Scores texts under a joint table of log-odds, contexts x 256 x 8."""

    def __init__(self, table: np.ndarray, lanes: int = 32):
        self.table, self.lanes = np.ascontiguousarray(table).reshape(-1).view(np.uint64), lanes

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each text."""
        total = np.zeros(len(texts))
        waiting = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        group: list[tuple[int, int]] = []  # texts in the lanes and their next byte; a lane that ends takes the next text
        weights = np.empty((len(KINDS), 0, 8), dtype=np.float32)
        refine = np.empty((0, 8 * _BINS), dtype=np.float32)
        while group or waiting:
            new = [waiting.pop() for _ in range(min(len(waiting), self.lanes - len(group)))]
            group += [(i, 0) for i in new]
            weights = np.concatenate([weights, np.full((len(KINDS), len(new), 8), _FIRST_WEIGHT * _SCALE, dtype=np.float32)], axis=1)
            refine = np.concatenate([refine, np.tile(_refine_start(), (len(new), 8))])
            order = sorted(range(len(group)), key=lambda j: group[j][1] - len(texts[group[j][0]]))
            group = [group[j] for j in order]
            weights, refine = np.ascontiguousarray(weights[:, order]), refine[order]
            numbers, firsts = map(list, zip(*group))
            window, sizes = windows([texts[i] for i in numbers], firsts)
            rows = contexts(window)
            rows *= 256
            rows += window[:, HISTORY:]
            flat, table = weights.reshape(len(KINDS), -1), refine.reshape(-1)
            for b in range(0, window.shape[1] - HISTORY, BLOCK):
                n = int((sizes > b).sum())
                own = np.arange(b, b + BLOCK)[:, None] < sizes[:n]
                following = window[:n, HISTORY + b : HISTORY + b + BLOCK].T
                block = np.ascontiguousarray(rows[:, :n, b : b + BLOCK].transpose(0, 2, 1))
                total[numbers[:n]] += self._block(block, following, own, flat[:, : 8 * n], table[: 8 * n * _BINS])
            group = [(i, first + SPAN) for i, first in group if len(texts[i]) > first + SPAN]  # those at the front
            weights, refine = weights[:, : len(group)], refine[: len(group)]
        return total

    def _block(self, rows, following, own, weights, refine) -> np.ndarray:
        """Bits of one block per lane; then weights and refinement learn from it, in place. Arrays are positions x (lanes x bits)."""
        size, lanes = following.shape
        sign = _by_bit(_SIGNS[following])
        odds = [_by_bit(self.table[rows[k]]) for k in range(len(KINDS))]
        mixed = odds[0] * weights[0]
        step = np.empty_like(mixed)
        for k in range(1, len(KINDS)):
            np.multiply(odds[k], weights[k], out=step)
            mixed += step
        np.clip(mixed, -11.9, 11.9, out=mixed)
        np.add(mixed, np.float32(12), out=step)
        place = step.astype(np.int64)
        place += np.arange(0, 8 * lanes * _BINS, _BINS)
        seen = refine.take(place, mode="clip")  # all are in range; the mode spares a check
        mixed *= sign
        tail = np.exp(np.negative(mixed, out=mixed), out=mixed)
        tail += 1
        right = np.reciprocal(tail, out=tail)  # probability of the bit that came, before refinement
        seen *= sign
        np.multiply(sign, np.float32(-0.5), out=step)
        step += np.float32(0.5)
        refined = np.add(seen, step, out=seen)
        np.add(right, refined, out=step)
        step *= np.float32(0.5)
        share = step.reshape(-1)  # at least 0.00005 a bit, so the product of eight is a normal float
        for _ in range(3):
            share = share[0::2] * share[1::2]
        bits = -(np.log(share).reshape(size, lanes) * own).sum(axis=0, dtype=np.float64) / np.log(2)
        if not own.all():
            sign.reshape(size, lanes, 8)[~own] = 0
        error = np.subtract(np.float32(1), right, out=right)
        error *= sign
        rate = np.repeat(_RATE * _SCALE * _SCALE / (own.sum(axis=0) + 8), 8)
        for k in range(len(KINDS)):
            weights[k] += np.einsum("bl,bl->l", error, odds[k]) * rate
        away = np.subtract(np.float32(1), refined, out=refined)
        away *= sign
        refine += np.bincount(place.reshape(-1), weights=away.reshape(-1), minlength=len(refine)) * (1 / (BLOCK + 32))
        np.clip(refine, 1e-4, 1 - 1e-4, out=refine)
        return bits


#: The signs of a byte's bits as eight int8 in one integer.
_SIGNS = np.ascontiguousarray(SIGN.astype(np.int8)).view(np.uint64).reshape(-1)


def _by_bit(packed: np.ndarray) -> np.ndarray:
    """Eight int8 per byte to floats, positions x (lanes x bits)."""
    return np.ascontiguousarray(packed).view(np.int8).astype(np.float32)


def _refine_start() -> np.ndarray:
    middle = np.arange(_BINS) - 11.5
    return (1 / (1 + np.exp(-middle))).astype(np.float32)
