"""CGK embedding, bit-sampling LSH and exact edit distance over arrays of word numbers."""

from __future__ import annotations

import numpy as np

_U32 = np.uint32


class Walks:
    """Random walks that map sequences at small edit distance to arrays at small Hamming distance.

    A walk reads one symbol per step and moves on by the step's coin for that
    symbol; equal symbols get equal coins, so two sequences fall into step again
    soon after an edit. Each table of a walk samples ``coordinates`` steps.
    """

    def __init__(self, walks: int, tables: int, coordinates: int, seed: int = 7):
        self.walks, self.tables, self.coordinates, self.seed = walks, tables, coordinates, seed

    def keys(self, symbols: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
        """Table keys, (walks * tables) x starts, of the sequences that begin at ``starts``; symbols must reach ``steps`` further."""
        out = np.empty((self.walks * self.tables, len(starts)), dtype=np.uint64)
        for w in range(self.walks):
            rng = np.random.default_rng((self.seed, w, steps))
            coins = rng.integers(0, 1 << 32, size=(2, steps), dtype=np.uint32)
            sampled = [np.sort(rng.choice(steps, self.coordinates, replace=False)) for _ in range(self.tables)]
            wanted = {int(s) for table in sampled for s in table}
            at, seen = starts.astype(np.int64), {}
            for j in range(max(wanted) + 1):
                symbol = symbols[at]
                if j in wanted:
                    seen[j] = symbol.astype(np.uint64)
                mixed = (symbol.astype(_U32) + coins[0, j]) * (coins[1, j] | _U32(1))
                at += ((mixed ^ (mixed >> _U32(15))) * _U32(0x9E3779B1)) >> _U32(31)
            for t, table in enumerate(sampled):
                key = np.full(len(starts), w * self.tables + t, dtype=np.uint64)
                for j in table:
                    key = (key ^ seen[int(j)]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                out[w * self.tables + t] = key
        return out


def fit(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(edits, end) of the best match of the whole pattern against any stretch of the text, the earliest end of the best."""
    masks: dict[int, int] = {}
    for i, p in enumerate(pattern):
        masks[p] = masks.get(p, 0) | 1 << i
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for j, c in enumerate(text):
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best[0]:
            best = (score, j + 1)
    return best


def best_stretch(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the best match; of equal ones that which ends first and then starts last."""
    edits, end = fit(pattern, text)
    _, length = fit(pattern[::-1], text[:end][::-1])
    return edits, end - length, end
