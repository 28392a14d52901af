"""Greedy pair merging over integer symbols, many short pieces at once.

A byte-pair vocabulary is given as ``{string: rank}``: two neighbouring symbols
may merge when their concatenation is in the vocabulary, and the pair of the
lowest rank merges first, the leftmost of equal ones. Short distinct pieces are
merged together as rows of one matrix; a long piece uses a linked list with a
heap, so a run of n symbols costs n log n.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

NONE = np.int64(1 << 40)
#: pieces of more symbols than this take the heap
LONG = 48


class PairMerger:
    """``vocab``: string -> rank; the rank is also the merged symbol's id."""

    def __init__(self, vocab: dict) -> None:
        self.base = max(vocab.values(), default=0) + 1
        pairs = {}
        for s, rank in vocab.items():
            for cut in range(1, len(s)):
                a, b = vocab.get(s[:cut]), vocab.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pairs = pairs
        self.keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(self.keys)
        self.keys = np.append(self.keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a negative symbol never merges."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def _long(self, s: Sequence[int]) -> list[int]:
        n, sym = len(s), list(s)
        left, right, pairs, base = list(range(-1, n - 1)), list(range(1, n + 1)), self.pairs, self.base
        rank = lambda i, j: pairs.get(sym[i] * base + sym[j]) if sym[i] >= 0 and sym[j] >= 0 else None
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = r, 1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                if (q := rank(i, right[j])) is not None:
                    heapq.heappush(heap, (q, i, r, sym[right[j]]))
            if left[i] >= 0 and (q := rank(left[i], i)) is not None:
                heapq.heappush(heap, (q, left[i], sym[left[i]], r))
        return [sym[i] for i in range(n) if not gone[i]]

    def merge(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``flat``: the symbols of all pieces one after the other, ``lens``: symbols
        of each piece. The same two arrays after all merges."""
        flat, lens = np.asarray(flat, np.int64), np.asarray(lens, np.int64)
        starts = np.cumsum(lens) - lens
        new = np.zeros_like(lens)
        out = flat.copy()  # each piece is written to the start of its own room
        for k in np.flatnonzero(lens > LONG):
            got = self._long(flat[starts[k]:starts[k] + lens[k]].tolist())
            new[k] = len(got)
            out[starts[k]:starts[k] + len(got)] = got
        short = np.flatnonzero((lens <= LONG) & (lens > 0))
        short = short[np.argsort(lens[short], kind="stable")]
        for lo in range(0, len(short), 16384):
            part = short[lo:lo + 16384]
            cols = np.arange(int(lens[part[-1]]) + 1)
            at = starts[part][:, None] + cols
            m = np.where(cols < lens[part][:, None], flat[np.minimum(at, len(flat) - 1)], -1)
            m, new[part] = self._matrix(m, lens[part])
            keep = cols < new[part][:, None]
            out[at[keep]] = m[keep]
        room = np.repeat(starts, new)
        inner = np.arange(len(room)) - np.repeat(np.cumsum(new) - new, new)
        return out[room + inner], new

    def _matrix(self, m: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols, padded with at least one -1; other negative symbols never merge."""
        width = m.shape[1] - 1
        rank = self._rank(m[:, :-1], m[:, 1:])
        done, left = m.copy(), lens.copy()
        live, cols = np.arange(len(m)), np.arange(width + 1)
        while len(live):
            pos = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), pos]
            on = best < NONE
            if not on.all():
                done[live[~on]] = m[~on]
                live, pos, best, m, rank = live[on], pos[on], best[on], m[on], rank[on]
                if not len(live):
                    break
            k = np.arange(len(live))
            past = cols > pos[:, None]
            m = np.where(past, np.concatenate([m[:, 1:], np.full((len(live), 1), -1)], axis=1), m)
            m[k, pos] = best
            rank = np.where(past[:, :-1], np.concatenate([rank[:, 1:], np.full((len(live), 1), NONE)], axis=1), rank)
            rank[k, pos] = self._rank(best, m[k, np.minimum(pos + 1, width)])
            before = np.maximum(pos - 1, 0)
            rank[k, before] = np.where(pos > 0, self._rank(m[k, before], best), rank[k, before])
            left[live] -= 1
        return done, left
