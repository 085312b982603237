"""Agendas of adjacent symbol pairs, for many words at once.

A word's agenda is the row of ranks its adjacent pairs would merge with; every
step merges the best pair (leftmost of equals) of each word that still has one.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max  # rank of a pair that does not merge
WIDEST = 64  # symbols of a word that fits a row; longer words keep a heap of their own
SHIFT = 21  # bits of a symbol


class MergeTable:
    """``pairs`` maps two symbols to (rank, merged symbol); symbols are below 2 ** 21."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.pairs = pairs
        size = 1 << max(10, (len(pairs) * 8).bit_length())
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        if pairs:
            left = np.array(list(pairs), np.int64)
            keys = (left[:, 0] << SHIFT) | left[:, 1]
            values = np.array(list(pairs.values()), np.int64)
            todo, slot = np.arange(len(keys)), self._slot(keys)
            while len(todo):
                free = self.keys[slot[todo]] < 0
                self.keys[slot[todo[free]]] = keys[todo[free]]  # the last writer stays
                won = self.keys[slot[todo]] == keys[todo]
                self.ranks[slot[todo[won]]] = values[todo[won], 0]
                self.merged[slot[todo[won]]] = values[todo[won], 1]
                todo = todo[~won]
                slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(40)).astype(np.int64)) & self.mask

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; negative symbols never merge."""
        keys = (a.astype(np.int64) << SHIFT) | b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        there = self.keys[slot]
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            left = left[(there != keys[left]) & (there != -1)]
        found = self.keys[slot] == keys
        return np.where(found, self.ranks[slot], NONE), self.merged[slot]

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """Symbols of each word after all merges."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for width in (1, 4, 8, 12, 16, 24, 32, WIDEST):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for i in range(0, len(rows), 8192):
                part = rows[i : i + 8192]
                if width == 1:
                    done = [words[r] for r in part]
                else:
                    done = self._merge_rows([words[r] for r in part], sizes[part], width)
                for r, d in zip(part, done):
                    out[r] = d
        for r in np.flatnonzero((sizes > WIDEST) | (sizes == 0)):
            out[r] = self._merge_long(words[r])
        return out

    def _merge_rows(self, words: list[list[int]], sizes: np.ndarray, width: int) -> list[list[int]]:
        symbols = np.full((len(words), width + 1), -1, np.int32)
        symbols[np.arange(width + 1) < sizes[:, None]] = [s for w in words for s in w]
        ranks, into = self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        ranks, into = ranks.reshape(-1, width), into.reshape(-1, width)
        final = symbols.copy()
        at, columns = np.arange(len(words)), np.arange(width)
        while len(at):
            best = ranks.argmin(axis=1)
            row = np.arange(len(at))
            alive = ranks[row, best] != NONE
            if not alive.all():
                final[at[~alive]] = symbols[~alive]
                at, symbols, ranks, into, best = at[alive], symbols[alive], ranks[alive], into[alive], best[alive]
                row = np.arange(len(at))
                if not len(at):
                    break
            symbols[row, best] = into[row, best]
            # Close the gap behind the merged symbol.
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols[:, :-1] = np.take_along_axis(symbols, columns + (columns > best[:, None]), 1)
            symbols[:, -1] = -1
            ranks, into = np.take_along_axis(ranks, shift, 1), np.take_along_axis(into, shift, 1)
            ranks[:, -1] = NONE
            ranks[row, best], into[row, best] = self.look_up(symbols[row, best], symbols[row, best + 1])
            inner = np.flatnonzero(best > 0)
            before = best[inner] - 1
            ranks[inner, before], into[inner, before] = self.look_up(symbols[inner, before], symbols[inner, before + 1])
        return [w[:n] for w, n in zip(final.tolist(), (final >= 0).sum(axis=1).tolist())]

    def _merge_long(self, word: list[int]) -> list[int]:
        symbols, n, pairs = list(word), len(word), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def offer(i: int, j: int) -> None:
            found = pairs.get((symbols[i], symbols[j]))
            if found is not None:
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, a, b, merged = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s >= 0]
