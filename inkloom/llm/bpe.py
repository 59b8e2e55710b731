"""Byte-level BPE with a public rank file, vectorised over many words.

A word is held as a contiguous row of part ids and a row of the ranks of its
adjacent pairs. Each round finds the minimum of every row at once, deletes that
boundary (the row closes up) and looks up the two neighbouring ranks anew. In
a rank file a merged part's id is its rank. Words longer than ``LONG`` bytes go
through the same rule with a heap, as closing up a row is linear in its length.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import regex

#: Pattern that splits text before the merges (fixed value of the public rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int64(1 << 40)
LONG = 512
CACHE = 200_000


class ByteBpe:
    def __init__(self, ranks: bytes):
        table = {}
        for line in ranks.splitlines():
            if line:
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        self.split = regex.compile(PATTERN).findall
        self.byte = np.array([table[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in table.items():
            for cut in range(1, len(token)):
                left, right = table.get(token[:cut]), table.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.values = np.array(values, dtype=np.int64)[order]
        self.pair = dict(zip(keys, values))
        self.cache: dict[str, np.ndarray] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def _rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        count = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        size = np.array([len(w) for w in words])
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.byte[raw], -1)
        if width == 1:
            return list(ids)
        ranks = np.full((count, width), NONE)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        done: list[np.ndarray] = [None] * count  # type: ignore[list-item]
        live = np.arange(count)
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            best = ranks[row, at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[live[k]] = ids[k, : size[k]].copy()
                keep = ~over
                ids, ranks, size, live, at, best = ids[keep], ranks[keep], size[keep], live[keep], at[keep], best[keep]
                if not len(live):
                    break
                row = np.arange(len(live))
                most = int(size.max())
                ids, ranks, column = ids[:, :most], ranks[:, :most], column[:most]
            ids[row, at] = best
            pull = np.minimum(column + (column > at[:, None]), len(column) - 1)
            ids = np.take_along_axis(ids, pull, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), len(column) - 1), axis=1)
            size -= 1
            ids[row, size] = -1
            ranks[row, size] = NONE
            right = np.minimum(at + 1, len(column) - 1)
            ranks[row, at] = np.where(at + 1 < size, self._ranks(ids[row, at], ids[row, right]), NONE)
            left = np.maximum(at - 1, 0)
            fresh = self._ranks(ids[row, left], ids[row, at])
            ranks[row, left] = np.where(at > 0, fresh, ranks[row, left])
        return done

    def _long(self, word: bytes) -> np.ndarray:
        ids = [int(x) for x in self.byte[np.frombuffer(word, np.uint8)]]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [
            (r, i, ids[i], ids[i + 1])
            for i in range(len(ids) - 1)
            if (r := self.pair.get(ids[i] << 20 | ids[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.pair.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not cached yet; rows of like length go together."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        by: dict[int, list[str]] = {}
        for word in words - self.cache.keys():
            n = len(word.encode())
            by.setdefault(1 << (n - 1).bit_length() if n <= LONG else 0, []).append(word)
        for width, group in by.items():
            for k in range(0, len(group), 4096):
                part = group[k : k + 4096]
                raw = [w.encode() for w in part]
                self.cache.update(zip(part, map(self._long, raw) if not width else self._rows(raw, width)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts give an empty array."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):  # blocks bound the words held at once
            stop, chars = start, 0
            while stop < len(texts) and chars < 400_000:
                chars += len(texts[stop] or "")
                stop += 1
            split = [self.split(t) if t else [] for t in texts[start:stop]]
            self.learn({w for words in split for w in words})
            out += [
                np.concatenate([self.cache[w] for w in words]).astype(np.int32) if words else np.empty(0, np.int32)
                for words in split
            ]
            start = stop
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.encode(texts)]
