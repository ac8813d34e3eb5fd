"""Byte-pair merging of many words at once.

All words of one length class are rows of a matrix of symbols. Every step finds each
row's leftmost pair of lowest rank, merges it, and looks up only the two pairs that
changed. Words longer than the widest class are merged one by one with a heap, in
O(n log n). Both give what merging one pair at a time gives.
"""

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
_WIDTHS = (8, 16, 32, 64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairMerges:
    """Ranks of symbol pairs: merging (left, right) has a rank and gives a symbol."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        bits = max(4, int(4 * len(left)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NONE, np.int32)
        self._merged = np.full(1 << bits, -1, np.int32)
        keys = (left << np.uint64(32) | right).astype(np.int64)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        at, rest = self._slot(keys), np.arange(len(keys))
        self._probes = 0
        while len(rest):
            self._probes += 1
            free = self._keys[at[rest]] == -1
            self._keys[at[rest[free]]] = keys[rest[free]]  # of several for one slot the last stays
            won = rest[self._keys[at[rest]] == keys[rest]]
            self._ranks[at[won]], self._merged[at[won]] = rank[won], merged[won]
            rest = rest[self._keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & self._mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self._shift).astype(np.int64)

    def find(self, left, right):
        """(rank, merged symbol) of pairs; NONE where they do not merge. Symbol -1 is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self._keys[at]
        rank = np.where(found == keys, self._ranks[at], NONE)
        merged = np.where(found == keys, self._merged[at], -1)
        rest = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        for _ in range(self._probes):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & self._mask
            found = self._keys[at[rest]]
            hit = rest[found == keys[rest]]
            rank[hit], merged[hit] = self._ranks[at[hit]], self._merged[at[hit]]
            rest = rest[(found != keys[rest]) & (found != -1)]
        return rank, merged

    def merge(self, symbols, lengths):
        """Merge words given as one flat array and their lengths; (flat ids, counts)."""
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = lengths.copy()
        pieces = np.empty(len(symbols), np.int32)  # a word's ids lie at its old start
        low = 0
        for width in _WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for i in range(0, len(rows), 1 << 15):
                part = rows[i:i + (1 << 15)]
                self._merge_rows(symbols, starts[part], lengths[part], width, part, counts, pieces)
        for row in np.flatnonzero(lengths > low):
            first = starts[row]
            ids = self._merge_long(symbols[first:first + lengths[row]])
            counts[row] = len(ids)
            pieces[first:first + len(ids)] = ids
        keep = np.arange(len(symbols)) - np.repeat(starts, lengths) < np.repeat(counts, lengths)
        return pieces[keep], counts

    def _merge_rows(self, symbols, starts, lengths, width, rows, counts, pieces):
        columns = np.arange(width)
        at = starts[:, None] + columns
        inside = columns < lengths[:, None]
        ids = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
        rank, merged = (x.reshape(len(ids), width - 1)
                        for x in self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        left = lengths.copy()
        while len(ids):
            own = np.arange(len(ids))
            best = rank.argmin(axis=1)
            live = rank[own, best] != NONE
            if not live.all():
                done = ~live
                keep = columns < left[done][:, None]
                pieces[(starts[done][:, None] + columns)[keep]] = ids[done][keep]
                counts[rows[done]] = left[done]
                ids, rank, merged, left, starts, rows, best = (
                    x[live] for x in (ids, rank, merged, left, starts, rows, best))
                if not len(ids):
                    return
                own = np.arange(len(ids))
            ids[own, best] = merged[own, best]
            take = columns[:-1] + (columns[:-1] > best[:, None])
            ids[:, :-1] = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            rank[:, :-1] = np.take_along_axis(rank, take[:, :-1], 1)
            merged[:, :-1] = np.take_along_axis(merged, take[:, :-1], 1)
            rank[:, -1] = NONE
            left -= 1
            after = np.minimum(best, width - 2)
            rank[own, after], merged[own, after] = self.find(ids[own, after], ids[own, after + 1])
            has = np.flatnonzero(best > 0)
            before = best[has] - 1
            rank[has, before], merged[has, before] = self.find(ids[has, before],
                                                               ids[has, before + 1])

    def _merge_long(self, symbols):
        ids = [int(x) for x in symbols]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.find(np.asarray(symbols[:-1]), np.asarray(symbols[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1], int(m))
                for i, (r, m) in enumerate(zip(rank, merged)) if r != NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    r, m = self.find(np.array([ids[k]]), np.array([ids[after[k]]]))
                    if r[0] != NONE:
                        heapq.heappush(heap, (int(r[0]), k, ids[k], ids[after[k]], int(m[0])))
        return [x for x, keep in zip(ids, alive) if keep]
