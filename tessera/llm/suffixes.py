"""Blockwise suffix sorting with a difference cover.

A block is a text made of strings, each followed by a mark of its own, so no two suffixes are equal. The suffixes at
positions whose residue modulo the period is in the cover are the sample; they are ranked first, by doubling. Any suffixes,
of whatever residues, are then sorted one bucket at a time: a bucket holds suffixes of neighbouring first bytes, and is
sorted by the first period of bytes. Suffixes that agree on all of it (long ties) are merged by comparisons of two ranks: for any
two positions the cover has a shift, smaller than the period, that takes both to the sample, and as the bytes before
agree, the ranks there decide. So a comparison reads a period of bytes at most, and memory is bounded by the block, its
ranks, and one bucket.
"""

from __future__ import annotations

from functools import lru_cache

PERIOD = 32
#: Suffixes of a bucket, about: suffixes of equal first bytes stay together.
BUCKET = 1 << 17


def difference_cover(period: int) -> list[int]:
    """Residues of which every residue is a difference; found greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best, gain = None, set()
        for x in range(1, period):
            if x not in cover:
                new = {(x - c) % period for c in cover} | {(c - x) % period for c in cover}
                if len(new & missing) > len(gain):
                    best, gain = x, new & missing
        cover.append(best)
        missing -= gain
    return sorted(cover)


COVER = tuple(difference_cover(PERIOD))


@lru_cache
def shifts(period: int, cover: tuple[int, ...]):
    """For each two residues the least shift that takes both into the cover: (period, period)."""
    import numpy as np

    inside = np.zeros(2 * period, bool)
    inside[[*cover, *(c + period for c in cover)]] = True
    a, b = np.arange(period)[:, None], np.arange(period)[None, :]
    found = np.full((period, period), -1)
    for s in range(period - 1, -1, -1):
        found[inside[a + s] & inside[b + s]] = s
    if (found < 0).any():
        raise ValueError("not a difference cover: some positions have no shift into it in common")
    return found


def _heads(fresh):
    """For each element the index of the last one before it, itself included, that is marked."""
    import numpy as np

    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


class Block:
    """The text of some strings; ``starts`` has the position of each."""

    def __init__(self, strings: list[bytes], period: int = PERIOD, cover: tuple[int, ...] = COVER):
        import numpy as np

        if period % 8:
            raise ValueError("the period is a multiple of 8")
        self.period, self.shift = period, shifts(period, tuple(cover))
        # the mark after a string: a byte that no UTF-8 text has, and the string's number
        raw = b"".join([x for k, s in enumerate(strings) for x in (s, b"\xff" + k.to_bytes(5, "big"))]) + b"\1"
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 6
        self.starts, self.n = np.cumsum(sizes) - sizes, len(raw)
        wide = np.frombuffer(raw + bytes(period + 16 + -len(raw) % 8), np.uint8)
        self.words = np.empty(len(raw) + period, np.uint64)  # the eight bytes from each position on
        for k in range(8):
            own = wide[k : k + (len(wide) - k) // 8 * 8].view(">u8")[: len(range(k, len(self.words), 8))]
            self.words[k::8] = own
        inside = np.zeros(period, bool)
        inside[list(cover)] = True
        self.sample = np.flatnonzero(inside[np.arange(self.n) % period])
        self.ranks = self._ranked()

    def _first(self, of):
        """Keys of the first period of bytes, the last word first."""
        return [self.words[of + k] for k in range(self.period - 8, -1, -8)]

    def _ranked(self):
        """The rank, from 1 on, of the suffix at each position of the sample, 0 elsewhere and past the end."""
        import numpy as np

        p, ranks, reach = self.sample, np.zeros(self.n + 1, np.int64), self.period
        keys = self._first(p)
        order = np.lexsort(keys)
        p = p[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        ranks[p] = _heads(fresh) + 1
        while True:
            # equal ones go on: a suffix ranked by its first bytes is ranked by twice as many with the rank that far on
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            p = p[tied]
            if not len(p):
                return ranks
            own, next_ = ranks[p], ranks[np.minimum(p + reach, self.n)]
            order = np.lexsort([next_, own])
            p, own, next_ = p[order], own[order], next_[order]
            group, fresh = np.ones(len(p), bool), np.ones(len(p), bool)
            group[1:] = own[1:] != own[:-1]
            fresh[1:] = group[1:] | (next_[1:] != next_[:-1])
            ranks[p] = own + _heads(fresh) - _heads(group)
            reach *= 2

    def _less(self, a, b):
        """Whether suffixes come before others that have the first period of bytes in common."""
        s = self.shift[a % self.period, b % self.period]
        return self.ranks[a + s] < self.ranks[b + s]

    def _merged(self, of, group):
        """Positions in groups (whose numbers ascend), each group in order; its suffixes have the first period in common."""
        import numpy as np

        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(of)]]))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        index = np.arange(len(of)) - base
        width = 1
        while width < sizes.max(initial=0):
            run = index // width
            other = np.minimum((run ^ 1) * width, size)  # the run to merge with, in the group
            low, high = other.copy(), np.minimum(other + width, size)
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                before = self._less(of[base[todo] + mid], of[todo])
                low[todo[before]] = mid[before] + 1
                high[todo[~before]] = mid[~before]
                todo = todo[low[todo] < high[todo]]
            out = np.empty_like(of)
            out[base + (run & ~1) * width + index - run * width + low - other] = of
            of, width = out, 2 * width
        return of

    def buckets(self, of):
        """Suffixes ``of`` in order, bucket by bucket: (positions, whether each has its first period in common with the
        one before)."""
        import numpy as np

        of = of[np.argsort(self.words[of], kind="stable")]
        cuts = np.concatenate([[0], np.flatnonzero(self.words[of[1:]] != self.words[of[:-1]]) + 1, [len(of)]])
        at = 0
        while at < len(of):
            to = int(cuts[min(len(cuts) - 1, np.searchsorted(cuts, at + BUCKET))])
            bucket, at = of[at:to], to
            keys = self._first(bucket)
            order = np.lexsort(keys)
            alike = np.zeros(len(bucket), bool)
            alike[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
            bucket = bucket[order]
            tied = alike.copy()
            tied[:-1] |= alike[1:]
            at_ties = np.flatnonzero(tied)
            if len(at_ties):
                bucket[at_ties] = self._merged(bucket[at_ties], np.cumsum(~alike)[at_ties])
            yield bucket, alike

    def repeated(self, of, depth: int):
        """Those of the positions ``of`` whose ``depth`` bytes, which lie in one string, start at another of them too:
        sorts them, and compares neighbours. ``depth`` is a period at least."""
        import numpy as np

        if depth < self.period:
            raise ValueError(f"the depth is {self.period} at least")
        found = [of[:0]]
        for bucket, alike in self.buckets(of):
            pair = np.flatnonzero(alike[1:])
            for k in [*range(self.period, depth - 8, 8), depth - 8]:
                pair = pair[self.words[bucket[pair] + k] == self.words[bucket[pair + 1] + k]]
            hit = np.zeros(len(bucket), bool)
            hit[pair] = hit[pair + 1] = True
            found.append(bucket[hit])
        return np.concatenate(found)
