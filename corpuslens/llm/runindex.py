"""A run-length index of many short strings: bounded-order Burrows-Wheeler transform in runs.

Suffixes are sorted by their first `order` bytes, which is all that matches of up to
`order` bytes need. The transform is kept as runs of equal bytes with the number of
equal bytes before each run; every class of suffixes that agree on `order` bytes keeps
one sample, the smallest owner. The indexed strings stream through it from their last
byte to the first, all at once, and give at each place the matching statistic (length up
to `order`, which only the end of the string can shorten) and, at full length, the
sample: the smallest owner of an equal match.
"""

from __future__ import annotations

import numpy as np


PACKED = 7  # symbols of 0 to 256 that fit one 64-bit integer


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and an order that sorts them."""
    order = np.argsort(key)
    ranked = key[order]
    ranks = np.empty(len(key), dtype=np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return ranks, order


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """Rank (plus one) of the suffix `by` places on; 0 beyond the end."""
    out = np.zeros(len(ranks), dtype=np.int64)
    out[: max(0, len(ranks) - by)] = ranks[by:] + 1
    return out


def _longer(ranks: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the prefix that goes `by` symbols further, for prefixes of at least that length."""
    return _ranked(ranks * (len(ranks) + 1) + _shifted(ranks, by))


def prefix_ranks(text: np.ndarray, size: int) -> np.ndarray:
    """Rank of every suffix by its first `size` symbols (0 to 256)."""
    width = min(PACKED, size)
    key = np.zeros(len(text), dtype=np.int64)
    for place in range(width):
        key *= 257
        key[: max(0, len(text) - place)] += text[place:]
    ranks, _ = _ranked(key)
    while width < size:
        step = min(width, size - width)
        ranks, _ = _longer(ranks, step)
        width += step
    return ranks


class RunLengthIndex:
    """Index of `strings` (bytes); `owners[i]` is the sample value of string i."""

    def __init__(self, strings: list[bytes], owners: np.ndarray, order: int):
        self.order = order
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        ends = np.cumsum(lengths + 1)  # one separator (symbol 0) after each string
        text = np.zeros(int(ends[-1]), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + 1
        short = prefix_ranks(text, order - 1)
        full, rows = _ranked(short * 258 + _shifted(text, order - 1))
        transform = text[rows - 1]  # the first suffix has the last symbol before it
        ranked, ranked_short = full[rows], short[rows]
        self.size = len(text)
        #: starts of the classes that agree on order - 1 symbols, and on order symbols
        self.short_starts = np.flatnonzero(np.diff(ranked_short, prepend=-1))
        self.full_starts = np.flatnonzero(np.diff(ranked, prepend=-1))
        owner = np.repeat(np.asarray(owners, dtype=np.int64), lengths + 1)
        self.samples = np.minimum.reduceat(owner[rows], self.full_starts)
        # runs, ordered by (symbol, start): one search finds the run for a rank query
        start = np.flatnonzero(np.diff(transform, prepend=-1))
        symbol = transform[start]
        size = np.diff(np.append(start, len(text)))
        by_symbol = np.lexsort((start, symbol))
        self.run_key = symbol[by_symbol] * (self.size + 1) + start[by_symbol]
        self.run_start, self.run_size = start[by_symbol], size[by_symbol]
        before = np.cumsum(self.run_size) - self.run_size
        #: rows of smaller symbols plus equal symbols before the run: rank and C array in one
        self.run_before = before
        self.first = np.searchsorted(symbol[by_symbol], np.arange(258))
        self.below = np.concatenate([before, [self.size]])

    @property
    def runs(self) -> int:
        return len(self.run_key)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows that start with a smaller symbol, or with this one where it stands before `row` in the transform."""
        at = np.searchsorted(self.run_key, symbol * (self.size + 1) + row, side="left") - 1
        inside = at >= self.first[symbol]
        held = np.maximum(at, 0)
        counted = self.run_before[held] + np.minimum(row - self.run_start[held], self.run_size[held])
        return np.where(inside, counted, self.below[self.first[symbol]])

    def stream(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(length, sample) for every place of every string, both of shape (strings, longest).

        Column j is the place j of the string. A length below `order` has sample -1.
        """
        n, longest = len(strings), max(map(len, strings), default=0)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        padded = np.frombuffer(b"".join(s.rjust(longest, b"\0") for s in strings), dtype=np.uint8)
        padded = padded.reshape(n, longest).astype(np.int64) + 1
        statistic = np.zeros((n, longest), dtype=np.int64)
        sample = np.full((n, longest), -1, dtype=np.int64)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)
        length = np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        for back in range(longest):
            live = live[lengths[live] > back]
            symbol = padded[live, longest - 1 - back]
            self._shorten(live, low, high, length, self.order - 1)
            new_low, new_high = self._step(symbol, low[live]), self._step(symbol, high[live])
            if (new_low >= new_high).any():
                raise ValueError("a streamed string is not part of the index")
            low[live], high[live] = new_low, new_high
            length[live] += 1
            place = lengths[live] - 1 - back
            statistic[live, place] = length[live]
            whole = np.flatnonzero(length[live] == self.order)
            hit = np.searchsorted(self.full_starts, low[live[whole]], side="right") - 1
            sample[live[whole], place[whole]] = self.samples[hit]
        return statistic, sample

    def _shorten(self, live, low, high, length, most: int) -> None:
        """Matches of full length give up their last symbol: their interval grows to the class of order - 1."""
        who = live[length[live] > most]
        if len(who):
            at = np.searchsorted(self.short_starts, low[who], side="right")
            low[who] = self.short_starts[at - 1]
            high[who] = np.append(self.short_starts, self.size)[at]
            length[who] = most
