"""Local alignment of word sequences, and a table of word grams to look up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: What a matching word adds; a differing, missing or additional word costs 1.
MATCH = 2
#: Cells (4 bytes each) that an alignment holds whole; of larger ones it holds some rows.
CELLS = 4 << 20


@dataclass
class Alignment:
    score: int  # 2 for each matching word, less 1 for each other step
    matched: int  # words that match
    first: tuple[int, int]  # where it begins in a and in b
    end: tuple[int, int]


def align(a: np.ndarray, b: np.ndarray, low: int | None = None, high: int | None = None) -> Alignment:
    """The best local (Smith-Waterman) alignment of a and b along the diagonals j - i from low to high (all by default).

    A row of cells at a time: column c is diagonal low + c, so a step in both stays in its column, one in a alone comes
    from column c + 1 of the row before, and steps in b alone are a running maximum. Where the cells are more than CELLS,
    only one row of each square root of them is held, and the way back computes the rows between again."""
    low = -len(a) if low is None else low
    high = len(b) if high is None else high
    width = max(1, high - low + 1)
    step = max(1, len(a) if len(a) * width <= CELLS else int(len(a) ** 0.5))
    ramp = np.arange(width, dtype=np.int32)
    cells = np.zeros((step + 1, width + 1), np.int32)

    def fill(begin: int) -> int:
        """Rows behind row `begin`, which is cells[0], to the next that is held; gives their number."""
        count = min(step, len(a) - begin)
        for k in range(count):
            row = cells[k + 1]
            row[:] = 0
            j0 = begin + k + low
            first, end = min(max(0, -j0), width), max(0, min(width, len(b) - j0))
            if first >= end:
                continue
            before = cells[k]
            own = np.where(b[j0 + first : j0 + end] == a[begin + k], MATCH, -1) + before[first:end]
            np.maximum(own, before[first + 1 : end + 1] - 1, out=own)
            np.maximum(own, 0, out=own)
            row[first:end] = np.maximum.accumulate(own + ramp[first:end]) - ramp[first:end]
        return count

    held, score, i, c = {}, 0, 0, 0
    for begin in range(0, len(a), step):
        held[begin] = cells[0].copy()
        count = fill(begin)
        k, at = (int(x) for x in np.unravel_index(cells[1 : count + 1].argmax(), (count, width + 1)))
        if cells[k + 1, at] > score:
            score, i, c = int(cells[k + 1, at]), begin + k + 1, at
        cells[0] = cells[count]
    if not score:
        return Alignment(0, 0, (0, 0), (0, 0))
    ends, matched, firsts = (i, i + low + c), 0, (i, i + low + c)
    begin = -1
    if step >= len(a):
        begin, cells[0] = 0, 0  # all rows are here still
    while i > 0:
        if (i - 1) // step * step != begin:
            begin = (i - 1) // step * step
            cells[0] = held[begin]
            fill(begin)
        k = i - begin
        if cells[k, c] <= 0:
            break
        j = i + low + c  # this cell ends with a[i - 1] and b[j - 1]: diagonal (j - 1) - (i - 1)
        same = 0 < j <= len(b) and b[j - 1] == a[i - 1]
        if cells[k, c] == cells[k - 1, c] + (MATCH if same else -1):
            matched += same
            i -= 1
        elif c + 1 <= width and cells[k, c] == cells[k - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
        firsts = (i, i + low + c)
    return Alignment(score, int(matched), firsts, ends)


class GramTable:
    """Positions of word grams in numbered sequences. find gives, for grams of a text, where they stand in these."""

    def __init__(self, grams: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], owner[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(grams >> np.uint64(44)).astype(np.int64)] = True

    def spans(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each gram of a text, the first entry of this table with it and the end of these."""
        first, end = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        maybe = np.flatnonzero(self.seen[(grams >> np.uint64(44)).astype(np.int64)])
        first[maybe], end[maybe] = np.searchsorted(self.grams, grams[maybe], "left"), np.searchsorted(self.grams, grams[maybe], "right")
        return first, end

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an index into grams and an index into this table's entries."""
        maybe = np.flatnonzero(self.seen[(grams >> np.uint64(44)).astype(np.int64)])
        first, end = np.searchsorted(self.grams, grams[maybe], "left"), np.searchsorted(self.grams, grams[maybe], "right")
        count = end - first
        entries = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(maybe, count), entries
