"""Periodic runs of words: stretches that repeat a phrase of q words at least twice.

Karp, Miller and Rosenberg's naming gives every window of 2 ** k words a number, equal for equal windows of one document:
level 0 numbers the words, a window of level k + 1 is a pair of level k. The longest common extension of two places is read
from the names, from the highest level down. A run of period q and at least 2 * q words covers a multiple i of q within its
first q words, and extends forward or backward from (i, i + q) by half of its length less q; so only places of this grid
whose names of the level below that half agree are extended. Texts of a batch are worked on together in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least twice its period.
LEAST_WORDS = 12
#: Documents are named together up to about this many words; a longer one by itself.
BATCH_WORDS = 1 << 17
#: Places of the grid that are looked at together.
GRID = 1 << 19


def named_levels(names: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words at every place, up to the last length that occurs twice.

    names: numbers of the words, different ones for the words of different documents. A window that occurs once, also one
    that would reach beyond its document, has a name of its own. Each level ends with -1, which equals nothing."""
    n = len(names)
    levels: list[np.ndarray] = []
    at, key = np.arange(n), names.astype(np.int64)
    while len(at):
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if not twice.any():
            break
        groups = len(counts)
        level = np.arange(groups, groups + n + 1, dtype=np.int32 if n + groups < 2**31 - 1 else np.int64)
        level[n] = -1
        at = at[twice]
        level[at] = inverse[twice]
        levels.append(level)
        repeated = np.zeros(n + 1, bool)
        repeated[at] = True
        other = np.minimum(at + (1 << (len(levels) - 1)), n)
        at = at[repeated[other]]
        key = level[at].astype(np.int64) * groups + level[np.minimum(at + (1 << (len(levels) - 1)), n)]
    return levels


def extension(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """Words that follow places x and y alike (step 1), or stand before them alike (step -1)."""
    n = len(levels[0]) - 1
    x, y = x.copy(), y.copy()
    length = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        far = 1 << k
        one, two = (x, y) if step > 0 else (x - far, y - far)
        same = levels[k][np.where(one < 0, n, one)] == levels[k][np.maximum(two, 0)]
        move = np.where(same, far, 0)
        length += move
        x += step * move
        y += step * move
    return length


def _grid(n: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) for all q in [low, high) and multiples i of q with i + q < n, some at a time."""
    q = low
    while q < high:
        end, total = q, 0
        while end < high and (total == 0 or total + (n - 1) // end <= GRID):
            total += (n - 1) // end
            end += 1
        periods = np.arange(q, end)
        counts = (n - 1) // periods
        per = np.repeat(periods, counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        whole = (np.arange(len(per)) - first) * per
        for a in range(0, len(per), GRID):
            yield whole[a : a + GRID], per[a : a + GRID]
        q = end


def runs(names: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of every run, by start and period. names: as for named_levels; longest: words of the longest
    document among them."""
    n, levels = len(names), named_levels(names)
    found = [np.zeros((0, 3), np.int64)]
    low = 1
    while low <= longest // 2:
        half = (max(LEAST_WORDS, 2 * low) - low + 1) // 2
        k = half.bit_length() - 1
        # periods below `high` have the same level below half of what a run extends
        high = min(low + 1 if 2 * low < LEAST_WORDS else 2 ** (k + 2) - 1, longest // 2 + 1)
        if k >= len(levels):
            # no window of 2 ** k words occurs twice, nor does a longer one
            if 2 * low >= LEAST_WORDS:
                break
            low = high
            continue
        level, far = levels[k], 1 << k
        for i, q in _grid(n, low, high):
            before = np.where(i >= far, i - far, n)
            ok = (level[i] == level[i + q]) | (level[before] == level[np.maximum(i + q - far, 0)])
            i, q = i[ok], q[ok]
            if not len(i):
                continue
            start = i - extension(levels, i, i + q, -1)
            end = i + q + extension(levels, i, i + q, 1)
            size = end - start
            ok = size >= np.maximum(LEAST_WORDS, 2 * q)
            rows = np.stack([start[ok], end[ok], q[ok]], axis=1)
            found.append(np.unique(rows, axis=0) if len(rows) > 1 else rows)
        low = high
    every = np.concatenate(found)
    # one stretch with several periods: the smallest divides the others
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    once = np.ones(len(every), bool)
    once[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[once]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _settle(texts: list[tuple[list[bytes], np.ndarray]]) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each (words, names): its runs as (start, length, period), and the words that are kept joined by a space."""
    sizes = np.array([len(w) for w, _ in texts])
    at = np.concatenate(([0], np.cumsum(sizes)))
    whole = runs(np.concatenate([n for _, n in texts]), int(sizes.max(initial=0)))
    cut = np.searchsorted(whole[:, 0], at)
    for d, (words, _) in enumerate(texts):
        own = whole[cut[d] : cut[d + 1]]
        if not len(own):
            yield own, b" ".join(words)
            continue
        start, end, period = own[:, 0] - at[d], own[:, 1] - at[d], own[:, 2]
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, start + period, 1)
        np.add.at(inside, end, -1)
        kept = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
        yield np.stack([start, end - start, period], axis=1), b" ".join([words[j] for j in kept.tolist()])


def _numbered(words: list[bytes], base: int) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, base + len(ids)) for w in words], np.int64)


RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batch(ids: pa.Array, sizes: list[int], found: list[tuple[np.ndarray, bytes]]) -> pa.RecordBatch:
    rows = np.concatenate([r for r, _ in found]) if found else np.zeros((0, 3), np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r, _ in found]))).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
    collapsed = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat, type=_RUN), collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs (doc_id, text): all runs as (start, length, period), by start
    and period, in words from 0; and the text without what runs repeat, its words joined by one space.

    A run is a longest stretch of words of smallest period q with at least max(12, 2 * q) words; its first q words are kept,
    unless they repeat something in another run. Words are what stands between spaces, tabs and line breaks of ASCII.
    `prepare` may change a document's words first. Null and empty texts, and those of less than 12 words, have no runs; rows
    are independent, so repeated ids give a row each. A task holds a batch of documents or one longer document at a time:
    some 4 bytes for each word and level of names."""

    def read(batches):
        for b in batches:
            done, texts, total = 0, [], 0
            for i, text in enumerate(b.column(1)):
                words = (text.as_py() or "").encode().split()
                if prepare is not None:
                    words = prepare(b.column(0)[i].as_py(), words)
                if texts and total + len(words) > BATCH_WORDS:
                    yield _batch(b.column(0).slice(done, len(texts)), [len(w) for w, _ in texts], list(_settle(texts)))
                    done, texts, total = i, [], 0
                texts.append((words, _numbered(words, total)))
                total += len(words)
            if texts:
                yield _batch(b.column(0).slice(done, len(texts)), [len(w) for w, _ in texts], list(_settle(texts)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(read, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def looped_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The documents of a tenth of all ids with a tail that repeats one of its phrases, as `prepare`: a known share of runs."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs: the longest
    run (ties: smallest start, then period; nulls without runs) and SHA-256 of all runs and of the kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.less")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
