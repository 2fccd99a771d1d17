"""Exact substring dedup with suffix arrays sorted in two stages.

A window of `span` bytes is repeated if the same bytes start anywhere else, in any document; shorter ones of `least` bytes
tell which passages documents share. Each window of `least` bytes names an anchor, the k-gram of least hash in it, so
equal windows name equal anchors at equal places. Successive windows with one anchor make a slice, with the bytes up to
`span` behind each. Slices meet by anchor; where an anchor occurs more than once, the slices' suffixes are sorted, and
common prefixes with the neighbours tell the repeated windows. Equal slices are sorted once; an anchor with very many
different slices is split by more of the bytes around it first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import BYTE_VALUE, as_long, mix, prefix_sums, span_hash, text_blocks, text_buffer, words, written

#: A shared passage is looked for by windows of LEAST bytes, and reported if it has PASSAGE_WORDS words.
SPAN, LEAST, ANCHOR, PASSAGE_WORDS = 400, 256, 48, 51
#: Slices are sorted together up to about so many bytes. An anchor with more different slices than MOST_SLICES is split:
#: its windows part into SPLIT groups by where the anchor stands in them, and meet by what all of a group have around it.
SORT_BYTES, MOST_SLICES, SPLIT = 3 << 20, 2048, 8
#: Text is cut into slices in blocks of about so many bytes, which stay in the processor's cache.
SLICE_BLOCK = 1 << 18
#: Before sorting, what two slices of an anchor have in common is found in steps of so many bytes.
TRIM_STEP = 32


def suffix_types(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than its successor; the last one isn't."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    # where two bytes are equal, the next pair that differs decides
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _sorted_seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """The seeds (suffixes that are smaller than their successor while the one before is larger) in order of their first
    `depth` bytes, ties in any order.

    Suffixes that agree so far are told apart by the last seed within what they have in common, whose own rank counts
    there: so each round about doubles what has been compared. Where there is none (a long run), 8 more bytes count."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8))

    def word(at):
        return eight[np.minimum(at, n + depth)].view(">u8").ravel().astype(np.uint64)

    # a seed is known as one once the first byte that differs from its own has been seen
    differs = np.flatnonzero(text[1:] != text[:-1]) + 1
    known = np.append(differs, n)[np.searchsorted(differs, seeds, "right")]
    before = np.zeros(n + 2, np.int32)  # seeds known before a place
    before[1:] = np.cumsum(np.bincount(known, minlength=n + 1))
    first = word(seeds)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(seeds), np.int64)
    deep = np.full(len(seeds), 8)

    def regroup(members, changed):
        # members: in sorted order, each group whole; changed: where a new group begins
        begins = np.flatnonzero(changed)
        return np.repeat(begins, np.diff(np.append(begins, len(members))))

    ordered = first[order]
    group = regroup(order, np.append(True, ordered[1:] != ordered[:-1]))
    rank[order] = group
    places = np.arange(len(seeds))
    while True:
        size = np.bincount(group, minlength=len(order))[group]
        open_ = (size > 1) & (deep[order] < depth)
        if not open_.any():
            return seeds[order]
        where = places[open_]
        members = order[where]
        reach = seeds[members] + deep[members]
        inner = before[np.minimum(reach, n + 1)].astype(np.int64) - 1
        stuck = inner <= members
        inner = np.maximum(inner, 0)
        key = rank[inner].astype(np.uint64)
        if stuck.any():  # within a group all are stuck or none
            key[stuck] = np.unique(word(reach[stuck]), return_inverse=True)[1]
        gain = np.where(stuck, deep[members] + 8, seeds[inner] - seeds[members] + deep[inner])
        own = group[where]
        again = np.argsort(own.astype(np.uint64) << np.uint64(32) | key)
        members, key, own, gain = members[again], key[again], own[again], gain[again]
        order[where] = members
        changed = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
        fresh = where[regroup(members, changed)]
        group[where] = fresh
        rank[members] = fresh
        deep[members] = gain


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of the bytes in order of their first `depth` bytes, ties in any order.

    Only suffixes smaller than their successors are sorted directly, of each ascending run the first; two scans over
    the buckets of first bytes induce the others: ascending, a suffix larger than its successor comes behind those that
    the scan has met before; descending, the rest come before those met. A bucket is scanned as a whole: what it adds to
    itself is scanned as further waves."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    smaller = suffix_types(text)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ordered = _sorted_seeds(text, seeds, depth) if len(seeds) else seeds
    codes = np.arange(257)
    edges = np.searchsorted(text[ordered], codes) if len(ordered) else np.zeros(257, np.int64)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[text[-1]].append(np.array([n - 1]))

    def spread(wave, kind, lists, bucket):
        """Suffixes one before those of the wave, if of this kind, to their buckets; gives those for the bucket itself."""
        before = wave[wave > 0] - 1
        before = before[smaller[before] == kind]
        if not len(before):
            return before
        first = text[before]
        before = before[np.argsort(first, kind="stable")]
        counts = np.bincount(first, minlength=256)
        end = 0
        own = before[:0]
        for c in np.flatnonzero(counts):
            part = before[end : end + counts[c]]
            end += counts[c]
            lists[c].append(part)
            if c == bucket:
                own = part
        return own

    for c in range(256):
        waves = larger[c]
        wave = np.concatenate(waves) if waves else np.zeros(0, np.int64)
        while len(wave):
            wave = spread(wave, False, larger, c)
        if edges[c] < edges[c + 1]:
            spread(ordered[edges[c] : edges[c + 1]], False, larger, c)
    less: list[list[np.ndarray]] = [[] for _ in range(256)]
    down = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in larger]
    for c in range(255, -1, -1):
        wave = np.concatenate(less[c]) if less[c] else np.zeros(0, np.int64)
        while len(wave):
            wave = spread(wave, True, less, c)
        if len(down[c]):
            spread(down[c][::-1], True, less, c)
    return np.concatenate([x for c in range(256) for x in (down[c], np.concatenate(less[c])[::-1] if less[c] else down[c][:0])])


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of order has in common with the one before it there (the first: 0), `most` at most."""
    found = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return found
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    left = np.arange(1, len(order))
    for done in range(0, min(most, 16), 8):  # most differ early
        one, two = eight[order[left] + done], eight[order[left - 1] + done]
        same = one == two
        odd = one[~same] ^ two[~same]
        lowest = odd & (~odd + np.uint64(1))
        found[left[~same]] = done + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        left = left[same]
    rows = np.lib.stride_tricks.sliding_window_view(padded, most)
    for part in np.split(left, np.arange(8192, len(left), 8192)):
        differ = rows[order[part]] != rows[order[part - 1]]
        at = differ.argmax(axis=1)
        found[part] = np.where(differ[np.arange(len(part)), at] if len(part) else False, at, most)
    # bytes past the end are none in common
    beyond = len(text) - np.maximum(order, np.append(order[0], order[:-1]))
    return np.minimum(np.minimum(found, most), beyond)


def repeated_windows(slices: list[bytes], wins: list[int], cross: list[bool], low: list[int], high: list[int], span: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each slice and each of its first `wins` places: whether the window of span bytes there also stands in another
    slice, and whether the window of least bytes there stands in two documents. low, high: the least and largest name of
    the documents that hold the slice; cross: whether there are two of them (of which names may be equal)."""
    text = np.frombuffer(b"".join(slices), np.uint8)
    sizes, wins_ = np.array([len(s) for s in slices], np.int64), np.array(wins, np.int64)
    starts = np.cumsum(sizes) - sizes
    order = suffix_array(text, span)
    owner = np.repeat(np.arange(len(slices)), sizes)
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    order = order[(place < wins_[owner])[order]]
    of = owner[order]
    common = common_prefixes(text, order, span)
    marked = np.zeros((2, len(text)), bool)
    run = np.flatnonzero(common < span)  # runs of windows with equal bytes
    whole = place[order] + span <= sizes[of]
    if len(order):
        again = np.repeat(np.add.reduceat(whole.astype(np.int64), run) > 1, np.diff(np.append(run, len(order))))
        marked[0][order[again & whole]] = True
        run = np.flatnonzero(common < least)
        shared = np.maximum.reduceat(np.array(cross, bool)[of], run)
        shared |= np.minimum.reduceat(np.array(low, np.int64)[of], run) != np.maximum.reduceat(np.array(high, np.int64)[of], run)
        marked[1][order[np.repeat(shared, np.diff(np.append(run, len(order))))]] = True
    return [(marked[0][a : a + n], marked[1][a : a + n]) for a, n in zip(starts, wins, strict=True)]


def trimmed(groups: np.ndarray, slices: list[bytes], at: np.ndarray, wins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slice (of a group, with its anchor at `at`) the first and the end of those of its windows of least bytes that
    can equal one of another slice of its group.

    Equal windows have the anchor at the same place, so they agree as far as each reaches to both sides of it. How far a
    slice agrees with any other is found to TRIM_STEP bytes, by hashes of what stands left and right of the anchor."""
    sizes = np.array([len(s) for s in slices], np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = prefix_sums(np.frombuffer(b"".join(slices), np.uint8), BYTE_VALUE)
    anchor = starts + at
    reach = []
    for room, sign in ((at, -1), (sizes - at, 1)):
        far = np.zeros(len(slices), np.int64)
        for step in range(TRIM_STEP, least + 1, TRIM_STEP):
            own = np.flatnonzero((room >= step) & (far == step - TRIM_STEP))
            if not len(own):
                break
            ends = anchor[own] + sign * step
            names = span_hash(sums, np.minimum(anchor[own], ends), np.maximum(anchor[own], ends)) ^ mix(groups[own])
            _, back, count = np.unique(names, return_inverse=True, return_counts=True)
            far[own[count[back] > 1]] = step
        reach.append(np.minimum(room, far + TRIM_STEP - 1))
    # the window at place p has at - p bytes left of the anchor and least - (at - p) from there on
    first = np.maximum(0, at - reach[0])
    end = np.minimum(wins, at - least + reach[1] + 1)
    return first, np.maximum(first, end)


def _covered(starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges covered by windows of `span` bytes at the starts (ascending)."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > span)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + span


def _named(whole: np.ndarray, at: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """The print of slices: of their bytes, the anchor's place and the number of windows."""
    return mix(whole ^ mix(((at.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | wins.astype(np.uint64)))


def slices_of(data: np.ndarray, at: np.ndarray, span: int, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, print, start in the row, length, the anchor's place, windows) of the slices of a block, in order of row
    and start."""
    n, w = len(data), least - k + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none, none
    sums = prefix_sums(data, BYTE_VALUE)
    place = np.arange(n - k + 1)
    hashes = span_hash(sums, place, place + k)
    # 33 bits of the hash, then the place: the least is the leftmost of the least hash
    low = hashes >> np.uint64(31) << np.uint64(31) | place.astype(np.uint64)
    step = 1
    while 2 * step <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if w > step:
        low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
    starts = np.flatnonzero(np.arange(len(low)) + least <= at[1:][row])
    if not len(starts):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none, none
    anchor = (low[starts] & np.uint64((1 << 31) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first, last = starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]
    end = np.minimum(last + span, at[1:][row[first]])
    place, wins = anchor[new] - first, last - first + 1
    return row[first], hashes[anchor[new]], _named(span_hash(sums, first, end), place, wins), first - at[row[first]], end - first, place, wins


def _slice_rows(docs: DataFrame, span: int, least: int, k: int) -> DataFrame:
    """anchor, print, length, the anchor's place, number of windows, and the starts in a document, for each document and
    different slice."""

    def rows(batches):
        for b in batches:
            for i, _, data, at in text_blocks(b.column(2), SLICE_BLOCK):
                found = slices_of(data, at, span, least, k)
                row, anchor, name, start, length, place, wins = (x[np.lexsort((found[3], found[2], found[1], found[0]))] for x in found)
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]))) if len(row) else row
                own = pa.array(row[new] + i)
                starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(start.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(as_long(anchor[new])), pa.array(as_long(name[new])), pa.array(length[new].astype(np.int32)), pa.array(place[new].astype(np.int32)), pa.array(wins[new].astype(np.int32)), starts], ["id", "hash", "anchor", "print", "length", "at", "wins", "starts"])

    return docs.mapInArrow(rows, "id long, hash long, anchor long, print long, length int, at int, wins int, starts array<int>")


#: What a slice is known by on its way: copies in all, cross (two documents hold it), the least and largest name of these.
_SLICE = "anchor long, print long, copies long, cross boolean, low long, high long, at int, wins int, bytes binary"
_NAMES = [x.split()[0] for x in _SLICE.split(", ")]
_KINDS = dict(zip(_NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))
#: Covered ranges: kind 0 by repeated windows of span bytes, kind 1 by windows of least bytes that documents share.
_MARKS = "anchor long, print long, kind int, first array<int>, end array<int>"


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _whole_marks(rows: DataFrame, span: int, least: int, repeated: Column, shared: Column, length: Column) -> DataFrame:
    """rows with the covered ranges of slices of which all windows are repeated or shared, or none: kind, first, end."""
    ranges = F.array(
        F.struct(F.lit(0).alias("kind"), F.when(repeated & (length >= span), length).alias("to")),
        F.struct(F.lit(1).alias("kind"), F.when(shared, F.col("wins") + (least - 1)).alias("to")),
    )
    out = rows.withColumn("_mark", F.explode(ranges)).where("_mark.to is not null")
    return out.withColumns({"kind": F.col("_mark.kind"), "first": F.array(F.lit(0)), "end": F.array(F.col("_mark.to").cast("int"))}).drop("_mark")


def _sorted_marks(slices: DataFrame, span: int, least: int) -> DataFrame:
    """The covered ranges of each slice by suffix sorting; each anchor is in one task."""
    kinds = dict(zip(("anchor", "print", "kind", "first", "end"), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True))

    def marks(batches):
        held: list[tuple] = []
        size = 0

        def done():
            anchors, prints, copies, cross, low, high, at, wins, texts = zip(*held, strict=True)
            first, end = trimmed(np.array(anchors, np.int64).view(np.uint64), list(texts), np.array(at, np.int64), np.array(wins, np.int64), least)
            kept = [i for i in range(len(held)) if first[i] < end[i]]
            found = repeated_windows([texts[i][first[i] : end[i] - 1 + span] for i in kept], [int(end[i] - first[i]) for i in kept], *([x[i] for i in kept] for x in (cross, low, high)), span, least) if kept else []
            ranges = []
            for i, both in zip(kept, found, strict=True):
                for kind, width in enumerate((span, least)):
                    if kind == 0 and copies[i] > 1 or kind == 1 and cross[i]:
                        continue  # all of them, below
                    own = np.flatnonzero(both[kind])
                    if len(own):
                        ranges.append((anchors[i], prints[i], kind, *_covered(own + first[i], width)))
            for a, p, c, x, w, t in zip(anchors, prints, copies, cross, wins, texts, strict=True):
                if c > 1 and len(t) >= span:
                    ranges.append((a, p, 0, [0], [len(t)]))
                if x:
                    ranges.append((a, p, 1, [0], [w - 1 + least]))
            return _batch(ranges, kinds)

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= SORT_BYTES and x[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(x)
                size += len(x[-1])
        if held:
            yield done()

    return slices.select(*_NAMES).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(marks, _MARKS)


def _split(slices: DataFrame, span: int, least: int, cell: int) -> DataFrame:
    """The slices in pieces: of windows with the anchor at least i * cell and less than (i + 1) * cell bytes from their start, for
    each i. All windows of such a group share the bytes around the anchor that name the piece's own anchor."""
    kinds = {"of": pa.int64(), "named": pa.int64(), "shift": pa.int32()} | _KINDS

    def pieces(batches):
        for b in batches:
            for first in range(0, b.num_rows, 1024):
                out = []
                for anchor, name, copies, cross, low, high, at, wins, text in zip(*(c.to_pylist() for c in b.slice(first, 1024).columns), strict=True):
                    sums = prefix_sums(np.frombuffer(text, np.uint8), BYTE_VALUE)
                    nearest, farthest = at - wins + 1, at  # bytes from a window's start to the anchor
                    for near in range(nearest // cell * cell, farthest + 1, cell):
                        shift, last = at - min(farthest, near + cell - 1), at - max(nearest, near)
                        end = min(len(text), last + span)
                        whole = span_hash(sums, np.array([at - near, shift]), np.array([at - near - cell + 1 + least, end]))
                        own = mix(whole[:1] ^ mix(np.array([near + 1], np.uint64) ^ np.array([anchor], np.int64).view(np.uint64)))
                        place, n = np.array([at - shift]), np.array([last - shift + 1])
                        out.append((anchor, name, shift, int(as_long(own)[0]), int(as_long(_named(whole[1:], place, n))[0]), copies, cross, low, high, at - shift, last - shift + 1, text[shift:end]))
                yield _batch(out, kinds)

    return slices.select(*_NAMES).mapInArrow(pieces, f"of long, named long, shift int, {_SLICE}")


def _marks_of(slices: DataFrame, span: int, least: int, cell: int, most: int) -> DataFrame:
    """The covered ranges of each slice (a written table, one row for each anchor and print).

    Anchors with more than `most` slices are split and their pieces, equal ones merged, taken the same way. The windows of
    pieces of cell 1 that have one anchor are equal, so this ends."""
    hot = slices.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor")
    if hot.isEmpty():
        return _sorted_marks(slices, span, least)
    hot = written(hot, "hot")
    cell = -(-cell // SPLIT)
    pieces = written(_split(slices.join(hot, "anchor", "left_semi"), span, least, cell), "pieces")
    names = [F.min("low").alias("low"), F.max("high").alias("high")]
    merged = pieces.groupBy("anchor", "print").agg(F.sum("copies").alias("copies"), (F.max("cross") | (F.min("low") != F.max("high"))).alias("cross"), *names, *(F.first(c).alias(c) for c in ("at", "wins", "bytes")))
    of_anchor = pieces.groupBy("anchor").agg(((F.min("print") != F.max("print")) & F.lit(cell > 1)).alias("many"), (F.max("cross") | (F.min("low") != F.max("high"))).alias("shared"))
    merged = written(written(merged, "merged").join(written(of_anchor, "anchors"), "anchor"), "merged")
    marks = _whole_marks(merged.where("not many"), span, least, F.col("copies") > 1, F.col("shared"), F.octet_length("bytes")).select("anchor", "print", "kind", "first", "end")
    if cell > 1:
        marks = marks.union(_marks_of(written(merged.where("many").select(*_NAMES), "split"), span, least, cell, most))
    back = pieces.select("of", "named", "shift", "anchor", "print").join(marks, ["anchor", "print"])
    back = back.select(F.col("of").alias("anchor"), F.col("named").alias("print"), "kind", *(F.transform(c, lambda x: x + F.col("shift")).alias(c) for c in ("first", "end")))
    return _sorted_marks(slices.join(hot, "anchor", "left_anti"), span, least).union(back)


def _edges(ranges: pa.ListArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each kind and byte of a block how many covered ranges begin there less those that end there; and which rows have
    any. ranges: for each row a list of (starts, kind, first, end): the ranges [first, end) behind each of the starts."""
    edges = np.zeros((2, int(at[-1]) + 1), np.int32)
    ranges = ranges.fill_null([]) if ranges.null_count else ranges
    count = np.diff(np.asarray(ranges.offsets)).astype(np.int64)
    held = ranges.flatten()
    if not len(held):
        return edges, count > 0
    starts, kind, first, end = held.flatten()
    begin = np.asarray(starts.offsets)[:-1].astype(np.int64) - starts.offsets[0].as_py()
    inner = np.asarray(first.offsets)[:-1].astype(np.int64) - first.offsets[0].as_py()
    many, wide = (np.diff(np.asarray(x.offsets)).astype(np.int64) for x in (starts, first))
    # each start with each range: the pairs of a record, numbered
    record = np.repeat(np.arange(len(held)), many * wide)
    number = np.arange(len(record)) - np.repeat(np.cumsum(many * wide) - many * wide, many * wide)
    base = np.repeat(at[:-1], count)[record] + np.asarray(starts.flatten())[begin[record] + number // wide[record]]
    place = inner[record] + number % wide[record]
    kinds = np.asarray(kind)[record]
    np.add.at(edges, (kinds, base + np.asarray(first.flatten())[place]), 1)
    np.add.at(edges, (kinds, base + np.asarray(end.flatten())[place]), -1)
    return edges, count > 0


def _passages(text: np.ndarray, shared: np.ndarray, least_words: int) -> int:
    """Runs of shared bytes that hold so many whole words."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], shared.astype(np.int8), [0]))))
    if not len(turns):
        return 0
    _, start, end, _ = words(text, np.array([0, len(text)]))
    return int((np.searchsorted(end, turns[1::2], "right") - np.searchsorted(start, turns[::2], "left") >= least_words).sum())


def without_repeats(docs: DataFrame, span: int = SPAN, least: int | None = None, k: int | None = None, passage_words: int = PASSAGE_WORDS, most_slices: int = MOST_SLICES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and removed (start and end bytes of the removed runs) for
    each row of docs (doc_id long, text).

    Every byte is removed that a window of `span` bytes covers whose bytes also start anywhere else in the table, its own
    document included; windows are judged on the whole input. n_passages reports, and removes nothing: the runs of bytes
    covered by windows of `least` bytes that stand in another document too, if they hold passage_words whole words. Null
    and empty texts, and texts shorter than a window, lose nothing. Rows that repeat a doc_id (or have none) are documents
    of their own. An empty table gives no rows."""
    least = min(span, LEAST) if least is None else least
    k = min(ANCHOR, max(1, least // 2)) if k is None else k
    text = docs["text"].cast("string")
    keyed = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = written(_slice_rows(keyed, span, least, k), "slices")
    # a row is one slice of one document, so two rows of an anchor and print are two documents
    kinds = rows.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n"), (F.min("print") != F.max("print")).alias("many"), (F.count("*") > 1).alias("shared")).where("n > 1").drop("n")
    members = written(rows.join(written(kinds, "kinds"), "anchor"), "members")  # written, so that Spark splits a hot anchor in the join
    doc = F.xxhash64("id", "hash")
    distinct = members.where("many").groupBy("anchor", "print").agg(F.sum(F.size("starts")).alias("copies"), (F.count("*") > 1).alias("cross"), F.min(doc).alias("low"), F.max(doc).alias("high"), F.min(F.struct("id", "hash", F.col("starts")[0].alias("start"), "length", "at", "wins")).alias("one"))
    distinct = distinct.select("anchor", "print", "copies", "cross", "low", "high", "one.*")
    own = ["start", "length", *_NAMES[:-1]]
    wanted = distinct.groupBy("id", "hash").agg(F.collect_list(F.struct(*own)).alias("slices"))
    wanted = wanted.select(F.col("id").alias("of"), F.col("hash").alias("named"), "slices")

    def cut(batches):
        for b in batches:
            data, at = text_buffer(b.column(0))
            held, size = [], 0
            for i, own in enumerate(b.column(1)):
                for s in own.as_py():
                    first = int(at[i]) + s["start"]
                    held.append((*(s[n] for n in _NAMES[:-1]), data[first : first + s["length"]].tobytes()))
                    size += s["length"]
                if held and (size > 4 << 20 or i == b.num_rows - 1):
                    yield _batch(held, _KINDS)
                    held, size = [], 0

    same = keyed["id"].eqNullSafe(wanted["of"]) & (keyed["hash"] == wanted["named"])
    slices = written(keyed.join(wanted, same).select("text", "slices").mapInArrow(cut, _SLICE).dropDuplicates(["anchor", "print"]), "bytes")
    marks = written(_marks_of(slices, span, least, least - k + 1, most_slices), "marks")
    ranges = ["id", "hash", "starts", "kind", "first", "end"]
    found = members.where("many").select("id", "hash", "anchor", "print", "starts").join(marks, ["anchor", "print"]).select(*ranges)
    # an anchor with one slice only: all of its copies are repeated
    whole = _whole_marks(members.where("not many"), span, least, F.lit(True), F.col("shared"), F.col("length")).select(*ranges)
    # rows of equal doc_id and text have the same ranges: a set, so that these count once
    ranges = found.union(whole).groupBy("id", "hash").agg(F.collect_set(F.struct("starts", "kind", "first", "end")).alias("ranges")).select(F.col("id").alias("of"), F.col("hash").alias("named"), "ranges")

    def finish(batches):
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passages": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        for b in batches:
            for i, end, data, at in text_blocks(b.column(1)):
                edges, marked = _edges(b.column(2).slice(i, end - i), at)
                gone, shared = np.cumsum(edges[:, :-1], axis=1) > 0
                out = []
                for r, doc in enumerate(b.column(0).slice(i, end - i).to_pylist()):
                    own, lost = data[at[r] : at[r + 1]], gone[at[r] : at[r + 1]]
                    if not marked[r]:
                        out.append((doc, len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest(), 0, []))
                        continue
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0]))))
                    removed = [{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)]
                    out.append((doc, len(own), int(lost.sum()), len(removed), hashlib.sha256(own[~lost].tobytes()).hexdigest(), _passages(own, shared[at[r] : at[r + 1]], passage_words), removed))
                yield _batch(out, kinds)

    same = keyed["id"].eqNullSafe(ranges["of"]) & (keyed["hash"] == ranges["named"])
    joined = keyed.join(ranges, same, "left").select("id", "text", "ranges")
    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, removed array<struct<start:long,end:long>>")
