"""Benchmark decontamination: rare word grams of the test items seed candidates in the training texts, and
Smith-Waterman alignment scores copies, edited ones included.

A gram of an item is a seed unless it is much more common than most of the item's own grams: among the documents (set
phrases; grams that none holds don't count), or among the items (openings that many share). By either, at least three quarters
of an item's grams stay, so an edited copy keeps seeds whatever other versions of the item the documents hold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.align import MATCH, GramTable, align
from fieldmerge.llm.common import PUNCTUATION, text_blocks, word_grams, words

#: Words of a seed, different seeds that a passage needs, and the part of an item's best possible score that a copy reaches.
GRAM, SEEDS, COPY = 3, 2, 0.5
#: A gram is common if it is in more than so many times as many documents (or items) as an item's upper quartile, and in more
#: than so many.
TIMES, DOCUMENTS, ITEMS = 4, 1000, 16
#: Pairs of a hit and an item's gram that are looked at together.
PAIRS = 1 << 20
#: The items are taken in blocks of about so many bytes, each a pass over the documents: what is sent to the tasks stays bounded.
ITEM_BYTES = 4 << 20


def _lowered(df: DataFrame, key: str) -> DataFrame:
    return df.select(df[key].alias("key"), F.lower(df["text"].cast("string")).alias("text"))


class Items:
    """A block of test items: their words and the table of their grams."""

    def __init__(self, keys: list, texts: pa.Array):
        self.keys, self.words = keys, []
        grams, owner, place = [], [], []
        number = 0
        for _, end, data, at in text_blocks(texts):
            hashes, _, _, rows = words(data, at, PUNCTUATION)
            found, first, offsets = word_grams(hashes, rows, GRAM)
            for r in range(len(at) - 1):
                self.words.append(hashes[rows[r] : rows[r + 1]])
                own = slice(offsets[r], offsets[r + 1])
                grams.append(found[own])
                place.append(first[own] - rows[r])
                owner.append(np.full(offsets[r + 1] - offsets[r], number))
                number += 1
        empty = [np.zeros(0, np.uint64)]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.table = GramTable(np.concatenate(grams + empty), np.concatenate([*owner, np.zeros(0, np.int64)]), np.concatenate([*place, np.zeros(0, np.int64)]))

    def keep_rare(self, documents: dict[int, int]) -> None:
        """Keep the seeds of each item. documents: how many hold a gram, by its index among the table's different grams."""
        table = self.table
        different, of = np.unique(table.grams, return_inverse=True)
        held = np.zeros(len(different), np.int64)
        held[list(documents.keys())] = list(documents.values())
        pairs = np.unique(np.stack([of, table.owner], axis=1), axis=0)
        shared = np.bincount(pairs[:, 0], minlength=len(different))
        seeds = held[of] > 0
        for counts, known, least in ((held[of], seeds.copy(), DOCUMENTS), (shared[of], np.ones(len(of), bool), ITEMS)):
            order = np.lexsort((counts, table.owner))
            known = order[known[order]]
            first = np.searchsorted(table.owner[known], np.arange(len(self.words)))
            size = np.bincount(table.owner[known], minlength=len(self.words))
            quartile = np.zeros(len(self.words), np.int64)
            some = size > 0
            quartile[some] = counts[known][(first + (3 * (size - 1) + 3) // 4)[some]]
            seeds &= counts <= np.maximum(TIMES * quartile[table.owner], least)
        self.table = GramTable(table.grams[seeds], table.owner[seeds], table.place[seeds])


def copies_in(own: Items, text: np.ndarray, at: np.ndarray, entries: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(item, score, matched words, first word, end word) of the items of which the text (word hashes) holds a copy.

    at, entries: where the text has a seed, and which. Hits of an item stand together if they are no further apart
    than the item is long; each such stretch, widened by the item's length, is aligned with the item."""
    out = []
    owner = own.table.owner[entries]
    order = np.lexsort((at, owner))
    edges = np.flatnonzero(np.diff(owner[order])) + 1
    for hits in np.split(order, edges):
        item = int(owner[hits[0]])
        query = own.words[item]
        best = None
        places = at[hits]
        for part in np.split(hits, np.flatnonzero(np.diff(places) > len(query)) + 1):
            if len(np.unique(own.table.grams[entries[part]])) < min(SEEDS, len(query) - GRAM + 1):
                continue
            first, end = max(0, int(at[part[0]]) - len(query)), min(len(text), int(at[part[-1]]) + GRAM + len(query))
            if np.isin(query, text[first:end]).sum() < COPY * len(query):
                continue  # no alignment scores more than MATCH for each word that stands there
            found = align(query, text[first:end])
            score = found.score / (MATCH * len(query))
            if score >= COPY and (best is None or score > best[1]):
                best = (item, score, found.matched, first + found.first[1], first + found.end[1])
        if best:
            out.append(best)
    return out


def _hits(own: Items, grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index into grams, entry of the table) of the pairs of a document and an item with enough hits. PAIRS are
    looked at together: once to count them, once to take what counts."""
    first, end = own.table.spans(grams)
    at = np.flatnonzero(end > first)
    cuts = np.searchsorted(np.cumsum((end - first)[at]), np.arange(PAIRS, (end - first)[at].sum() + PAIRS, PAIRS), "left") + 1
    slices = [x for x in np.split(at, cuts[:-1]) if len(x)] if len(at) else []

    def pairs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = (end - first)[part]
        hit = np.repeat(part, count)
        entries = np.repeat(first[part], count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        doc = np.searchsorted(offsets, hit, "right") - 1
        return hit, entries, doc * len(own.words) + own.table.owner[entries]

    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in slices:
        found, count = np.unique(pairs(part)[2], return_counts=True)
        keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, count]), len(keys)).astype(np.int64)
    good = keys[counts >= np.minimum(SEEDS, own.sizes[keys % max(1, len(own.words))] - GRAM + 1)]
    kept = [np.zeros((2, 0), np.int64)]
    for part in slices if len(good) else []:
        hit, entries, key = pairs(part)
        stays = np.isin(key, good)
        kept.append(np.stack([hit[stays], entries[stays]]))
    hit, entries = np.concatenate(kept, axis=1)
    return np.searchsorted(offsets, hit, "right") - 1, hit, entries


def _matches(own: Items, texts: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
    """The row of texts, then as copies_in, for every copy in these rows."""
    out = []
    for i, _, data, at in text_blocks(texts):
        hashes, _, _, rows = words(data, at, PUNCTUATION)
        grams, first, offsets = word_grams(hashes, rows, GRAM)
        doc, hit, entries = _hits(own, grams, offsets)
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
            d = int(doc[part[0]])
            out += [(i + d, *x) for x in copies_in(own, hashes[rows[d] : rows[d + 1]], first[hit[part]] - rows[d], entries[part])]
    return out


def _documents_with(docs: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the grams (sorted, different), by index; grams in none are left out. Summed per batch,
    then by Spark; a block of items bounds what comes back."""
    known = docs.sparkSession.sparkContext.broadcast(grams)

    def count(batches):
        seen = np.zeros(1 << 20, bool)  # by a hash's first bits
        seen[(known.value >> np.uint64(44)).astype(np.int32)] = True
        for b in batches:
            total = np.zeros(len(known.value), np.int64)
            for _, _, data, at in text_blocks(b.column(0)):
                hashes, _, _, rows = words(data, at, PUNCTUATION)
                found, _, offsets = word_grams(hashes, rows, GRAM)
                hit = np.flatnonzero(seen[(found >> np.uint64(44)).astype(np.int32)])
                place = np.minimum(np.searchsorted(known.value, found[hit]), len(total) - 1)
                hit, place = (x[known.value[place] == found[hit]] for x in (hit, place))
                doc = np.searchsorted(offsets, hit, "right") - 1
                total += np.bincount(np.unique(doc * len(total) + place) % len(total), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = docs.select(F.lower(docs["text"].cast("string")).alias("text")).mapInArrow(count, "gram long, n long")
    return {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def _item_blocks(docs: DataFrame, benchmark: DataFrame):
    """For each block of items: a broadcast Items, and the Arrow type of item_id."""
    spark = docs.sparkSession
    item_bytes = benchmark.agg(F.coalesce(F.sum(F.octet_length(benchmark["text"].cast("string"))), F.lit(0))).first()[0]
    blocks = max(1, -(-int(item_bytes) // ITEM_BYTES))
    asked = _lowered(benchmark, "item_id").withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    for number in range(blocks):
        table = asked.where(F.col("block") == number).toArrow()
        items = Items(table["key"].to_pylist(), table["text"].combine_chunks())
        if len(items.table.grams):
            items.keep_rare(_documents_with(docs, np.unique(items.table.grams)))
        yield spark.sparkContext.broadcast(items), table.schema.field("key").type


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, matched_words, first_word and end_word of each pair of a document (doc_id, text) and a test
    item (item_id, text) of which it holds a copy: the best one, as a part of the item's best possible score.

    A passage is aligned if it has SEEDS different seeds of the item. Of an item, all grams are seeds that aren't common beside
    its others.
    Words are runs of letters and digits, lower-cased. Items of fewer than GRAM words and null texts match nothing; an
    item of GRAM words needs a passage that is the same. Rows of an item_id or doc_id that occur more than once are
    items or documents of their own. Empty tables give no rows."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, matched_words int, first_word long, end_word long"

    def search(items, kind):
        def rows(batches):
            for b in batches:
                own = items.value
                columns = list(zip(*_matches(own, b.column(1)), strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(columns[0], pa.int64())), pa.array([own.keys[k] for k in columns[1]], kind), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[4:])],
                    ["doc_id", "item_id", "score", "matched_words", "first_word", "end_word"],
                )

        return _lowered(docs, "doc_id").mapInArrow(rows, schema)

    return reduce(DataFrame.union, [search(*block) for block in _item_blocks(docs, benchmark)])


def without_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no copy of a test item, with their columns."""
    schema, last = docs.schema, len(docs.columns)

    def clean(rows, items):
        def keep(batches):
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[m[0] for m in _matches(items.value, b.column(last))]] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(stays)) for c in b.columns[:last]], b.schema.names[:last])

        lowered = rows.select(*rows.columns, F.lower(rows["text"].cast("string")).alias("_lowered_text"))
        return lowered.mapInArrow(keep, schema)

    return reduce(clean, [items for items, _ in _item_blocks(docs, benchmark)], docs)
