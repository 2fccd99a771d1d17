"""Sharding by histogram sort.

Rows are ordered by a key (a hash of the text, then doc_id), so equal texts stand together. Candidate boundaries are
probed: each round counts the exact bytes below every probe over all partitions, and the probes close in until each
splitter is within tolerance. Then rows go to their shards in one exchange.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.llm.common import written

SHARDS, OVERHEAD = 40, 16
#: Probes for each splitter and round; a splitter may miss its share by this part of a shard, and by WHOLE_GROUP of a
#: shard, or by the largest row, to leave the rows of one text together.
PROBES, TOLERANCE, WHOLE_GROUP, ROUNDS = 16, 0.002, 0.02, 40
#: Slots are numbered in parts of about so many rows, so no task sorts a whole shard.
PART_ROWS = 50_000

_TOP = 1 << 128


def _key(text_hash: int, doc: int) -> int:
    return (text_hash + (1 << 63)) << 64 | doc + (1 << 63)


def _as_bytes(probes: list[int]) -> np.ndarray:
    return np.array([struct.pack(">QQ", p >> 64, p & (1 << 64) - 1) for p in probes], "V16").view("S16")


def _order(hashes: pa.Array, docs: pa.Array) -> np.ndarray:
    """Keys as 16 bytes each, to be compared as bytes; a null doc_id comes first."""
    both = np.empty((len(hashes), 2), ">u8")
    both[:, 0] = np.asarray(hashes.fill_null(0)).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = np.asarray(docs.fill_null(-(1 << 63))).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both).view("S16").ravel()


def _bytes_below(keys: DataFrame, probes: list[int]) -> np.ndarray:
    """For each probe (ascending), the exact bytes of the rows with smaller keys: a sum in each task, then over tasks."""
    bounds = _as_bytes(probes)

    def count(batches):
        sums = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            np.add.at(sums, np.searchsorted(bounds, _order(b.column(0), b.column(1)), "right"), np.asarray(b.column(2)))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bin", "bytes"])

    found = keys.select("_hash", "_doc", "_size").mapInArrow(count, "bin long, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect()
    sums = np.zeros(len(bounds) + 1, np.int64)
    for r in found:  # one row a bin: as many as there are probes
        sums[r["bin"]] = r["bytes"]
    return np.cumsum(sums)[:-1]


def find_splitters(keys: DataFrame, total: int, shards: int, tolerance: float = TOLERANCE, whole_group: float = WHOLE_GROUP, largest: int = 0) -> list[int]:
    """The keys at which shards 1 to shards - 1 begin. A boundary that falls within the rows of one text moves to their
    nearer edge if that costs whole_group of a shard at most, or the largest row's bytes; else they are divided by doc_id."""
    wanted = [total * j / shards for j in range(1, shards)]
    low, high = [0] * len(wanted), [_TOP] * len(wanted)
    bytes_at = {0: 0, _TOP: total}
    done: dict[int, int] = {}
    slack = max(1.0, total / shards * tolerance)
    for _ in range(ROUNDS):
        probes = set()
        for j in range(len(wanted)):
            if j in done:
                continue
            step = (high[j] - low[j]) / (PROBES + 1)
            if high[j] - low[j] <= PROBES + 1:
                probes |= set(range(low[j] + 1, high[j]))
            else:
                probes |= {low[j] + int(step * i) for i in range(1, PROBES + 1)}
            # the edges of the text that the interval has come down to
            if low[j] >> 64 == (high[j] - 1) >> 64:
                probes |= {low[j] >> 64 << 64, min(_TOP - 1, ((low[j] >> 64) + 1) << 64)}
        probes = sorted(p for p in probes if 0 < p < _TOP and p not in bytes_at)
        if probes:
            bytes_at |= dict(zip(probes, _bytes_below(keys, probes).tolist(), strict=True))
        known = sorted(bytes_at)
        below = np.array([bytes_at[p] for p in known])
        for j, want in enumerate(wanted):
            if j in done:
                continue
            i = int(np.searchsorted(below, want, "left"))  # below[i - 1] < want <= below[i]
            low[j], high[j] = known[max(i - 1, 0)], known[i]
            near = min((low[j], high[j]), key=lambda p: abs(bytes_at[p] - want))
            if abs(bytes_at[near] - want) <= slack or high[j] - low[j] <= 1:
                done[j] = near
            elif low[j] >> 64 == (high[j] - 1) >> 64:
                edges = [p for p in (low[j] >> 64 << 64, ((low[j] >> 64) + 1) << 64) if p in bytes_at]
                if edges and abs(bytes_at[best := min(edges, key=lambda p: abs(bytes_at[p] - want))] - want) <= max(largest, total / shards * whole_group):
                    done[j] = best
        if len(done) == len(wanted):
            break
    return sorted(done.get(j, high[j]) for j in range(len(wanted)))


def sharded(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, tolerance: float = TOLERANCE, whole_group: float = WHOLE_GROUP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs (doc_id long, text), and its columns `keep`; one of
    these that has such a name itself gets _of_input behind it.

    size: UTF-8 bytes of the text (null: 0) plus overhead; shards have nearly equal sizes. Rows of one text share a shard,
    unless that would shift a boundary by more than find_splitters allows. slot numbers the rows of a
    shard from 0 without gaps. Rows of equal text and doc_id can't be told apart: they stay in one shard and take its
    slots in any order. A null text counts as empty, a null doc_id as the smallest. An empty table gives no rows."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # the columns' own names don't matter: ours are taken from expressions over docs and prefixed
    made = [docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(text).alias("_hash"), (F.octet_length(text) + overhead).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc")]
    keys = written(docs.select(*made), "keys")
    n, total, largest = keys.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0)), F.max("_size")).first()
    bounds = _as_bytes(find_splitters(keys, total, shards, tolerance, whole_group, largest)) if n else np.zeros(0, "S16")

    def place(batches):
        for b in batches:
            at = np.searchsorted(bounds, _order(b.column(0), b.column(1)), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "_shard"])

    rows = docs.select(*made, *(docs[c].alias(f"k{i}") for i, c in enumerate(keep))) if keep else keys
    order = ["_hash", "_doc", *(c for c in rows.columns if c not in ("_hash", "_doc"))]
    fields = [rows.schema[c] for c in order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _shard int"
    placed = rows.select(*order).mapInArrow(place, schema)
    parts = max(1, -(-n // (shards * PART_ROWS)))
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_hash", "_doc"), F.lit(parts)).cast("int"))
    counted = keys.select("_hash", "_doc", "_size").mapInArrow(place, "_hash long, _doc long, _size long, _shard int")
    counted = counted.withColumn("_part", F.pmod(F.xxhash64("_hash", "_doc"), F.lit(parts)).cast("int")).groupBy("_shard", "_part").agg(F.count("*").alias("_n"))
    starts = counted.withColumn("_start", F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_n")).drop("_n")
    joined = placed.join(starts, ["_shard", "_part"]) if parts > 1 else placed.withColumn("_start", F.lit(0))
    slot = F.col("_start") + F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_hash", "_doc")) - 1
    out = [F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), slot.cast("long").alias("slot")]
    names = {"doc_id", "size", "text_crc32", "shard", "slot"}
    return joined.select(*out, *(F.col(f"k{i}").alias(f"{c}_of_input" if c.lower() in names else c) for i, c in enumerate(keep)))

