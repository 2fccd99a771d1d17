"""Legal groups of dense components: connected sets of observations of different fields, with the weight of the best tree.

Groups grow by one observation a round, along links. A best tree of a group has a leaf, and is that leaf's link and a best
tree of the rest; so the least over all ways to reach a group is the weight of its best tree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.operators.cover import WorkExceeded, best_partition
from fieldmerge.plans.settled import settled

#: Components with more groups of one size than these are given up, so no task gets more than a few times as many rows.
MOST_GROUPS = 400_000

_KEYS = ["submission_id", "component"]


def legal_groups(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submission_id, component, members, weight) with members in ascending order, and the keys of components given up.

    nodes: (submission_id, component, uid, field_idx); links: (submission_id, component, a_uid, b_uid, w)."""
    ends = links.select(*_KEYS, F.col("a_uid").alias("uid"), F.col("b_uid").alias("other"), "w")
    ends = ends.unionByName(links.select(*_KEYS, F.col("b_uid").alias("uid"), F.col("a_uid").alias("other"), "w"))
    around = settled(ends.join(nodes.select(*_KEYS, F.col("uid").alias("other"), F.col("field_idx").alias("field")), [*_KEYS, "other"]))
    level = settled(nodes.select(*_KEYS, F.array("uid").alias("members"), F.array("field_idx").alias("fields"), F.lit(0).cast("bigint").alias("weight")))
    levels, given_up = [level], []
    while True:
        spread = level.withColumn("uid", F.explode("members"))
        reached = spread.join(around, [*_KEYS, "uid"]).where(~F.array_contains("fields", F.col("field")))
        members = F.array_sort(F.array_append("members", F.col("other")))
        grown = reached.groupBy(*_KEYS, members.alias("members")).agg(F.any_value(F.array_append("fields", F.col("field"))).alias("fields"), F.min(F.col("weight") + F.col("w")).alias("weight"))
        level = settled(grown)
        sizes = settled(level.groupBy(*_KEYS).agg(F.count("*").alias("n")))
        if sizes.isEmpty():
            break
        large = sizes.where(F.col("n") > MOST_GROUPS).select(*_KEYS)
        if not large.isEmpty():
            given_up.append(large)
            level = level.join(large, _KEYS, "left_anti")
        levels.append(level)
    over = reduce(DataFrame.unionByName, given_up) if given_up else nodes.select(*_KEYS).limit(0)
    every = reduce(DataFrame.unionByName, (x.select(*_KEYS, "members", "weight") for x in levels))
    return (every.join(over, _KEYS, "left_anti") if given_up else every), over


def _table(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observations (uid, field, rank by uid), groups as rows of their places, filled up, and weights; single ones first."""
    members = table.column("members").combine_chunks()
    lengths = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    weights = table.column("weight").to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = members.flatten().to_numpy(zero_copy_only=False)
    single = lengths == 1
    uids = np.sort(flat[starts[single]])
    n = len(uids)
    rows = np.full((len(lengths), int(lengths.max())), n, np.int64)
    rows[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = np.searchsorted(uids, flat)
    order = np.lexsort((*rows.T[::-1], lengths))
    columns = [table.column(c).to_numpy(zero_copy_only=False)[order[:n]].astype(np.int64) for c in ("field_idx", "id_rank")]
    return np.stack([uids, *columns]), rows[order], weights[order], lengths[order]


def searched_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(submission_id, component, a_uid, b_uid): links of the best forest of dense components; of one that is given up, a
    row without links. nodes and links: as for legal_groups, nodes with id_rank too."""
    groups, over = legal_groups(nodes, links)
    single = nodes.select(*_KEYS, F.array("uid").alias("members"), "field_idx", "id_rank")
    rows = groups.where(F.size("members") > 1).select(*_KEYS, "members", "weight", F.lit(None).cast("int").alias("field_idx"), F.lit(None).cast("int").alias("id_rank"))
    alone = single.join(over, _KEYS, "left_anti").select(*_KEYS, "members", F.lit(0).cast("bigint").alias("weight"), "field_idx", "id_rank")

    def solve(key, table):
        (uids, fields, ranks), places, weights, _ = _table(table)
        try:
            _, _, chosen = best_partition(fields.tolist(), ranks.tolist(), places, weights)
            ends = [(int(uids[a]), int(uids[b])) for a, b in chosen]
        except WorkExceeded:
            ends = [(None, None)]
        keys = [pa.repeat(k, len(ends)) for k in key]
        return pa.Table.from_arrays([*keys, pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32())], ["submission_id", "component", "a_uid", "b_uid"])

    kind = links.schema["submission_id"].dataType.simpleString()
    schema = f"submission_id {kind}, component int, a_uid int, b_uid int"
    solved = rows.unionByName(alone).groupBy(*_KEYS).applyInArrow(solve, schema)
    return solved.unionByName(over.select(*_KEYS, F.lit(None).cast("int").alias("a_uid"), F.lit(None).cast("int").alias("b_uid")))
