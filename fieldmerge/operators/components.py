"""Connected components of the candidate graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.plans.settled import settled

#: Groups of up to so many links are labelled in one pass over them; larger ones by joins.
MOST_IN_ROW = 100_000


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels from links in order of their submissions: only one submission's observations are held at a time."""
    now, up, kind = None, {}, None

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def table(found):
        columns = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.int32()), strict=True)], ["submission_id", "uid", "component"])

    for batch in batches:
        kind, found = batch.schema.field("submission_id").type, []
        for submission, a_uid, b_uid in zip(*(batch.column(c).to_pylist() for c in ("submission_id", "a_uid", "b_uid")), strict=True):
            if submission != now:
                found += [(now, x, root(x)) for x in list(up)]
                now = submission
                up.clear()
            a, b = root(a_uid), root(b_uid)
            up[max(a, b)] = min(a, b)
        yield table(found)
    if up:
        yield table([(now, x, root(x)) for x in list(up)])


def components(links: DataFrame) -> DataFrame:
    """(submission_id, uid, component) of the observations that have links; component is its smallest uid.

    links should be a written table: it is counted first. Links don't cross submissions or categories, so a group of (submission, category) is labelled by itself: in one pass
    over its links, or, where it has more than MOST_IN_ROW links, in rounds of joins."""
    keys = ["submission_id", "category"]
    # a written table is counted from its footers; only a large one can hold a large group
    large, crowded = None, links.count() > MOST_IN_ROW
    if crowded:
        large = settled(links.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_ROW).select(*keys))
        crowded = not large.isEmpty()
    rest = links.join(large, keys, "left_anti") if crowded else links
    dealt = rest.repartition(*keys).select("submission_id", "a_uid", "b_uid").sortWithinPartitions("submission_id")
    kind = links.schema["submission_id"].dataType.simpleString()
    labels = dealt.mapInArrow(_labels, f"submission_id {kind}, uid int, component int")
    return labels.unionByName(_joined_labels(links.join(large, keys, "left_semi"))) if crowded else labels


def _joined_labels(links: DataFrame) -> DataFrame:
    """As components, for groups of any size: each round a node takes the least label around it, then its label's own."""
    ends = links.select("submission_id", F.col("a_uid").alias("uid"), F.col("b_uid").alias("other"))
    both = settled(ends.union(links.select("submission_id", "b_uid", "a_uid")).distinct())
    labels = settled(both.groupBy("submission_id", "uid").agg(F.least("uid", F.min("other")).alias("component")))
    while True:
        around = both.join(labels.select("submission_id", F.col("uid").alias("other"), F.col("component").alias("near")), ["submission_id", "other"])
        least = around.groupBy("submission_id", "uid").agg(F.min("near").alias("near"))
        moved = labels.join(least, ["submission_id", "uid"]).withColumn("to", F.least("component", "near"))
        jump = labels.select("submission_id", F.col("uid").alias("to"), F.col("component").alias("further"))
        moved = settled(moved.join(jump, ["submission_id", "to"]).select("submission_id", "uid", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("component")).alias("changed")))
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return labels
