"""Candidate links: pairs of observations that may be one object, and the limits on their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.functions.geometry import manhattan, within
from fieldmerge.plans.settled import settled

#: More candidate links in a submission, or observations or links in a component, are refused.
MOST_LINKS, MOST_COMPONENT_NODES, MOST_COMPONENT_LINKS = 100_000, 200, 5_000
#: Observations of one submission and category up to which they meet as a whole; more meet by cells.
MOST_PLAIN = 200
# What is said of these refusals.
SAY_LINKS = "候选关联数量 %d 超出求解上限 %d，请缩小容差或拆分批次"
SAY_COMPONENT_NODES = "单个重叠区域的观测数 %d 超出求解上限 %d"
SAY_COMPONENT_LINKS = "单个重叠区域的候选关联数 %d 超出求解上限 %d"

_SIDE = ["uid", "field_idx", "particle_id", "n", "filter_x", "filter_y"]


def _sides(observations: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    shared, own = ["submission_id", "category", *keys], [c for c in _SIDE if c in observations.columns]
    a = observations.select(*shared, "tolerance", *(F.col(c).alias(f"a_{c}") for c in own))
    b = observations.select(*shared, *(F.col(c).alias(f"b_{c}") for c in own))
    return a, b


def _linked(pairs: DataFrame) -> DataFrame:
    near = within(F.col("a_filter_x"), F.col("a_filter_y"), F.col("b_filter_x"), F.col("b_filter_y"), F.col("tolerance"))
    weight = manhattan(F.col("a_filter_x"), F.col("a_filter_y"), F.col("b_filter_x"), F.col("b_filter_y"))
    kept = pairs.where((F.col("a_field_idx") < F.col("b_field_idx")) & near)
    if "a_n" in pairs.columns:
        return kept.select("submission_id", "category", "a_uid", "b_uid", (F.col("a_n") * F.col("b_n")).alias("n"))
    return kept.select("submission_id", "category", "a_uid", "b_uid", F.col("a_particle_id").alias("a_id"), F.col("b_particle_id").alias("b_id"), weight.alias("w"))


def places(observations: DataFrame) -> DataFrame:
    """(submission_id, category, tolerance, field_idx, filter_x, filter_y, uid, n): the n observations of one field, category
    and position as one place, with their least uid. They have the same links, so links of places (with n, the links that
    they stand for) tell how many links there are and what hangs together, however many observations lie together."""
    return observations.groupBy("submission_id", "category", "tolerance", "field_idx", "filter_x", "filter_y").agg(F.min("uid").alias("uid"), F.count("*").alias("n"))


def candidate_links(observations: DataFrame) -> DataFrame:
    """(submission_id, category, a_uid, b_uid, a_id, b_id, w): observations of one submission and category in different
    fields whose coordinates differ by the tolerance at most. uid order is field order, so a is the earlier."""
    a, b = _sides(observations)
    return _linked(a.join(b, ["submission_id", "category"]))


def _placed(observations: DataFrame) -> DataFrame:
    """With the cell of tolerance + 1 by x and y; those of one cell are within the tolerance of each other."""
    cell = F.col("tolerance") + 1
    return observations.withColumn("cx", F.floor(F.col("filter_x") / cell)).withColumn("cy", F.floor(F.col("filter_y") / cell))


def _spread(rows: DataFrame) -> DataFrame:
    """Each row in its own cell and the 8 around it, with the distance in cells as ix and iy."""
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    spread = rows.withColumn("ix", F.explode(around)).withColumn("iy", F.explode(around))
    return spread.withColumn("cx", F.col("cx") + F.col("ix")).withColumn("cy", F.col("cy") + F.col("iy"))


def candidate_links_banded(observations: DataFrame) -> DataFrame:
    """The same links through a grid of cells of tolerance + 1 by x and y: an observation meets those of the 9 cells
    around its own, so a category with very many observations doesn't meet itself as a whole."""
    a, b = _sides(_placed(observations), "cx", "cy")
    return _linked(_spread(a).drop("ix", "iy").join(b, ["submission_id", "category", "cx", "cy"]))


def planned_links(observations: DataFrame) -> DataFrame:
    """The same links: by cells for the observations of a submission and category that are more than MOST_PLAIN, as a whole
    for the others."""
    keys = ["submission_id", "category"]
    crowded = settled(observations.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > MOST_PLAIN).select(*keys))
    if crowded.isEmpty():
        return candidate_links(observations)
    plain, rest = (observations.join(crowded, keys, how) for how in ("left_anti", "left_semi"))
    return candidate_links(plain).unionByName(candidate_links_banded(rest))


def link_bounds(observations: DataFrame) -> DataFrame:
    """(submission_id, at_least, at_most): bounds of each submission's number of links, from counts by cell and field: pairs
    of one cell are links, those of cells that don't touch are none. No pair of observations is made."""
    keys = ["submission_id", "category", "cx", "cy"]
    counts = _placed(observations).groupBy(*keys, "field_idx").agg(F.count("*").alias("n"))
    a = _spread(counts.withColumnsRenamed({"field_idx": "a_field", "n": "a_n"}))
    both = a.join(counts, keys).where(F.col("a_field") < F.col("field_idx"))
    pairs = F.col("a_n") * F.col("n")
    own = (F.col("ix") == 0) & (F.col("iy") == 0)
    return both.groupBy("submission_id").agg(F.sum(F.when(own, pairs).otherwise(0)).alias("at_least"), F.sum(pairs).alias("at_most"))


def refused_links(observations: DataFrame) -> DataFrame:
    """(submission_id, n_links) of the submissions with more than MOST_LINKS links. Only those with enough observations, and
    then enough in cells that touch, have their links counted; no links are written."""
    few = settled(observations.groupBy("submission_id").agg(F.count("*").alias("n")).where(F.col("n") * (F.col("n") - 1) / 2 > MOST_LINKS).select("submission_id"))
    if few.isEmpty():
        return few.withColumn("n_links", F.lit(0).cast("bigint"))
    many = observations.join(few, "submission_id", "left_semi")
    open_ = link_bounds(many).where(F.col("at_most") > MOST_LINKS).select("submission_id")
    met = candidate_links_banded(places(many.join(settled(open_), "submission_id", "left_semi")))
    return met.groupBy("submission_id").agg(F.sum("n").alias("n_links")).where(F.col("n_links") > MOST_LINKS)


def link_counts(links: DataFrame) -> DataFrame:
    """(submission_id, n_links, over_limit)."""
    counts = links.groupBy("submission_id").agg(F.count("*").alias("n_links"))
    return counts.withColumn("over_limit", F.col("n_links") > MOST_LINKS)


def component_sizes(links: DataFrame, components: DataFrame) -> DataFrame:
    """(submission_id, component, n_nodes, n_links, over_limit); of places' links and components where both have n."""
    counted = lambda rows: F.sum("n") if "n" in rows.columns else F.count("*")
    nodes = components.groupBy("submission_id", "component").agg(counted(components).alias("n_nodes"))
    edges = with_component(links, components.select("submission_id", "uid", "component")).groupBy("submission_id", "component").agg(counted(links).alias("n_links"))
    both = nodes.join(edges, ["submission_id", "component"])
    return both.withColumn("over_limit", (F.col("n_nodes") > MOST_COMPONENT_NODES) | (F.col("n_links") > MOST_COMPONENT_LINKS))


def with_component(links: DataFrame, components: DataFrame) -> DataFrame:
    """Links with the component of their ends."""
    ends = components.withColumnRenamed("uid", "a_uid")
    return links.join(ends, ["submission_id", "a_uid"])
