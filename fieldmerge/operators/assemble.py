"""Final objects: the trees of chosen links, with members, centroid and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.geometry import round2
from fieldmerge.functions.text import utf16_key
from fieldmerge.operators.components import components
from fieldmerge.plans.settled import settled


def rooted(observations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Observations with root, the smallest uid of their object; those without links are objects of their own."""
    categories = observations.select("submission_id", F.col("uid").alias("a_uid"), "category")
    linked = components(settled(chosen.join(categories, ["submission_id", "a_uid"]).select("submission_id", "category", "a_uid", "b_uid")))
    return observations.join(linked.withColumnRenamed("component", "root"), ["submission_id", "uid"], "left").withColumn("root", F.coalesce("root", "uid"))


def final_particles(observations: DataFrame, chosen: DataFrame) -> DataFrame:
    """(submission_id, particle_no, category, rep_x, rep_y, n_obs, observations, links), numbered by earliest member.

    observations are in uid order, links in the order of their ids (a the earlier observation, not the smaller id)."""
    placed = rooted(observations, chosen)
    member = F.struct("uid", "field_idx", "field_name", "particle_id", "local_x", "local_y", "filter_x", "filter_y")
    objects = placed.groupBy("submission_id", "root").agg(
        F.min_by("category", "uid").alias("category"),
        round2(F.avg("filter_x")).alias("rep_x"),
        round2(F.avg("filter_y")).alias("rep_y"),
        F.count("*").cast("int").alias("n_obs"),
        F.transform(F.array_sort(F.collect_list(member)), lambda m: m.dropFields("uid")).alias("observations"),
    )
    ends = placed.select("submission_id", F.col("uid").alias("a_uid"), "root")
    link = F.struct(utf16_key(F.col("a_id")).alias("ka"), utf16_key(F.col("b_id")).alias("kb"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("w").alias("manhattan"))
    links = chosen.join(ends, ["submission_id", "a_uid"]).groupBy("submission_id", "root").agg(F.transform(F.array_sort(F.collect_list(link)), lambda m: m.dropFields("ka", "kb")).alias("links"))
    none = F.array().cast("array<struct<a:string,b:string,manhattan:bigint>>")
    number = F.row_number().over(Window.partitionBy("submission_id").orderBy("root"))
    return objects.join(links, ["submission_id", "root"], "left").select("submission_id", number.alias("particle_no"), "category", "rep_x", "rep_y", "n_obs", "observations", F.coalesce("links", none).alias("links"))


def particle_observations(particles: DataFrame) -> DataFrame:
    """One row for each observation of each final object."""
    return particles.select("submission_id", "particle_no", F.explode("observations").alias("o")).select("submission_id", "particle_no", "o.*")


def summaries(particles: DataFrame, fields: DataFrame) -> DataFrame:
    """(submission_id, tolerance, field_count, observation_count, link_count, total_particles).

    fields: (submission_id, tolerance, field_count), empty fields counted; submissions without observations have 0s."""
    sums = particles.groupBy("submission_id").agg(F.sum("n_obs").alias("observation_count"), F.sum(F.size("links")).alias("link_count"), F.count("*").alias("total_particles"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return fields.join(sums, "submission_id", "left").select("submission_id", "tolerance", F.col("field_count").cast("bigint").alias("field_count"), zero("observation_count"), zero("link_count"), zero("total_particles"))
