"""Whole jobs: observations to final objects, and raw submissions to outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.operators import assemble, candidates, forest, rules, validate
from fieldmerge.operators.components import components
from fieldmerge.operators.expand import expand
from fieldmerge.plans.settled import settled


@dataclass
class Adjudication:
    observations: DataFrame
    links: DataFrame
    components: DataFrame
    chosen: DataFrame
    particles: DataFrame


def adjudicate(observations: DataFrame, banded: bool = False) -> Adjudication:
    """Final objects of any observations; nothing is checked, and any number of fields is taken. banded: all observations
    meet by cells, not only crowded ones."""
    observations = settled(observations)
    links = settled(candidates.candidate_links_banded(observations) if banded else candidates.planned_links(observations))
    parts = settled(components(links))
    chosen = settled(forest.chosen_links(observations, links, parts))
    return Adjudication(observations, links, parts, chosen, assemble.final_particles(observations, chosen))


def _say(template: str, n: str, most: int) -> Column:
    return F.format_string(template, F.col(n), F.lit(most))


def crowded(observations: DataFrame) -> DataFrame:
    """(submission_id, error_message) of submissions with too many links."""
    return candidates.refused_links(observations).select("submission_id", _say(candidates.SAY_LINKS, "n_links", candidates.MOST_LINKS).alias("error_message"))


def refusals(links: DataFrame, parts: DataFrame) -> DataFrame:
    """(submission_id, error_message) of submissions with a component beyond the solver's limits: the first one. links and
    parts may be those of places."""
    sizes = candidates.component_sizes(links, parts).where("over_limit")
    nodes = _say(candidates.SAY_COMPONENT_NODES, "n_nodes", candidates.MOST_COMPONENT_NODES)
    said = F.when(F.col("n_nodes") > candidates.MOST_COMPONENT_NODES, nodes).otherwise(_say(candidates.SAY_COMPONENT_LINKS, "n_links", candidates.MOST_COMPONENT_LINKS))
    return sizes.select("submission_id", "component", said.alias("m")).groupBy("submission_id").agg(F.min_by("m", "component").alias("error_message"))


def process_submissions(raw: DataFrame) -> DataFrame:
    """(submission_id, status, error_message, issues, result) of raw bodies (submission_id, body as text or bytes): status
    200 with a result, 413 for a body of more bytes than the limit, 400 with located issues, 422 beyond the solver's limits
    or its steps.

    One row for each row of raw: a null or repeated submission_id names several bodies, each with an outcome of its own. A
    null body is read as an empty one, invalid UTF-8 as replacement characters; a lone surrogate escaped in a JSON string
    comes out as the escape. An empty table gives no rows."""
    large = F.coalesce(F.octet_length("body") > validate.MOST_BYTES, F.lit(False))  # of the bytes as they came
    text = F.when(~large, F.make_valid_utf8(F.col("body").cast("string")))
    named = raw.select(F.monotonically_increasing_id().alias("row"), F.col("submission_id").alias("named"), large.alias("large"), text.alias("body"))
    nothing = F.array().cast(validate.ISSUES)
    # a body is only kept for what still reads it: the inspector, or the observations of one without issues
    kept = F.when(F.col("issues").isNull() | (F.size("issues") == 0), F.col("body"))
    read = rules.concluded(named.withColumn("body", F.when(~F.col("large"), F.coalesce("body", F.lit("")))))
    read = settled(read.withColumn("body", kept).withColumn("issues", F.when(F.col("large"), nothing).otherwise(F.col("issues"))))
    left = read.where("issues is null").drop("issues")
    checked = settled(read.where("issues is not null").unionByName(validate.concluded(left)))
    good = checked.where("not large and size(issues) = 0")
    submissions = settled(validate.normalised(good.select(F.col("row").alias("submission_id"), "body")))
    observations = settled(expand(submissions))
    over = settled(crowded(observations))
    # what is refused is told from places; links are only written for the rest
    places = settled(candidates.places(observations.join(over, "submission_id", "left_anti")))
    met = settled(candidates.planned_links(places))
    labelled = settled(places.join(components(met), ["submission_id", "uid"]))
    over = settled(over.unionByName(refusals(met, labelled)))
    solvable = observations.join(over, "submission_id", "left_anti")
    links = settled(candidates.planned_links(solvable))
    position = ["submission_id", "category", "field_idx", "filter_x", "filter_y"]
    parts = settled(solvable.join(labelled.select(*position, "component"), position).select("submission_id", "uid", "component"))
    searched = settled(forest.searched_links(solvable, links, parts))
    given_up = searched.where("a_uid is null").select("submission_id", F.lit(forest.SAY_WORK).alias("error_message")).distinct()
    over = settled(over.unionByName(given_up))
    chosen = settled(forest.with_links(searched.join(over, "submission_id", "left_anti"), links))
    particles = assemble.final_particles(observations.join(over, "submission_id", "left_anti"), chosen)
    fields = submissions.join(over, "submission_id", "left_anti").select("submission_id", "tolerance", F.size("fields").alias("field_count"))
    result = F.struct(F.col("tolerance"), F.col("field_count").alias("fieldCount"), F.col("observation_count").alias("observationCount"), F.col("link_count").alias("linkCount"), F.col("total_particles").alias("totalParticles"), F.col("particles"))
    listed = particles.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("particle_no").alias("id"), "category", F.struct(F.col("rep_x").alias("x"), F.col("rep_y").alias("y")).alias("representative"),
        F.transform("observations", lambda o: F.struct(o["field_idx"].alias("fieldIndex"), o["field_name"].alias("fieldName"), o["particle_id"].alias("particleId"), o["local_x"].alias("localX"), o["local_y"].alias("localY"), o["filter_x"].alias("filterX"), o["filter_y"].alias("filterY"))).alias("observations"),
        "links",
    ))).alias("particles"))
    solved = assemble.summaries(particles, fields).join(listed, "submission_id", "left").select("submission_id", result.alias("result"))
    ready = good.select(F.col("row").alias("submission_id"), "named", "large", "issues").join(over, "submission_id", "left").join(solved, "submission_id", "left").drop("submission_id")
    refused = checked.where("large or size(issues) > 0").select("named", "large", "issues")
    joined = ready.unionByName(refused, allowMissingColumns=True)
    status = F.when(F.col("large"), 413).when(F.size("issues") > 0, 400).when(F.col("error_message").isNotNull(), 422).otherwise(200)
    unread = F.exists("issues", lambda i: i["message"] == validate.SAY_JSON)
    message = F.when(F.col("large"), validate.SAY_LARGE).when(unread, validate.SAY_UNREAD).when(F.size("issues") > 0, validate.SAY_REFUSED).otherwise(F.col("error_message"))
    return joined.select(F.col("named").alias("submission_id"), status.alias("status"), message.alias("error_message"), "issues", "result")
