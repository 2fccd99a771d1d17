"""Observations: one row for each particle of a submission, numbered and moved to filter coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.text import default_name, trimmed

OBSERVATION = ["submission_id", "tolerance", "uid", "field_idx", "particle_idx", "field_name", "particle_id", "category", "local_x", "local_y", "filter_x", "filter_y"]


def numbered(rows: DataFrame) -> DataFrame:
    """Observations from flat rows with particle_order, offsets and local coordinates.

    uid counts a submission's observations from 0 by field, then by order in the field; particle_idx those of a field."""
    in_field = Window.partitionBy("submission_id", "field_idx").orderBy("particle_order")
    whole = Window.partitionBy("submission_id").orderBy("field_idx", "particle_order")
    return rows.select(
        "*",
        (F.row_number().over(whole) - 1).alias("uid"),
        (F.row_number().over(in_field) - 1).alias("particle_idx"),
        (F.col("offset_x") + F.col("local_x")).alias("filter_x"),
        (F.col("offset_y") + F.col("local_y")).alias("filter_y"),
    ).select(*OBSERVATION)


def expand(submissions: DataFrame) -> DataFrame:
    """Observations of typed submissions (submission_id, tolerance, fields); empty fields give no rows. They are numbered as
    by `numbered`, from their places within the submission's row."""
    before = lambda i: F.aggregate(F.slice("fields", 1, i), F.lit(0), lambda n, f: n + F.greatest(F.coalesce(F.size(f["particles"]), F.lit(0)), F.lit(0)))
    listed = F.transform("fields", lambda f, i: F.struct(f.alias("field"), before(i).alias("before")))
    fields = submissions.select("submission_id", "tolerance", F.posexplode(listed).alias("field_idx", "f")).select("submission_id", "tolerance", "field_idx", "f.*")
    particles = fields.select("submission_id", "tolerance", "field_idx", "before", default_name(F.col("field.name"), F.col("field_idx")).alias("field_name"), F.col("field.offset").alias("offset"), F.posexplode("field.particles").alias("particle_idx", "p"))
    return particles.select(
        "submission_id", "tolerance", (F.col("before") + F.col("particle_idx")).alias("uid"), "field_idx", "particle_idx", "field_name",
        trimmed(F.col("p.id")).alias("particle_id"), trimmed(F.col("p.category")).alias("category"), F.col("p.x").alias("local_x"), F.col("p.y").alias("local_y"),
        (F.col("offset.x") + F.col("p.x")).alias("filter_x"), (F.col("offset.y") + F.col("p.y")).alias("filter_y"),
    ).select(*OBSERVATION)
