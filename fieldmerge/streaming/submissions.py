"""Submissions as a stream: each micro-batch is a batch of its own, since submissions don't depend on one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldmerge.plans.adjudicate import process_submissions
from fieldmerge.plans.settled import scratch


def submission_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of {submission_id, body} as they arrive in a folder."""
    return spark.readStream.schema("submission_id string, body string").json(path)


def write_outcomes(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the outcomes of each micro-batch as Parquet in a folder of its own, so that a batch that is run again
    replaces what it wrote before. The batch's intermediate tables go when its outcomes are written."""

    def one(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            process_submissions(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
