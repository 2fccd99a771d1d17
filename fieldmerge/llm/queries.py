"""The registered queries of this package: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.llm import audit, decontam, gif, htmltext, langid, licenses, minhash, mixing, runs, secrets, sharding, suffix, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.gif_digests(gif.store_texts(_table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.pages_read(warc.write_archives(_table(spark, sf_dir, "pages")))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(_table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.secrets(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(_table(spark, sf_dir, "documents"), runs.looped_tail))


QUERIES = {
    f.__name__: f
    for f in (
        op1_gif_media, op2_suffix_dedup, op3_language, op4_mixing, op5_sharding, op6_minhash, op7_main_text, op8_warc, op9_decontamination, op10_licenses,
        op11_secrets, op12_filter_audit, op13_periodic_runs,
    )
}

ORACLE = {"op4_mixing": mixing.MIXING_SQL, "op12_filter_audit": audit.AUDIT_SQL}
