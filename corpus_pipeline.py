"""The corpus pipeline: documents that pass five operators of fieldmerge.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are
written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.llm import decontam, langid, minhash, mixing, sharding
from fieldmerge.llm.common import written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that fit the languages learned from these documents' own labels. Null texts go; rows that
    repeat are judged alike; without any label every text with letters stays."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest key: doc_id, or where rows have none or share
    one, a hash of doc_id and text. Rows with equal keys are one document. Texts without words are linked with nothing."""
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_of")), "repeated")
    if repeated.isEmpty() and docs.where("doc_id is null").isEmpty():
        keyed, odd = docs.withColumn("_key", F.col("doc_id").cast("long")), False
    else:
        marked = docs.join(repeated, docs["doc_id"] == repeated["_of"], "left")
        key = F.when(docs["doc_id"].isNull() | F.col("_of").isNotNull(), F.xxhash64(docs["doc_id"], docs["text"])).otherwise(docs["doc_id"].cast("long"))
        keyed, odd = marked.select(*docs.columns, key.alias("_key")), True
    near = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    kept = near.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    one = keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi")
    return (one.dropDuplicates(["_key"]) if odd else one).drop("_key")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item. Null and empty texts stay, and without test items all do."""
    return decontam.without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; a null source is one of its own, equal doc_ids draw alike."""
    return mixing.mixed(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards of nearly equal bytes: the documents' columns with size, text_crc32, shard and slot.
    Rows of one text and doc_id take neighbouring slots in any order; a null text counts as empty."""
    return sharding.sharded(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: SQL can't express the stages (mixtures, minwise signatures, alignment). tests/llm holds their operators against plain
#: computations or planted cases, and the stages against odd tables; no test recomputes a whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
