"""Mixing sources to target weights, in DataFrame functions only.

Each source's words are summed, a target share gives its repetition rate, and a document comes out floor(rate) times
plus once more where a draw seeded by its doc_id falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, null last, repeating; the share of all words; copies of a source at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = "mix-1"
#: Rates of at most so many sources are sent to every task (about 3 MB); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09 to 0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _ranged(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of `sums`, the running total up to the row itself, in the given order (which has no ties).

    Rows are dealt into ranges of the order, which are summed by themselves; what stands before a range comes from a window
    over the ranges, a row each. So no task holds more rows than a range."""
    rows = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(written(starts, "starts"), "_range")
    return joined.select(*(c for c in rows.columns if c != "_range"), *((F.col(f"_{n}") + F.sum(c).over(own)).alias(n) for n, c in sums.items()))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Targets share `share` of all words by weight; one that would pass `most` times its source's words stops there and
    the excess goes to the others by weight, until none is above. With caps c and weights w the result is
    min(c, w * level): with the first i sources in order of c / w full, the others' level is what is left over their
    weights. No choice of i gives more than the true level, and the true i gives it, so it is the largest. A source without words has target and rate 0."""
    summed = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    placed = _ranged(summed, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("most") / F.col("weight"))
    ordered = written(_ranged(capped, [F.col("ratio"), F.col("source").asc_nulls_last()], {"full": F.col("most"), "weighed": F.col("weight")}), "ordered")
    words, full, weighed = (x or 0 for x in ordered.agg(F.sum("source_size"), F.sum("most"), F.sum("weight")).first())  # three numbers
    level = (F.lit(float(min(words * share, full))) - (F.col("full") - F.col("most"))) / (F.lit(float(weighed)) - (F.col("weighed") - F.col("weight")))
    highest = ordered.agg(F.max(level)).first()[0]
    target = F.least(F.col("most"), F.lit(highest).cast("double") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return ordered.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and doc_id alone (null as the text null)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixing_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source).

    copies is what the mix takes of the row: floor(rate), and one more with the fraction's probability. Rows of equal
    doc_id draw alike, so reruns and recomputed tasks agree. A null text has size 0, a null source is a source of its
    own, an empty table gives no rows. keep: the columns of docs and one more, the last, for the copies, under a name
    that none of them has."""
    sizes = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"))
    if not keep:
        sizes = written(sizes, "sizes")
    rates = written(source_targets(sizes, weights, share, most), "rates")
    rows = docs if keep else sizes
    free = "_mix"
    while any(c.lower().startswith(free) for c in rows.columns):
        free += "_"
    rates = rates.toDF(*(f"{free}_{c}" for c in rates.columns))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(rates) if few else rates, rows["source"].eqNullSafe(rates[f"{free}_source"]))
    rate = F.col(f"{free}_rate")
    copies = F.floor(rate).cast("int") + (draw(rows["doc_id"], seed) < rate - F.floor(rate)).cast("int")
    if keep:
        return joined.select(*(rows[f"`{c}`"] for c in rows.columns), copies.alias(f"{free}_copies"))
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", F.col(f"{free}_source_size").alias("source_size"), F.col(f"{free}_target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, with the columns of docs."""
    plan = mixing_plan(docs, keep=True, **options)
    copies = plan[plan.columns[-1]]
    return plan.where(copies > 0).withColumn(f"{plan.columns[-1]}_", F.explode(F.sequence(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))


MIXING_SQL = """
with sizes as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from sizes group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by encode(source) nulls last) - 1) % 3)::int + 1]::double as weight, source_size * 2.0::double as most from sums),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as level
      from w window o as (order by most / weight, encode(source) nulls last)),
t as (select source, source_size, least(most, weight * max(level) over ()) as target from l),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sizes join r on sizes.source is not distinct from r.source
"""
