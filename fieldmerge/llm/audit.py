"""What filters remove, alone and together: counts on the edges of the lattice of applied filters, read along all orders.

A document that fails the filters of a set m reaches the edge (S, f), where the filters of S are applied and f is next, if
m and S share nothing; f removes it if f is in m. So the documents are counted by (part, m) first; each of these classes
adds its counts to the n * 2 ** (n - 1) edges, and an order of the n filters is a path of n edges.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import written

#: There are n! orders; more filters than these would make more steps than a report can hold.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_BLANKS = " \t\n\u000b\f\r"


def failures(text: Column) -> dict[str, Column]:
    """The conditions by which a text fails filters A to D: few words, few different words, many capitals, odd signs."""
    inner = F.btrim(text, F.lit(_BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part by the filters A to E that they fail, as bits, and how many of
    them are labelled good and toxic.

    E fails a document whose text a smaller doc_id has too. Texts are compared by SHA-256. Rows are added up by doc_id,
    text, part and bits before anything is joined, so copies, equal ids and large parts weigh as one row a task."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(text).values())), F.lit(0))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits"))
    thin = written(rows.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n")), "audit")
    flag = lambda c: F.max((labels[c] == 1).cast("int"))
    known = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(F.coalesce(flag("quality"), F.lit(0)).alias("good"), F.coalesce(flag("toxic"), F.lit(0)).alias("toxic"))
    none = F.lit(0)
    named = thin.where("doc_id is not null")
    labelled = named.join(known, "doc_id", "left").select("doc_id", "digest", "part", "bits", "n", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    judged = labelled.join(first, ["digest", "doc_id"], "left").select("part", (F.col("bits") + again).alias("fails"), "n", "good", "toxic")
    unnamed = thin.where("doc_id is null").select("part", F.col("bits").alias("fails"), "n", none.alias("good"), none.alias("toxic"))
    return judged.unionByName(unnamed).groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def edges(counted: DataFrame, filters: str) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost): the counts of every edge of
    every part, zeros included; applied has the bits of the filters before."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    spread = counted.withColumn("applied", F.explode(sets)).withColumn("place", F.explode(F.array(*(F.lit(i) for i in range(len(filters))))))
    bit = F.expr("shiftleft(1, place)")
    spread = spread.where(F.col("applied").bitwiseAND(bit) == 0)
    failed, earlier = F.col("fails").bitwiseAND(bit) != 0, F.col("fails").bitwiseAND(F.col("applied")) != 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    return spread.groupBy("part", "applied", F.substring(F.lit(filters), F.col("place") + 1, F.lit(1)).alias("filter")).agg(
        total("n", ~failed & ~earlier).alias("kept"),
        total("n", failed & ~earlier).alias("removed"),
        total("n", failed & earlier).alias("redundant"),
        total("n", F.col("fails") == bit).alias("unique_fails"),
        total("good", failed & ~earlier).alias("good_lost"),
        total("toxic", failed & ~earlier).alias("toxic_lost"),
    )


def steps(table: DataFrame, filters: str) -> DataFrame:
    """(filter_order, step, filter, applied): the n! * n steps of all orders, as paths along the edges."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders; at most {MOST_FILTERS} are taken")
    orders = " ".join("".join(p) for p in permutations(filters))
    walked = table.sparkSession.range(1).select(F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    walked = walked.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    before = lambda i: F.when(F.locate(filters[i], F.col("filter_order")) < F.col("step"), 1 << i).otherwise(0)
    return walked.select("filter_order", "step", F.expr("substring(filter_order, step, 1)").alias("filter"), sum((before(i) for i in range(len(filters))), F.lit(0)).alias("applied"))


def along_orders(counted: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley): the edges' counts along every order, and the removals of a step's filter
    added up over all orders. The steps are 600 rows for five filters, so they are sent to every task."""
    lattice = edges(counted, filters)
    paths = lattice.join(F.broadcast(steps(counted, filters)), ["applied", "filter"])
    # an edge lies on |applied|! * (n - 1 - |applied|)! orders
    after = len(filters) - 1 - F.bit_count("applied")
    shares = lattice.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.factorial(F.bit_count("applied")) * F.factorial(after)).alias("shapley"))
    return paths.join(shares, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What filters A to E remove from documents (doc_id, text, source) in all 120 orders, by source: one row for each part,
    filter_order and step.

    A null text is empty and a null source the empty part. Rows without doc_id have no labels, are never repeats of others
    and make none of them one; rows that share doc_id and text are repeats of smaller ids only. Of several labels of a
    doc_id any with 1 counts. Other columns are ignored; an empty table gives no rows."""
    return along_orders(classes(docs, labels), "ABCDE")


#: DuckDB SQL for filter_audit over documents and labels.
AUDIT_SQL = r"""
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
marks as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels group by 1),
failed as (select part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as m, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from words left join marks using (doc_id)),
classes as (select part, m, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
orders as (select a.x || b.x || c.x || d.x || e.x as o, [a.b, b.b, c.b, d.b, e.b] as s from letters a, letters b, letters c, letters d, letters e where a.b | b.b | c.b | d.b | e.b = 31),
steps as (select o, k, s[k] as b, list_sum(s[1:k - 1])::int as before from orders, unnest([1, 2, 3, 4, 5]) as u(k)),
found as (select part, o, k, b, coalesce(sum(n) filter (m & (before | b) = 0), 0)::bigint as kept, coalesce(sum(n) filter (m & before = 0 and m & b <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (m & before <> 0 and m & b <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (m = b), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (m & before = 0 and m & b <> 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (m & before = 0 and m & b <> 0), 0)::bigint as toxic_lost
  from (select part, o, k, b, coalesce(before, 0) as before, m, n, good, toxic from classes, steps) group by 1, 2, 3, 4)
select part, o as filter_order, k::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, b))::bigint as shapley from found"""
