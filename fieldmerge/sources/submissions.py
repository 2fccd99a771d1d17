"""Submissions as DataFrames: typed, or cut from event and order tables.

A typed submission is (submission_id, tolerance, fields array<struct<name, offset struct<x, y>, particles
array<struct<id, x, y, category>>>>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTICLE = "struct<id:string,x:bigint,y:bigint,category:string>"
FIELD = f"struct<name:string,offset:struct<x:bigint,y:bigint>,particles:array<{PARTICLE}>>"
SUBMISSION = f"submission_id string, tolerance bigint, fields array<{FIELD}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of orders that one task sorts, about.
MOST_ROWS = 250_000


def dealt(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows of a file, which is counted from its footers, by keys in parts of some `most` rows: more rows are more parts, so
    a task's time and memory don't grow with them."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // most)
    return rows.repartition(parts, *keys)


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from the events table: a user is a submission, event_id modulo 5 the field; tolerance 2.

    Fields are translated by (100, -50) times their index, so local coordinates are told from filter coordinates."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    field = F.col("event_id") % 5
    rows = e.select(
        F.col("user_id").alias("submission_id"),
        F.lit(2).cast("bigint").alias("tolerance"),
        field.cast("int").alias("field_idx"),
        F.concat(F.lit("F"), (field + 1).cast("string")).alias("field_name"),
        F.col("event_id").alias("particle_order"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("particle_id"),
        F.col("event_type").alias("category"),
        (F.floor(F.col("value") / 5).cast("bigint") - 100 * field).alias("local_x"),
        (F.hour("ts").cast("bigint") + 50 * field).alias("local_y"),
        (100 * field).cast("bigint").alias("offset_x"),
        (-50 * field).cast("bigint").alias("offset_y"),
    )
    return rows


def _bodies(rows: DataFrame, tolerance: int) -> DataFrame:
    """(submission_id, body) as the service gets them, from (submission_id, field_idx, place, name, offset, particle)."""
    listed = rows.groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct("field_idx", "place", "name", "offset", "particle"))).alias("rows"))
    listed = listed.withColumn("order", F.sort_array(F.array_distinct("rows.field_idx")))
    own = F.transform("order", lambda i: F.filter("rows", lambda r: r["field_idx"] == i))
    field = lambda of: F.struct(F.get(of, 0)["name"].alias("name"), F.get(of, 0)["offset"].alias("offset"), F.transform(of, lambda r: r["particle"]).alias("particles"))
    return listed.withColumn("own", own).select("submission_id", F.to_json(F.struct(F.lit(tolerance).alias("tolerance"), F.transform("own", field).alias("fields"))).alias("body"))


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as raw submissions: those of event_observations, as JSON."""
    o = event_observations(spark, sf_dir)
    particle = F.struct(F.col("particle_id").alias("id"), F.col("local_x").alias("x"), F.col("local_y").alias("y"), "category")
    return _bodies(o.select("submission_id", "field_idx", F.col("particle_order").alias("place"), F.col("field_name").alias("name"), F.struct(F.col("offset_x").alias("x"), F.col("offset_y").alias("y")).alias("offset"), particle.alias("particle")), 2)


def order_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of order_fields as raw submissions; most have issues. Every fifth has a tolerance that is none."""
    particle = F.struct(F.col("particle_id").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "category")
    rows = order_fields(spark, sf_dir).select("submission_id", "field_idx", F.col("particle_idx").alias("place"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("offset"), particle.alias("particle"))
    bodies = _bodies(rows, 1)
    return bodies.withColumn("body", F.when(F.col("submission_id") % 5 == 0, F.regexp_replace("body", '"tolerance":1', '"tolerance":1.5')).otherwise(F.col("body")))


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows from the lineitem table for validation: an order is a submission, l_linenumber modulo 5 its field."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # both windows read this one order
    rows = dealt(li, MOST_ROWS, "l_orderkey").withColumn("m", F.col("l_linenumber") % 5).sortWithinPartitions("l_orderkey", "m", *order)
    rows = rows.withColumn("particle_idx", F.row_number().over(Window.partitionBy("l_orderkey", "m").orderBy(*order)) - 1)
    return rows.withColumn("field_idx", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("m")) - 1).select(
        F.col("l_orderkey").alias("submission_id"), "field_idx", "particle_idx",
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("particle_id"),
        F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_returnflag").alias("category"),
    )


#: rule_bodies are of so many kinds, told by the customer's key; kind 23 has a body beyond the limit for every fifth key only.
KINDS = 30


def rule_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw submission for each customer, of a kind (c_custkey modulo KINDS) that breaks one of the rules, or none."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), 5_000, "c_custkey")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    spaces = " \u3000\u00a0"

    def particle(name="A", x=nation, y="-7", category=F.col("c_mktsegment"), own=None):
        own = join('"', F.col("c_name"), name, '"') if own is None else own
        category = join('"', category, '"') if not isinstance(category, str) else category
        return join('{"id":', own, ',"x":', x, ',"y":', y, ',"category":', category, ',"more":[{}]}')

    def field(*particles, offset='{"x":100,"y":-100}', name=None, listed=None):
        listed = join("[", *(q for i, p in enumerate(particles) for q in ((",", p) if i else (p,))), "]") if listed is None else listed
        return join("{", "" if name is None else join('"name":', name, ","), '"offset":', offset, ',"particles":', listed, "}")

    def body(*fields, tolerance="0"):
        return join('{"tolerance":', tolerance, ',"fields":[', *(q for i, f in enumerate(fields) for q in ((",", f) if i else (f,))), '],"extra":null}')

    # the three fields of a body without issues lie apart, so nothing is linked
    one, two, three = field(particle()), field(particle("B"), offset='{"x":300,"y":0}'), field(particle("C"), particle("D", "5000"), offset='{"x":-300,"y":50}')
    good = body(one, two, three)
    long = lambda n, sign="n": F.lit(sign * n)
    many = lambda n, name: join("[", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit('{"id":"'), F.lit(name), i.cast("string"), F.lit('","x":'), (i * 10).cast("string"), F.lit(',"y":0,"category":"c"}'))), ","), "]")
    blank = particle(own='"\u3000"')
    kinds = {
        0: good,
        1: join('"', F.col("c_name"), '"'),
        2: body(one, two, three, tolerance="0.5"),
        3: body(one, two, three, tolerance='"5"'),
        4: F.lit('{"tolerance":-1,"fields":{"0":[]}}'),
        5: body(one, two),
        6: body(one, two, three, field(), field(), field()),
        7: body(F.lit("3"), one, two, F.lit("null")),
        8: body(field(name=F.lit("null")), field(name=join('"', long(51), '"')), field(name=join('"', long(50), spaces, '"'))),
        9: body(field(offset="[]"), field(offset="null"), one),
        10: body(field(offset='{"x":1000001,"y":"0"}'), field(offset='{"y":true}'), one),
        11: body(field(listed=F.lit('"x"')), field(listed=F.lit("{}")), one),
        12: body(field(listed=many(501, "m")), one, two),
        13: body(field(F.lit("4"), particle(), F.lit("null"), F.lit("[]")), two, three),
        14: body(field(particle(own='""'), particle(own="5"), blank), two, three),
        15: body(field(particle(own=join('"', long(65), '"')), particle(own=join('"', long(65), '"')), particle(own=join('"', long(64), spaces, '"'))), two, three),
        16: body(one, field(particle("A"), particle("B")), field(particle(own=join('"', spaces, F.col("c_name"), 'A\\t"')))),
        17: body(field(particle(x="0.5", y="1000001")), field(particle("B", x="null", y='"1"')), three),
        18: body(field(particle(category='" \u3000"')), field(particle("B", category="null")), three),
        19: body(field(particle(category=long(51))), field(particle("B", category=long(26, "\U0001f600"))), field(particle("C", category=long(25, "\U0001f600")))),
        20: body(*(field(listed=many(401, f)) for f in "abcde"), tolerance="null"),
        21: join("{not valid json ", key),
        22: join(good, " x"),
        23: F.when(F.col("c_custkey") % 5 == 3, F.rpad(good, 1_048_577, " ")).otherwise(good),
        24: body(field(*([blank] * 60)), one, two),
        25: body(field(particle(x="-0", y="1e2")), field(particle("B", x="5.0", y="1.00000000000000000000001"), offset='{"x":3e2,"y":0.0}'), three, tolerance="0e5"),
        26: F.regexp_replace(good, '"tolerance":0', '"tolerance":"x","tolerance":1'),
        27: body(one, two, three, tolerance=join("1", long(5000, "0"))),
        28: body(field(particle(own='"A\\"\\\\"', x="-100", y="100")), field(particle(own='"\uff61"', x="-100", y="100")), field(particle(own='"\\ud83d\\ude00"', x="-100", y="100"))),
        29: body(field(particle(own=join('"', spaces, F.col("c_name"), spaces, '"'), category=join(spaces, F.col("c_mktsegment"), "\\n")), name=join('"', spaces, 'f', spaces, '"')), field(name='"\\t"'), two),
    }
    chosen = F.lit(None).cast("string")
    for kind, text in kinds.items():
        chosen = F.when(F.col("c_custkey") % KINDS == kind, text).otherwise(chosen)
    return c.select(F.col("c_custkey").alias("submission_id"), chosen.alias("body"))


def crowded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from the orders table: submissions of 550 orders, 110 in each of 5 fields, tolerance 5, whose orders lie in
    clusters far from each other. Of every four submissions one has a single cluster, one has clusters of 275 orders, one of
    180, one of 5. uid is told from the key alone: by field, then by order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    submission, place = F.floor(key / 550).cast("bigint"), key % 550
    size = F.element_at(F.array(*(F.lit(n) for n in (550, 275, 180, 5))), (submission % 4 + 1).cast("int"))
    x, y = (1000 * F.floor(place / size) + place % 3).cast("bigint"), (place % 2).cast("bigint")
    uid = ((key % 5) * 110 + F.floor(place / 5)).cast("int")
    return o.select(
        submission.alias("submission_id"), F.lit(5).cast("bigint").alias("tolerance"), uid.alias("uid"), (key % 5).cast("int").alias("field_idx"), F.floor(place / 5).cast("int").alias("particle_idx"),
        F.concat(F.lit("F"), (key % 5 + 1).cast("string")).alias("field_name"), F.concat(F.lit("O"), key.cast("string")).alias("particle_id"), F.lit("o").alias("category"), x.alias("local_x"), y.alias("local_y"), x.alias("filter_x"), y.alias("filter_y"),
    )


def crowded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of crowded_observations as raw submissions."""
    o = crowded_observations(spark, sf_dir)
    particle = F.struct(F.col("particle_id").alias("id"), F.col("filter_x").alias("x"), F.col("filter_y").alias("y"), "category")
    return _bodies(o.select("submission_id", "field_idx", F.col("particle_idx").alias("place"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("offset"), particle.alias("particle")), 5)
