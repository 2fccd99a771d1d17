"""Steps whose work or memory must not grow faster than the tables."""

import json
import random

from pyspark.sql import functions as F

from fieldmerge.operators import candidates, rules, validate
from fieldmerge.operators.components import components
from fieldmerge.operators.expand import expand
from fieldmerge.plans import queries
from fieldmerge.plans.adjudicate import process_submissions
from fieldmerge.plans.settled import settled
from fieldmerge.sources import submissions
from fieldmerge.sources.submissions import SUBMISSION
from test_rules import changed
from test_submissions import BAD, doc, field

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_concluded_in_their_rows(spark):
    rnd = random.Random(4)
    bodies = [b for b, _ in BAD.values()] + [None, "", json.dumps(doc()), json.dumps(doc(tolerance=None, fields=[field([{"id": f" {i % 7}", "x": i % 3 - 0.5 * (i % 2), "y": 0, "category": "c" * (i % 60)} for i in range(n)]) for n in (90, 0, 501)]))]
    for _ in range(200):
        many = [field([{"id": rnd.choice("abcdefghij") * rnd.choice((1, 1, 65)), "x": 1, "y": 2, "category": "c"} for _ in range(rnd.randint(0, 40))]) for _ in range(rnd.randint(2, 6))]
        bodies.append(json.dumps(changed(rnd, doc(fields=many)), ensure_ascii=False))
    table = spark.createDataFrame(list(enumerate(bodies)), "named int, body string")
    made = rules.concluded(table)
    assert made.columns == ["named", "body", "issues"]
    assert not [x for x in ("Exchange", "Window", "Python") if x in plan_of(made)]
    read = 0
    for r in made.collect():
        if r["issues"] is not None:
            read += 1
            assert [i.asDict() for i in r["issues"]] == validate.conclude(bodies[r["named"]])[0], bodies[r["named"]]
    assert read > len(bodies) - 40
    left = validate.concluded(made.where("issues is null").drop("issues")).collect()
    assert len(left) == len(bodies) - read and all(([i.asDict() for i in r["issues"]], r["body"]) == validate.conclude(bodies[r["named"]]) for r in left)


def test_all_repeats_of_a_large_body(spark):
    """60 000 particles of one id, and as many of different ids: no step compares all of them with each other."""
    bodies = [json.dumps({"tolerance": 1, "fields": [{"particles": [{"id": str(i % most)} for i in range(60_000)]}]}) for most in (1, 30_000)]
    for r in rules.concluded(spark.createDataFrame(list(enumerate(bodies)), "named int, body string")).collect():
        assert [i.asDict() for i in r["issues"]] == validate.conclude(bodies[r["named"]])[0]


def test_rule_bodies_are_dealt_by_rows(spark, tmp_path):
    """A file of one row group is made into bodies by many tasks."""
    from fieldmerge.sources.submissions import rule_bodies

    one = spark.range(100_000).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("m").alias("c_mktsegment"), F.lit(3).alias("c_nationkey"))
    one.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert rule_bodies(spark, str(tmp_path)).rdd.getNumPartitions() >= 20


def test_components_hold_one_submission_at_a_time(spark):
    """Links come to the labels in order, not as a list in a row; labels are the least uids."""
    rnd = random.Random(8)
    rows = [(s, "c", *sorted(rnd.sample(range(60), 2))) for s in range(40) for _ in range(rnd.randint(1, 60))]
    links = settled(spark.createDataFrame(rows, "submission_id long, category string, a_uid int, b_uid int"))
    made = components(links)
    assert "collect_list" not in plan_of(made)
    expected = {}
    for s, _, a, b in rows:
        for x in (a, b):
            expected.setdefault((s, x), x)
    for _ in range(60):
        for s, _, a, b in rows:
            expected[s, a] = expected[s, b] = min(expected[s, a], expected[s, b])
    assert {(r["submission_id"], r["uid"]): r["component"] for r in made.collect()} == expected


def test_refusals_are_told_from_places(spark, monkeypatch):
    """Observations that lie together are one place: crowded submissions are refused without a link being written."""
    rows = [(s, 5, [{"name": None, "offset": {"x": 0, "y": 0}, "particles": [{"id": f"{f}-{i}", "x": 1000 * (i // each) + i % 3, "y": i % 2, "category": "c"} for i in range(108)]} for f in range(5)]) for s, each in (("one", 108), ("two", 54), ("small", 27))]
    observations = expand(spark.createDataFrame(rows, SUBMISSION))
    places = settled(candidates.places(observations))
    assert places.count() == 5 * 6 * (1 + 2 + 4)
    met, parts = settled(candidates.planned_links(places)), settled(candidates.planned_links(observations))
    labelled = settled(places.join(components(met), ["submission_id", "uid"]))
    sizes = lambda links, labels: sorted(tuple(r) for r in candidates.component_sizes(links, labels).collect())
    assert sizes(met, labelled) == sizes(parts, settled(components(parts)))
    assert met.count() < parts.count() / 50
    bodies = spark.createDataFrame([(s, json.dumps({"tolerance": t, "fields": [{k: v for k, v in f.items() if k != "name"} for f in fields]})) for s, t, fields in rows], "submission_id string, body string")
    seen, plain = [], candidates.planned_links
    monkeypatch.setattr(candidates, "planned_links", lambda x: seen.append((x.columns, x.count())) or plain(x))
    said = {r["submission_id"]: r["error_message"] for r in process_submissions(bodies).collect()}
    assert said == {"one": candidates.SAY_LINKS % (116640, 100000), "two": candidates.SAY_COMPONENT_NODES % (270, 200), "small": candidates.SAY_COMPONENT_LINKS % (7290, 5000)}
    assert [n for columns, n in seen if "n" not in columns] == [0]


def test_orders_are_dealt_by_rows_and_sorted_once(spark, monkeypatch):
    """More lines are more tasks, not larger ones, and both windows of order_fields read one order."""
    made = submissions.order_fields(spark, SMALL)
    lines = made.count()
    monkeypatch.setattr(submissions, "MOST_ROWS", lines // 23)
    more = submissions.order_fields(spark, SMALL)
    assert more.rdd.getNumPartitions() >= 23
    assert plan_of(submissions.order_fields(spark, SMALL)).count("Sort [") == 1
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, made.collect()))


def test_repeated_ids_keep_their_parts(spark, monkeypatch):
    """Ids of an order are compared where its lines were dealt to, not after a further shuffle into a fixed number of parts."""
    monkeypatch.setattr(submissions, "MOST_ROWS", 200)
    found = queries.validation_issues_ids(spark, SMALL)
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    assert found.rdd.getNumPartitions() >= 23


def test_bodies_are_made_by_one_grouping(spark):
    """An order's body is made where its lines were dealt to, by one aggregation."""
    made = submissions.order_bodies(spark, SMALL)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan_of(made).count("Exchange hashpartitioning") == 1


def test_bodies_share_a_marker(spark):
    """The parser keeps the names that it reads: bodies don't bring one each. A body that may hold the marker has its own."""
    whole = json.dumps(doc())
    plain = spark.range(500).select(F.concat(F.lit('{"tolerance":'), F.col("id").cast("string"), F.lit("}")).alias("body"))
    assert [r["m"] for r in plain.select(rules._marker(F.col("body")).alias("m")).distinct().collect()] == [rules.MARKER]
    name = "".join(f"\\u{ord(c):04x}" for c in rules.MARKER)
    bodies = [start + f'{between}"{m}":0{end}' for m in (rules.MARKER, name, name[:6] + rules.MARKER[1:]) for start in (whole, "{}", "1") for between in (",", " ,") for end in ("", "}", "}}", "},", '},"x":1')]
    bodies += [whole[:-1] + f',"{m}":0}}' for m in (rules.MARKER, name)]
    made = rules.concluded(spark.createDataFrame(list(enumerate(bodies)), "named int, body string"))
    for r in made.unionByName(validate.concluded(made.where("issues is null").drop("issues"))).where("issues is not null").collect():
        assert [i.asDict() for i in r["issues"]] == validate.conclude(bodies[r["named"]])[0], bodies[r["named"]]
    assert {r["named"] for r in made.where("issues is not null").collect()} == {len(bodies) - 2, len(bodies) - 1}
