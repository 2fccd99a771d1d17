"""Raw submissions to outcomes, in a batch and as a stream."""

import json
import os

import pytest

from fieldmerge.functions.geometry import round2
from fieldmerge.functions.text import trimmed, utf16_length
from fieldmerge.operators import forest, groups, validate
from fieldmerge.plans.adjudicate import process_submissions
from fieldmerge.plans.settled import scratch, settled
from fieldmerge.streaming.submissions import submission_stream, write_outcomes


def doc(tolerance=5, fields=None):
    return {
        "tolerance": tolerance,
        "fields": fields
        or [
            {"name": " F1 ", "offset": {"x": 0, "y": 0}, "particles": [{"id": "A1", "x": 10, "y": 10, "category": "PE"}, {"id": "A2", "x": 40, "y": 40, "category": "PP"}, {"id": "A3", "x": 90, "y": 10, "category": "PE"}]},
            {"offset": {"x": 100, "y": 0}, "particles": [{"id": "B1", "x": -8.0, "y": 12, "category": "PE"}, {"id": "B2", "x": -6, "y": 9, "category": " PE　"}]},
            {"name": "", "offset": {"x": 0, "y": 1e2}, "particles": [{"id": "C1", "x": 40, "y": -58, "category": "PP"}, {"id": "C2", "x": 5, "y": 5, "category": "PET"}]},
        ],
    }


def field(particles, **other):
    return {"offset": {"x": 0, "y": 0}, "particles": particles} | other


BAD = {
    "array": ("[]", [("", validate.SAY_BODY)]),
    "broken": ("{not valid json", [("", validate.SAY_JSON)]),
    "nan": ('{"tolerance": NaN}', [("", validate.SAY_JSON)]),
    "no_fields": ('{"tolerance": true}', [("tolerance", validate.SAY_TOLERANCE), ("fields", validate.SAY_FIELDS)]),
    "two_fields": (
        json.dumps(doc(fields=[field([{"id": "A1", "x": 0, "y": 0, "category": "PE"}]), field([{"id": " A1 ", "x": 0.5, "y": 0, "category": ""}], name=None)])),
        [("fields", validate.SAY_FIELD_COUNT.format(2)), ("fields[1].name", validate.SAY_NAME), ("fields[1].particles[0].id", validate.SAY_ID_TWICE.format("A1", "fields[0].particles[0].id")), ("fields[1].particles[0].x", validate.SAY_COORDINATE), ("fields[1].particles[0].category", validate.SAY_CATEGORY)],
    ),
    "shapes": (
        json.dumps(doc(fields=[3, field("x", offset=[]), field([4, {"id": "x" * 65, "x": "5", "y": 2_000_000, "category": "c" * 51}], offset={"x": 0.5}), field([])])),
        [
            ("fields[0]", validate.SAY_FIELD), ("fields[1].offset", validate.SAY_OFFSET), ("fields[1].particles", validate.SAY_PARTICLES), ("fields[2].offset.x", validate.SAY_OFFSET_VALUE), ("fields[2].offset.y", validate.SAY_OFFSET_VALUE),
            ("fields[2].particles[0]", validate.SAY_PARTICLE), ("fields[2].particles[1].id", validate.SAY_ID_LENGTH), ("fields[2].particles[1].x", validate.SAY_COORDINATE), ("fields[2].particles[1].y", validate.SAY_COORDINATE), ("fields[2].particles[1].category", validate.SAY_CATEGORY_LENGTH),
        ],
    ),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    many = doc(fields=[field([{"id": "", "x": 0, "y": 0, "category": "PE"}] * 60), field([]), field([])])
    crowded = doc(fields=[field([{"id": f"{f}-{i}", "x": 0, "y": 0, "category": "PE"} for i in range(70)]) for f in range(3)])
    empty = doc(fields=[field([]), field([]), field([])])
    rows = [("sample", json.dumps(doc())), ("many", json.dumps(many)), ("crowded", json.dumps(crowded)), ("empty", json.dumps(empty)), ("large", " " * (validate.MOST_BYTES + 1)), ("null", None)]
    rows += [(name, body) for name, (body, _) in BAD.items()]
    dense = [field([{"id": f"{f}-{i}", "x": i % 4, "y": i // 4, "category": "PE"} for i in range(12)]) for f in range(5)]
    lone = '{"tolerance": 1, "fields": [' + ",".join('{"name": "\\ud83d", "offset": {"x": 0, "y": 0}, "particles": [%s]}' % p for p in ('{"id": "\\ud800", "x": 0, "y": 0, "category": "c"}', '{"id": "\\ud83d\\ude00", "x": 0, "y": 0, "category": "c"}', "")) + "]}"
    rows += [("dense", json.dumps(doc(tolerance=2, fields=dense))), ("lone", lone), ("twice", json.dumps(doc())), ("twice", json.dumps(empty)), (None, json.dumps(doc())), (None, "[]")]
    found = process_submissions(spark.createDataFrame(rows, "submission_id string, body string")).collect()
    assert len(found) == len(rows)
    return {r["submission_id"]: r for r in found if r["submission_id"] not in ("twice", None)} | {"several": [r for r in found if r["submission_id"] in ("twice", None)]}


def test_sample(outcomes):
    r = outcomes["sample"]
    assert (r["status"], r["issues"], r["error_message"]) == (200, [], None)
    out = r["result"]
    assert (out["tolerance"], out["fieldCount"], out["observationCount"], out["linkCount"], out["totalParticles"]) == (5, 3, 7, 2, 5)
    assert [[o["particleId"] for o in p["observations"]] for p in out["particles"]] == [["A1"], ["A2", "C1"], ["A3", "B1"], ["B2"], ["C2"]]
    assert [(p["representative"]["x"], p["representative"]["y"]) for p in out["particles"]][1:3] == [(40.0, 41.0), (91.0, 11.0)]
    assert {o["fieldName"] for p in out["particles"] for o in p["observations"]} == {"F1", "F2", "F3"}


def test_issues(outcomes):
    for name, (_, expected) in BAD.items():
        assert outcomes[name]["status"] == 400, name
        assert [(i["path"], i["message"]) for i in outcomes[name]["issues"]] == expected, name
    assert len(outcomes["many"]["issues"]) == validate.MOST_ISSUES
    assert outcomes["null"]["status"] == 400


def test_limits(outcomes):
    assert outcomes["large"]["status"] == 413
    assert outcomes["crowded"]["status"] == 422 and outcomes["crowded"]["result"] is None
    assert outcomes["empty"]["status"] == 200 and outcomes["empty"]["result"]["totalParticles"] == 0


def test_each_body_by_itself(outcomes):
    """Dense components, odd text, and null or repeated ids don't touch other submissions."""
    # 12 observations in each of 5 fields: groups grown by joins, all full
    assert (outcomes["dense"]["status"], outcomes["dense"]["result"]["linkCount"], outcomes["dense"]["result"]["totalParticles"]) == (200, 48, 12)
    lone = outcomes["lone"]
    assert (lone["status"], lone["result"]["totalParticles"]) == (200, 1)
    assert [(o["fieldName"], o["particleId"]) for p in lone["result"]["particles"] for o in p["observations"]] == [("\\ud83d", "\\ud800"), ("\\ud83d", "😀")]
    several = [(r["submission_id"], r["status"], r["result"] and r["result"]["totalParticles"]) for r in outcomes["several"]]
    assert sorted(several, key=str) == [("twice", 200, 0), ("twice", 200, 5), (None, 200, 5), (None, 400, None)]


def test_given_up_alone(spark, monkeypatch):
    monkeypatch.setattr(groups, "MOST_GROUPS", 500)
    dense = [field([{"id": f"{f}-{i}", "x": i % 4, "y": i // 4, "category": "PE"} for i in range(12)]) for f in range(5)]
    rows = [("dense", json.dumps(doc(tolerance=2, fields=dense))), ("sample", json.dumps(doc()))]
    found = {r["submission_id"]: r for r in process_submissions(spark.createDataFrame(rows, "submission_id string, body string")).collect()}
    assert (found["dense"]["status"], found["dense"]["result"], found["dense"]["error_message"]) == (422, None, forest.SAY_WORK)
    assert found["sample"]["status"] == 200


def test_cap(spark):
    rows = [(s, i, f"p{i}", "m") for s, n in (("a", 5), ("b", 3), ("c", 1)) for i in range(n)]
    out = validate.capped(spark.createDataFrame(rows, "submission_id string, place int, path string, message string"), ["place"], 3).collect()
    assert sorted((r["submission_id"], r["ord"], r["path"]) for r in out) == [(s, i, f"p{i}") for s, n in (("a", 3), ("b", 3), ("c", 1)) for i in range(n)]


def test_empty_table(spark):
    assert process_submissions(spark.createDataFrame([], "submission_id string, body string")).count() == 0


def test_functions(spark):
    row = spark.createDataFrame([("﻿　 a b \t", "😀é")], "t string, u string").select(trimmed("t").alias("t"), utf16_length("u").alias("n")).first()
    assert (row["t"], row["n"]) == ("a b", 3)
    values = spark.createDataFrame([(0.125,), (-0.001,), (-2.5,)], "v double").select(round2(__import__("pyspark").sql.functions.col("v")).alias("r")).collect()
    assert [v["r"] for v in values] == [0.13, 0.0, -2.5] and str(values[1]["r"]) == "0.0"


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"submission_id": "s", "body": json.dumps(doc())}) + "\n")
    query = write_outcomes(submission_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [200]
    shared = spark.conf.get("spark.checkpoint.dir")
    assert not [x for x in os.listdir(shared) if x.startswith("scratch-")]


def test_scratch_is_removed_after_failures(spark):
    with pytest.raises(RuntimeError), scratch(spark):
        made = settled(spark.range(3))
        assert made.count() == 3
        raise RuntimeError
    assert not [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("scratch-")]
