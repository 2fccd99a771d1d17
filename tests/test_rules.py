"""The rules as expressions against the inspector, bodies as bytes, responses as text, and bounds of link counts."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fieldmerge.operators import candidates, respond, rules, validate
from fieldmerge.operators.expand import expand
from fieldmerge.plans.adjudicate import process_submissions
from fieldmerge.sources.submissions import SUBMISSION
from test_submissions import BAD, doc, field

SCALARS = [None, True, 0, 1, -1, 0.5, 1e6, 1000001, "", "a", " x ", "x" * 65, "😀" * 26, [], {}, [1], {"x": 1}, 1.0, 1e2, -0.0, "　"]


def changed(rnd, x):
    if rnd.random() < 0.12:
        return rnd.choice(SCALARS)
    if isinstance(x, dict):
        return {k: changed(rnd, v) for k, v in x.items() if rnd.random() > 0.05}
    return [changed(rnd, v) for v in x] if isinstance(x, list) else x


def test_expressions_against_the_inspector(spark):
    rnd = random.Random(3)
    whole = json.dumps(doc())
    bodies = [b for b, _ in BAD.values()] + [whole, whole + " x", whole + "}", whole + "\x00", '{"a":1},"x":2', '{}],[', None, "", " ", "﻿{}", "nul", '{"tolerance":1,"tolerance":2}', '{"tolerance":1' + "0" * 5000 + "}", "[" * 900 + "]" * 900]
    bodies += [json.dumps(changed(rnd, doc()), ensure_ascii=rnd.random() < 0.5) for _ in range(500)]
    table = spark.createDataFrame(list(enumerate(bodies)), "submission_id int, body string")
    got = {}
    for r in rules.inspected(table).collect():
        got.setdefault(r["submission_id"], []).append(tuple(r)[1:])
    for i, body in enumerate(bodies):
        assert [x[1:] for x in sorted(got[i]) if x[1] != "document"] == [x for x in validate.inspect(body) if x[0] != "document"], body
    left = rules.parsed(table).where("doc is null").count()
    assert 0 < left < 150


def test_deep_bodies(spark):
    good = json.dumps(doc())
    deep = "[" * 100_000 + "]" * 100_000
    bodies = {"array": (deep, 400, validate.SAY_BODY), "beside": (good[:-1] + f',"more":{deep}}}', 200, None), "name": (good.replace('"name": ""', f'"name": {deep}'), 400, validate.SAY_NAME), "open": (deep[:-1], 400, validate.SAY_JSON), "objects": ('{"a":' * 50_000 + "1" + "}" * 50_000, 400, validate.SAY_TOLERANCE)}
    out = {r["submission_id"]: r for r in process_submissions(spark.createDataFrame([(n, b) for n, (b, _, _) in bodies.items()], "submission_id string, body string")).collect()}
    for name, (_, status, message) in bodies.items():
        assert (out[name]["status"], out[name]["issues"][0]["message"] if message else None) == (status, message), name


def test_nested_reader_against_the_parser():
    rnd = random.Random(6)
    whole = json.dumps({"a": [1, -0.5e3, "x\\u00e9\\n", None, {"b": [], "c": {}}], "d": [[], [[True, False]]]})
    for _ in range(4000):
        text = list(whole)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randint(0, 2)] = rnd.choice(["", ",", "]", "}", "[", "{", '"', ":", "1", " ", "null", "-", "0", "\\"])
        text = "".join(text)
        try:
            expected = json.loads(text, parse_int=float, parse_constant=validate._no_constant)
        except ValueError:
            with pytest.raises(ValueError):
                validate.read_nested(text)
        else:
            assert validate.read_nested(text) == expected, text


def test_bodies_as_bytes(spark):
    good = json.dumps(doc(), ensure_ascii=False).encode()
    fill = lambda n, sign=b" ": good + sign * (n - len(good))
    odd = good.replace(b'"A1"', b'"A1\xff\xfe"')
    rows = [("fits", fill(validate.MOST_BYTES)), ("large", fill(validate.MOST_BYTES + 1)), ("odd", odd), ("odd fits", odd[:-1] + b" " * (validate.MOST_BYTES - len(odd)) + b"}"), ("odd large", fill(validate.MOST_BYTES + 1, b"\xff")), ("odd read", fill(validate.MOST_BYTES, b"\xff")), ("null", None)]
    out = {r["submission_id"]: r for r in process_submissions(spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in rows], "submission_id string, body binary")).collect()}
    assert {n: out[n]["status"] for n, _ in rows} == {"fits": 200, "large": 413, "odd": 200, "odd fits": 200, "odd large": 413, "odd read": 400, "null": 400}
    assert out["odd"]["result"]["particles"][0]["observations"][0]["particleId"] == "A1��"
    # the same bytes in a text column count as they are, not as the replacement characters they become
    text = spark.createDataFrame([("odd", bytearray(odd[:-1] + b" " * (validate.MOST_BYTES - len(odd)) + b"}"))], "submission_id string, body binary").select("submission_id", F.col("body").cast("string").alias("body"))
    assert [r["status"] for r in process_submissions(text).collect()] == [200]


def test_text_of_responses(spark):
    texts = ["", "a", 'q"\\/', "".join(map(chr, range(33))), "\x7f é😀", "\\u000B \\n"]
    shown = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(respond.quoted(F.col("t")).alias("t")).collect()]
    assert shown == [json.dumps(t, ensure_ascii=False) for t in texts]
    numbers = {0.0: "0", 40.0: "40", 0.5: "0.5", -3.07: "-3.07", 1234567.89: "1234567.89", -0.1: "-0.1", 2e6: "2000000", -2.5: "-2.5", 0.01: "0.01", -7.0: "-7"}
    shown = [r["t"] for r in spark.createDataFrame([(v,) for v in numbers], "v double").select(respond.decimal2(F.col("v")).alias("t")).collect()]
    assert shown == list(numbers.values())
    rnd = random.Random(1)
    values = [rnd.randint(-200_000_000, 200_000_000) / 100 for _ in range(2000)]
    shown = [r["t"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(respond.decimal2(F.col("v")).alias("t")).collect()]
    assert shown == [repr(v).removesuffix(".0") for v in values]


def test_sample_document(spark):
    done = respond.responses(process_submissions(spark.createDataFrame([("s", json.dumps(doc())), ("l", "x" * (validate.MOST_BYTES + 1)), ("b", "[]")], "submission_id string, body string")))
    out = {r["submission_id"]: r["response"] for r in done.collect()}
    one = json.loads(out["s"])
    assert (one["totalParticles"], [p["id"] for p in one["particles"]], one["particles"][2]["links"]) == (5, [1, 2, 3, 4, 5], [{"a": "A3", "b": "B1", "manhattan": 4}])
    assert out["s"] == json.dumps(one, ensure_ascii=False, separators=(",", ":")) and '"representative":{"x":91,"y":11}' in out["s"]
    assert json.loads(out["l"]) == {"error": {"message": validate.SAY_LARGE}}
    assert json.loads(out["b"]) == {"error": {"message": validate.SAY_REFUSED, "issues": [{"path": "", "message": validate.SAY_BODY}]}}


@pytest.fixture(scope="module")
def scattered(spark):
    rnd = random.Random(5)
    rows = []
    for name, fields, each, size, tolerance in (("a", 3, 4, 6, 2), ("b", 5, 30, 20, 3), ("c", 4, 60, 9, 1), ("d", 2, 1, 1, 0), ("e", 5, 3, 4, 0)):
        typed = [{"name": None, "offset": {"x": -5, "y": 3}, "particles": [{"id": f"{f}-{i}", "x": rnd.randrange(size) - 3, "y": rnd.randrange(size), "category": rnd.choice("pq")} for i in range(each)]} for f in range(fields)]
        rows.append((name, tolerance, typed))
    return expand(spark.createDataFrame(rows, SUBMISSION))


def counts(observations):
    links, cells = {}, {}
    rows = observations.collect()
    for a, b in combinations(sorted(rows, key=lambda r: (r["submission_id"], r["uid"])), 2):
        if (a["submission_id"], a["category"]) != (b["submission_id"], b["category"]) or a["field_idx"] == b["field_idx"]:
            continue
        t, s = a["tolerance"], a["submission_id"]
        links[s] = links.get(s, 0) + (abs(a["filter_x"] - b["filter_x"]) <= t and abs(a["filter_y"] - b["filter_y"]) <= t)
        cell = lambda r: (r["filter_x"] // (t + 1), r["filter_y"] // (t + 1))
        near = max(abs(p - q) for p, q in zip(cell(a), cell(b), strict=True))
        low, high = cells.get(s, (0, 0))
        cells[s] = low + (near == 0), high + (near <= 1)
    return links, cells


def test_planned_links_are_the_plain_ones(spark, scattered, monkeypatch):
    plain = sorted(tuple(r) for r in candidates.candidate_links(scattered).collect())
    for most in (0, 3, 70, 10**6):
        monkeypatch.setattr(candidates, "MOST_PLAIN", most)
        assert sorted(tuple(r) for r in candidates.planned_links(scattered).collect()) == plain


def test_bounds_and_refusals(spark, scattered, monkeypatch):
    links, cells = counts(scattered)
    found = {r["submission_id"]: (r["at_least"], r["at_most"]) for r in candidates.link_bounds(scattered).collect()}
    assert found == {s: c for s, c in cells.items() if c[1]}
    assert all(found[s][0] <= n <= found[s][1] for s, n in links.items() if s in found)
    for most in (0, 5, links["b"] - 1, links["b"], links["c"], 10**6):
        monkeypatch.setattr(candidates, "MOST_LINKS", most)
        assert {tuple(r) for r in candidates.refused_links(scattered).collect()} == {(s, n) for s, n in links.items() if n > most}


def test_all_rules_are_reached():
    from fieldmerge.plans.outcomes import _BROKEN

    said = {m for found in _BROKEN.values() for _, m in found}
    rules_ = {v for k, v in vars(validate).items() if k.startswith("SAY_") and k not in ("SAY_JSON", "SAY_LARGE", "SAY_UNREAD", "SAY_REFUSED")}
    assert all(any(m.startswith(rule.split("{")[0]) for m in said) for rule in rules_ if not rule.startswith("视野必须")) and validate.SAY_FIELD in said


def test_many_particles(spark):
    at_limit = doc(tolerance=0, fields=[field([{"id": f"{f}-{i}", "x": 10 * i, "y": 10 * f, "category": "c"} for i in range(n)]) for f, n in enumerate((500, 500, 500, 500, 0))])
    out = process_submissions(spark.createDataFrame([("at", json.dumps(at_limit))], "submission_id string, body string")).collect()
    assert [(r["status"], r["result"]["totalParticles"]) for r in out] == [(200, 2000)]
