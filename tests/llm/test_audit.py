"""The filter audit against applying the filters in each order."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from fieldmerge.llm import audit


def by_hand(rows, labels):
    """{(part, order, step): counts} by walking each document through each order."""
    firsts, marks = {}, {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    for i, quality, toxic in labels:
        if i is not None:
            known = marks.setdefault(i, [0, 0])
            known[0] |= quality == 1
            known[1] |= toxic == 1
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": re.search("[#$%&*|]", t) is not None, "E": i is not None and i > firsts[t]}
        docs.append((source or "", {f for f, bad in fails.items() if bad}, marks.get(i, [0, 0])))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(lost)
                out[part, order, step] = (len(left), len(lost), sum(f in d[0] for d in gone), sum(d[0] == {f} for d in own), sum(d[1][0] for d in lost), sum(d[1][1] for d in lost))
                gone = gone + lost
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as good", "2 as n", "3 as part", "doc_id as applied")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    out = audit.filter_audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *audit.COUNTS, "shapley"]
    return {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}, out


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(6)
    pool = [None, "", " \t", "ABC def", "# x", " ".join("abcdefghij"[i % 10] for i in range(60)), " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(55)), "a\x0bb c " * 30, "é " * 49, "x" * 100_000, " ".join(f"n{i}$" for i in range(51))]
    rows = [(i, rnd.choice(pool) if rnd.random() < 0.7 else f"{i} " + (rnd.choice(pool) or ""), rnd.choice(["a", "a", "a", "b", None, ""])) for i in range(120)]
    rows += [(None, pool[6], "a"), (None, pool[6], "c"), (3, pool[6], "b"), (3, pool[6], "b"), (3, pool[6], "a"), (200, pool[6], "a")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 130, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return rows, labels


def test_against_walking_each_order(spark, table):
    got, _ = found(spark, *table)
    expected = by_hand(*table)
    assert len(got) == 600 * 4 and got == expected


def test_empty_tables(spark, table):
    assert found(spark, [], [])[0] == {}
    rows = table[0][:5]
    assert found(spark, rows, [])[0] == by_hand(rows, [])


def test_types(spark, table):
    _, out = found(spark, *table)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "string", "int", *["bigint"] * 7]


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        audit.steps(spark.range(1), "ABCDEFG")
