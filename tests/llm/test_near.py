"""Near duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from fieldmerge.llm import minhash


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    for n in (3, 40, 400, 3000):
        shared = rnd.integers(1, 1 << 63, n).astype(np.uint64)
        one, two = (np.sort(np.append(shared, rnd.integers(1, 1 << 63, n // 3).astype(np.uint64))) for _ in range(2))
        a = minhash.signatures(np.append(one, two), np.array([0, len(one), len(one) + len(two)]), 250)
        assert abs((a[0] == a[1]).mean() - n / (n + 2 * (n // 3))) < 0.15
        assert (a != 0xFFFFFFFF).all()


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "X", "the"]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one TWO"), (105, "one two three"), (106, "to " * 50), (107, "To " * 80)]
    for g in range(25):
        base = rnd.choices(vocabulary, k=rnd.randint(5, 90))
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows) + 1000, " ".join(copy)))
    rnd.shuffle(rows)
    expected = brute(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 3)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert out == expected


def test_odd_rows(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "A b c d e f g"), (9, "a b c d e f g"), (None, "u v w x y z"), (4, "x " * 60_000 + "y")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [("4", "4", True), ("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "7", False), ("None", "None", False)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [0, 3, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (500, 400)]
    out = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert out == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 200, 300), 100), 400: 400, 500: 400}
