"""The solver against hand-made cases and exhaustive search."""

import random
from itertools import combinations

import pytest

from fieldmerge.operators import components
from fieldmerge.operators.expand import expand
from fieldmerge.operators.forest import WorkExceeded, best_forest
from fieldmerge.plans.adjudicate import adjudicate
from fieldmerge.sources.submissions import SUBMISSION

CASES = {
    # name: (tolerance, fields of (id, x, y, category), chosen links, objects)
    "greedy_trap": (1, [[("A1", 0, 0), ("A2", 2, 0)], [("B1", 1, 0), ("B2", 0, 1)]], {("A1", "B2"), ("A2", "B1")}, 2),
    "min_weight": (3, [[("A1", 0, 0), ("A2", 2, 0)], [("B1", 2, 1), ("B2", 0, 1)]], {("A1", "B2"), ("A2", "B1")}, 2),
    "triangle": (0, [[("P1", 0, 0)], [("P2", 0, 0)], [("P3", 0, 0)]], {("P1", "P2"), ("P2", "P3")}, 1),
    "five_chain": (0, [[(f"P{i}", 0, 0)] for i in range(1, 6)], {("P1", "P2"), ("P2", "P3"), ("P3", "P4"), ("P4", "P5")}, 1),
    "one_per_field": (1, [[("A1", 0, 0), ("A2", 0, 2)], [("B1", 0, 1)]], {("A2", "B1")}, 2),
    "category": (5, [[("A1", 0, 0, "PE")], [("B1", 0, 0, "PP")]], set(), 2),
    "same_field": (10, [[("A1", 0, 0), ("A2", 1, 1)], [("B1", 50, 50)]], set(), 3),
    "inside": (4, [[("A1", 0, 0)], [("B1", 3, 4)]], {("A1", "B1")}, 1),
    "outside_x": (4, [[("A1", 0, 0)], [("B1", 5, 0)]], set(), 2),
    "outside_y": (4, [[("A1", 0, 0)], [("B1", 0, 5)]], set(), 2),
    "chain": (2, [[("A1", 0, 0)], [("B1", 2, 0)], [("C1", 4, 0)]], {("A1", "B1"), ("B1", "C1")}, 1),
    "multi_field": (2, [[("A1", 0, 0), ("A2", 10, 0)], [("B1", 1, 1), ("B2", 11, 1)], [("C1", 0, 1)]], {("A1", "C1"), ("B1", "C1"), ("A2", "B2")}, 2),
    "string_order": (0, [[("P10", 0, 0)], [("P9", 0, 0)], [("P2", 0, 0)]], {("P10", "P2"), ("P9", "P2")}, 1),
}


def test_hand_made_cases(spark):
    rows = []
    for name, (tolerance, fields, _, _) in CASES.items():
        typed = [{"name": None, "offset": {"x": 10 * i, "y": 0}, "particles": [{"id": p[0], "x": p[1] - 10 * i, "y": p[2], "category": p[3] if len(p) > 3 else "PE"} for p in f]} for i, f in enumerate(fields)]
        rows.append((name, tolerance, typed))
    observations = expand(spark.createDataFrame(rows, SUBMISSION))
    for banded in (False, True):
        done = adjudicate(observations, banded)
        chosen, objects = {}, {}
        for r in done.chosen.collect():
            chosen.setdefault(r["submission_id"], set()).add((r["a_id"], r["b_id"]))
        for r in done.particles.collect():
            objects.setdefault(r["submission_id"], []).append(r)
        for name, (_, fields, links, count) in CASES.items():
            assert chosen.get(name, set()) == links, name
            assert len(objects[name]) == count == sum(map(len, fields)) - len(links), name
            assert sorted(p["particle_no"] for p in objects[name]) == list(range(1, count + 1))
    first = min(objects["inside"], key=lambda p: p["particle_no"])
    assert (first["rep_x"], first["rep_y"], first["links"][0]["manhattan"]) == (1.5, 2.0, 7)
    assert [o["field_name"] for o in first["observations"]] == ["F1", "F2"]


def test_components_by_joins(spark, monkeypatch):
    rnd = random.Random(8)
    links = [(s, "c", a, b) for s in "xy" for a, b in ({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(35)} | {(i, i + 1) for i in range(100, 140)})]
    table = spark.createDataFrame(links, "submission_id string, category string, a_uid int, b_uid int")
    expected = sorted(components.components(table).collect())
    assert len({r["component"] for r in expected}) > 3
    monkeypatch.setattr(components, "MOST_IN_ROW", 60)
    assert sorted(components.components(table).collect()) == expected


def exhaustive(fields, ranks, links):
    edges = sorted(links)
    best = None
    for size in range(len(edges) + 1):
        for chosen in combinations(edges, size):
            tree = list(range(len(fields)))
            legal = True
            for a, b in chosen:
                one, two = tree[a], tree[b]
                mine = {fields[v] for v in range(len(fields)) if tree[v] == one}
                other = {fields[v] for v in range(len(fields)) if tree[v] == two}
                if one == two or mine & other:
                    legal = False
                    break
                tree = [one if t == two else t for t in tree]
            if legal:
                partners = [sorted([ranks[b] for a, b in chosen if a == v] + [ranks[a] for a, b in chosen if b == v]) for v in range(len(fields))]
                key = (-size, sum(links[e] for e in chosen), partners)
                if best is None or key < best[0]:
                    best = (key, sorted(chosen))
    return best


def test_against_exhaustive_search():
    rnd = random.Random(5)
    tried = 0
    while tried < 250:
        fields = sorted(rnd.randrange(rnd.randint(2, 5)) for _ in range(rnd.randint(2, 8)))
        points = [(rnd.randint(0, 3), rnd.randint(0, 3)) for _ in fields]
        links = {(a, b): abs(points[a][0] - points[b][0]) + abs(points[a][1] - points[b][1]) for a, b in combinations(range(len(fields)), 2) if fields[a] != fields[b] and rnd.random() < 0.5}
        if len(links) > 11:
            continue
        tried += 1
        ranks = list(range(len(fields)))
        rnd.shuffle(ranks)
        key, chosen = exhaustive(fields, ranks, links)
        count, weight, found = best_forest(fields, ranks, points, links)
        assert (-count, weight, found) == (key[0], key[1], chosen)


def test_gives_up_loudly():
    fields = [i // 6 for i in range(24)]
    links = {(a, b): 0 for a, b in combinations(range(24), 2) if fields[a] != fields[b]}
    with pytest.raises(WorkExceeded):
        best_forest(fields, list(range(24)), [(0, 0)] * 24, links, work=500)
