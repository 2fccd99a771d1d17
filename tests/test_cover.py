"""The search of dense components against exhaustive search, the search group by group, and plain copies."""

import random
import time
from itertools import combinations

import numpy as np
import pytest

from fieldmerge.operators import cover, groups
from fieldmerge.operators.cover import FieldForest, WorkExceeded, best_partition
from fieldmerge.operators.expand import expand
from fieldmerge.operators.forest import best_forest
from fieldmerge.plans.adjudicate import adjudicate
from fieldmerge.sources.submissions import SUBMISSION
from test_forest import exhaustive


def legal(fields, links):
    """All legal groups and the weights of their best trees, as the search takes them."""
    near = {}
    for (a, b), w in links.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    found = level = {(v,): 0 for v in range(len(fields))}
    while level:
        grown = {}
        for group, weight in level.items():
            for m in group:
                for v, w in near.get(m, ()):
                    if fields[v] not in {fields[x] for x in group}:
                        key = tuple(sorted((*group, v)))
                        grown[key] = min(grown.get(key, weight + w), weight + w)
        found, level = found | grown, grown
    n, order = len(fields), sorted(found, key=lambda g: (len(g), g))
    width = max(map(len, order))
    return np.array([[*g, *[n] * (width - len(g))] for g in order]), np.array([found[g] for g in order])


def scattered(fields, size, tolerance, seed):
    rnd = random.Random(seed)
    points = [(rnd.randrange(size), rnd.randrange(size)) for _ in fields]
    apart = lambda a, b: (abs(points[a][0] - points[b][0]), abs(points[a][1] - points[b][1]))
    links = {(a, b): sum(apart(a, b)) for a, b in combinations(range(len(fields)), 2) if fields[a] != fields[b] and max(apart(a, b)) <= tolerance}
    ranks = list(range(len(fields)))
    rnd.shuffle(ranks)
    return points, links, ranks


def test_against_exhaustive_search():
    rnd, tried = random.Random(11), 0
    while tried < 200:
        fields = sorted(rnd.randrange(rnd.randint(2, 5)) for _ in range(rnd.randint(2, 8)))
        _, links, ranks = scattered(fields, rnd.choice([1, 2, 4]), rnd.choice([0, 1, 2]), tried)
        if not 1 <= len(links) <= 11:
            continue
        tried += 1
        key, chosen = exhaustive(fields, ranks, links)
        assert best_partition(fields, ranks, *legal(fields, links)) == (-key[0], key[1], chosen)


def test_against_the_search_group_by_group():
    rnd = random.Random(12)
    for seed in range(400):
        fields = sorted(rnd.randrange(rnd.randint(2, 6)) for _ in range(rnd.randint(2, 14)))
        points, links, ranks = scattered(fields, rnd.choice([1, 2, 3, 6]), rnd.choice([1, 2, 3]), seed)
        assert best_partition(fields, ranks, *legal(fields, links)) == best_forest(fields, ranks, points, links, work=10**7)


@pytest.mark.parametrize("fields, each, size, tolerance, seconds", [(5, 6, 100, 85, 10), (3, 60, 30, 6, 30), (4, 50, 60, 8, 60)])
def test_dense_and_large_components(fields, each, size, tolerance, seconds):
    fields = [f for f in range(fields) for _ in range(each)]
    points, links, ranks = scattered(fields, size, tolerance, 1)
    every = legal(fields, links)
    start = time.time()
    count, weight, chosen = best_partition(fields, ranks, *every)
    assert time.time() - start < seconds
    forest = FieldForest(1 << f for f in fields)
    assert all(forest.union(a, b) for a, b in chosen) and (count, weight) == (len(chosen), sum(links[e] for e in chosen))
    greedy = FieldForest(1 << f for f in fields)
    taken = [w for w, e in sorted((w, e) for e, w in links.items()) if greedy.union(*e)]
    assert (-count, weight) <= (-len(taken), sum(taken)) and count <= len(fields) - each


def test_gives_up_loudly(monkeypatch):
    fields = [i // 6 for i in range(30)]
    _, links, ranks = scattered(fields, 100, 85, 1)
    with pytest.raises(WorkExceeded):
        best_partition(fields, ranks, *legal(fields, links), pivots=20)
    monkeypatch.setattr(cover, "TIGHT", 30)
    with pytest.raises(WorkExceeded):
        best_partition(fields, ranks, *legal(fields, links))


def test_rollback_against_a_plain_copy():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randint(2, 12)
        masks = [1 << rnd.randrange(5) for _ in range(n)]
        forest, trees, saved = FieldForest(masks), [{v} for v in range(n)], []
        for _ in range(60):
            turn = rnd.random()
            if turn < 0.2:
                saved.append((forest.checkpoint(), [set(t) for t in trees]))
            elif turn < 0.35 and saved:
                state, trees = saved.pop(rnd.randrange(len(saved)))
                saved = [s for s in saved if s[0] <= state]
                forest.rollback(state)
            else:
                a, b = rnd.sample(range(n), 2)
                one, two = next(t for t in trees if a in t), next(t for t in trees if b in t)
                held = lambda t: {masks[v] for v in t}
                can = one is not two and not held(one) & held(two)
                assert forest.union(a, b) == can
                if can:
                    trees = [t for t in trees if t is not one and t is not two] + [one | two]
            for t in trees:
                assert len({forest.root(v) for v in t}) == 1
                assert forest.masks[forest.root(min(t))] == sum({masks[v] for v in t})
            assert len({forest.root(v) for v in range(n)}) == len(trees)


def observations(spark, bodies):
    rows = [(name, tolerance, [{"name": None, "offset": {"x": 0, "y": 0}, "particles": [{"id": f"{f}-{i}", "x": x, "y": y, "category": "c"} for i, (x, y) in enumerate(points)]} for f, points in enumerate(fields)]) for name, tolerance, fields in bodies]
    return expand(spark.createDataFrame(rows, SUBMISSION))


def test_groups_grown_by_joins(spark):
    rnd = random.Random(9)
    bodies = [(f"s{k}", 2, [[(rnd.randrange(5), rnd.randrange(5)) for _ in range(rnd.randint(0, 3))] for _ in range(4)]) for k in range(12)]
    done = adjudicate(observations(spark, bodies))
    from fieldmerge.operators.candidates import with_component
    from fieldmerge.operators.forest import _ranked

    keys = ["submission_id", "component"]
    nodes = _ranked(done.observations, done.components).select(*keys, "uid", "field_idx", "id_rank")
    inner = with_component(done.links, done.components).select(*keys, "a_uid", "b_uid", "w")
    grown, over = groups.legal_groups(nodes, inner)
    assert over.isEmpty()
    expected = {}
    for r in nodes.collect():
        expected.setdefault(tuple(r)[:2], ([], {}))[0].append((r["uid"], r["field_idx"]))
    for r in inner.collect():
        expected[tuple(r)[:2]][1][r["a_uid"], r["b_uid"]] = r["w"]
    got = {}
    for r in grown.collect():
        got.setdefault(tuple(r)[:2], {})[tuple(r["members"])] = r["weight"]
    for key, (of, links) in expected.items():
        of = sorted(of)
        place = {u: i for i, (u, _) in enumerate(of)}
        rows, weights = legal([f for _, f in of], {(place[a], place[b]): w for (a, b), w in links.items()})
        assert got[key] == {tuple(of[v][0] for v in row if v < len(of)): w for row, w in zip(rows.tolist(), weights.tolist(), strict=True)}
    chosen = sorted(tuple(r) for r in done.chosen.select(*keys, "a_uid", "b_uid").collect())
    assert sorted(tuple(r) for r in groups.searched_groups(nodes, inner).collect()) == chosen


def test_too_many_groups_are_given_up_alone(spark, monkeypatch):
    bodies = [("dense", 3, [[(i, i) for i in range(3)]] * 4), ("small", 1, [[(0, 0)], [(0, 1)], [(1, 1)]])]
    done = adjudicate(observations(spark, bodies))
    from fieldmerge.operators.candidates import with_component
    from fieldmerge.operators.forest import _ranked

    keys = ["submission_id", "component"]
    nodes = _ranked(done.observations, done.components).select(*keys, "uid", "field_idx", "id_rank")
    inner = with_component(done.links, done.components).select(*keys, "a_uid", "b_uid", "w")
    monkeypatch.setattr(groups, "MOST_GROUPS", 20)
    out = [tuple(r) for r in groups.searched_groups(nodes, inner).collect()]
    assert [r for r in out if r[0] == "dense"] == [("dense", 0, None, None)] and len([r for r in out if r[0] == "small"]) == 2
