"""Mixing and sharding against plain computations."""

import random
import re
import zlib

import pytest

from fieldmerge.llm import mixing, sharding


def level(sums, weights=(3, 1, 2)):
    names = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [s for s in sums if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sums.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sums[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sums[s]
            rest -= target[s]
            open_.remove(s)
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"]) if i > 3 else "nil", i) for i in range(600)]
    rows += [(600, None, "a", 0), (601, "", "b", 0), (602, "a b\t\n\x0b\x0c\rc d ", "b", 0), (None, "no id here", "b", 0), (603, "x" * 200_000, "b", 0)]
    rows = [(r[0], "" if r[2] == "nil" else r[1], r[2], r[3]) for r in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_copies int")


def test_plan(docs):
    rows, table = docs
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s, _ in rows:
        sums[s] = sums.get(s, 0) + size(t)
    targets = level(sums)
    plan = mixing.mixing_plan(table).collect()
    again = {r["doc_id"]: r for r in mixing.mixing_plan(table.repartition(7)).collect()}
    assert len(plan) == len(rows)
    taken = dict.fromkeys(sums, 0)
    for r in plan:
        t = next(t for i, t, _, _ in rows if i == r["doc_id"])
        assert r["size"] == size(t) and r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] and again[r["doc_id"]] == r
        taken[r["source"]] += r["taken"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sums.values()))
    assert sum(taken.values()) == pytest.approx(sum(targets.values()), rel=0.1)


def test_mixed_rows(docs):
    rows, table = docs
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixing_plan(table).collect()}
    out = mixing.mixed(table)
    assert out.columns == table.columns
    counts = {}
    for r in out.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {k: v for k, v in copies.items() if v}


def test_shards(docs):
    rows, table = docs
    for shards, parts in ((7, 50_000), (3, 20)):
        sharding.PART_ROWS, before = parts, sharding.PART_ROWS
        out = sharding.sharded(table, shards=shards, keep=("text", "source", "_mix_copies")).collect()
        sharding.PART_ROWS = before
        assert len(out) == len(rows)
        sums = [0] * shards
        for r in out:
            data = (r["text"] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
            sums[r["shard"]] += r["size"]
        for k in range(shards):
            slots = sorted(r["slot"] for r in out if r["shard"] == k)
            assert slots == list(range(len(slots)))
        total = sum(sums) - 200_016  # but for the one document that is larger than a shard
        assert all(s <= total / shards * 1.3 + 200_016 for s in sums)


def test_even_shards_and_hot_text(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(2000 + i, "the same text") for i in range(1000)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    sums = [sum(r["size"] for r in out if r["shard"] == k) for k in range(10)]
    assert max(sums) <= 1.05 * min(sums)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixing_plan(none).count() == mixing.mixed(none).count() == sharding.sharded(none).count() == 0


def test_a_text_keeps_to_one_shard(spark):
    rows = [(i, "x" * (50 + i % 7)) for i in range(400)] + [(1000 + i, f"group {i % 9} " * 30) for i in range(90)] + [(5000, "y" * 4000)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    text = dict(rows)
    shards = {}
    for r in out:
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in shards.items() if t.startswith(("group", "y")))
    assert len(out) == len(rows) and len({(r["shard"], r["slot"]) for r in out}) == len(rows)


def test_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 3 + [(None, "a b c", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixing_plan(docs).count() == 5
    out = sharding.sharded(docs, shards=3).collect()
    assert len(out) == 5 and len({(r["shard"], r["slot"]) for r in out}) == 5


def test_targets_of_many_sources(spark):
    rnd = random.Random(11)
    sums = {f"s{i}": rnd.choice([0, 1, 5, 40, rnd.randint(1, 5000)]) for i in range(3000)} | {None: 300, "é": 7, "Z": 90_000}
    rows = [(s, n // 2) for s, n in sums.items()] + [(s, n - n // 2) for s, n in sums.items()]
    found = mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(5)).collect()
    wanted = level(sums)
    assert len(found) == len(sums) and all(r["target"] == pytest.approx(wanted[r["source"]], rel=1e-9) and r["source_size"] == sums[r["source"]] for r in found)


def test_shards_by_plain_order(spark):
    """Boundaries are where the rows' order by (hash of text, doc_id) reaches each share, to the largest row."""
    from pyspark.sql import functions as F

    rnd = random.Random(12)
    rows = [(i, rnd.choice([None, "", f"text {rnd.randint(0, 400)} " * rnd.randint(1, 9)])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.sharded(docs, shards=8, whole_group=0.0, tolerance=0.0).collect()}
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(got, key=lambda i: (hashed[i], i))
    assert [got[i]["shard"] for i in order] == sorted(r["shard"] for r in got.values())
    total, below, largest = sum(r["size"] for r in got.values()), 0, max(r["size"] for r in got.values())
    for i, before in zip(order[1:], order, strict=False):
        below += got[before]["size"]
        if got[i]["shard"] != got[before]["shard"]:
            group = [j for j in order if hashed[j] == hashed[i]]
            inside = hashed[i] == hashed[before]
            room = 0 if inside else largest + sum(got[j]["size"] for j in group)
            assert got[i]["shard"] == got[before]["shard"] + 1 and abs(below - total * got[i]["shard"] / 8) <= max(room, largest)
    for k in range(8):
        own = [i for i in order if got[i]["shard"] == k]
        assert sorted(got[i]["slot"] for i in own) == list(range(len(own)))
