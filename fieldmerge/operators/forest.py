"""The optimal set of links: fewest objects, then least total distance, then least partner lists.

An object is a tree of links with at most one observation of each field. Components of one link choose it in plain
DataFrame operations. The others are one row each; a small exact search runs over these rows. Where that takes too many
steps, the component's legal groups are grown by joins, and the best partition among them is found (groups, cover).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmerge.functions.text import utf16_key
from fieldmerge.operators.candidates import with_component
from fieldmerge.operators.cover import WorkExceeded
from fieldmerge.operators.groups import searched_groups
from fieldmerge.plans.settled import settled

#: Groups of observations that the first search may try in a component before its groups are grown by joins.
WORK = 10_000
#: What is said of a submission with a component that is given up there too.
SAY_WORK = "a component needs more groups or steps than the exact search may take"


def best_forest(fields: list[int], ranks: list[int], points: list[tuple[int, int]], links: dict[tuple[int, int], int], work: int = WORK) -> tuple[int, int, list[tuple[int, int]]]:
    """(links, weight, chosen links) of the best forest over nodes 0 .. n - 1 in uid order.

    A set of nodes is a bit mask. The least node by position must be in some group: a connected set of different
    fields, joined by its best spanning tree. For each such group the rest falls into parts that are solved by
    themselves. Keys (-links, weight, partner lists in node order) add up over parts, so the least total is made of
    the least parts."""
    near = [0] * len(fields)
    for a, b in links:
        near[a] |= 1 << b
        near[b] |= 1 << a
    spatial = {v: i for i, v in enumerate(sorted(range(len(fields)), key=lambda v: (points[v], v)))}
    spent = 0

    def members(mask):
        while mask:
            yield (mask & -mask).bit_length() - 1
            mask &= mask - 1

    def part_of(node, mask):
        seen = grown = 1 << node
        while grown:
            around = 0
            for v in members(grown):
                around |= near[v]
            grown = around & mask & ~seen
            seen |= grown
        return seen

    trees: dict[int, tuple] = {}

    def tree(mask):
        """The key of a group's best spanning tree, with its links."""
        if mask not in trees:
            nodes = list(members(mask))
            inner = [(a, b) for a, b in combinations(nodes, 2) if (a, b) in links]
            best = None
            for chosen in combinations(inner, len(nodes) - 1):
                up = {v: v for v in nodes}
                for a, b in chosen:
                    while up[a] != a:
                        a = up[a]
                    while up[b] != b:
                        b = up[b]
                    if a == b:
                        break
                    up[b] = a
                else:
                    partners = {v: tuple(sorted([ranks[b] for a, b in chosen if a == v] + [ranks[a] for a, b in chosen if b == v])) for v in nodes}
                    key = (sum(links[e] for e in chosen), [partners[v] for v in nodes])
                    if best is None or key < best[0]:
                        best = (key, chosen, partners)
            trees[mask] = best
        return trees[mask]

    def groups(node, mask):
        """Connected groups with the node, of different fields, each once."""
        stack = [(1 << node, 1 << fields[node], near[node] & mask, 1 << node)]
        while stack:
            group, used, edge, closed = stack.pop()
            yield group
            for v in members(edge & ~closed):
                closed |= 1 << v
                if not used >> fields[v] & 1:
                    stack.append((group | 1 << v, used | 1 << fields[v], edge | near[v] & mask, closed))

    def bound(mask):
        """Links that a set can have at most: each observation of its fullest field is in an object of its own."""
        count: dict[int, int] = {}
        for v in members(mask):
            count[fields[v]] = count.get(fields[v], 0) + 1
        return sum(count.values()) - max(count.values(), default=0)

    solved: dict[int, tuple] = {0: (0, 0, {}, ())}

    def solve(mask):
        nonlocal spent
        if mask in solved:
            return solved[mask]
        pivot = min(members(mask), key=spatial.__getitem__)
        part = part_of(pivot, mask)
        if part != mask:
            one, two = solve(part), solve(mask & ~part)
            solved[mask] = (one[0] + two[0], one[1] + two[1], one[2] | two[2], one[3] + two[3])
            return solved[mask]
        nodes, best, best_key = list(members(mask)), None, None
        for group in sorted(groups(pivot, mask), key=lambda g: -g.bit_count()):
            spent += 1
            if spent > work:
                raise WorkExceeded(f"more than {work} groups in a component of {len(fields)} observations and {len(links)} links")
            count, rest = group.bit_count() - 1, mask & ~group
            if best is not None and count + bound(rest) < best[0]:
                continue
            (weight, _), chosen, partners = tree(group)
            more = solve(rest)
            found = (count + more[0], weight + more[1], partners | more[2], chosen + more[3])
            if best is None or (-found[0], found[1]) <= best_key[:2]:
                key = (-found[0], found[1], [found[2][v] for v in nodes])
                if best is None or key < best_key:
                    best, best_key = found, key
        solved[mask] = best
        return best

    done = solve((1 << len(fields)) - 1)
    return done[0], done[1], sorted(done[3])


#: Components that are Python objects at a time: one may have thousands of links.
FEW = 64


def _each(batches: Iterator[pa.RecordBatch], solve: Callable[[dict], list[tuple]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What solve finds for each row (submission_id, component, links, nodes), a few rows at a time."""
    for batch in batches:
        own = [batch.schema.field("submission_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for at in range(0, batch.num_rows, FEW):
            found = [(row["submission_id"], row["component"], *x) for row in batch.slice(at, FEW).to_pylist() for x in solve(row)]
            columns = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, own)], names)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(row):
        nodes = sorted(row["nodes"], key=lambda x: x["uid"])
        place = {x["uid"]: i for i, x in enumerate(nodes)}
        links = {(place[x["a_uid"]], place[x["b_uid"]]): x["w"] for x in row["links"]}
        try:
            _, _, chosen = best_forest([x["field_idx"] for x in nodes], [x["id_rank"] for x in nodes], [(x["filter_x"], x["filter_y"]) for x in nodes], links)
            return [(nodes[a]["uid"], nodes[b]["uid"]) for a, b in chosen]
        except WorkExceeded:
            return [(None, None)]

    return _each(batches, solve, ["submission_id", "component", "a_uid", "b_uid"])


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(row):
        found = []
        taken = {x["uid"]: 1 << x["field_idx"] for x in row["nodes"]}
        up = {x["uid"]: x["uid"] for x in row["nodes"]}
        for link in sorted(row["links"], key=lambda x: (x["w"], x["a_uid"], x["b_uid"])):
            a, b = link["a_uid"], link["b_uid"]
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            if a != b and not taken[a] & taken[b]:
                up[b] = a
                taken[a] |= taken[b]
                found.append((link["a_uid"], link["b_uid"], link["w"]))
        return found

    return _each(batches, solve, ["submission_id", "component", "a_uid", "b_uid", "w"])


def _ranked(observations: DataFrame, components: DataFrame) -> DataFrame:
    """Observations with component and id_rank, their place by id within it."""
    rank = F.row_number().over(Window.partitionBy("submission_id", "component").orderBy(utf16_key(F.col("particle_id"))))
    return observations.join(components, ["submission_id", "uid"]).withColumn("id_rank", rank)


def _rows(observations: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """One row for each component: links (a_uid, b_uid, w) and nodes (uid, field_idx, id_rank, filter_x, filter_y)."""
    keys = ["submission_id", "component"]
    grouped = links.groupBy(*keys).agg(F.collect_list(F.struct("a_uid", "b_uid", "w")).alias("links"))
    nodes = _ranked(observations, components).groupBy(*keys).agg(F.collect_list(F.struct("uid", "field_idx", "id_rank", "filter_x", "filter_y")).alias("nodes"))
    return grouped.join(nodes, keys)


def searched_links(observations: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """(submission_id, component, a_uid, b_uid): the links of the best forest; of a component that is given up one row
    without links."""
    own = with_component(links, components).withColumn("n", F.count("*").over(Window.partitionBy("submission_id", "component")))
    columns = ["submission_id", "component", "a_uid", "b_uid"]
    kind = links.schema["submission_id"].dataType.simpleString()
    solved = _rows(observations, own.where("n > 1"), components).mapInArrow(_solved, f"submission_id {kind}, component int, a_uid int, b_uid int")
    first = settled(own.where("n = 1").select(*columns).unionByName(solved))
    dense = settled(first.where("a_uid is null").select("submission_id", "component"))
    if dense.isEmpty():
        return first
    keys = ["submission_id", "component"]
    nodes = settled(_ranked(observations, components).join(dense, keys, "left_semi").select(*keys, "uid", "field_idx", "id_rank"))
    inner = settled(with_component(links, components).join(dense, keys, "left_semi").select(*columns, "w"))
    return first.where("a_uid is not null").unionByName(searched_groups(nodes, inner))


def with_links(searched: DataFrame, links: DataFrame) -> DataFrame:
    """(submission_id, component, a_uid, b_uid, a_id, b_id, w) of the links that were found."""
    return searched.join(links, ["submission_id", "a_uid", "b_uid"]).select("submission_id", "component", "a_uid", "b_uid", "a_id", "b_id", "w")


def chosen_links(observations: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """The links of the best forest, as with_links; fails on a component that is given up."""
    searched = searched_links(observations, links, components)
    failed = F.raise_error(F.format_string(SAY_WORK + " (submission %s, component %d)", F.col("submission_id").cast("string"), F.col("component")))
    return with_links(searched.withColumn("a_uid", F.when(F.col("a_uid").isNull(), failed.cast("int")).otherwise(F.col("a_uid"))), links)


def greedy_links(observations: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """(submission_id, component, a_uid, b_uid, w): links taken in order of distance, then uids, where they join two trees
    without a common field. A first guess, not the best forest, unless no field occurs twice."""
    kind = links.schema["submission_id"].dataType.simpleString()
    weight = links.schema["w"].dataType.simpleString()
    return _rows(observations, with_component(links, components), components).mapInArrow(_greedy, f"submission_id {kind}, component int, a_uid int, b_uid int, w {weight}")


def forest_values(chosen: DataFrame) -> DataFrame:
    """(submission_id, component, n_links, weight) of each component's best forest."""
    return chosen.groupBy("submission_id", "component").agg(F.count("*").alias("n_links"), F.sum("w").alias("weight"))


def partner_lists(observations: DataFrame, chosen: DataFrame) -> DataFrame:
    """(submission_id, uid, particle_id, partners): ids of each observation's chosen partners in UTF-16 order."""
    ends = [chosen.select("submission_id", F.col(f"{a}_uid").alias("uid"), F.col(f"{b}_id").alias("partner")) for a, b in ("ab", "ba")]
    listed = reduce(DataFrame.union, ends).groupBy("submission_id", "uid").agg(F.transform(F.array_sort(F.collect_list(F.struct(utf16_key(F.col("partner")).alias("k"), "partner"))), lambda x: x["partner"]).alias("partners"))
    return observations.join(listed, ["submission_id", "uid"], "left").select("submission_id", "uid", "particle_id", F.coalesce("partners", F.array().cast("array<string>")).alias("partners"))
