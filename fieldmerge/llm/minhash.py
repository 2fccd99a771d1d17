"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

Documents with equal shingle sets are one class from the start; only one of each class is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import as_long, mix, text_blocks, word_grams, words, written

#: Words of a shingle; a link needs LINK[0] / LINK[1] of the union.
SHINGLE, LINK = 5, (75, 100)
#: A signature has BANDS x ROWS slots: a pair of similarity 0.75 shares no band with probability 6e-6.
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree less are not verified: 7.8 standard deviations below a similarity of 0.75.
LEAST_AGREEMENT = 0.45
#: What one task's union-find takes (some 50 MB).
FEW_EDGES = 200_000
#: Documents of a bucket or a family are compared in blocks of so many, and of so many shingles (8 bytes each).
BUCKET_BLOCK, BLOCK_SHINGLES = 2048, 2 << 20

_RANK, _SLOT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F)
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows of a block, ascending in each row, and the n + 1 offsets of the rows."""
    hashes, _, _, rows = words(data, at)
    grams, _, offsets = word_grams(hashes, rows, SHINGLE)
    count = np.diff(rows)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    parts, sizes = [], np.zeros(len(count), np.int64)
    whole = {int(r): hashes[rows[r] : rows[r + 1]] for r in short}
    for r in range(len(count)):
        if offsets[r] < offsets[r + 1]:
            found = np.unique(grams[offsets[r] : offsets[r + 1]])
        elif r in whole:
            seed = np.array([0x51ED270B + len(whole[r])], np.uint64)
            for w in whole[r]:
                seed = mix(seed ^ w)
            found = seed
        else:
            continue
        parts.append(found)
        sizes[r] = len(found)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: each element walks the slots in a random order of its own and offers its j-th slot the value j + r.

    All elements take step j together; a row stops as soon as every slot has a value below j + 1, since later offers
    are larger. A value is held as j in the upper 8 bits and r in the lower 24. Rows without elements stay empty."""
    n = len(offsets) - 1
    out = np.full(n * slots, _EMPTY, np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    elements, taken = sets, []
    for j in range(slots):
        if not len(elements):
            break
        salt = np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        rank = (mix((elements ^ _RANK) + salt) >> np.uint64(40)).astype(np.uint32)
        pick = j + ((mix((elements ^ _SLOT) + salt) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = pick.copy()
        for i in range(j - 1, -1, -1):  # what earlier swaps of the shuffle have put in this place
            np.copyto(slot, i, where=taken[i] == slot)
        np.minimum.at(out, row * slots + slot, np.uint32(j << 24) | rank)
        taken.append(pick)
        full = (out.reshape(n, slots) != _EMPTY).all(axis=1)
        left = ~full[row]
        if not left.all():
            elements, row, taken = elements[left], row[left], [t[left] for t in taken]
    return out.reshape(n, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for i in range(ROWS):
        keys = mix(keys ^ parts[:, :, i] * np.uint64(0x9FB21C651E98DF25))
    return keys


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), two 64-bit sums of the set that name its class, and the signature (null if the set is empty).

    Of the rows of a block with one set, only that of the least doc_id has the signature: no other can be the class's
    first, and copies needn't carry it through the shuffle."""

    def rows(batches):
        for b in batches:
            for i, end, data, at in text_blocks(b.column(1)):
                sets, offsets = shingle_sets(data, at)
                both = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))[offsets] for x in (sets, mix(sets))]
                n = np.diff(offsets)
                named = [as_long(x[1:] - x[:-1]) for x in both]
                ids = b.column(0).slice(i, end - i)
                order = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), n, *named))
                first = np.ones(len(order), bool)
                first[1:] = (n[order][1:] != n[order][:-1]) | (named[0][order][1:] != named[0][order][:-1]) | (named[1][order][1:] != named[1][order][:-1])
                leads = np.sort(order[first & (n[order] > 0)])
                own = np.concatenate([sets[offsets[r] : offsets[r + 1]] for r in leads] + [sets[:0]])
                signed = signatures(own, np.concatenate(([0], np.cumsum(n[leads]))))
                held: list[bytes | None] = [None] * len(n)
                for r, x in zip(leads.tolist(), signed, strict=True):
                    held[r] = x.tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(named[0]), pa.array(named[1]), pa.array(held, pa.binary())], ["doc_id", "n", "set1", "set2", "signature"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(rows, "doc_id long, n long, set1 long, set2 long, signature binary")


def _banded(classes: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            if b.num_rows:
                signed = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(1)])
                yield pa.RecordBatch.from_arrays([pa.array(as_long(band_keys(signed).ravel())), pa.array(np.repeat(np.asarray(b.column(0)), BANDS))], ["band", "id"])

    return classes.select("id", "signature").mapInArrow(rows, "band long, id long")


def _briefs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8).reshape(len(column), SLOTS)


def _briefly(classes: DataFrame) -> DataFrame:
    """id and brief, the lowest byte of each slot of the signature, which is enough to compare."""

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint8).tobytes() for x in b.column(1)], pa.binary())], ["id", "brief"])

    return classes.select("id", "signature").mapInArrow(rows, "id long, brief binary")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose signatures agree enough."""

    def rows(batches):
        for b in batches:
            if b.num_rows:
                one, two = (_briefs(b.column(i)) for i in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((one == two).mean(axis=1) >= LEAST_AGREEMENT))

    signed = pairs
    for side in ("a", "b"):
        signed = signed.join(classes.select(F.col("id").alias(side), F.col("brief").alias(f"s{side}")), side)
    return signed.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def _members(families: DataFrame, docs: DataFrame) -> DataFrame:
    """component, id, members (the full set), brief and n for each document (id) of the families (id, component)."""

    def sets(batches):
        for b in batches:
            for i, end, data, at in text_blocks(b.column(1)):
                found, offsets = shingle_sets(data, at)
                briefs = signatures(found, offsets).astype(np.uint8)
                own = [found[offsets[r] : offsets[r + 1]] for r in range(end - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, end - i), pa.array([int(x.sum().view(np.int64)) for x in own], pa.int64()), pa.array(np.diff(offsets)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in briefs], pa.binary())], ["id", "name", "n", "members", "brief"])

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).join(families.select("id"), "id", "left_semi")
    # rows of one doc_id and text give one set
    members = texts.mapInArrow(sets, "id long, name long, n long, members binary, brief binary").dropDuplicates(["id", "name"])
    return members.join(families, "id").select("component", "id", "members", "brief", "n")


def _blocks(rows: DataFrame, of: list[str], name: str) -> DataFrame:
    """Into how many blocks the rows (n: shingles) of each group are dealt."""
    parts = F.greatest(F.ceil(F.count("*") / BUCKET_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return rows.groupBy(*of).agg(parts.alias(name))


def _joined_by_sets(held: list[pa.RecordBatch], pairs) -> pa.RecordBatch:
    """Links (a, b) among the rows (id, label, members, brief), decided on full sets: a spanning forest of them.

    pairs gives (row, other rows) to look at. A pair is skipped if its labels are joined already, or if its sizes or its
    signatures rule it out."""
    whole = pa.Table.from_batches(held)
    ids, labels = np.asarray(whole["id"]), np.asarray(whole["label"])
    briefs = _briefs(whole["brief"].combine_chunks())
    full = [np.frombuffer(x.as_buffer(), np.uint64) for x in whole["members"]]
    sizes = np.array([len(x) for x in full])
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    links = []
    for i, others in pairs(whole):
        agreed = (briefs[others] == briefs[i]).sum(axis=1)
        near = (agreed >= LEAST_AGREEMENT * SLOTS) & (labels[others] != labels[i]) & (LINK[1] * np.minimum(sizes[others], sizes[i]) >= LINK[0] * np.maximum(sizes[others], sizes[i]))
        for j in others[near][np.argsort(-agreed[near], kind="stable")].tolist():
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a == b:
                continue
            both = len(np.intersect1d(full[i], full[j], assume_unique=True))
            if LINK[1] * both >= LINK[0] * (sizes[i] + sizes[j] - both):
                up[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _within_blocks(members: DataFrame) -> DataFrame:
    """Links (a, b) between the members (component, id, members, brief, n) of a block of a family; each row is sent once."""
    dealt = members.join(_blocks(members, ["component"], "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    order = ["component", "block"]

    def compare(held):
        yield _joined_by_sets(held, lambda whole: ((i, np.arange(i + 1, whole.num_rows)) for i in range(whole.num_rows)))

    rows = dealt.select(*order, "id", F.col("id").alias("label"), "members", "brief")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_by_key(order, compare), "a long, b long")


def _across_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between the members of a family that labels (id, label) keep apart: those outside of the label with the
    most members ask, and each block of asking ones meets each block of the family in a task that holds these two only."""
    rows = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    counted = rows.groupBy("component", "label").agg(F.count("*").alias("size"))
    main = counted.groupBy("component").agg(F.max(F.struct("size", "label")).getField("label").alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    rows = written(rows.join(main, "component").withColumn("asks", F.col("label") != F.col("main")), "apart")
    blocks = _blocks(rows, ["component"], "blocks").join(_blocks(rows.where("asks"), ["component"], "asking"), "component")
    rows = rows.join(blocks, "component")
    order = ["component", "q", "r"]
    rest = ["id", "label", "members", "brief"]
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("component", every("asking").alias("q"), own("blocks").alias("r"), F.lit(False).alias("asks"), *rest)
    asking = rows.where("asks").select("component", own("asking").alias("q"), every("blocks").alias("r"), "asks", *rest)

    def compare(held):
        def pairs(whole):
            asks = np.asarray(whole["asks"].combine_chunks().to_numpy(zero_copy_only=False), bool)
            others = np.flatnonzero(~asks)
            return ((i, others) for i in np.flatnonzero(asks)) if len(others) else ()

        yield _joined_by_sets(held, pairs)

    return asked.union(asking).repartition(*order).sortWithinPartitions(*order).mapInArrow(_by_key(order, compare), "a long, b long")


def _linked(families: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, component): the components of the links within the families (id, component), decided on full shingle sets.

    Families of one block are compared there. Of larger ones the blocks are, then one document of each component found in
    a block stands for it in the next round, until all fit one block or a round joins nothing. What is then still apart in
    such a family is compared in full: so no pair that the signatures allow is left out, and where nearly all of a large
    family is one component, each document is sent a few times at most."""
    members = written(_members(families, docs), "sets")
    large = written(_blocks(members, ["component"], "blocks").where("blocks > 1").select("component"), "large")
    links = written(_within_blocks(members), "links")
    if large.isEmpty():
        return components(links)
    inside = members.join(large, "component", "left_semi")
    for _ in range(8):
        labels = written(components(links).select("id", F.col("component").alias("label")), "labels")
        first = inside.join(labels, "id", "left").where("label is null or label = id").drop("label")
        more = written(_within_blocks(first), "links")
        if more.isEmpty():
            break
        links = links.union(more)
    apart = written(_across_blocks(inside, labels), "links")
    return components(links.union(apart))


def _by_key(order: list[str], work):
    """A function for mapInArrow that calls work with the batches of each run of rows with equal keys."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(n))).astype(np.int64) for n in order], 1)
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(keys[first])
                if now != key and held:
                    yield from work(held)
                    held = []
                key = now
                held.append(batch.slice(first, end - first))
        if held:
            yield from work(held)

    return run


def _within_buckets(rows: DataFrame) -> DataFrame:
    """Pairs of agreeing documents of one bucket and different components, for those rows that ask: a spanning forest of
    them in each task.

    rows: band, id, component, asks, brief. A bucket is dealt into blocks; a block of asking rows meets each block of the
    bucket in a task that holds these two blocks only."""
    blocks = lambda c: F.ceil(F.sum(c) / BUCKET_BLOCK).cast("int")
    sizes = rows.groupBy("band").agg(blocks(F.lit(1)).alias("blocks"), blocks(F.col("asks").cast("int")).alias("asking"))
    rows = rows.join(written(sizes, "sizes"), "band")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("band", every("asking").alias("q"), own("blocks").alias("r"), F.lit(False).alias("asks"), "id", "component", "brief")
    asking = rows.where("asks").select("band", own("asking").alias("q"), every("blocks").alias("r"), "asks", "id", "component", "brief")
    order = ["band", "q", "r"]

    def compare(held):
        whole = pa.Table.from_batches(held)
        asks = np.asarray(whole["asks"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        if not asks.any() or asks.all():
            return
        ids, parts = np.asarray(whole["id"]), np.asarray(whole["component"])
        briefs = _briefs(whole["brief"].combine_chunks())
        others = np.flatnonzero(~asks)
        names, at = np.unique(parts, return_inverse=True)
        label = np.arange(len(names))  # of each component, what it is joined to
        pairs = []
        for i in np.flatnonzero(asks):
            near = others[((briefs[others] == briefs[i]).sum(axis=1) >= LEAST_AGREEMENT * SLOTS) & (label[at[others]] != label[at[i]])]
            for j in near[np.unique(label[at[near]], return_index=True)[1]]:
                pairs.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                label[label == label[at[j]]] = label[at[i]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return asked.union(asking).repartition(*order).sortWithinPartitions(*order).mapInArrow(_by_key(order, compare), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of the edges (a, b); component is the smallest id reachable.

    Union-find within each partition first leaves a forest of its edges. Then rounds of contraction: each node joins
    its neighbour (or itself) of the least random rank of that round, so the graph shrinks by a constant factor. Once
    FEW_EDGES or fewer edges are left, one task's union-find ends it; no task holds more."""

    def forest(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    def roots(batches):
        for b in forest(batches):
            yield b.rename_columns(["node", "to"])

    edges = written(edges.mapInArrow(forest, "a long, b long"), "edges")
    labels = None
    for number in range(200):
        few = edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES
        if few:
            moved = edges.repartition(1).mapInArrow(roots, "node long, to long")
        else:
            both = edges.select("a", "b").union(edges.select("b", "a"))
            rank = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("rank"), c.alias("to"))  # noqa: B023, E731
            near = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("near"))
            moved = near.select(F.col("a").alias("node"), F.least("near", rank(F.col("a"))).getField("to").alias("to"))
        moved = written(moved, "moved")
        if labels is None:
            labels = moved.select(F.col("node").alias("id"), F.col("to").alias("label"))
            if few:  # a root has no row of its own
                labels = labels.union(labels.select("label", "label").distinct())
        else:
            labels = labels.join(moved, labels["label"] == moved["node"], "left").select("id", F.coalesce("to", "label").alias("label"))
        if few:
            break
        labels = written(labels, "labels")
        for side in ("a", "b"):
            edges = edges.join(moved.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("to", f"_{side}")
        edges = written(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("contraction did not end")
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return written(labels.join(least, "label").select("id", "component"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id long, text).

    Rows without words (or text) have 0 shingles and are linked with nothing. Rows that share a doc_id are one
    document: each of their texts links it. A row of null doc_id can copy a document but is none itself: it gets the
    component of the rows with its shingle set, null if these have no doc_id either, and isn't kept. An empty table
    gives no rows.

    Candidates: in each bucket of a band every class meets the bucket's first, and those whose signatures agree are one
    family; then those of another family than the first are compared with all others of the bucket, in blocks, and
    families join that have an agreeing pair. So each pair that shares a band and agrees is in one family, and within
    families links are decided on full sets."""
    base = written(shingled(docs), "shingled")
    # the class table has rows for classes of two documents or more only, and is written, so that Spark splits a large class in the join
    names = base.where("n > 0").groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    joined = base.where("n > 0").join(written(names, "names"), ["set1", "set2", "n"], "left")
    alone = F.col("id").isNull() & F.col("doc_id").isNotNull()
    lead = F.col("doc_id") == F.col("id")
    members = joined.withColumn("id", F.when(alone, F.col("doc_id")).otherwise(F.col("id"))).select("doc_id", "n", "id", F.when(lead, F.col("signature")).alias("signature"))
    members = written(members, "members")
    classes = written(members.where("signature is not null").dropDuplicates(["id", "signature"]).select("id", "n", "signature"), "classes")
    briefs = written(_briefly(classes), "briefs")
    bands = written(_banded(classes), "bands")
    buckets = written(bands.groupBy("band").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"), "buckets")
    shared = written(bands.join(buckets, "band"), "shared")
    stars = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    near = written(_agreeing(stars, briefs), "agreeing")
    families = components(near)
    placed = written(shared.join(families, "id", "left").select("band", "id", "first", F.coalesce("component", "id").alias("component")), "placed")
    main = F.max(F.when(F.col("id") == F.col("first"), F.col("component"))).alias("main")
    open_ = written(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), main).where("low <> high").select("band", "main"), "open")
    rows = placed.join(open_, "band").select("band", "id", "component", (F.col("component") != F.col("main")).alias("asks"))
    more = written(_within_buckets(written(rows.join(briefs, "id"), "asking")), "within")
    if not more.isEmpty():
        families = components(near.union(more))
    found = _linked(families, docs)
    grouped = members.join(found, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    alone = base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
