"""Alignment, benchmark copies, license notices, and the pipeline against plain computations."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from fieldmerge.llm import decontam, licenses
from fieldmerge.llm.align import align
from fieldmerge.llm.queries import op9_decontamination


def smith_waterman(a, b):
    cells = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cells[i, j] = max(0, cells[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), cells[i - 1, j] - 1, cells[i, j - 1] - 1)
    return cells.max()


def test_alignment_of_held_rows(monkeypatch):
    rnd = np.random.default_rng(3)
    for _ in range(80):
        a, b = (rnd.integers(0, 4, rnd.integers(1, 60)) for _ in range(2))
        band = () if rnd.random() < 0.5 else (int(rnd.integers(-20, 0)), int(rnd.integers(0, 20)))
        whole = align(a, b, *band)
        with monkeypatch.context() as patch:
            patch.setattr("fieldmerge.llm.align.CELLS", 1)
            assert align(a, b, *band) == whole


def test_long_item(spark):
    rnd = random.Random(12)
    item = [f"w{rnd.randrange(3000)}" for _ in range(3000)]
    edited = [x if rnd.random() < 0.9 else "zz" for x in item]
    docs = spark.createDataFrame([(1, "before " * 50 + " ".join(edited) + " after" * 50), (2, " ".join(item[:300])), (1, " ".join(item))], "doc_id long, text string")
    out = decontam.contaminated(docs, spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"] == 1.0) for r in out) == [(1, 7, False), (1, 7, True)]


def edited(words, rate, rnd):
    return [x if rnd.random() >= rate else rnd.choice(["", "other", "new word"]) for x in words]


def test_recall_by_edit_rate(spark):
    """Of 60 items of 40 words, each hidden in a document of its own with a part of its words edited."""
    rnd = random.Random(2)
    items = [(i, [f"v{rnd.randrange(800)}" for _ in range(40)]) for i in range(60)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {}
    for rate in (0.05, 0.1, 0.15, 0.2):
        rows = [(i, " ".join([f"n{rnd.randrange(900)}" for _ in range(80)] + edited(w, rate, rnd) + [f"n{rnd.randrange(900)}" for _ in range(80)])) for i, w in items]
        hits = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
        assert all(d == i for d, i in hits)
        found[rate] = len(hits) / len(items)
    assert found[0.05] == found[0.1] == 1 and found[0.15] >= 0.95 and found[0.2] >= 0.9, found


def test_alignment():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rnd.integers(0, 4, rnd.integers(1, 25)) for _ in range(2))
        found = align(a, b)
        assert found.score == smith_waterman(a, b)
        (i0, j0), (i1, j1) = found.first, found.end
        assert 0 <= i0 <= i1 <= len(a) and 0 <= j0 <= j1 <= len(b)
        assert found.score == smith_waterman(a[i0:i1], b[j0:j1]) and found.matched <= min(i1 - i0, j1 - j0)
    assert align(np.arange(3), np.arange(0)).score == 0
    banded = align(np.arange(5), np.append(np.arange(100, 120), np.arange(5)), 18, 22)
    assert (banded.matched, banded.first, banded.end) == (5, (0, 20), (5, 25))


def corpus(rnd):
    common = ["the", "of", "and", "to", "in"]
    vocabulary = common * 40 + [f"w{i}" for i in range(900)]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    return say, [say(rnd.randint(15, 45)) for _ in range(12)]


def test_copies(spark, tmp_path):
    rnd = random.Random(8)
    say, items = corpus(rnd)
    docs, expected = [], set()
    for i in range(200):
        text = say(rnd.randint(5, 150))
        if i % 4 == 0:
            k = rnd.randrange(len(items))
            words = items[k].split()
            for _ in range(i % 3 * len(words) // 12):
                words[rnd.randrange(len(words))] = "edit"
            text = f"{say(20)} {' '.join(words).upper() if i % 8 else ', '.join(words)}. {text}"
            expected.add((i, k))
        docs.append((i, text))
    docs += [(500, None), (501, ""), (None, items[0]), (502, (say(30_000) + " " + items[1])), (503, items[2]), (503, items[2])]
    expected |= {(None, 0), (502, 1), (503, 2)}
    bench = [*enumerate(items), (90, None), (91, ""), (92, "the of"), (93, "the of and")]
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = op9_decontamination(spark, str(tmp_path)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out if r["item_id"] != 93}
    assert found == expected and len([r for r in out if r["item_id"] != 93]) == len(expected) + 1
    table, items_table = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "benchmark"))
    clean = decontam.without_copies(table, items_table.where("item_id <> 93"))
    assert clean.columns == table.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in expected}
    assert decontam.contaminated(table.limit(0), items_table).count() == decontam.contaminated(table, items_table.limit(0)).count() == 0


def test_many_item_blocks(spark, monkeypatch):
    say, items = corpus(random.Random(9))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 300)
    docs = spark.createDataFrame([(i, f"{say(9)} {t} {say(9)}") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()) == [(i, i) for i in range(len(items))]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    edited = mit.replace("free of charge", "at no cost").replace("Software", "Program")
    rows = [(1, "é first. Released under the MIT License. Then more."), (2, f"x {mit} y {mit}"), (3, edited), (4, "Licensed under CC BY-NC 4.0.\nThe"), (5, None), (6, ""), (7, "the license of the work is under no terms"), (None, "w " * 50_000 + licenses.TEMPLATES["Apache-2.0"][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as license")
    out = {}
    for r in licenses.license_spans(docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert [(r["license"], r["coverage"], r["excerpt"]) for r in out[1]] == [("MIT", 1.0, "Released under the MIT License")]
    assert rows[0][1].encode()[out[1][0]["first_byte"] : out[1][0]["end_byte"]].decode() == out[1][0]["excerpt"]
    assert [(r["license"], r["coverage"]) for r in out[2]] == [("MIT", 1.0)] * 2
    assert out[3][0]["license"] == "MIT" and 0.75 <= out[3][0]["coverage"] < 1
    assert [r["license"] for r in out[4]] == ["CC-BY-NC-4.0"] and [r["license"] for r in out[None]] == ["Apache-2.0"]
    assert set(out) == {1, 2, 3, 4, None}
    assert licenses.license_spans(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each document that comes out is one of its group's, has letters, holds no test item, and the shards are gapless."""
    rnd = random.Random(10)
    say, items = corpus(rnd)
    rows = []
    for i in range(120):
        rows.append((i, say(rnd.randint(30, 60)), "en", f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(300, rows[0][1] + " more", "en", "s0", 0), (301, say(20) + " " + items[0], "en", "s1", 0), (302, "12 34 !", "en", "s1", 0), (303, None, "en", "s1", 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {r[0] for r in rows} - {302, 303}
    assert kept[1] == set(range(120)) | {301}
    assert kept[2] == set(range(120))
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept[4]
    words = sum(len(re.findall(r"\S+", r["text"])) for r in out)
    assert 1.2 < words / sum(len(r[1].split()) for r in rows[:120]) < 1.8
    for k in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_edited_copies_need_no_rare_gram(spark):
    """Edited copies without an exact one, and many edited copies beside an exact one, whose grams are then the rarest."""
    item = [f"q{i}" for i in range(40)]
    edited = " ".join("edit" if i % 5 == 4 else w for i, w in enumerate(item))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    alone = spark.createDataFrame([(1, f"so it goes {edited} and on")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.contaminated(alone, bench).collect()] == [1]
    assert decontam.without_copies(alone, bench).count() == 0
    many = spark.createDataFrame([(i, f"so it goes {edited} and on") for i in range(200)] + [(200, " ".join(item))], "doc_id long, text string")
    assert {r["doc_id"] for r in decontam.contaminated(many, bench).collect()} == set(range(201))


def license_places(text, known):
    own = licenses.Templates(known)
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, _, _, rows = licenses.words(data, np.array([0, len(data)]), licenses.PUNCTUATION)
    grams, first, _ = licenses.word_grams(hashes, rows, licenses.GRAM)
    hit, entries = own.index.find(grams)
    return [(own.names[s[0]], *s[3:]) for s in licenses.spans_in(own, hashes, first[hit], entries)] if len(hit) else []


def test_repeated_notices_count_at_each_place():
    for notice, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), (licenses.TEMPLATES["MIT"][2], "MIT")):
        n = len(re.findall(r"\w+", notice))
        for between in ("", "and ", "one two three four five six "):
            step = n + len(between.split())
            for times in (2, 3, 50):
                assert license_places((notice + " " + between) * times, licenses.TEMPLATES) == [(name, i * step, i * step + n) for i in range(times)], (notice, between, times)


def test_licenses_are_told_apart_by_name_and_version():
    known = licenses.TEMPLATES
    short = {
        "Licensed under the Mozilla Public License, Version 2.0": "MPL-2.0", "Licensed under the Eclipse Public License, Version 2.0": "EPL-2.0", "Licensed under the Apache License 2.0": "Apache-2.0",
        "Released under the BSD License.": "BSD", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under the Made Up Public License, Version 2.0": None, "Released under the Foo License.": None,
    }
    for text, name in short.items():
        assert [s[0] for s in license_places(f"First words. {text} and then more", known)] == ([name] if name else []), text
    for name, texts in known.items():
        for text in texts:
            assert name in {s[0] for s in license_places(f"So {text} it is", known)}, text[:80]


def test_all_pairs_of_a_small_table(spark):
    """Every item is aligned with every document as a whole; what reaches the score is found, and nothing else."""
    from fieldmerge.llm.align import MATCH

    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [rnd.choices(vocabulary, k=rnd.randint(8, 30)) for _ in range(25)]
    docs = []
    for i in range(120):
        text = rnd.choices(vocabulary, k=rnd.randint(0, 60))
        if i % 2:
            copy = [rnd.choice(vocabulary) if rnd.random() < (i % 7) / 20 else w for w in rnd.choice(items)]
            at = rnd.randint(0, len(text))
            text = text[:at] + copy + text[at:]
        docs.append(text)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(table, bench).collect()}
    number = {w: i for i, w in enumerate(vocabulary)}
    coded = lambda t: np.array([number[w] for w in t], np.int64)
    best = {}
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            score = align(coded(item), coded(text)).score / (MATCH * len(item)) if text else 0
            grams = {tuple(item[j : j + 3]) for j in range(len(item) - 2)} & {tuple(text[j : j + 3]) for j in range(len(text) - 2)}
            if score >= decontam.COPY:
                best[d, k] = score, len(grams)
    assert set(found) <= set(best) and all(found[p] == pytest.approx(best[p][0]) for p in found)
    assert len(found) > 40 and {p for p in best if best[p][1] >= decontam.SEEDS} == set(found)


def test_items_with_one_opening(monkeypatch):
    """Openings that many items share are no seeds; pairs are looked at some at a time, with the same result."""
    import pyarrow as pa

    rnd = random.Random(1)
    vocabulary, opening = [f"w{i}" for i in range(5000)], "please read the text below and answer it"
    texts = [opening + " " + " ".join(rnd.choices(vocabulary, k=25)) for _ in range(400)]
    page = " ".join(opening + " " + " ".join(rnd.choices(vocabulary, k=20)) for _ in range(100)) + " " + texts[7]
    items = decontam.Items(list(range(400)), pa.array(texts))
    different = np.unique(items.table.grams)
    held = decontam.Items([0], pa.array([page])).table.grams
    whole = sorted(decontam._matches(items, pa.array([page])))
    monkeypatch.setattr(decontam, "PAIRS", 1000)
    assert sorted(decontam._matches(items, pa.array([page]))) == whole and [m[1] for m in whole] == [7]
    before = len(items.table.grams)
    items.keep_rare({int(i): 1 for i in np.flatnonzero(np.isin(different, held))})
    assert len(items.table.grams) < before / 10
    assert sorted(decontam._matches(items, pa.array([page]))) == whole


def test_bare_names_and_denials(spark):
    texts = {
        "See the Apache License, Version 2.0, for more.": ["Apache-2.0"], "Under GNU GPL v3 since then.": ["GPL-3.0"], "the GNU Affero General Public License, version 3": ["AGPL-3.0"], "GNU Lesser General Public License, version 3": ["LGPL-3.0"],
        "GNU General Public License, version 2": ["GPL-2.0"], "This text is not licensed under the MIT License.": [], "It isn't free. Licensed under the MIT License.": ["MIT"], "That is not so. Licensed under the MIT License.": ["MIT"],
        "It was never released under the BSD License, I think.": [], "neither licensed under the MIT License nor any": [], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licenses.license_spans(docs).collect():
        found.setdefault(r["doc_id"], []).append(r["license"])
    assert {t: found.get(i, []) for i, t in enumerate(texts)} == texts
