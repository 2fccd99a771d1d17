"""Language mixtures: held-out accuracy, proportions of mixed texts and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from fieldmerge.llm import langid

SYLLABLES = {"aa": "ba be bi bo lo la mo ma", "bb": "sch ung ein ver keit heit ach", "cc": "tion eux oi aux é è que"}


def text_in(rnd, lang, words):
    return " ".join("".join(rnd.choices(SYLLABLES[lang].split(), k=rnd.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(2)
    rows = [(i, text_in(rnd, lang, rnd.randint(5, 60)), lang, "x") for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=300))]
    rows += [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "12 345 !!", "aa", "x"), (1003, "b", None, "x"), (1004, text_in(rnd, "aa", 300) + " " + text_in(rnd, "bb", 300), None, "x"), (None, text_in(rnd, "cc", 40), "cc", "x"), (1005, "qzxw jkvq wxzq kqjx zzxq " * 20, None, "x"), (1006, text_in(rnd, "aa", 120_000), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    return rows, {r["doc_id"]: r for r in langid.identified(docs).collect()}


def test_held_out_accuracy(found):
    rows, out = found
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 30 and all(out[r[0]]["held_out"] for r in held)
    assert not any(out[r[0]]["held_out"] for r in rows[:300] if r not in held)
    assert np.mean([out[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.95
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())


def test_odd_texts(found):
    _, out = found
    for i in (1000, 1001, 1002):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["fits"]) == ("und", 0.0, False)
    assert out[1003]["lang_pred"] in SYLLABLES and out[1006]["lang_pred"] == "aa"
    assert out[None]["lang_pred"] == "cc" and out[None]["held_out"]
    assert not out[1005]["fits"] and out[1006]["fits"]


def test_mixture(found):
    _, out = found
    shares = out[1004]["languages"]
    assert set(shares) == {"aa", "bb"} and all(0.3 < s < 0.7 for s in shares.values())


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identified(docs).collect()] == [("und", 0.0)]
    assert langid.identified(docs.limit(0)).count() == 0


def test_accepted_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "lola mobe", "aa", 7), (2, "...", "aa", 8), (3, "bobila", "aa", 9), (4, "mama bola", "aa", 1)], "doc_id long, text string, lang string, fits int")
    out = langid.accepted(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def plain_outside(text, texts_by_lang):
    """The share outside of all languages, by counting trigrams (not buckets of them) in dictionaries."""

    def grams(t):
        t = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in t.lower()).split())} "
        return [t[i : i + 3] for i in range(len(t) - 2)]

    chances = []
    for texts in texts_by_lang.values():
        seen = {}
        for t in texts:
            for g in grams(t):
                seen[g] = seen.get(g, 0) + 1
        total = sum(seen.values()) + langid.SMOOTHING * langid.BUCKETS
        chances.append(lambda g, seen=seen, total=total: (seen.get(g, 0) + langid.SMOOTHING) / total)
    chances.append(lambda g: 1 / langid.BUCKETS)
    own = grams(text)
    weights = [1 / len(chances)] * len(chances)
    for _ in range(langid.ROUNDS):
        sums = [0.0] * len(chances)
        for g in own:
            parts = [w * c(g) for w, c in zip(weights, chances, strict=True)]
            sums = [s + p / sum(parts) for s, p in zip(sums, parts, strict=True)]
        moved = max(abs(s / len(own) - w) for s, w in zip(sums, weights, strict=True))
        weights = [s / len(own) for s in sums]
        if moved < 1e-3:
            break
    return weights[-1]


def test_rejected_texts_by_plain_mixtures(spark):
    rnd = random.Random(8)
    rows = [(i, text_in(rnd, lang, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    codes = lambda n: " ".join("".join(rnd.choices("bcdfghjkqvwxyz", k=9)) for _ in range(n))
    rows += [(100 + k, text_in(rnd, "aa", 30) + " " + codes(k * 6), None) for k in range(12)] + [(200, codes(40), None), (201, "Ω ψ жук лес", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            learned.setdefault(lang, []).append(t)
    shares = {i: plain_outside(t, learned) for i, t, _ in rows}
    kept = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert kept == {i for i, s in shares.items() if s < langid.MOST_OUTSIDE}
    assert {r["doc_id"] for r in langid.identified(docs).where("fits").collect()} == kept
    assert set(range(60)) | {100} <= kept and not kept & {111, 200, 201}


def test_proportions_by_plain_mixtures(spark):
    """The best set of languages, of all sets there are, is what leaving out one after the other finds here."""
    from itertools import combinations

    rnd = random.Random(5)
    langs = list(SYLLABLES)
    names, chances = langid.learn(spark.createDataFrame([(text_in(rnd, x, 60), x) for x in langs * 10], "text string, lang string"))
    assert names == sorted(langs)
    for chosen in (["aa"], ["bb"], ["aa", "cc"], ["aa", "bb"], ["aa", "bb", "cc"]):
        buckets, _ = langid.trigram_buckets([" ".join(text_in(rnd, x, 80) for x in chosen)])
        every = np.bincount(buckets, minlength=langid.BUCKETS).astype(float)
        used = np.flatnonzero(every)
        price = langid.PENALTY * np.log(len(buckets)) / 2
        fits = {s: langid._mixture(chances[list(s)][:, used], every[used], np.full(n, 1 / n))[1] - n * price for n in (1, 2, 3) for s in combinations(range(3), n)}
        best = max(fits, key=fits.get)
        assert tuple(np.flatnonzero(langid.proportions(chances, buckets)[0])) == best == tuple(names.index(x) for x in chosen)
