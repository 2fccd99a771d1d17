"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

from fieldmerge.llm import runs


def every_run(words):
    """{(start, end): smallest period} by walking each period along the words."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def some_words(rnd, n):
    words = [str(rnd.randrange(rnd.choice([1, 2, 3, 5, 40]) or 1)) for _ in range(n)] if rnd.random() < 0.3 else [str(rnd.randrange(k)) for k in [rnd.choice([1, 2, 2, 3, 40])] for _ in range(n)]
    if n and rnd.random() < 0.5:
        a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_against_every_period(monkeypatch):
    rnd = random.Random(1)
    for _ in range(1500):
        monkeypatch.setattr(runs, "GRID", rnd.choice([7, 50, 1 << 19]))
        docs, texts, total = [some_words(rnd, rnd.randint(0, 70)) for _ in range(rnd.randint(1, 4))], [], 0
        for words in docs:
            encoded = [w.encode() for w in words]
            texts.append((encoded, runs._numbered(encoded, total)))
            total += len(words)
        for words, (own, kept) in zip(docs, runs._settle(texts), strict=True):
            expected = every_run(words)
            assert [tuple(r) for r in own.tolist()] == expected, words
            assert kept.decode() == collapsed(words, expected)


def test_names_and_extensions_against_comparing_words():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(60):
        words = [rnd.randrange(3) for _ in range(rnd.randint(2, 60))]
        n, levels = len(words), runs.named_levels(np.array(words))
        for k, level in enumerate(levels):
            for x in range(n):
                for y in range(x + 1, n):
                    whole = y + (1 << k) <= n
                    assert (level[x] == level[y]) == (whole and words[x : x + (1 << k)] == words[y : y + (1 << k)])
        if levels:
            x = np.array([rnd.randrange(n - 1) for _ in range(30)])
            y = np.array([rnd.randrange(i + 1, n) for i in x])
            ahead = [next((d for d in range(n) if j + d >= n or words[i + d] != words[j + d]), n) for i, j in zip(x, y, strict=True)]
            behind = [next((d for d in range(n) if i - d - 1 < 0 or words[i - d - 1] != words[j - d - 1]), n) for i, j in zip(x, y, strict=True)]
            assert runs.extension(levels, x, y, 1).tolist() == ahead and runs.extension(levels, x, y, -1).tolist() == behind


def test_table(spark):
    twelve = " ".join(["a", "b", "c"] * 4)
    rows = [(1, f"x {twelve}\ty", "r"), (1, f"x {twelve}\ty", "r"), (2, None, None), (3, "", ""), (4, "é z " * 30, ""), (None, "w " * 11, ""), (5, "q " * 150_000, ""), (6, " ".join(map(str, range(200_000))), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = runs.run_digests(runs.periodic_runs(docs)).collect()
    assert len(out) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by = {r["doc_id"]: r for r in out}
    assert tuple(by[1])[:6] == (1, 1, 1, 12, 3, 4000) and by[1]["runs_sha256"] == sha("1,12,3\n") and by[1]["collapsed_sha256"] == sha("x a b c y")
    for i in (2, 3, None):
        assert tuple(by[i])[1:6] == (0, None, None, None, None) and by[i]["runs_sha256"] == sha("")
    assert by[None]["collapsed_sha256"] == sha(" ".join(["w"] * 11)) and by[2]["collapsed_sha256"] == sha("")
    assert tuple(by[4])[:6] == (4, 1, 0, 30, 1, 30000) and tuple(by[5])[:6] == (5, 1, 0, 150_000, 1, 150_000_000) and by[6]["n_runs"] == 0
    assert runs.run_digests(runs.periodic_runs(docs.limit(0))).count() == 0


def test_query(spark):
    from fieldmerge.llm.queries import op13_periodic_runs

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out, looped = op13_periodic_runs(spark, sf).collect(), 0
    assert len(out) == len(texts)
    for r in out:
        words = [w.decode() for w in (texts[r["doc_id"]] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        expected = every_run(words)
        best = min(((-n_, s, q) for s, n_, q in expected), default=None)
        shown = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert tuple(r)[1:6] == (len(expected), *shown)
        assert r["runs_sha256"] == sha("".join(f"{s},{n_},{q}\n" for s, n_, q in expected)) and r["collapsed_sha256"] == sha(collapsed(words, expected))
    assert looped > 5
