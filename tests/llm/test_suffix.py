"""Suffix arrays and repeated windows against brute force."""

import hashlib
import random
import re

import numpy as np

from fieldmerge.llm import suffix


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(150):
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256))])
        text = bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 250)))
        text = text + (text[: len(text) // 2] + text if rnd.random() < 0.5 else b"a" * rnd.randint(0, 60))
        depth = rnd.choice([1, 5, 30, 400])
        data = np.frombuffer(text, np.uint8)
        order = suffix.suffix_array(data, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        heads = [text[i : i + depth] for i in order]
        assert heads == sorted(heads)
        common = suffix.common_prefixes(data, order, depth)
        for i in range(1, len(heads)):
            same = next((k for k, (a, b) in enumerate(zip(heads[i - 1], heads[i], strict=False)) if a != b), min(len(heads[i - 1]), len(heads[i])))
            assert common[i] == same


def brute(texts, span):
    seen = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, least, most_words):
    """Runs covered by windows of `least` bytes that another text holds, with so many whole words."""
    of = {}
    for n, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            of.setdefault(t[i : i + least], set()).add(n)
    out = []
    for t in texts:
        held = bytearray(len(t) + 1)
        for i in range(len(t) - least + 1):
            if len(of[t[i : i + least]]) > 1:
                held[i : i + least] = b"1" * least
        runs = [(m.start(), m.end()) for m in re.finditer(b"1+", bytes(held))]
        spots = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        out.append(sum(sum(a <= x and y <= b for x, y in spots) >= most_words for a, b in runs))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    passage = " ".join(rnd.choices(words, k=30))
    texts = ["", None, "short", "ab" * 100, "ab" * 70 + "x", "z" * 500]
    for i in range(40):
        own = " ".join(rnd.choices(words, k=rnd.randint(1, 80)))
        cut = rnd.randint(0, len(own))
        texts.append(own[:cut] + (passage[rnd.randint(0, 20) :] if i % 3 else "") + own[cut:])
    texts += [texts[10], texts[11], texts[12][:60] + "!" + texts[12][61:]]
    rows = [(None if i == 7 else 5 if i in (8, 9) else i, t, "clash") for i, t in enumerate(texts)]
    rows += [rows[13]] * 3 + [rows[7]] * 2  # rows that can't be told apart
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    expected = sorted(brute([(t or "").encode() for _, t, _ in rows], 40))
    shared = sorted(zip((str(r[0]) for r in rows), brute_passages([(t or "").encode() for _, t, _ in rows], 24, 6), strict=True))
    assert any(n for _, n in shared)
    for most in (suffix.MOST_SLICES, 1):
        out = suffix.without_repeats(docs, span=40, least=24, passage_words=6, most_slices=most).collect()
        assert sorted((str(r["doc_id"]), r["n_passages"]) for r in out) == shared
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == expected
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in rows)


def test_trimmed_keeps_what_is_repeated():
    rnd = random.Random(5)
    for _ in range(40):
        span, anchor = 100, bytes(rnd.choice(b"xyz") for _ in range(12))
        left, right = (bytes(rnd.choice(b"ab") for _ in range(100)) for _ in range(2))
        slices, at = [], []
        for _ in range(rnd.randint(2, 6)):
            far, near = rnd.randint(0, 88), rnd.randint(0, 88)
            far, near = max(far, near), min(far, near)  # bytes from a window's start to the anchor
            a, b = bytearray(left), bytearray(right)
            for part in (a, b):
                if rnd.random() < 0.7:
                    part[rnd.randrange(100)] = ord("!")
            slices.append(bytes(a[100 - far :] + anchor + b)[: far - near + span])
            at.append(far)
        assert all(len(s) >= span for s in slices)
        wins = [len(x) - span + 1 for x in slices]
        whole = suffix.repeated_windows(slices, wins, [False] * len(slices), [1] * len(slices), [1] * len(slices), span, span)
        first, end = suffix.trimmed(np.full(len(slices), 9, np.uint64), slices, np.array(at), np.array(wins), span)
        for (marks, _), i, j in zip(whole, first, end, strict=True):
            assert not marks[:i].any() and not marks[j:].any()


def test_empty_table(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
