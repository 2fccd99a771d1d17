"""Language identification by mixtures: expectation-maximisation estimates each document's language proportions from
letter n-gram likelihoods, and a penalised likelihood selects the set of languages.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import BLOCK_BYTES, text_buffer, written

#: Letter trigrams are counted in 2**BUCKET_BITS buckets, so a model has languages x buckets numbers whatever the input:
#: 64 MB at most, and 130 MB of counts on their way to the driver. More languages are refused, loudly.
BUCKET_BITS, SMOOTHING, MOST_LANGUAGES = 15, 0.1, 256
#: Rounds of expectation-maximisation at most; a language costs PENALTY * log(trigrams) / 2; weights below LEAST_SHARE go.
ROUNDS, PENALTY, LEAST_SHARE = 25, 2.0, 0.02
#: A text fits the learned languages if less of it than this stands in none of them.
MOST_OUTSIDE = 0.5

BUCKETS = 1 << BUCKET_BITS


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts and the n + 1 offsets of the texts. Letters are lower-cased; whatever stands
    between words is one space, and so are both ends. A text without letters has none."""
    lowered = [f" {t.lower()} " for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[ends[:-1]] = True  # a space of its own before each text; the one after its last word is kept as any other
    at = np.concatenate(([0], np.cumsum(kept)))[ends]
    codes = np.where(letter, codes, 32)[kept].astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    buckets = mixed >> np.uint32(32 - BUCKET_BITS)
    size = np.maximum(np.diff(at) - 2, 0)
    whole = np.repeat(at[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return buckets[whole], np.concatenate(([0], np.cumsum(size)))


def _blocks(column: pa.Array):
    """(first row, texts) of runs of rows with about BLOCK_BYTES; null texts are empty."""
    _, at = text_buffer(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES // 4, "right")) - 1)
        yield first, [t or "" for t in column.slice(first, end - first).to_pylist()]
        first = end


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is a multiple of 5; a null doc_id counts as the empty text, which is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, in order of their names, and the logarithms' arguments: a probability for each language and
    bucket, from all rows of labelled (text, lang not null). Each task sends one sum for each language and bucket; the
    driver gets at most MOST_LANGUAGES x BUCKETS numbers, and fails loudly beyond."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for first, texts in _blocks(b.column(0)):
                buckets, at = trigram_buckets(texts)
                for i in range(len(texts)):
                    own = sums.setdefault(langs[first + i], np.zeros(BUCKETS, np.int64))
                    own += np.bincount(buckets[at[i] : at[i + 1]], minlength=BUCKETS)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "bucket", "n"])

    rows = labelled.select(labelled["text"].cast("string").alias("text"), labelled["lang"].cast("string").alias("lang")).mapInArrow(count, "lang string, bucket int, n long")
    summed = written(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    names = sorted(r[0] for r in summed.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    numbers = summed.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "lang string, number int")
    found = summed.join(F.broadcast(numbers), "lang").select("number", "bucket", "n").toArrow()  # MOST_LANGUAGES x BUCKETS rows at most
    counts = np.full((len(names), BUCKETS), SMOOTHING)
    counts[np.asarray(found["number"]), np.asarray(found["bucket"])] += np.asarray(found["n"])
    return names, (counts / counts.sum(axis=1, keepdims=True))


def _mixture(chances: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights after expectation-maximisation from the given ones, and the log-likelihood."""
    total = counts.sum()
    mixture = weights @ chances
    if len(weights) > 1:
        for _ in range(ROUNDS):
            updated = weights * (chances @ (counts / mixture)) / total
            moved = np.abs(updated - weights).max()
            weights = updated
            mixture = weights @ chances
            if moved < 1e-3:
                break
    return weights, float(counts @ np.log(mixture))


def proportions(chances: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, float]:
    """The weights of all languages (0 outside the selected set) for a text's trigrams, and the text's log-likelihood.

    From all languages on, the one of the least weight leaves as long as that doesn't worsen the penalised likelihood."""
    every = np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(every)
    counts, own = every[used].astype(float), chances[:, used]
    price = PENALTY * np.log(max(2, len(buckets))) / 2
    chosen = np.arange(len(chances))
    weights, fit = _mixture(own, counts, np.full(len(chances), 1 / len(chances)))
    while len(chosen) > 1:
        stays = weights >= LEAST_SHARE
        if stays.all():
            stays[weights.argmin()] = False
        elif not stays.any():
            stays[weights.argmax()] = True
        fewer, worse = _mixture(own[chosen[stays]], counts, weights[stays] / weights[stays].sum())
        if worse + price * (len(chosen) - stays.sum()) < fit:
            break
        chosen, weights, fit = chosen[stays], fewer, worse
    out = np.zeros(len(chances))
    out[chosen] = weights
    return out, fit


def outside(chances: np.ndarray, buckets: np.ndarray) -> float:
    """The share of a text's trigrams that no language explains: the weight of one more component, under which all
    buckets are equally likely, in the mixture of all languages. Without languages that is all of the text."""
    every = np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(every)
    own = np.vstack([chances[:, used], np.full((1, len(used)), 1 / BUCKETS)])
    return float(_mixture(own, every[used].astype(float), np.full(len(own), 1 / len(own)))[0][-1])


def identified(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and fits for each row of docs (doc_id, text; lang for learning).

    Learns from labelled (by default the rows of docs that have a lang and aren't held out). lang_pred is the language
    of the largest proportion (ties: the first by name), score that proportion, languages the selected set with its
    proportions. A text that is null or has no letter gets und, 0 and an empty map; so does every text where nothing
    was learned. fits: less than MOST_OUTSIDE of the text stands outside of all languages. Only the text is used."""
    if labelled is None:
        labelled = docs.where(docs["lang"].isNotNull() & ~is_held_out(docs["doc_id"]))
    names, chances = learn(labelled)
    model = docs.sparkSession.sparkContext.broadcast((names, chances))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        names, chances = model.value
        for b in batches:
            out = []
            for _, texts in _blocks(b.column(2)):
                buckets, at = trigram_buckets(texts)
                for i in range(len(texts)):
                    own = buckets[at[i] : at[i + 1]]
                    if not len(own) or not names:
                        out.append(("und", 0.0, [], False))
                        continue
                    weights, _ = proportions(chances, own)
                    best = int(weights.argmax())
                    out.append((names[best], min(1.0, float(weights[best])), [(names[k], float(weights[k])) for k in np.flatnonzero(weights)], outside(chances, own) < MOST_OUTSIDE))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "held_out", "lang_pred", "score", "languages", "fits"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), is_held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages map<string,double>, fits boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, whose text has letters and of which less than MOST_OUTSIDE stands outside of all
    learned languages (without any language, every text with letters). Learns as identified does."""
    names, chances = learn(docs.where(docs["lang"].isNotNull() & ~is_held_out(docs["doc_id"])))
    model = docs.sparkSession.sparkContext.broadcast((names, chances))
    at_text = docs.columns.index("text")

    def keep(batches):
        names, chances = model.value
        for b in batches:
            fits = []
            for _, texts in _blocks(b.column(at_text)):
                buckets, at = trigram_buckets(texts)
                for i in range(len(texts)):
                    own = buckets[at[i] : at[i + 1]]
                    fits.append(bool(len(own)) and (not names or outside(chances, own) < MOST_OUTSIDE))
            yield b.filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
