"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors,
the first permuted twice and the second once; a document is the sum of its trigrams, a language the
sum of its training documents scaled to length one. The nearest language by cosine is predicted.

Profiles are learned from at most ``max_rows`` texts, those of the smallest hash of id and text;
partial sums are aggregated by language and dimension. Profiles are few and broadcast.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import cut_lineage, held_out, per_text, ship_package, struct_of, text_key, whole_text

DIMENSIONS = 512
SEED = 20_240_611
MAX_ROWS = 20_000
#: Texts and characters that are turned into vectors together.
TEXTS, CHARS = 64, 1 << 20
#: Counts of a trigram in a text that are held at once; texts of wider alphabets are taken in smaller parts.
COUNTS = 1 << 21


@cache
def letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(1 << 16)
def letter(code: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def vectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text's trigrams; zero where a text has no letter.

    Anything between letters is one boundary, as are both ends; a trigram has a letter in the middle.
    """
    joined = np.frombuffer("\0\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = [len(t.lower()) + 2 for t in texts]
    doc = np.repeat(np.arange(len(texts) + 1), [*sizes, len(joined) - sum(sizes)])
    codes = np.where(letters()[joined], joined, 0)
    keep = np.r_[True, (codes[1:] > 0) | (codes[:-1] > 0)]
    codes, doc = codes[keep], doc[keep]
    present = np.unique(codes)
    small = np.searchsorted(present, codes)
    middle = np.flatnonzero(codes[1:-1] > 0)
    if not len(middle):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    k = len(present)
    grams = (small[middle] * k + small[middle + 1]) * k + small[middle + 2]
    owner = doc[middle + 1]
    if k**3 <= 1 << 22:
        distinct = np.flatnonzero(np.bincount(grams, minlength=k**3))
        place = np.zeros(k**3, np.int64)
        place[distinct] = np.arange(len(distinct))
        at = place[grams]
    else:
        distinct, at = np.unique(grams, return_inverse=True)
    if len(texts) > 1 and len(texts) * len(distinct) > COUNTS:
        half = len(texts) // 2
        return np.concatenate([vectors(texts[:half]), vectors(texts[half:])])
    counts = np.bincount(owner * len(distinct) + at, minlength=len(texts) * len(distinct))
    counts = counts.reshape(len(texts), -1).astype(np.float32)
    own = np.array([letter(int(c)) for c in present])
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i in range(0, len(distinct), 4096):  # trigram vectors of bounded size
        d = distinct[i : i + 4096]
        bound = np.roll(own, 2, 1)[d // (k * k)] * np.roll(own, 1, 1)[d // k % k] * own[d % k]
        out += counts[:, i : i + 4096] @ bound.astype(np.float32)
    return out


def slices(texts: pa.Array):
    """Places and texts, so many together as TEXTS and CHARS allow."""
    at, own, size = [], [], 0
    for i, t in enumerate(texts):
        at.append(i)
        own.append(t.as_py())
        size += len(own[-1])
        if size >= CHARS or len(own) == TEXTS:
            yield at, own
            at, own, size = [], [], 0
    if own:
        yield at, own


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def profiles(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """lang, dimension, value: sums over the training documents, whose lang is known and id not held out.

    They are at most ``max_rows``, whatever ids repeat: rows are told by id, text and lang, and
    repeated ones are one. A null or empty text adds nothing; an empty table gives no rows. A long
    text counts as much as a short one, as every document's vector has length one.
    """
    own = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    own = own.select("doc_id", text_key().alias("key"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    name = ["doc_id", "key", "lang"]
    met = own.select(name).distinct().orderBy(F.xxhash64("key", "lang"), *name).limit(max_rows)
    rows = own.join(F.broadcast(cut_lineage(met)), name, "left_semi")
    rows = rows.groupBy(name).agg(F.min("text").alias("text")).select("lang", "text")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in slices(batch.column("text")):
                for i, v in zip(at, unit(vectors(texts))):
                    sums[langs[i]] = sums.get(langs[i], 0) + v.astype(np.float64)
        for lang, v in sums.items():
            columns = [pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "dimension", "value"])

    ship_package(docs.sparkSession)
    parts = rows.mapInArrow(bundle, "lang string, dimension int, value double")
    return parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value"))


def identify(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the nearest profile and its cosine, not below 0.

    lang_pred is ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Of
    languages with equal cosines the first by name is taken. Repeated rows repeat, a null doc_id
    stays null, an empty table gives no rows. A long text goes through in one piece, its trigrams'
    vectors 4,096 at a time.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("dimension", "value"))), lambda x: x["value"])
    # A row for each language, max_rows of 4 kB at most.
    rows = sorted(learned.groupBy("lang").agg(values.alias("v")).collect(), key=lambda r: r["lang"])
    table = np.array([r["v"] for r in rows]).reshape(-1, DIMENSIONS)
    shared = docs.sparkSession.sparkContext.broadcast(([r["lang"] for r in rows], unit(table).astype(np.float32)))

    @per_text("struct<lang: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        langs, table = shared.value
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        for at, own in slices(texts) if langs else ():
            rows = vectors(own)
            near = unit(rows) @ table.T
            best = near.argmax(axis=1)
            for i, row, b, c in zip(at, rows, best, near[np.arange(len(own)), best]):
                if row.any():
                    pred[i], score[i] = langs[b], min(1.0, max(0.0, float(c)))
        return struct_of(["lang", "score"], [pa.array(pred, pa.string()), pa.array(score)])

    rows = docs.select("doc_id", held_out().alias("held_out"), run(whole_text()).alias("r"))
    return rows.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"))
