"""A quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A token is a run of letters, of digits or of marks. It counts as a word (in lower case) and as a
shape (how it is cased, which marks, whether it repeats the word before), and the features are
hashed 1- and 2-grams of words and 1- to 3-grams of shapes. A document's values are its counts over
the root of its number of features, so a score is one sparse dot product whatever the length.

Training reads at most ``max_rows`` labelled texts, those of the smallest hash of id and text, in a
fixed number of shards; each shard makes the FTRL-proximal updates in one pass, and the shards'
weights are averaged by feature, each by its number of rows. The model has at most 2^18 weights and
is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import cut_lineage, held_out, per_text, ship_package, text_key, whole_text

BITS = 18
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SLICE = 1 << 21
#: The place of the number of rows among a shard's weights.
ROWS = -1


@dataclass(frozen=True)
class Training:
    """The bound on labelled rows, the shards they are trained in and FTRL's parameters."""

    max_rows: int = 20_000
    shards: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1


def shape(token: str) -> str:
    if not token[0].isalpha():
        return token[:3] if not token[0].isdigit() else "9"
    return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts one after the other, and the text that each is of."""
    tokens = [TOKEN.findall(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    flat = pa.array([w for t in tokens for w in t], pa.string()).dictionary_encode()
    distinct, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    words = np.array([xxhash.xxh64_intdigest(w.lower(), 1) for w in distinct] or [0], np.uint64)[at]
    shapes = np.array([xxhash.xxh64_intdigest(shape(w), 2) for w in distinct] or [0], np.uint64)[at]
    if len(words) > 1:
        shapes[1:] ^= ((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
    found, owner = [], []
    for stream, longest in ((words, 2), (shapes, 3)):
        gram = stream
        for n in range(1, longest + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ stream[n - 1 :]
            inside = doc[: len(gram)] == doc[n - 1 :] if n > 1 else np.ones(len(gram), bool)
            mixed = (gram + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            found.append((mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64))
            owner.append(doc[: len(gram)][inside])
            if len(gram) < 2:
                break
    return np.concatenate(found), np.concatenate(owner)


def batches_of(texts: pa.Array):
    """Places and texts, about SLICE characters at a time."""
    at, own, size = [], [], 0
    for i, t in enumerate(texts):
        at.append(i)
        own.append(t.as_py())
        size += len(own[-1])
        if size >= SLICE:
            yield at, own
            at, own, size = [], [], 0
    if own:
        yield at, own


def ftrl_pass(rows, t: Training) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights after one pass over (features, label); the last place is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        shrunk = np.maximum(np.abs(z[at]) - t.l1, 0) * -np.sign(z[at])
        return shrunk / ((t.beta + np.sqrt(n[at])) / t.alpha + t.l2)

    for found, label in rows:
        at, count = np.unique(found, return_counts=True)
        x = np.r_[count / np.sqrt(max(1, len(found))), 1.0]
        at = np.r_[at, 1 << BITS]
        w = weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / t.alpha
        z[at] += g - sigma * w
        n[at] += g * g
    at = np.flatnonzero(n)
    w = weights(at)
    return at[w != 0], w[w != 0]


def labelled(docs: DataFrame, labels: DataFrame, t: Training) -> DataFrame:
    """h, text, label of the training rows: known quality, id not held out.

    They are at most ``max_rows`` after the join, whatever repeats on either side: rows are told by
    id, text and label, repeated ones are one, and the bound is set on narrow rows.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    texts = docs.select("doc_id", whole_text().alias("text"), text_key().alias("key"))
    met = texts.select("doc_id", "key").join(known, "doc_id").distinct()
    picked = cut_lineage(met.orderBy(F.xxhash64("key", "label"), "key", "doc_id", "label").limit(t.max_rows))
    rows = texts.join(F.broadcast(picked), ["doc_id", "key"])
    rows = rows.groupBy("doc_id", "key", "label").agg(F.min("text").alias("text"))
    return rows.select(F.xxhash64("key", "label").alias("h"), "text", "label")


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """feature, weight; without labelled rows it is empty and every score is one half.

    Null texts are empty ones; null ids, and qualities other than 0 and 1, are not learned from.
    Repeated rows count once, an id of two texts or labels as two rows. A shard is one task's work,
    ``max_rows`` / ``shards`` rows, however many documents there are; a very long text is learned from
    whole, as one row.
    """

    def shards_of(batches):
        def rows():
            for batch in batches:
                labels, shards = batch.column("label").to_pylist(), batch.column("shard").to_pylist()
                for at, texts in batches_of(batch.column("text")):
                    found, owner = features(texts)
                    order = np.argsort(owner, kind="stable")
                    parts = np.split(found[order], np.searchsorted(owner[order], np.arange(1, len(texts))))
                    yield from ((shards[i], f, labels[i]) for i, f in zip(at, parts))

        # A partition may hold several shards or none; each is a pass of its own.
        for _, own in groupby(rows(), key=lambda r: r[0]):
            own = [(f, label) for _, f, label in own]
            at, w = ftrl_pass(own, t)
            columns = [pa.array(np.r_[at, ROWS]), pa.array(np.r_[w * len(own), len(own)])]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "weight"])

    ship_package(docs.sparkSession)
    rows = labelled(docs, labels, t).withColumn("shard", F.pmod("h", F.lit(t.shards)).cast("int"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "h", "text").select("text", "label", "shard")
    sums = cut_lineage(rows.mapInArrow(shards_of, "feature long, weight double").groupBy("feature").agg(F.sum("weight").alias("weight")))
    n = sums.filter(F.col("feature") == ROWS).agg(F.max("weight")).scalar()
    return sums.filter(F.col("feature") != ROWS).select("feature", (F.col("weight") / n).alias("weight"))


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, score: the probability of label 1 of every whole text.

    A null text is empty; an empty one scores by the bias alone. Repeated rows repeat, a null
    doc_id stays null, an empty table gives no rows. A very long text is held in memory with its
    features, some 100 bytes a token.
    """
    dense = np.zeros((1 << BITS) + 1)
    table = model.toArrow()  # at most 2^18 + 1 rows
    dense[table["feature"].to_numpy()] = table["weight"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(dense)

    @per_text("double")
    def run(texts: pa.Array) -> pa.Array:
        w, out = shared.value, np.zeros(len(texts))
        for at, own in batches_of(texts):
            found, owner = features(own)
            n = np.maximum(1, np.bincount(owner, minlength=len(own)))
            logit = np.bincount(owner, w[found], minlength=len(own)) / np.sqrt(n) + w[-1]
            out[at] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return pa.array(out)

    return docs.select("doc_id", run(whole_text()).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of one half).

    Rows are taken as ``score`` takes them; a null doc_id counts as not held out.
    """
    rows = score(docs, train(docs, labels, t))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
