"""SimHash near-duplicates by anchor-point covering.

Fingerprints are points of a 64-bit cube. The anchors are the codewords of the binary Golay code on
bits 0-22 times those on bits 23-45: every point has one anchor within 3 bits in each half, its
home. A point within the threshold of x lies within 3 + d1 and 3 + d2 bits of x's home, with
d1 + d2 <= THRESHOLD, so each fingerprint is replicated to all such anchors (about 61 of 2^24) and
every pair within the threshold meets at the home of either. Only pairs that meet are compared.

Equal fingerprints are one point, so copies do not multiply. Within an anchor a breadth-first
search returns a spanning forest, not pairs. A crowded anchor is not searched: its points go to the
midpoints instead (two points within 2 bits share a point within 1 bit of both; each midpoint has
at most 65 points), which is exact at any size.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import FOLD, anew, cut_lineage, per_text, ship_package, take_out, text_key, whole_text
from meterglass.llm.components import connected_components
from meterglass.llm.hashing import PAD, xxh64

THRESHOLD = 2
SEED = 42
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
BLOCK = 23
RADIUS = 3


#: Texts and bytes that a worker fingerprints at once; a longer text goes alone.
TEXTS, SLICE = 1024, 1 << 19
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_texts(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text, as a signed integer, of its shingles, repeats included; 0 without words.

    A text of fewer words than a shingle has is one shingle.
    """
    data = np.frombuffer(b"\n".join(t.translate(FOLD) for t in texts) + b"\n", np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    # Of each run of white space one space stays, so the shingles are slices of what is left.
    space = SPACE[data]
    kept = np.flatnonzero(~space | ~np.r_[False, space[:-1]])
    white = space[kept]
    text = np.append(np.where(white, 32, data[kept]), np.zeros(PAD)).astype(np.uint8)
    first = np.flatnonzero(~white & np.r_[True, white[:-1]])
    last = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    words = np.bincount(np.searchsorted(text_ends, kept[first], "right"), minlength=len(texts))
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    i = np.arange(len(owner)) + np.repeat(np.cumsum(words) - words - (np.cumsum(n) - n), n)
    hashes = xxh64(text, first[i], last[i + np.minimum(shingle, words[owner]) - 1], SEED)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = [np.bincount(owner * 256 + octets[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ BITS for k in range(8)]
    return np.packbits(2 * np.hstack(ones) > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def slices(texts: pa.Array):
    """Lists of TEXTS texts or of about SLICE bytes together, or of one longer text."""
    own, size = [], 0
    for t in texts:
        own.append(t.as_py())
        size += len(own[-1])
        if size >= SLICE or len(own) == TEXTS:
            yield own
            own, size = [], 0
    if own:
        yield own


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key and fp (longs) of every whole text; null counts as empty, without words it is 0."""

    @per_text("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint_texts(own, shingle) for own in slices(texts.cast(pa.binary()))]
        return pa.array(np.concatenate(found) if found else [], pa.int64())

    return docs.select("doc_id", text_key().alias("key"), run(whole_text()).alias("fp"))


@cache
def cosets() -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of every 23-bit word, and by weights the error patterns of each syndrome.

    The patterns are held as offsets by syndrome and one array: patterns of weight lo to hi.
    """
    unit = []
    for i in range(BLOCK):
        x = 1 << i
        for k in range(BLOCK - 1, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        unit.append(x)
    syndromes = np.zeros(1 << BLOCK, np.int16)
    for i, x in enumerate(unit):
        syndromes[1 << i : 2 << i] = syndromes[: 1 << i] ^ x
    words = [sum(1 << i for i in c) for w in range(RADIUS + THRESHOLD + 1) for c in combinations(range(BLOCK), w)]
    words = np.array(words, np.int64)
    weights, by = np.array([int(w).bit_count() for w in words]), syndromes[words]
    tables = {}
    for lo, hi in ((0, RADIUS), (0, RADIUS + 2), (RADIUS + 1, RADIUS + 1), (RADIUS + 1, RADIUS + 2)):
        own = np.flatnonzero((weights >= lo) & (weights <= hi))
        own = own[np.argsort(by[own], kind="stable")]
        tables[lo, hi] = (np.searchsorted(by[own], np.arange(2049)), words[own])
    return syndromes, tables


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints, one for each anchor a fingerprint goes to.

    A key is the anchor's 46 bits times two, plus 0 at the fingerprint's home and 1 elsewhere.
    """
    syndromes, tables = cosets()
    mask = (1 << BLOCK) - 1
    left, right = fps & mask, (fps >> BLOCK) & mask
    sl, sr = syndromes[left], syndromes[right]
    keys, points = [], []
    # (weights of the left pattern, of the right one): together all with d1 + d2 <= 2.
    for wl, wr in (((0, 3), (0, 5)), ((4, 5), (0, 3)), ((4, 4), (4, 4))):
        (at_l, pat_l), (at_r, pat_r) = tables[wl], tables[wr]
        nl, nr = at_l[sl + 1] - at_l[sl], at_r[sr + 1] - at_r[sr]
        n = nl * nr
        row = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a, b = pat_l[at_l[sl[row]] + nth // nr[row]], pat_r[at_r[sr[row]] + nth % nr[row]]
        away = (np.bitwise_count(a) > RADIUS) | (np.bitwise_count(b) > RADIUS)
        keys.append((((left[row] ^ a) | (right[row] ^ b) << BLOCK) << 1) | away)
        points.append(fps[row])
    return np.concatenate(keys), np.concatenate(points)


def forest(fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the points of one anchor; one of each pair is at home."""
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= THRESHOLD
            if not home[i]:
                near &= home[left]
            if near.any():
                edges += [(int(fps[i]), int(fps[j])) for j in left[near]]
                todo += list(left[near])
                left = left[~near]
    return edges


def compare_anchors(batches, crowd: int):
    """Edges (a, b, crowded) from batches sorted by key; the points of a crowded anchor as (a, a, true)."""
    keep_k, keep_p = np.empty(0, np.int64), np.empty(0, np.uint64)
    crowded_anchor = -1

    def edges_of(k, p):
        anchor, home = k >> 1, (k & 1) == 0
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(k)])
        found_a, found_b, dense = [], [], []
        # Small groups all at once: each point with the one k places on, while the anchor is the same.
        small = np.repeat((size > 1) & (size <= 16) & home[first], size)
        i = np.flatnonzero(small)
        for step in range(1, 16):
            i = i[i + step < len(k)]
            i = i[anchor[i] == anchor[i + step]]
            if not len(i):
                break
            near = i[home[i] & (np.bitwise_count(p[i] ^ p[i + step]) <= THRESHOLD)]
            found_a.append(p[near])
            found_b.append(p[near + step])
        for at, n in zip(first[size > 16], size[size > 16]):
            if n > crowd:
                dense.append(p[at : at + n])
            elif home[at]:
                pairs = forest(p[at : at + n], home[at : at + n])
                found_a.append(np.array([x for x, _ in pairs], np.uint64))
                found_b.append(np.array([x for _, x in pairs], np.uint64))
        return found_a, found_b, dense

    def out(found_a, found_b, dense):
        a, b = np.concatenate(found_a + dense + [keep_p[:0]]), np.concatenate(found_b + dense + [keep_p[:0]])
        flag = np.zeros(len(a), bool)
        flag[len(a) - sum(map(len, dense)) :] = True
        columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(flag)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "crowded"])

    for batch in batches:
        k = np.concatenate([keep_k, batch.column("key").to_numpy()])
        p = np.concatenate([keep_p, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(k):
            continue
        anchor, dense = k >> 1, []
        if anchor[0] == crowded_anchor:  # the rest of a group that was too large to hold
            n = int(np.searchsorted(anchor, crowded_anchor, "right"))
            dense, k, p, anchor = [p[:n]], k[n:], p[n:], anchor[n:]
        cut = int(np.searchsorted(anchor, anchor[-1])) if len(k) else 0
        if len(k) - cut > crowd:
            crowded_anchor = int(anchor[-1])
            dense.append(p[cut:])
            keep_k, keep_p = k[:0], p[:0]
        else:
            keep_k, keep_p = k[cut:], p[cut:]
        a, b, more = edges_of(k[:cut], p[:cut]) if cut else ([], [], [])
        yield out(a, b, more + dense)
    if len(keep_k):
        yield out(*edges_of(keep_k, keep_p))


def links(points: DataFrame, crowd: int = 4096) -> DataFrame:
    """Edges (a, b) that connect just those of the distinct fingerprints ``fp`` that links connect."""

    def replicate(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for i in range(0, len(fps), 8192):
                key, fp = anchors_of(fps[i : i + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    def compare(batches):
        yield from compare_anchors(batches, crowd)

    ship_package(points.sparkSession)
    met = (
        points.select("fp")
        .mapInArrow(replicate, "key long, fp long")
        .repartition(F.shiftright("key", 1))
        .sortWithinPartitions("key")
        .mapInArrow(compare, "a long, b long, crowded boolean")
    )
    met = cut_lineage(met.distinct())
    dense = met.filter("crowded").select(F.col("a").alias("fp")).distinct()
    flips = F.expr("explode(concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i))))")
    mid = dense.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = mid.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    near = mid.join(least, "mid").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return met.filter("not crowded").select("a", "b").union(near)


def _named(docs: DataFrame, shingle: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, fp) and each fingerprint's component with the document it is named after."""
    own = cut_lineage(fingerprints(docs, shingle))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    points = cut_lineage(own.groupBy("fp").agg(F.min(name).alias("least")))
    roots = connected_components(links(points, crowd))
    points = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    points = points.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = points.groupBy("root").agg(F.min("least").alias("name"))
    return own, points.join(anew(names, "root"), "root").select("fp", "name")


def near_groups(docs: DataFrame, shingle: int = 3, crowd: int = 4096) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    component_id is the smallest doc_id that can be reached over links, itself included. A null text
    counts as empty; texts without words have fingerprint zero and link like any other; a null
    doc_id never is a component's name unless all its ids are null. Repeated rows give repeated
    rows; an empty table gives none. A very long text is split into words in one worker.
    """
    own, named = _named(docs, shingle, crowd)
    return own.join(named, "fp").select("doc_id", "fp", F.col("name.doc_id").alias("component_id"))


def drop_near(docs: DataFrame, shingle: int = 3, crowd: int = 4096) -> DataFrame:
    """``docs``, all columns, with the one document of each component that it is named after.

    That is the one of the smallest doc_id. Nulls, repeated rows, texts without words and an empty
    table are treated as by ``near_groups``; of rows that repeat id and text one stays. Texts are
    fingerprinted where they lie, a very long one in some 100 bytes of memory a word.
    """
    own, named = _named(docs, shingle, crowd)
    rows = own.groupBy("doc_id", "key", "fp").agg(F.count("*").alias("copies")).join(named, "fp")
    stays = (F.col("key") == F.col("name.key")) & F.col("doc_id").eqNullSafe(F.col("name.doc_id"))
    rows = rows.withColumn("stays", stays)
    return take_out(docs, rows.filter("not stays"), rows.filter("stays and copies > 1"))
