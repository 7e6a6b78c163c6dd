"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash of the last 16 bytes runs over each text; a chunk starts where it is larger than at all
places within 20 bytes. That depends on nothing but the bytes nearby, so an insertion moves the
chunks around it and no others. A chunk alone may be a common phrase; what is compared is the digest
of a unit, a chunk and its successor, 80 bytes on average.

``repeated_units`` returns every unit that is found twice, within a document too, with its place and
length; ``repeats`` joins them to spans and leaves out what its caller's ``Span`` calls too short.

Digests are counted by half of their bits first, with a partial aggregation; only those found twice
meet again in full. Joins are to one row per digest with both sides straight from a shuffle, so a
passage that a third of all documents share is split over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.llm.common import anew, cut_lineage, distinct_rows, ship_package, text_key, whole_text

REACH = 20
WINDOW = 16
#: A passage that a run of units is found of can't reach further than the chunk before and the one after, and
#: there no further than LEAD and TAIL bytes beyond their outer edges: an edge deeper inside it would be found
#: in its copies too.
LEAD, TAIL = WINDOW + REACH, REACH
PAD = 64
#: Bytes that a worker chunks at once; arrays of eight times that stay in a core's cache.
SLICE = 1 << 18


@dataclass(frozen=True)
class Span:
    """What counts as a repeat.

    Chunks without a boundary of their own are cut at ``max_chunk`` bytes, before the character there.
    Units of fewer than ``min_unit`` bytes are not compared. A span is returned if it has ``min_bytes``
    or if the passage it is found of may have ``min_words``; 0 for both returns all of them. ``within``
    counts what repeats in one document only.
    """

    min_unit: int = 40
    max_chunk: int = 1024
    min_bytes: int = 100
    min_words: int = 50
    within: bool = False


#: Passages of fifty words that documents share: what the query and the corpus' deduplication look for.
PASSAGES = Span()
#: Whatever repeats, anywhere.
ANYTHING = Span(min_unit=1, min_bytes=0, min_words=0, within=True)


def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 pseudo-random words."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64)


GEAR = gear_table()


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x moved towards higher places (lower ones if by < 0), zeros coming in."""
    out = np.zeros_like(x)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At every byte the sum of the last WINDOW bytes' gears, each shifted by its age."""
    h, n = GEAR[data], 1
    while n < WINDOW:
        h = h + (_shifted(h, n) << np.uint64(n))
        n *= 2
    return h


def _highest(h: np.ndarray, direction: int) -> np.ndarray:
    """The largest of the REACH values next to each place, before (1) or after it (-1)."""
    m, n = _shifted(h, direction), 1
    while 2 * n <= REACH:
        m = np.maximum(m, _shifted(m, direction * n))
        n *= 2
    return np.maximum(m, _shifted(m, direction * (REACH - n)))


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """True where a chunk starts by its content; never within a character."""
    h = gear_hash(data)
    h[(data & 0xC0) == 0x80] = 0
    return (h > _highest(h, 1)) & (h >= _highest(h, -1)) & (h > 0)


def edges_of(text: bytes, cuts: list[int], longest: int) -> list[int]:
    """Where the chunks of a text start and the last one ends; those too long are cut before a character."""
    edges = [0]
    for e in [*cuts, len(text)]:
        while e - edges[-1] > longest:
            at = edges[-1] + longest
            while at > edges[-1] + 1 and text[at] & 0xC0 == 0x80:
                at -= 1
            edges.append(at)
        edges.append(e)
    return edges


def units_of(texts: list[bytes], span: Span = PASSAGES) -> list[list[tuple[int, int, bytes]]]:
    """For each text its units: start, end and 16-byte digest of a chunk and its successor.

    A text of one chunk is a unit; units of fewer than ``min_unit`` bytes are left out.
    """
    pad = bytes(PAD)
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    cuts = np.flatnonzero(chunk_starts(data))
    out, at = [], PAD
    for text in texts:
        own = cuts[np.searchsorted(cuts, at + 1) : np.searchsorted(cuts, at + len(text))] - at
        edges = edges_of(text, own.tolist(), span.max_chunk)
        last = max(1, len(edges) - 2)
        ends = edges[2:] or edges[1:]
        units = [(s, e) for s, e in zip(edges[:last], ends) if e - s >= max(1, span.min_unit)]
        out.append([(s, e, xxhash.xxh3_128_digest(text[s:e])) for s, e in units])
        at += len(text) + PAD
    return out


def word_reach(text: bytes, own: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each of a text's units the numbers of the first and last word that a passage it is found of may have."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    number = np.cumsum(~space & np.append(True, space[:-1]), dtype=np.int32)
    first = np.array([0, *[s for s, _, _ in own[:-1]]], np.int64) - LEAD
    last = np.array([*[e for _, e, _ in own[1:]], len(text)], np.int64) + TAIL
    return number[np.maximum(first, 0)], number[np.minimum(last, len(text)) - 1]


def units(docs: DataFrame, span: Span = PASSAGES) -> DataFrame:
    """doc_id, mark (a hash of the text), start, end (bytes), word_reach, h1 and h2 of every unit.

    Rows that repeat id and text are one document. Null and empty texts have no units, an empty table
    has none; a very long text is chunked in one worker, which holds some 60 bytes for each of its.
    """

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in enumerate(batch.column("text").cast(pa.binary())):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= SLICE or i == batch.num_rows - 1:
                    yield table(batch, ids, texts)
                    ids, texts, size = [], [], 0

    def table(batch, ids, texts):
        found = units_of(texts, span)
        n = [len(u) for u in found]
        flat = [u for us in found for u in us]
        digests = np.frombuffer(b"".join(d for _, _, d in flat), np.int64).reshape(-1, 2)
        reach = [word_reach(t, u) for t, u in zip(texts, found) if u] or [(np.zeros(0, np.int32),) * 2]
        rows = pa.array(np.repeat(ids, n), pa.int64())
        columns = [
            batch.column("doc_id").take(rows),
            batch.column("mark").take(rows),
            pa.array([s for s, _, _ in flat], pa.int32()),
            pa.array([e for _, e, _ in flat], pa.int32()),
            pa.array(np.concatenate([a for a, _ in reach])),
            pa.array(np.concatenate([b for _, b in reach])),
            pa.array(digests[:, 0].copy()),
            pa.array(digests[:, 1].copy()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "start", "end", "word", "last_word", "h1", "h2"])

    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = distinct_rows(docs.select("doc_id", whole_text().alias("text"), text_key().alias("mark")), "mark")
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, start int, end int, word int, last_word int, h1 long, h2 long")


def repeated_units(docs: DataFrame, span: Span = ANYTHING) -> DataFrame:
    """doc_id, mark, start, end, n_bytes, found, first_doc_id, first: a row per unit that repeats.

    ``found`` counts its places in all documents. ``first`` is where it stays: the document of the
    smallest doc_id that has it, or its first place there where ``within`` counts; a null id comes first.
    """
    rows = _repeated(docs, span)
    return rows.select("doc_id", "mark", "start", "end", (F.col("end") - F.col("start")).alias("n_bytes"), "found", "first_doc_id", "first")


def _repeated(docs: DataFrame, span: Span) -> DataFrame:
    found = units(docs, span)
    twice = found.groupBy("h1").count().filter("count > 1").select("h1")
    again = cut_lineage(found.join(anew(twice, "h1"), "h1", "left_semi"))
    place = F.struct("doc_id", "mark", "start")
    digests = again.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.count("*").alias("found"))
    shared = ~(F.col("a.doc_id").eqNullSafe(F.col("z.doc_id")) & (F.col("a.mark") == F.col("z.mark")))
    digests = digests.filter("found > 1" if span.within else shared).drop("z")
    there = F.col("doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("mark") == F.col("a.mark"))
    if span.within:
        there = there & (F.col("start") == F.col("a.start"))
    rows = again.join(anew(digests, "h1"), ["h1", "h2"])
    return rows.withColumns({"first": there, "first_doc_id": F.col("a.doc_id")}).drop("a", "h1", "h2")


def repeats(docs: DataFrame, span: Span = PASSAGES) -> DataFrame:
    """doc_id, mark, start, end, first_doc_id, first: a row per repeated span, in bytes of the text.

    A span is a run of repeated units without a gap; ``first`` ones stay, as their document is the
    first of each of their units, the others repeat what other documents have. first_doc_id is the
    smallest of those documents; where a span's parts are of several, it need not hold all of it.
    What is too short for ``span`` is left out, as are null and empty texts. Rows that repeat id and
    text are one document; a null id comes first; an empty table gives no rows.
    """
    rows = _repeated(docs, span)
    # Units overlap, as each chunk is in two of them.
    own = Window.partitionBy("doc_id", "mark", "first").orderBy("start", "end")
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(ahead), F.lit(-1))).cast("int"))
    rows = rows.withColumn("span", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        rows.groupBy("doc_id", "mark", "first", "span")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max("last_word") - F.min("word") + 1).alias("words"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .filter((F.col("end") - F.col("start") >= span.min_bytes) | (F.col("words") >= span.min_words))
        .select("doc_id", "mark", "start", "end", "first_doc_id", "first")
    )


def drop_repeats(docs: DataFrame, span: Span = PASSAGES) -> DataFrame:
    """``docs``, all columns, with the spans that stay elsewhere cut out of ``text``.

    Every chunk stays in the first of the documents that has it. Spans end between characters. Texts
    without such a span come back as they are, null ones too; repeated rows are cut alike, and an
    empty table gives no rows. Texts cross the network once if the spans are too many to broadcast.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for t, s, e in zip(texts.cast(pa.binary()), starts, ends):
            raw, at, kept = t.as_py(), 0, []
            for a, b in sorted(zip(s.as_py() or [], e.as_py() or [])):
                kept.append(raw[at : max(a, at)])
                at = max(at, b)
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    gone = repeats(docs, span).filter("not first").groupBy("doc_id", "mark")
    gone = gone.agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key().alias("mark"))
    same = F.col("r.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.mark") == F.col("g.mark"))
    rows = rows.alias("r").join(gone.alias("g"), same, "left")
    text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(
        cut(F.coalesce("row.text", F.lit("")), F.coalesce("starts", F.array().cast("array<int>")), F.coalesce("ends", F.array().cast("array<int>")))
    )
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
