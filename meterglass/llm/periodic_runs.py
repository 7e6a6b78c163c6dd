"""Stretches of a text that repeat one period, by Crochemore's partition refinement.

Two places of a text are in one class of level l if the same l words start at both. Level 1 are equal
words; level l + 1 splits a class by the class of the next place. A class is split only by the parts of
the last level's splits, and of the parts of a split all but the largest count, so a place is moved at
most log n times. Members of a class are linked in order of place. If neighbours of a class of level l
are l apart, a square stands there, of a root that is no power: were it one, a third member would stand
between. Squares of one period at places that follow each other make a run.

When neighbours were linked is noted with them. A pair at distance d reveals a square if it was there at
level d, which is decided when the pair is parted: nothing is searched for level by level.

All texts of a slice are refined at once, on arrays. A run of exponent e has a period of n / e words at
most, so a text takes part up to that level only; levels beyond a few are reached by texts that repeat
something long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterglass.llm.common import ship_package, struct_of, whole_text

#: Bytes and texts that a worker refines at once; a longer text goes alone, in some 100 bytes of memory a word.
SLICE, TEXTS = 6 << 20, 8192
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
RUN = "struct<start:bigint,length:bigint,period:bigint>"


@dataclass(frozen=True)
class Periodic:
    """What counts as a run: at least ``words`` words and ``exponent`` (2 or more) periods."""

    words: int = 24
    exponent: int = 3


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every range, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a value of ``x`` differs from the one before, the first place always."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


def spans(first: np.ndarray, n: int) -> np.ndarray:
    """The distances of ``first``, the last one to ``n``."""
    size = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=size[:-1])
    size[-1:] = n - first[-1:]
    return size


def squares(codes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and period of every square of a primitive root whose period is within its place's ``limit``.

    Equal ``codes`` are equal words; a code that occurs once, before, between and after the texts,
    keeps them apart.
    """
    n = len(codes)
    perm = np.argsort(codes, kind="stable").astype(np.int32)
    first = np.r_[True, np.diff(codes[perm]) != 0]
    heads = np.flatnonzero(first)
    # By class: where its members stand in perm, and how many there are. There are never more classes than places.
    begin, size = np.zeros(n, np.int32), np.zeros(n, np.int32)
    begin[: len(heads)], size[: len(heads)] = heads, np.diff(np.r_[heads, n])
    cls, loc = np.empty(n, np.int32), np.empty(n, np.int32)
    cls[perm], loc[perm] = np.cumsum(first) - 1, np.arange(n)
    # By place: its neighbours in the class, n where there is none, and the level from which the next one is its neighbour.
    after, before, born = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32), np.ones(n + 1, np.int32)
    same = np.flatnonzero(~first[1:])
    after[perm[same]], before[perm[same + 1]] = perm[same + 1], perm[same]
    leaves = np.zeros(n + 1, bool)
    made, level, at, period = len(heads), 1, [], []

    def part(x: np.ndarray) -> None:
        """The pairs of x and their neighbours end with this level."""
        d = after[x] - x
        found = (d <= level) & (born[x] <= d) & (d < n - x)
        if found.any():
            at.append(x[found])
            period.append(d[found])

    by = np.flatnonzero(size[cls] > 0)[1:]
    while True:
        p = by - 1
        p = np.sort(p[(size[cls[p]] > 1) & (level < limit[p])])
        if not len(p):
            break
        own, key = cls[p], cls[p].astype(np.int64) * n + cls[p + 1]
        order = np.argsort(key, kind="stable")
        p, own, key = p[order], own[order], key[order]
        # Groups: places of one class whose next places are of one class.
        g = firsts(key)
        g_size, g_own = spans(g, len(p)), own[g]
        c = firsts(g_own)
        c_id, c_of = g_own[c], np.repeat(np.arange(len(c)), spans(c, len(g)))
        whole = np.add.reduceat(g_size, c) == size[c_id]
        largest = (g_size == np.maximum.reduceat(g_size, c)[c_of]).nonzero()[0]
        largest = largest[firsts(c_of[largest])]
        # Of a class that all leave, the largest group keeps its place.
        moves = np.ones(len(g), bool)
        moves[largest[whole]] = False
        if not moves.any():
            break
        m, g_own = p[np.repeat(moves, g_size)], g_own[moves]
        g_size, c_of = g_size[moves], c_of[moves]
        g = np.cumsum(g_size) - g_size
        c = firsts(c_of)
        c_id, c_size, c_of = g_own[c], np.add.reduceat(g_size, c), np.repeat(np.arange(len(c)), spans(c, len(g)))
        new = made + np.arange(len(g), dtype=np.int32)
        made += len(g)

        # What stays is linked over the gaps.
        leaves[m] = True
        heads, tails = m[~leaves[before[m]]], m[~leaves[after[m]]]
        heads = heads[np.argsort(cls[heads].astype(np.int64) * n + heads)]
        tails = tails[np.argsort(cls[tails].astype(np.int64) * n + tails)]
        a, b = before[heads], after[tails]
        part(a[a < n])
        after[a], before[b], born[a] = b, a, level + 1
        after[n] = before[n] = n
        # What leaves is linked group by group.
        last = np.zeros(len(m), bool)
        last[g + g_size - 1] = True
        follow = np.full(len(m), n, np.int32)
        np.copyto(follow[:-1], m[1:], where=~last[:-1])
        changed = m[follow != after[m]]
        part(changed)
        born[changed] = level + 1
        after[m] = follow
        before[m] = n
        before[follow[~last]] = m[~last]

        # Its members go to the end of the class' stretch of perm, which becomes theirs.
        end = begin[c_id] + size[c_id] - c_size
        slots = ranges(end, c_size)
        there = perm[slots]
        there = there[~leaves[there]]
        stood = loc[m]
        free = stood[stood < np.repeat(end, c_size)]
        perm[free], loc[there] = there, free
        perm[slots], loc[m] = m, slots
        leaves[m] = False
        size[c_id] -= c_size.astype(np.int32)
        begin[new], size[new], cls[m] = slots[g], g_size, np.repeat(new, g_size)

        # All parts but the largest split on the next level.
        most = np.maximum.reduceat(g_size, c)
        rest = size[c_id] >= most
        spared = (g_size == most[c_of]).nonzero()[0]
        spared = spared[firsts(c_of[spared])]
        use = np.ones(len(g), bool)
        use[spared[~rest]] = False
        parts = np.concatenate([new[use], c_id[~rest]])
        by = perm[ranges(begin[parts], size[parts])]
        level += 1
    x = np.flatnonzero(after[:n] < n)
    d = after[x] - x
    found = (born[x] <= d) & (d <= limit[x])
    return np.concatenate([*at, x[found]]), np.concatenate([*period, d[found]])


def runs_of(texts: list[bytes], what: Periodic = Periodic()) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and rows (text, start, length, period) of its runs in that order."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, first - 1, "right")
    n = np.bincount(text, minlength=len(texts))
    # Words are told apart whole: their bytes without white space, by Arrow's dictionary.
    kept = np.cumsum(~space)
    offsets = np.r_[kept[first] - 1, kept[-1]]
    kind = pa.large_binary()
    words = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~space])])
    word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    # One place between texts, whose code no other place has.
    place = np.arange(len(word)) + text + 1
    codes = -1 - np.arange(len(word) + len(texts) + 1)
    codes[place] = text * (int(word.max(initial=0)) + 1) + word
    limit = np.zeros(len(codes), np.int64)
    limit[place] = (n // what.exponent)[text]
    x, d = squares(codes, limit)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)][: len(x)])
    tail = np.r_[head[1:], len(x)][: len(head)] - 1
    start, period = x[head].astype(np.int64), d[head].astype(np.int64)
    length = x[tail] - start + 2 * period
    long = length >= np.maximum(what.words, what.exponent * period)
    start, length, period = start[long], length[long], period[long]
    zero = np.cumsum(n + 1) - n  # the place of each text's first word
    own = np.searchsorted(zero, start, "right") - 1
    rows = np.stack([own, start - zero[own], length, period], axis=1)
    return n, rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those that a run (start, length, period) has beyond its first period."""
    words = text.split()
    if len(runs):
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
        np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
    return b" ".join(words)


def _slices(texts: pa.Array):
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


def _found(rows: DataFrame, what: Periodic) -> DataFrame:
    """What stands in ``rows`` (any column, text), with n_words, runs and collapsed in place of text; slice by slice."""
    ship_package(rows.sparkSession)
    name = rows.columns[0]

    def find(batches):
        for batch in batches:
            at = 0
            for own in _slices(batch.column(1).cast(pa.large_binary())):
                n, found = runs_of(own, what)
                cut = np.searchsorted(found[:, 0], np.arange(len(own) + 1))
                items = struct_of(["start", "length", "period"], [pa.array(found[:, k]) for k in (1, 2, 3)])
                short = [collapsed(t, found[i:j, 1:]) for t, i, j in zip(own, cut, cut[1:])]
                columns = [batch.column(0).slice(at, len(own)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cut.astype(np.int32), items)]
                columns.append(pa.array(short, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [name, "n_words", "runs", "collapsed"])
                at += len(own)

    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string")])
    return rows.mapInArrow(find, schema)


def periodic_runs(docs: DataFrame, what: Periodic = Periodic()) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row.

    A run is a stretch of words whose words one smallest period apart are equal, which no neighbouring
    word extends, long enough for ``what``. ``collapsed`` is the text's words, joined by one space,
    without those that any run has after its first period. A null text counts as empty and has no runs;
    null ids stay null, repeated rows repeat, an empty table gives no rows, further columns are left
    alone. A text is one row's work, in memory and with levels in proportion to its words.
    """
    return _found(docs.select("doc_id", whole_text().alias("text")), what)


def collapse_runs(docs: DataFrame, what: Periodic = Periodic()) -> DataFrame:
    """``docs``, all columns, each text with a run replaced by its collapsed words; other texts as they are.

    Rows are treated as by ``periodic_runs``; none is lost, and a null text stays null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _found(docs.select(row, whole_text().alias("text")), what)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row.text"))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def greatest_run(runs) -> F.Column:
    """Of an array of runs the one of the greatest length / period, compared exactly; the first of equals, null of none."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))
