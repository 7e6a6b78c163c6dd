"""Exact top-k inner products by a table of distances to pivots.

The distance of a query q and a vector c is at least |d(q, p) - d(c, p)| for every pivot p. With the
largest of those, L, their product is at most (|q|^2 + |c|^2 - L^2) / 2, and at most |q| |c|. Distances
of all vectors to the pivots are computed once. A query takes candidates in the order of that bound
until it is below its k-th score: the rest can't reach it.

That is done twice. Vectors are dealt into groups by range of nearest pivot and distance to it, and a
group's bound follows from the ranges of its distances. A query first visits the group of the best
bound, then those whose bound reaches the k-th score found there; inside a group it takes vectors by
bound. Pivots only decide how much is left out: they are picked from a bounded sample.

Equal vectors are one, with the k + 1 smallest of their ids, as ties go to smaller ids; so a vector that
a third of all rows have is one row. Queries meet groups in blocks of bounded size on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.llm.common import broadcast_if_small, cut_lineage, ship_package

#: Stands for a null id, which counts as the largest.
NO_ID = (1 << 63) - 1
#: Rounding that a distance may have, as a share of the distances it is of.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Pivots:
    """``count`` pivots, far from each other, out of ``sample`` vectors; groups of ``group`` vectors, blocks of ``asks`` queries."""

    count: int = 16
    sample: int = 2048
    group: int = 8192
    asks: int = 4096


def finite(v: Column) -> Column:
    """Whether a vector is there and has neither null nor infinite components nor any that are no numbers."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _keyed(df: DataFrame, name: str, v: str) -> DataFrame:
    """id, v (doubles, no negative zero), key (a digest of v) of the rows whose vector is finite."""
    rows = df.filter(finite(F.col(v))).select(F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias("id"), F.transform(F.col(v), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    said = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    return rows.withColumn("key", F.sha2(F.concat(F.size("v").cast("string"), F.lit(":"), said), 256))


def pick_pivots(vectors: list[list[float]], count: int) -> np.ndarray:
    """Rows far from each other: each the farthest from those before; vectors of fewer components are filled with zeros.

    Of no vectors the origin is the pivot.
    """
    width = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), width))
    for row, v in zip(x, vectors):
        row[: len(v)] = v
    chosen, near = [0][: len(x)], np.full(len(x), np.inf)
    while chosen and len(chosen) < min(count, len(x)):
        near = np.minimum(near, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
        chosen.append(int(near.argmax()))
    return x[chosen] if chosen else np.zeros((1, 0))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every row to every pivot; pivots are cut or filled with zeros to the rows' length."""
    own = np.zeros((len(pivots), x.shape[1]))
    width = min(x.shape[1], pivots.shape[1])
    own[:, :width] = pivots[:, :width]
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in own], axis=1)


def _matrix(lists: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The given rows, all of ``width`` elements, of a column of lists."""
    at = lists.offsets.to_numpy()[rows]
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[at[:, None] + np.arange(width)]


def _measured(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (key, v, ids) with norm (the square), dist (to each pivot), home (the nearest pivot) and near (its distance)."""

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            size = np.diff(v.offsets.to_numpy())
            norm, dist = np.zeros(len(size)), np.zeros((len(size), len(pivots)))
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                x = _matrix(v, own, width)
                norm[own], dist[own] = (x * x).sum(axis=1), distances(x, pivots)
            home = dist.argmin(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * len(pivots), pa.int32()), pa.array(dist.ravel()))
            more = [pa.array(norm), lists, pa.array(home, pa.int32()), pa.array(dist[np.arange(len(size)), home])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "norm", "dist", "home", "near"])

    return rows.mapInArrow(run, "key string, v array<double>, ids array<long>, norm double, dist array<double>, home int, near double")


def _upper(q_norm: Column, q_dist: Column) -> Column:
    """The most that a query's product with any vector of a group (norm, low, high) can be."""
    apart = F.zip_with(F.zip_with(q_dist, "high", lambda d, h: d - h), F.zip_with("low", q_dist, lambda lo, d: lo - d), lambda a, b: F.greatest(a, b))
    slack = ROUNDING * (F.array_max(q_dist) + F.array_max("high"))
    least = F.greatest(F.coalesce(F.array_max(apart) - slack, F.lit(0.0)), F.lit(0.0))
    by_pivot = (q_norm + F.col("norm") - least * least) / 2
    return F.least(by_pivot, F.sqrt(q_norm) * F.sqrt("norm")) + 1e-9 * (q_norm + F.col("norm")) + 1e-9


class _Group:
    """Vectors of one length, and what a query takes of them."""

    def __init__(self, x, dist, norm, keys, ids, counts):
        self.x, self.dist, self.norm, self.keys = x, dist, norm, keys
        self.ids, self.counts, self.at = ids, counts, np.cumsum(counts) - counts

    def bounds(self, q, dist):
        """Of every query (rows) and vector (columns) the most that their product can be."""
        apart = np.zeros((len(q), len(self.x)))
        for p in range(dist.shape[1]):
            np.maximum(apart, np.abs(dist[:, p, None] - self.dist[None, :, p]), out=apart)
        apart -= ROUNDING * (dist.max(axis=1, initial=0)[:, None] + self.dist.max(axis=1, initial=0)[None, :])
        np.maximum(apart, 0, out=apart)
        norm = (q * q).sum(axis=1)
        both = norm[:, None] + self.norm[None, :]
        upper = np.minimum((both - apart * apart) / 2, np.sqrt(norm)[:, None] * np.sqrt(self.norm)[None, :]) + 1e-9 * both + 1e-9
        return np.where(np.isnan(upper), np.inf, upper)

    def best(self, q, key, upper, least, k):
        """Scores, ids and whether they are of the query's own vector: the k best that reach ``least``, ties to smaller ids."""
        order = np.flatnonzero(upper >= least)
        order = order[np.argsort(-upper[order], kind="stable")]
        score, ids, own = np.empty(0), np.empty(0, np.int64), np.empty(0, bool)
        at, step = 0, 64
        while at < len(order) and upper[order[at]] >= least:
            some = order[at : at + step]
            at, step = at + step, 2 * step
            found = self.x[some] @ q
            found[np.isnan(found)] = -np.inf
            some, found = some[found >= least], found[found >= least]
            n = self.counts[some]
            place = np.repeat(self.at[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            score, ids = np.append(score, np.repeat(found, n)), np.append(ids, self.ids[place])
            own = np.append(own, np.repeat(self.keys[some] == key, n))
            if len(score) >= k:
                first = np.lexsort((ids, -score))[:k]
                score, ids, own = score[first], ids[first], own[first]
                least = max(least, score[-1])
        return score, ids, own


def _visits(groups: DataFrame, asks: DataFrame, k: int, what: Pivots) -> DataFrame:
    """key, score, id, own: what the queries ``asks`` (key, v, dist, part, least) find in the groups they name."""
    blocks = asks.groupBy("part").agg(F.ceil(F.count("*") / what.asks).cast("int").alias("blocks"))
    blocks = broadcast_if_small(blocks)
    none = {"ids": F.lit(None).cast("array<long>"), "norm": F.lit(None).cast("double")}
    asked = asks.join(blocks, "part").withColumns({"kind": F.lit(1), "block": F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), **none})
    held = groups.join(blocks, "part").withColumns({"kind": F.lit(0), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "least": F.lit(None).cast("double")})
    columns = ("part", "block", "kind", "key", "v", "dist", "ids", "norm", "least")
    rows = held.select(*columns).unionByName(asked.select(*columns)).repartition("part", "block").sortWithinPartitions("part", "block", "kind")

    def search(batches):
        place, pieces, made = None, [], {}
        for batch in batches:
            mark = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "kind")], axis=1).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]).any(axis=1)]) if len(mark) else []
            for i, j in zip(cuts, [*cuts[1:], len(mark)]):
                part, block, kind = mark[i]
                if place != (part, block):
                    place, pieces, made = (part, block), [], {}
                rows = batch.slice(i, j - i)
                if kind == 0:
                    pieces.append(rows)
                    continue
                if pieces:
                    made, pieces = grouped(pieces), []
                yield from answers(made, rows)

    def columns_of(rows, names):
        out = []
        for name in names:
            c = rows.column(name)
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            out.append(pa.concat_arrays([c]) if c.offset == 0 else pa.concat_arrays([c, c.slice(0, 0)]))
        return out

    def grouped(pieces):
        v, dist, ids, norm, key = columns_of(pa.Table.from_batches(pieces), ("v", "dist", "ids", "norm", "key"))
        size, out = np.diff(v.offsets.to_numpy()), {}
        counts, flat, start = np.diff(ids.offsets.to_numpy()), ids.values.to_numpy(), ids.offsets.to_numpy()
        width_of = np.diff(dist.offsets.to_numpy())[:1].sum()
        for width in np.unique(size):
            own = np.flatnonzero(size == width)
            n = counts[own]
            taken = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys = np.array(key.take(pa.array(own)).to_pylist(), dtype=object)
            out[width] = _Group(_matrix(v, own, width), _matrix(dist, own, width_of), norm.to_numpy()[own], keys, flat[taken], n)
        return out

    def answers(made, rows):
        v, dist, key, least = columns_of(rows, ("v", "dist", "key", "least"))
        size, keys, least = np.diff(v.offsets.to_numpy()), key.to_pylist(), least.to_numpy()
        width_of = np.diff(dist.offsets.to_numpy())[:1].sum()
        for width in np.unique(size):
            group, own = made.get(width), np.flatnonzero(size == width)
            if group is None:
                continue
            step = max(1, (1 << 19) // len(group.x))
            for i in range(0, len(own), step):
                some = own[i : i + step]
                q = _matrix(v, some, width)
                upper = group.bounds(q, _matrix(dist, some, width_of))
                found = [group.best(q[n], keys[r], upper[n], least[r], k) for n, r in enumerate(some)]
                said = pa.array([keys[r] for r, f in zip(some, found) for _ in f[0]], pa.string())
                score, ids, mine = (np.concatenate([f[n] for f in found]) for n in range(3))
                yield pa.RecordBatch.from_arrays([said, pa.array(score), pa.array(ids), pa.array(mine)], ["key", "score", "id", "own"])

    return rows.mapInArrow(search, "key string, score double, id long, own boolean")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each key."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, name: str = "vec_id", v: str = "v", what: Pivots = Pivots()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` greatest inner products of every row of ``queries`` with all rows of ``vectors``.

    Both have an id ``name`` and a vector ``v``. Ties go to the smaller id, a null one last. A row of
    ``vectors`` with a query's id and vector is the query's own, once: it is no candidate, further rows
    like it are. Vectors that are null or have null or non-finite components take no part; vectors meet
    only those of their own length. Repeated queries repeat their rows; fewer than ``k`` candidates give
    all; empty tables give no rows; further columns are left alone. Scores are doubles, exact for whole
    numbers below 2^53; one that is no number counts as the least.
    """
    ship_package(vectors.sparkSession)
    rows = _keyed(vectors, name, v)
    order = Window.partitionBy("key").orderBy("id")
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    rows = cut_lineage(rows.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    pivots = pick_pivots([r["v"] for r in rows.orderBy("key").limit(what.sample).collect()], what.count)
    parts = max(1, -(-rows.count() // what.group))
    table = _measured(rows, pivots).repartitionByRange(parts, F.size("v"), "home", "near", "key")
    table = cut_lineage(table.withColumn("part", F.spark_partition_id()).drop("home", "near"))
    low, high = ([f(F.get("dist", F.lit(p))) for p in range(len(pivots))] for f in (F.min, F.max))
    groups = table.groupBy("part", F.size("v").alias("width")).agg(F.max("norm").alias("norm"), F.array(*low).cast("array<double>").alias("low"), F.array(*high).cast("array<double>").alias("high"))
    groups = broadcast_if_small(groups)
    parts = (groups.agg(F.max("part")).first()[0] or 0) + 1

    asked = cut_lineage(_keyed(queries, name, v))
    asks = asked.dropDuplicates(["key"]).select("key", "v", F.array("id").alias("ids"))
    asks = cut_lineage(_measured(asks, pivots).select("key", "v", "dist", F.col("norm").alias("q_norm")))

    def bounded(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("width", F.size("v"))
        return met.join(groups, ["part", "width"]).withColumn("upper", _upper(F.col("q_norm"), F.col("dist"))).drop("norm", "low", "high", "width")

    first = bounded(asks).groupBy("key").agg(F.max_by("part", "upper").alias("part"))
    first = cut_lineage(asks.join(first, "key").withColumn("least", F.lit(float("-inf"))))
    found = cut_lineage(_visits(table, first, k + 1, what))
    least = found.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") > k)
    seen = first.select("key", F.col("part").alias("seen"))
    again = bounded(asks.join(seen, "key").join(least.drop("n"), "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    again = cut_lineage(again.filter("part != seen and upper >= least").select("key", "v", "dist", "part", "least"))
    found = _first(found.union(_visits(table, again, k + 1, what)), k + 1)
    found = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score", "own"))).alias("found"))
    out = asked.select("key", F.col("id").alias("query_id")).join(found, "key")
    mine = F.array_position(F.transform("found", lambda x: x["own"] & (x["id"] == F.col("query_id"))), F.lit(True))
    out = out.withColumn("mine", mine)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("mine")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("i", "x"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(real("query_id").alias("query_id"), (F.col("i") + 1).alias("rank"), real("x.id").alias("vec_id"), F.col("x.score").alias("score"))
