"""Exact top-k search against every product."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterglass.llm import pivot_search, queries
from meterglass.llm.pivot_search import Pivots, pick_pivots, top_k

SCHEMA = "vec_id bigint, v array<double>"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_top(asked, rows, k):
    """Every query row against every row but one like itself."""
    out = Counter()
    rows = [(i, tuple(v)) for i, v in rows if good(v)]
    for i, v in asked:
        if not good(v):
            continue
        left, scored = Counter(rows), []
        if (i, tuple(v)) in left:
            left[i, tuple(v)] -= 1
        for (j, w), n in left.items():
            if len(w) == len(v):
                scored += [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0)] * n
        for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1):
            out[i, rank, None if none else j, -s] += 1
    return out


def frame(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("key", "ids", "norm", "dist", "part", "n", "least", "kind", "a.b")})


def got_of(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def odd_vectors(seed):
    """Clusters, ties, copies of one vector, repeated rows and ids, lengths 0, 2 and 6, and what takes no part."""
    rng = random.Random(seed)
    centres = [[rng.randint(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(x + rng.randint(-6, 6)) for x in rng.choice(centres)]) for i in range(150)]
    rows += [(1000 + i, [float(x) for x in centres[0]]) for i in range(60)] + rows[:4] + [(3, rows[9][1]), (3, rows[9][1])]
    rows += [(200 + i, [rng.choice([0.0, 1.0, -0.0]) for _ in range(6)]) for i in range(30)] + [(300 + i, [float(i % 3), 2.0]) for i in range(9)]
    rows += [(400, []), (401, []), (402, None), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [math.nan] * 6), (405, [math.inf] + [0.0] * 5), (None, [500.0] * 6), (None, [500.0] * 6)]
    return rows


@pytest.mark.parametrize("what", [Pivots(count=4, sample=50, group=16, asks=5), Pivots(count=1, sample=1, group=40, asks=1000)])
def test_odd_vectors(spark, what):
    rows = odd_vectors(what.count)
    asked = [r for n, r in enumerate(rows) if n % 3 == 0 or n > 180]
    for k in (1, 5):
        assert got_of(top_k(frame(spark, asked), frame(spark, rows), k, what=what)) == plain_top(asked, rows, k)


def test_few_vectors_and_none(spark):
    rows = [(50, [3.0, 4.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0])]
    got = got_of(top_k(frame(spark, rows[:1]), frame(spark, rows)))
    assert got == {(50, 1, 7, 7.0): 1, (50, 2, 8, 7.0): 1}
    none = frame(spark, rows).filter("false")
    assert top_k(frame(spark, rows), none).count() == 0 and top_k(none, frame(spark, rows)).count() == 0


def test_far_pivots_and_large_numbers_lose_nothing(spark):
    """Pivots of a size that rounds the distances, and products near 2^52."""
    rng = random.Random(6)
    rows = [(0, [1e12, 0.0, 0.0]), (1, [0.0, -1e12, 0.0])] + [(i, [float(rng.randint(-40, 40)) for _ in range(3)]) for i in range(2, 200)]
    rows += [(i, [float(rng.randint(-(2**25), 2**25)) for _ in range(3)]) for i in range(200, 260)]
    asked = [r for r in rows if r[0] % 5 == 2]
    assert got_of(top_k(frame(spark, asked), frame(spark, rows), what=Pivots(3, 300, 32, 7))) == plain_top(asked, rows, 5)


def test_pivots_leave_vectors_out():
    """In clusters a query evaluates few of the others, and what it finds is right."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.integers(-3, 4, (400, 8)) for c in rng.integers(-200, 200, (10, 8))]).astype(float)
    pivots = pick_pivots(x[::7].tolist(), 8)
    norm = (x * x).sum(axis=1)
    group = pivot_search._Group(x, pivot_search.distances(x, pivots), norm, np.array(["k"] * len(x), dtype=object), np.arange(len(x)), np.ones(len(x), int))
    q = x[:400:40]
    upper = group.bounds(q, pivot_search.distances(q, pivots))
    true = q @ x.T
    assert (upper >= true).all()
    reached = [(u >= np.sort(t)[-6]).mean() for u, t in zip(upper, true)]
    assert np.mean(reached) < 0.5
    for n in range(len(q)):
        score, ids, _ = group.best(q[n], "", upper[n], -np.inf, 6)
        want = sorted(zip(-true[n], range(len(x))))[:6]
        assert list(zip(-score, ids)) == want


def test_query_against_its_contract(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(240)] + [(i, [0.5] * 8) for i in range(240, 320)]
    rows += [(350, None), (400, [float("nan")] * 8), (450, [float("inf")] + [0.0] * 7), (500, [None] + [1.0] * 7), (550, [-0.001] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = []
    for i, v in rows:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        whole.append((i, [float(math.floor(256 * x)) for x in v] if good(v) else None))
    found = queries.op13_pivot_search(spark, str(tmp_path))
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert got_of(found) == plain_top([r for r in whole if r[0] % 50 == 0], whole, 5)
