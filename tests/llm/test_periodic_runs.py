"""Periodic runs by partition refinement against a search period by period."""

import hashlib
import random
import re
import zlib

import numpy as np
from helpers import SCHEMA, collected, empty_documents, odd_documents, odd_rows, sentence
from pyspark.sql import functions as F

from meterglass.llm import periodic_runs, queries
from meterglass.llm.periodic_runs import Periodic, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, exponent=3):
    """Every maximal stretch that keeps a period, less those that have a smaller one."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            own = words[s : i + q]
            if i > s and len(own) >= max(least, exponent * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                found.append((s, len(own), q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(words, a, p):
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_random_words_of_small_alphabets():
    """Overlapping runs, runs in runs, runs at the ends; a slice's texts do not meet each other."""
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([0, 1, 3, 40, 90]))]
            if words and rng.random() < 0.6:
                a = rng.randrange(len(words))
                words = periodic(words, a, 1 + (len(words) - a) // rng.randint(2, 9))
            texts.append(words)
        least, exponent = rng.choice([(24, 3), (4, 2), (1, 3), (10, 4)])
        n, rows = runs_of([" ".join(w).encode() for w in texts], Periodic(least, exponent))
        for k, words in enumerate(texts):
            assert n[k] == len(words)
            assert [tuple(r[1:]) for r in rows.tolist() if r[0] == k] == plain_runs(words, least, exponent)


def test_strings_full_of_runs():
    """Fibonacci words and powers of powers, in which nearly every place starts a square."""
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    for text in (fib[-1], "aab" * 9 + "aabb" * 7 + "ab" * 40, "a" * 300, ("ab" * 3 + "c") * 20 + "ab" * 30):
        for what in (Periodic(6, 2), Periodic()):
            got = runs_of([" ".join(text).encode()], what)[1][:, 1:].tolist()
            assert [tuple(r) for r in got] == plain_runs(list(text), what.words, what.exponent)


def test_rows_of_any_kind(spark):
    got = {}
    for r in periodic_runs.periodic_runs(odd_documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for i, text, *_ in odd_rows():
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 5000 else []
        want.setdefault(i, []).append((len(words), runs, plain_collapsed(words, runs)))
    assert {i: sorted(x, key=str) for i, x in got.items()} == {i: sorted(x, key=str) for i, x in want.items()}
    assert got[14][0][1] == [(0, 300, 1)] and got[14][0][2] == "word"
    assert periodic_runs.periodic_runs(empty_documents(spark)).count() == 0


def test_collapse_keeps_rows_columns_and_texts_without_runs(spark):
    docs = odd_documents(spark)
    out = periodic_runs.collapse_runs(docs)
    assert out.schema.names == docs.schema.names
    texts = collected(out, "doc_id", "text")
    want = []
    for i, text, *_ in odd_rows():
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 5000 else []
        want.append((i, plain_collapsed(words, runs) if runs else text))
    assert texts == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_a_long_text_and_the_greatest_run(spark):
    """A period of thousands of words; of equal exponents the first; exponents are compared exactly."""
    rng = random.Random(8)
    words = periodic([f"w{rng.randrange(10**6)}" for _ in range(60_000)], 5_000, 17_000)
    n, rows = runs_of([" ".join(words).encode()])
    assert n[0] == 60_000 and rows.tolist() == [[0, 5_000, 55_000, 17_000]]
    df = spark.sql("SELECT array(named_struct('start', 5L, 'length', 30L, 'period', 10L), named_struct('start', 7L, 'length', 24L, 'period', 8L), named_struct('start', 9L, 'length', 900000001L, 'period', 300000000L), named_struct('start', 10L, 'length', 900000003L, 'period', 300000001L)) AS r")
    assert df.select(periodic_runs.greatest_run(F.col("r"))["start"]).first()[0] == 9
    assert df.selectExpr("filter(r, x -> false) AS r").select(periodic_runs.greatest_run(F.col("r"))).first()[0] is None


def test_query_against_its_contract(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, sentence(rng, rng.choice([0, 1, 20, 60, 150, 400]))) for i in range(150)] + [(500, None), (501, " \t "), (502, "a b " * 40)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in texts:
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            words, planted = periodic(words, g % n, 1 + (n - g % n) // (3 + g % 8)), planted + 1
        runs = plain_runs(words)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        row = got[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert planted > 5 and len(got) == len(texts)


def test_ranges_of_nothing():
    assert periodic_runs.ranges(np.array([], int), np.array([], int)).tolist() == []
