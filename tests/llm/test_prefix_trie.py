"""The prefix trie against plain lists of turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meterglass.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def said(turn):
    return (turn[0] or "", turn[1] or "")


def key_of(turn):
    role, text = said(turn)
    return hashlib.sha256(hashlib.sha256(role.encode()).hexdigest().encode() + text.encode()).digest()[:16]


def plain_lists(rows):
    """conv_id to its turns, by turn, null first, then by digest."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, key_of((role, text)), said((role, text))))
    return {c: [x[3] for x in sorted(own)] for c, own in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 9
        base = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), []) if c is not None else []
        out[c] = base[:h] + own[h:]
    return out


def plain_trie(convs):
    """(depth, prefix) to what the nodes hold, all subtrees walked."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    name = {k: min((c for c in own if c is not None), default=None) for k, own in members.items()}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, own in members.items():
        gain = (len(own) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += gain
            leaves[k[:d]] += not kids[k]
    rows = []
    for k, own in members.items():
        ids = ",".join("" if c is None else str(c) for c in sorted(ends.get(k, []), key=lambda c: (c is not None, c or 0)))
        rows.append((name[k], len(k), name[k[:-1]] if k else None, len(own), kids[k], leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(rows, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def rows_of(trie):
    nodes = trie.nodes.join(prefix_trie.listed_digests(trie.ends), "key", "left")
    nodes = nodes.select(*COLUMNS, F.coalesce("ids_sha256", F.sha2(F.lit(b""), 256)))
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def odd_conversations(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c - 7, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "größe \U0001f600"]) * rng.choice([1, 1, 3])))
    # Ties, null turns, roles, texts and ids, repeated rows, empty texts, a turn as long as a book, and copies.
    rows += [(70, 1, "user", "x"), (70, 1, "user", "y"), (70, None, "user", "z"), (71, None, None, None), (71, 0, "", ""), (None, 0, "user", "n"), (None, None, "user", "m")]
    rows += [(72, 3, "user", "again")] * 5 + [(73, 0, "user", "word " * 50_000), (74, 0, "", ""), (75, 0, "user\n", "a"), (76, 0, "user", "\na")]
    rows += [(c, t, "user", f"same {t}") for c in range(80, 140) for t in range(9)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in ("key", "said", "pos", "n", "block", "links", "part", "c", "b", "depth", "a.b")})


def test_trie_of_odd_rows(spark):
    rows = odd_conversations()
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows))) == plain_trie(plain_lists(rows))


def test_only_a_null_id_and_no_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b")]
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows))) == plain_trie(plain_lists(rows))
    empty = frame(spark, rows).filter("false")
    trie = prefix_trie.prefix_trie(empty)
    assert trie.nodes.count() == 0 and trie.ends.count() == 0


@pytest.mark.parametrize("block", [4, 7])
def test_long_conversations_over_many_blocks(spark, monkeypatch, block):
    """Keys are equal where and only where the turns before are, in whichever block they part."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    base = [("user", rng.choice("ab")) for _ in range(45)]
    rows = []
    for c in range(14):
        own = list(base[: rng.choice([0, 3, 4, 7, 8, 28, 44, 45])]) + [("assistant", rng.choice("abc")) for _ in range(rng.randint(0, 30))]
        rows += [(c, t, *x) for t, x in enumerate(own)]
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows))) == plain_trie(plain_lists(rows))


def test_a_conversation_over_many_parts_of_the_range(spark):
    """One conversation of most rows, a third of which are the same: places follow each other over all parts."""
    rows = [(5, t, "user", str(t)) for t in range(3000)] + [(5, 7000, "user", "same")] * 2500 + [(c, 0, "user", "x") for c in range(10)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, counts = prefix_trie.numbered(frame(spark, rows))
        got = sorted((r["pos"], bytes(r["said"])) for r in turns.filter("conv_id = 5").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = [key_of(x) for x in plain_lists(rows)[5]]
    assert got == list(enumerate(want, 1))
    assert {r["conv_id"]: r["n"] for r in counts.collect()} == {5: 5501} | {c: 1 for c in range(10) if c != 5}


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = odd_conversations(9) + [(c, t, "user", f"{c}") for c in (201, 207, -13) for t in range(2)]
    frame(spark, rows).drop("a.b").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r[c] for c in (*COLUMNS, "ends_sha256")) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    convs = plain_rebuilt(plain_lists(rows))
    assert any(not x for x in convs.values())
    assert got == plain_trie(convs)
