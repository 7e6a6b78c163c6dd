"""Quality rules, exact, near and substring deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import SCHEMA, collected, empty_documents, odd_documents, odd_rows, sentence
from pyspark.sql import functions as F

from meterglass.llm import common, components, exact_dedup, hashing, quality_rules, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_ledger_against_brute_force(spark):
    got = collected(quality_rules.ledger(odd_documents(spark)), "doc_id", *quality_rules.MEASURES[:5])
    assert got == sorted(((i, *measured(t)) for i, t, *_ in odd_rows()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_measures_do_not_depend_on_the_slice(spark):
    """Words, lines and windows end with their text, wherever slices are cut; upper case is the category Lu."""
    rng = random.Random(19)
    texts = ["a b c", "a b c", "", " a b c a b c ", "x\n\nx\n x", "\u2160 \u00c9\u00e9 \u01c5 \U0001d400", "one", *[sentence(rng, rng.randint(1, 90)) for _ in range(60)]]
    alone = [[int(c[0]) for c in quality_rules.measure([t])] for t in texts]
    assert [[int(x) for x in row] for row in zip(*quality_rules.measure(texts))] == alone
    assert [tuple(row[:5]) for row in alone] == [measured(t) for t in texts]
    assert alone[5][6:] == [4, 2] and alone[3][4] == 6 and alone[4][3] == 1


def test_policies_and_ablation(spark):
    book = quality_rules.ledger(odd_documents(spark))
    base, web = quality_rules.POLICIES["base"], quality_rules.POLICIES["web"]
    rows = quality_rules.apply_policy(book, web).collect()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert [r["kept"] for r in rows if r["doc_id"] in (14, 15, 16)] == [False] * 3
    table = {r["rule"]: r for r in quality_rules.ablations(book, base).collect()}
    few, rep = quality_rules.mask("too_few_words"), quality_rules.mask("repeated_words")
    masks = [r["failed"] for r in rows]
    assert table["too_few_words"]["n_failed"] == sum(bool(x & few) for x in masks)
    assert table["repeated_words"]["n_only"] == sum((x & (few | rep)) == rep for x in masks)
    assert table["too_few_words"]["n_docs"] == len(rows)


def test_keeping_good_rows_leaves_all_columns(spark):
    docs = odd_documents(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    verdict = {t: k for t, k in quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.POLICIES["web"]).join(docs.select("doc_id", "text"), "doc_id").select("text", "kept").collect()}
    assert all(verdict[r["text"]] for r in kept.filter("doc_id is not null").collect())
    assert quality_rules.ledger(empty_documents(spark)).count() == 0


def test_length_alone_takes_nothing_out_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setitem(quality_rules.RULES, "too_many_words", "n_words > 100")
    docs = spark.createDataFrame([(1, " ".join(f"{a}{b}" for a in ("stone", "river", "paper", "house", "light") for b in "abcdefghijklmnopqrstuvwxyz"), "en", "s", 1)], SCHEMA)
    assert quality_rules.ledger(docs).first()["failed"] == quality_rules.mask("too_many_words")
    assert quality_rules.keep_good(docs).count() == 1


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 1])
def test_exact_groups_against_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rows = odd_rows()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    expected = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda x: x != keep)):
            expected.append((i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    for prefix in (1, 256):
        got = [tuple(r) for r in exact_dedup.exact_groups(odd_documents(spark), prefix, with_digest=True).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
    kept = exact_dedup.drop_exact(odd_documents(spark), 2)
    assert kept.columns == odd_documents(spark).columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter({(i if (i := e[1]) is not None else None, t): 1 for t, ids in groups.items() for e in [(0, max([x for x in ids if x is not None], default=None))]})
    assert exact_dedup.exact_groups(empty_documents(spark)).count() == 0
    assert exact_dedup.drop_exact(empty_documents(spark)).count() == 0


def test_prefixes_are_read_of_shared_lengths_only(spark, monkeypatch):
    """A text whose length no other has is never hashed, not even its prefix."""
    read = spark.sparkContext.accumulator(0)

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        read.add(len(texts))
        return pa.array([hash(t.as_py()[:4]) for t in texts], pa.int64())

    monkeypatch.setattr(exact_dedup, "prefix_of", lambda chars: counted("text"))
    alone = [(i, "x" * (100 + i)) for i in range(50)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in [*alone, (90, "same"), (91, "same"), (92, "else")]], SCHEMA)
    rows = exact_dedup.sized(docs)
    lengths = exact_dedup.shared_lengths(rows)
    assert [r["n_bytes"] for r in lengths.collect()] == [4]
    assert exact_dedup.shared_prefixes(rows, lengths, 4).count() == 1 and read.value == 3
    assert {r["doc_id"] for r in exact_dedup.drop_exact(docs).collect()} == {i for i, _ in alone} | {91, 92}


def plain_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_hashes_of_slices_are_the_librarys():
    rng = random.Random(7)
    raw = bytes(rng.randrange(256) for _ in range(4000))
    start = np.array([rng.randrange(3000) for _ in range(3000)])
    end = start + np.array([n % 200 for n in range(3000)])
    got = hashing.xxh64(np.frombuffer(raw + bytes(hashing.PAD), np.uint8), start, end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(start, end)]


def test_fingerprints_do_not_depend_on_the_slice():
    rng = random.Random(8)
    texts = ["", " ", "A", "one\t\ntwo", " a  B\x0bc\r\n", "\x85 x \u00a0 y z", *[sentence(rng, rng.randint(1, 80)) for _ in range(80)]]
    signed = [f - (1 << 64) if f >> 63 else f for f in map(plain_fingerprint, texts)]
    raw = [t.encode() for t in texts]
    assert simhash.fingerprint_texts(raw).tolist() == signed == [int(simhash.fingerprint_texts([t])[0]) for t in raw]


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 1])
def test_near_groups_against_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rows = odd_rows()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    own = plain_components(fps)
    least = {c: min((i for (i, *_), x in zip(rows, own) if x == c and i is not None), default=None) for c in own}
    expected = [(i, f - (1 << 64) if f >> 63 else f, least[c]) for (i, *_), f, c in zip(rows, fps, own)]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = [tuple(r) for r in simhash.near_groups(odd_documents(spark)).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    kept = simhash.drop_near(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert kept.count() == len(set(own))
    assert simhash.near_groups(empty_documents(spark)).count() == 0
    assert simhash.drop_near(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_connect_all_near_fingerprints(spark, crowd):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(rng.randint(1, 6)):  # chains of near fingerprints
            for _ in range(rng.randint(1, 2)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    points = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)
    edges = simhash.links(points, crowd)
    assert all((r["a"] ^ r["b"]) % (1 << 64) and ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in edges.collect())
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    own = plain_components(fps)
    expected = {}
    for s, c in zip(signed, own):
        expected.setdefault(c, []).append(s)
    assert {s: roots.get(s, s) for s in signed} == {s: min(group) for group in expected.values() for s in group}


def test_anchors_cover_every_pair():
    """Every pair within two bits shares an anchor that is home to either."""
    rng = np.random.default_rng(3)
    for flips in (0, 1, 2):
        x = rng.integers(-(1 << 63), 1 << 63, 200, np.int64)
        y = x.copy()
        for n in range(200):
            for b in rng.choice(64, flips, replace=False):
                y[n] ^= np.int64(1) << np.int64(b) if b < 63 else np.int64(-(1 << 63))
        for n in range(200):
            kx, ky = set(simhash.anchors_of(x[n : n + 1])[0].tolist()), set(simhash.anchors_of(y[n : n + 1])[0].tolist())
            home = [k for k in kx if k % 2 == 0]
            assert len(home) == 1 and {home[0], home[0] + 1} & ky


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (1300, 2000), (2000, 1300)]
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert roots == {i: 0 for i in range(71)} | {1000 + i: 1000 for i in range(301)} | {2000: 1000}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(1)
    text = sentence(rng, 800)
    moved = text[:2000] + " inserted words " + text[2000:]
    a, b = substring_dedup.units_of([text.encode(), moved.encode()])
    shared = {h for _, _, h in a} & {h for _, _, h in b}
    assert len(shared) >= len(a) - 5
    again = substring_dedup.units_of([b"another text first " * 9, text.encode()])[1]
    assert again == a, "chunks depend on the text alone"
    assert all(e - s >= substring_dedup.PASSAGES.min_unit for s, e, _ in a) and a[0][0] == 0


def plain_units(text, span):
    """Chunks and their successors, a byte and a place at a time."""
    data = bytes(64) + text + bytes(64)
    gear = [int(g) for g in substring_dedup.GEAR]
    h = [sum(gear[data[i - k]] << k for k in range(min(16, i + 1))) % 2**64 if data[i] & 0xC0 != 0x80 else 0 for i in range(len(data))]
    edges = [0]
    starts = [i - 64 for i in range(65, 64 + len(text)) if h[i] > max(h[i - 20 : i]) and h[i] >= max(h[i + 1 : i + 21])]
    for e in [*starts, len(text)]:
        while e - edges[-1] > span.max_chunk:
            edges.append(len(text[: edges[-1] + span.max_chunk].decode(errors="ignore").encode()))
        edges.append(e)
    pairs = zip(edges, edges[2:]) if len(edges) > 2 else [(0, len(text))]
    return [(a, b, text[a:b]) for a, b in pairs if b - a >= max(1, span.min_unit)]


def plain_repeats(rows, span):
    """Place -> (found, first_doc_id, first) of every unit found twice; rows are (doc_id, text) without repeats."""
    places = defaultdict(list)
    for i, t in rows:
        for a, b, unit in plain_units((t or "").encode(), span):
            places[unit].append(((i is not None, i or 0), t or "", a, b, i))
    out = {}
    for found in places.values():
        documents = {(p[0], p[1]) for p in found}
        if len(found) > 1 if span.within else len(documents) > 1:
            least = min(p[0] for p in found)
            for own, t, a, b, i in found:
                tied = {p[1] for p in found if p[0] == least}
                first = own == least and (not span.within or a == min(p[2] for p in found if p[0] == least and p[1] == t))
                out[i, t, a, b] = (len(found), least[1] if least[0] else None, first if len(tied) == 1 else None)
    return out


@pytest.mark.parametrize("span", [substring_dedup.PASSAGES, substring_dedup.ANYTHING, substring_dedup.Span(min_unit=1, max_chunk=64), substring_dedup.Span(within=True)])
def test_units_against_a_plain_chunk_and_digest(spark, span):
    rng = random.Random(4)
    shared, wide = sentence(rng, 40), "\u4e2d\u6587\U0001f600" * 300
    rows = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 3000]
    rows += [(300, wide + shared), (301, "x" + wide), (302, f"{shared} {sentence(rng, 9)} {shared}"), (303, "ab" * 900), (304, None)]
    rows += [(305, " ".join([sentence(rng, 30)] * 3))]
    got = {}
    for r in substring_dedup.repeated_units(odd_documents(spark, [(i, t, None, None, None) for i, t in rows]), span).collect():
        text = [t for i, t in rows if i == r["doc_id"]]
        assert r["n_bytes"] == r["end"] - r["start"]
        got.setdefault((r["doc_id"], r["start"], r["end"]), []).append((r["found"], r["first_doc_id"], r["first"], text))
    expected = plain_repeats(sorted(set(rows), key=str), span)
    assert sum(map(len, got.values())) == len(expected)
    for (i, _, a, b), (found, least, first) in expected.items():
        own = [x[:3] for x in got[i, a, b]]
        assert any(x[:2] == (found, least) and (first is None or x[2] == first) for x in own)


def test_forced_cuts_stay_between_characters(spark):
    """Texts without boundaries of their own, of characters of two to four bytes, are cut and put together again."""
    rows = []
    for n, c in enumerate(["\u4e2d", "\u00e9", "\U0001f600", "a"]):
        rows += [(2 * n, c * 1500 + " end of one"), (2 * n + 1, c * 1500 + " another end")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    texts = dict(rows)
    for r in substring_dedup.repeats(docs).collect():
        texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(docs).collect()}
    assert all(cut[2 * n] == texts[2 * n] for n in range(4))
    assert all(0 < len(cut[2 * n + 1]) < 1500 and cut[2 * n + 1].endswith("another end") for n in range(4))


def test_what_repeats_in_one_document_is_found_where_it_counts(spark):
    rng = random.Random(23)
    line = sentence(rng, 60)
    docs = spark.createDataFrame([(1, "\n".join([line, sentence(rng, 30), line, line]), None, None, None)], SCHEMA)
    assert substring_dedup.repeats(docs).count() == 0
    within = substring_dedup.Span(within=True)
    kept = substring_dedup.drop_repeats(docs, within).first()["text"]
    assert line in kept and len(kept) < len(docs.first()["text"]) - 1.5 * len(line)


def test_rows_that_repeat_are_one_document(spark):
    rng = random.Random(29)
    text, other = sentence(rng, 80), sentence(rng, 80)
    rows = [(1, text)] * 50 + [(2, other)] * 3 + [(3, other)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    got = substring_dedup.repeats(docs).collect()
    assert {(r["doc_id"], r["first"]) for r in got} == {(2, True), (3, False)}
    assert len(got) == len({(r["doc_id"], r["start"]) for r in got})
    assert Counter(r["doc_id"] for r in substring_dedup.drop_repeats(docs).collect()) == {1: 50, 2: 3, 3: 1}


def test_repeats_find_planted_passages_and_nothing_else(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [prose(51) for _ in range(12)]
    rows = [(i, prose(150)) for i in range(60)]
    for n, p in enumerate(passages):
        for i in (n, 59 - n, 20 + n):
            at = rows[i][1].split(" ")
            cut = rng.randrange(len(at))
            rows[i] = (i, " ".join([*at[:cut], p, *at[cut:]]))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = substring_dedup.repeats(docs).collect()
    holders = defaultdict(set)
    for i, t in rows:
        for n, p in enumerate(passages):
            if p in t:
                holders[n].add(i)
    assert {r["doc_id"] for r in got} == set().union(*holders.values())
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert any(text.encode()[r["start"] : r["end"]].decode() in p or p in text for p in passages)
    assert all(r["first"] == (r["doc_id"] == r["first_doc_id"]) for r in got)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(docs).collect()}
    gone = sum(len(dict(rows)[i]) - len(t) for i, t in cut.items())
    assert gone >= 0.5 * sum(len(p) * (len(holders[n]) - 1) for n, p in enumerate(passages))
    assert all(cut[i] == t for i, t in rows if i not in set().union(*holders.values()))


def test_passages_of_short_words_are_not_filtered_out(spark):
    """51 words of two letters are 152 bytes: where a whole unit of them is shared, the passage is returned."""
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(n))
    texts, found = {}, set()
    for n in range(150):
        passage = prose(51)
        a, b = (" ".join([prose(60), passage, prose(60)]) for _ in range(2))
        texts |= {2 * n: a, 2 * n + 1: b}
        left, right = substring_dedup.units_of([a.encode(), b.encode()])
        if {h for *_, h in left} & {h for *_, h in right}:
            found |= {2 * n, 2 * n + 1}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA)
    assert len(found) > 200
    assert {r["doc_id"] for r in substring_dedup.repeats(docs).collect()} == found


def test_repeats_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = substring_dedup.repeats(docs)
    flagged = {r["doc_id"] for r in got.collect()}
    assert {7, 8, 9, 11, 12} <= flagged and not flagged & {1, 2, 3, 4, 5, 18, 19}
    kept = substring_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert substring_dedup.repeats(empty_documents(spark)).count() == 0
    assert kept.filter(F.col("doc_id") == 1).first()["text"] is None
