"""Mixing, licences, BPE, chat, classifier and languages on fixtures and against brute force."""

import hashlib
import io
import json
import math
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import SCHEMA, collected, empty_documents, odd_documents, odd_rows, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterglass.llm import bpe, chat_format, language_id, license_scan, mixing, quality_model

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Mixing


def skewed(spark, n=400):
    rng = random.Random(9)
    sizes = {"big": n, "mid": n // 4, "small": n // 20, None: n // 10}
    rows = [(i, sentence(rng, rng.randint(1, 60)), "en", s, 1) for s, k in sizes.items() for i in range(k)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("mix", [mixing.Mixture(), mixing.Mixture(entropy=0.9, budget=2.5), mixing.Mixture(entropy=1.0, max_repeats=1.5), mixing.Mixture(budget=0.3, seed=1)])
def test_mixture_against_brute_force(spark, mix):
    rows, docs = skewed(spark)
    count = {i: len(t.split()) for i, t, *_ in rows}
    tokens = Counter()
    for i, _, _, s, _ in rows:
        tokens[s] += count[i]
    total = sum(tokens.values())

    def weights(a):
        raised = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: w / sum(raised.values()) for s, w in raised.items()}

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    repeats = lambda a: max(mix.budget * total * w / tokens[s] for s, w in weights(a).items())
    lo, hi = 0, mixing.GRID
    ok = lambda a: entropy(a) >= mix.entropy * math.log(len(tokens)) - 1e-12
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if ok(mid / mixing.GRID) else (lo, mid)
    exponent = lo / mixing.GRID
    if repeats(exponent) > mix.max_repeats:
        lo, hi = 0, mixing.GRID
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if repeats(mid / mixing.GRID) <= mix.max_repeats else (mid, hi)
        exponent = hi / mixing.GRID
    expected = Counter()
    for s, w in weights(exponent).items():
        own = [(i, count[i]) for i, _, _, x, _ in rows if x == s]
        target = math.floor(w * mix.budget * total)
        full, rest = divmod(target, tokens[s])
        for i, _ in own:
            expected[i] += full
        at = 0
        for i, n in sorted(own, key=lambda p: hashlib.md5(f"{mix.seed}:{full}:{p[0]}".encode()).hexdigest()):
            at += n
            if at > rest or not rest:
                break
            expected[i] += 1
    got = mixing.mix_sources(docs, mix).collect()
    assert Counter(r["doc_id"] for r in got) == +expected
    assert len({(r["doc_id"], r["block"]) for r in got}) == len(got)
    assert all(abs(r["weight"] - weights(exponent)[r["source"]]) < 1e-6 for r in got)
    assert Counter(r["doc_id"] for r in mixing.mix_documents(docs, mix).collect()) == +expected


@pytest.mark.parametrize("bucket", [0.05, 4, 64])
def test_prefix_by_buckets_is_that_by_one_sort(spark, monkeypatch, bucket):
    """Buckets of any size, of less than a document too, give the same mixture as one bucket per source."""
    _, docs = skewed(spark)
    one = collected(mixing.mix_sources(docs), "doc_id", "block")
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    assert collected(mixing.mix_sources(docs), "doc_id", "block") == one


def test_mixture_on_odd_rows(spark):
    docs = odd_documents(spark)
    assert mixing.mix_documents(docs).columns == docs.columns
    sources = {r["source"] for r in mixing.mix_sources(docs).collect()}
    assert {None, "hot", "cold", "rare"} >= sources >= {None, "hot"}
    for empty in (empty_documents(spark), docs.filter("text is null")):
        assert mixing.mix_sources(empty).count() == 0


# Licences


def plain_scan(text, idf):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license_scan.WORDS, folded)
    labels, base, starts, score = set(), set(), [], 0.0
    for t in license_scan.TEMPLATES:
        rare = license_scan.rare_words(t, idf)
        weights = {at: max(1, idf[w]) for at, w in rare}
        for s in range(-len(t.words), len(words)):
            at = lambda k, s=s: words[s + k] if 0 <= s + k < len(words) else None
            held = sum(weights[k] for k, w in rare if at(k) == w)
            if held and held >= math.ceil(license_scan.LEAST * sum(weights.values())) and all(at(k) == w for k, w in t.required()) and (s >= 0 or not t.base):
                labels.add(t.label)
                score = max(score, held / sum(weights.values()))
                if t.base:
                    base.add(t.label)
                    starts.append(s)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licence_scan_against_brute_force(spark):
    lines = [t.text for t in license_scan.TEMPLATES] + ["Licensed under CC BY-NC 4.0.", "cc by cc by", "CC BY", "the Apache License", "cc", "by", "All rights, reserved; all RIGHTS reserved"]
    rng = random.Random(3)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([x for x in lines] + [sentence(rng, 30) + " " + rng.choice(lines) + " " + sentence(rng, 9) + " " + rng.choice(lines) for _ in range(60)])]
    rows += [(1000 + n, t, None, None, None) for n, (_, t, *_) in enumerate(odd_rows())]
    docs = odd_documents(spark, rows)
    idf = license_scan.rarity(license_scan.noted(docs))
    n = len(rows)
    held = Counter(w for _, t, *_ in rows for w in set(re.findall(license_scan.WORDS, (t or "").lower())))
    assert all(idf[w] == round(math.log((n + 1) / (held[w] + 1)) * 1e6) for w in idf)
    expected = sorted((i, *plain_scan(t, idf)) for i, t, *_ in rows)
    got = sorted(tuple(r) for r in license_scan.scan(docs).collect())
    for g, e in zip(got, expected):
        assert g[:7] == e[:7] and abs(g[7] - e[7]) < 1e-12
    assert license_scan.scan(empty_documents(spark)).count() == 0


def test_licence_scan_of_a_text_with_all_templates(spark):
    """More index words in one text than any cap: each template is found where it stands."""
    rng = random.Random(13)
    everything = " ; ".join(t.text for t in license_scan.TEMPLATES)
    some = " ; ".join(t.text for t in license_scan.TEMPLATES if t.label in ("bsd", "mit", "mpl-2.0", "lgpl", "cc-by-sa", "apache-2.0"))
    rows = [(1, everything, "en", "s", 1), (2, some, "en", "s", 1)]
    common = "0 2 version license apache the under licensed mit released"
    rows += [(10 + n, common + " " + sentence(rng, 20), "en", "s", 1) for n in range(60)]
    docs = odd_documents(spark, rows)
    idf = license_scan.rarity(license_scan.noted(docs))
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(docs).filter("doc_id < 10").collect()}
    assert got == {i: plain_scan(t, idf) for i, t, *_ in rows[:2]}
    assert got[1][5].split(",") == sorted({t.label for t in license_scan.TEMPLATES})


# BPE


def hard_texts(n=300):
    rng = random.Random(11)
    alphabet = list("abcXYZ 019'.,!?#") + ["é", "é", "ß", "İ", "Σ", "中", "\U0001f600", " ", "\t", "\n", "'s", "'LL", "٠", " ", "\x1c", "‍", "<|endoftext|>", "<|startoftext|>", "<|"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["don't we'll I'VE", "x" * 500, "12345 ½ Ⅰ", "<|endoftext|>" * 3]


@pytest.mark.parametrize("size", [0, 7, 32_768])
def test_encoding_is_the_librarys(spark, size):
    reference = Tokenizer.from_file(VOCABULARY)
    texts = [t for _, t, *_ in odd_rows()] + hard_texts()
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = bpe.decode(bpe.encode(odd_documents(spark, rows), VOCABULARY, size), VOCABULARY).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = reference.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids, repr(texts[r["doc_id"]])
        assert r["decoded"] == reference.decode(ids, skip_special_tokens=False)
    again = bpe.round_trip(odd_documents(spark, rows), VOCABULARY, size).collect()
    assert sorted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in again) == sorted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got)


def test_every_code_point_is_encoded_as_the_library_does(tmp_path):
    """Letters, marks and cases of other Unicode versions than Python's, alone, in words, doubled and between marks."""
    reference = Tokenizer.from_file(VOCABULARY)
    vocab = bpe.Vocabulary(VOCABULARY, io.BytesIO(bpe.library_tables(VOCABULARY)))
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.Lexicon.compile({}))
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{x}b ??{x}{x}1" for x in map(chr, codes[i : i + 2000])) for i in range(0, len(codes), 2000)]
    low = [c for c in codes if c < 0x20000]
    texts += [" ".join(f"e{x}\u0316\u0301'{x} {x}\u0334" for x in map(chr, low[i : i + 2000])) for i in range(0, len(low), 2000)]
    texts += ["'s't 'S's!'s '' ''s don'tx we'll'll 're'RE've 'l 'll", "'", "x'", "<|endoftext|>'s<|startoftext|>'", "\U00011935\U00011930 \U00011938"]
    for i in range(0, len(texts), 32):
        part = texts[i : i + 32]
        ids, ends = bpe.encode_texts(part, vocab, bpe.Lexicon(str(path)), bpe.Memo())
        for n, own in enumerate(reference.encode_batch(part, add_special_tokens=False)):
            assert ids[ends[n] : ends[n + 1]].tolist() == own.ids, i + n


def test_a_very_long_text_and_a_word_without_end(spark):
    rng = random.Random(21)
    texts = [sentence(rng, 300_000), "x" * 20_000, "\u4e2d" * 5_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))]
    reference = Tokenizer.from_file(VOCABULARY)
    got = bpe.encode(odd_documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), VOCABULARY).collect()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_merging_takes_time_in_proportion_and_the_memo_is_bounded():
    vocab = bpe.Vocabulary(VOCABULARY, io.BytesIO(bpe.library_tables(VOCABULARY)))
    rng = random.Random(2)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.process_time()
    assert len(vocab.merge(word)) > 200_000 and time.process_time() - began < 20
    for n in range(1, 90):  # with a heap and without
        some = "".join(rng.choices("abcdeinorst", k=n))
        parts = [vocab.letters[b] for b in some.encode()]
        assert vocab._merged(parts.copy()) == vocab._merged_short(parts.copy())
    memo = bpe.Memo(most=6400)
    for i in range(3000):
        memo.keep(f"word{i}".encode(), [1, 2, 3])
        assert memo.held == sum(len(w) + len(x) for w, x in memo.items()) <= 6400
    memo.keep(b"x" * 101, [1])
    assert b"x" * 101 not in memo and memo.get(b"word2999") == [1, 2, 3]


def test_encoding_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = bpe.encode(docs, VOCABULARY)
    assert got.count() == docs.count()
    assert all(len(r["ids"]) == 0 for r in got.filter("doc_id in (1, 2, 3)").collect())
    assert bpe.encode(empty_documents(spark), VOCABULARY).count() == 0


def test_lexicon_holds_just_its_words(tmp_path):
    import pyarrow as pa

    rng = random.Random(4)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {b"\xff\xfe", b"x" * 3000}
    entries = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for w in words}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(bpe.Lexicon.compile(entries))
    lexicon = bpe.Lexicon(str(path))
    asked = sorted(words) + [b"", b"zzz", b"abcdabcdabcd", b"x" * 2999]
    found = lexicon.find(pa.array(asked, pa.binary()))
    for w, n in zip(asked, found):
        assert (n >= 0) == (w in entries)
        if n >= 0:
            assert lexicon.ids[lexicon.at[n] : lexicon.at[n + 1]].tolist() == entries[w]
    short = {w: entries[w] for w in words if len(w) < 10}
    path.write_bytes(bpe.Lexicon.compile(short))
    endings = {frozenset(w[len(p) :] for w in short if w.startswith(p)) for x in short for p in (x[:n] for n in range(len(x) + 1))}
    assert len(bpe.Lexicon(str(path)).final) == len(endings), "a state for each set of endings, no more"


# Chat


def test_layouts_are_known_by_their_paths(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = {
        1: {"messages": [{"role": r, "content": t} for r, t in turns], "extra": {"role": 1}},
        2: {"conversations": [{"from": r, "value": t} for r, t in turns]},
        3: {"prompt": "q", "completion": "a", "id": 9},
        4: {"prompt": "q", "response": "a"},
        5: {"instruction": "q", "output": "a"},
        6: {"instruction": "q", "input": "", "output": "a"},
        7: {"system": "s", "prompt": "q", "completion": "a"},
        8: {"instruction": "q", "input": "more", "output": "a"},
    }
    rows = [(i, json.dumps(r)) for i, r in records.items()] + [(20, "no json"), (21, '{"what": 1}'), (22, None)]
    got = defaultdict(list)
    for r in chat_format.turns_of_records(spark.createDataFrame(rows, "conv_id int, record string")).orderBy("turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert {i: got[i] for i in range(1, 7)} == {i: turns for i in range(1, 7)}
    assert got[7] == [("system", "s"), *turns] and got[8] == [("user", "q\n\nmore"), turns[1]] and not {20, 21, 22} & set(got)
    frame = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "conv_id int, messages array<struct<role:string,content:string>>")
    assert collected(chat_format.turns_of_frame(frame)) == [(1, 0, "user", "q"), (1, 1, "assistant", "")]
    with pytest.raises(ValueError):
        chat_format.turns_of_frame(spark.range(1))


def test_records_with_nulls_and_further_fields_keep_all_turns(spark):
    turns = [("user", "q"), ("assistant", "a")]
    said = [{"role": r, "content": t} for r, t in turns]
    records = {
        1: ({"messages": [{"role": "assistant", "content": None}, *said]}, [("assistant", ""), *turns]),
        2: ({"messages": [{"role": "tool"}, *said]}, [("tool", ""), *turns]),
        3: ({"prompt": None, "completion": "x"}, [("user", ""), ("assistant", "x")]),
        4: ({"messages": said, "system": "s"}, [("system", "s"), *turns]),
        5: ({"messages": said, "input": "i"}, turns),
        6: ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), *turns]),
        7: ({"system": "s", "instruction": "q", "output": "a"}, [("system", "s"), *turns]),
        8: ({"system": "s", "instruction": "q", "input": "more", "output": "a"}, [("system", "s"), ("user", "q\n\nmore"), turns[1]]),
        9: ({"system": None, "prompt": "q", "completion": "a", "instruction": None, "input": None, "output": None, "messages": None}, turns),
        10: ({"system": "s", "conversations": [{"from": r, "value": t} for r, t in turns]}, [("system", "s"), *turns]),
        11: ({"messages": [None, *said]}, [("", ""), *turns]),
        12: ({"prompt": "q", "completion": None, "response": "a"}, turns),
    }
    rows = [(i, json.dumps(r)) for i, (r, _) in records.items()] + [(20, "no json"), (21, '{"what": 1}'), (21, "{}"), (22, None), (23, '{"messages": ["text"]}')]
    docs = spark.createDataFrame(rows, "conv_id int, record string")
    got = defaultdict(list)
    for r in chat_format.turns_of_records(docs).orderBy("turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(got) == {i: expected for i, (_, expected) in records.items()}
    assert collected(chat_format.unmatched_records(docs)) == [(20, "no json", 1), (21, "no layout", 2), (22, "no json", 1), (23, "no layout", 1)]


def test_contents_given_as_parts_are_their_texts(spark):
    parts = [{"type": "text", "text": "one "}, {"type": "text", "text": "two"}]
    records = {
        1: {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "a"}]},
        2: {"messages": [{"role": "user", "content": []}, {"role": "assistant", "content": 5}]},
        3: {"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}, "plain", None, *parts]}]},
        4: {"conversations": [{"from": "human", "value": parts}]},
    }
    rows = [(i, json.dumps(r)) for i, r in records.items()] * 2 + [(None, json.dumps(records[1]))]
    got = defaultdict(list)
    for r in chat_format.turns_of_records(spark.createDataFrame(rows, "conv_id int, record string")).orderBy("turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got[1] == [("user", "one two")] * 2 + [("assistant", "a")] * 2 and got[None] == [("user", "one two"), ("assistant", "a")]
    assert got[2] == [("user", "")] * 2 + [("assistant", "5")] * 2
    assert [t for _, t in got[3]] == ['{"type":"image","url":"u"}plainone two'] * 2
    assert got[4] == [("human", "one two")] * 2


def test_tables_of_turns_go_by_their_fingerprint(spark):
    paths = {"conv_id", "turn", "role", "text"}
    assert chat_format.layout_of(paths).name == chat_format.layout_of(paths | {"input", "extra"}).name == "turn_rows"
    rows = [(1, 5, "user", None, "i"), (1, 5, "user", None, "i"), (None, None, None, "t", "i")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, input string")
    assert collected(chat_format.turns_of_frame(frame)) == [(None, None, "", "t"), (1, 5, "user", ""), (1, 5, "user", "")]


def test_formatting_reads_back(spark):
    rng = random.Random(6)
    pieces = ["\\", "<", "[", "|", "<|im_end|>\n", "<|im_sep|>", "<\\|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "n", "\n", "é", "\U0001f600", "<\\/s>", "ok"]
    rows, turns = [], defaultdict(list)
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "<|im_sep|>odd\n"])
            text = rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))])
            rows.append((c, t, role, text, 1))
            turns[c].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n int").repartition(3)
    formatted = chat_format.format_turns(chat_format.turns_of_frame(df))
    for r in chat_format.read_back(formatted).collect():
        assert [tuple(t) for t in r["turns"]] == turns[r["conv_id"]]
        assert r["loss_text"] == "".join(x for role, x in turns[r["conv_id"]] if role == "assistant")
    for r in formatted.collect():
        marks = re.findall(r"<\|[a-z_]+\|>|</?s>|\[/?INST\]", r["formatted"])
        assert marks == ["<|im_start|>", "<|im_sep|>", "<|im_end|>"] * len(turns[r["conv_id"]])
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert len(spans) == sum(role == "assistant" for role, _ in turns[r["conv_id"]])
    assert chat_format.format_turns(chat_format.turns_of_frame(df.filter("false"))).count() == 0


# Models


def held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_classifier_learns_from_its_part_only(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = sentence(rng, 40)
        rows.append((i, text if good else " ".join(w + rng.choice(["***", "###"]) for w in text.split()), "en", "s", 1))
        labels.append((i, int(good)))
    docs = odd_documents(spark, rows + [(9000, None, None, None, None), (9001, "", None, None, None), (None, "x", None, None, None)])
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_model.classify(docs, marks).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["held_out"] == held_out(i) for i in range(600))
    assert np.mean([got[i]["predicted"] == q for i, q in labels if held_out(i)]) > 0.97
    turned = spark.createDataFrame([(i, 1 - q if held_out(i) else q) for i, q in labels], "doc_id bigint, quality int")
    again = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, turned).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i, _ in labels), "held-out labels change nothing"
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spread = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, marks).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(abs(spread[i] - got[i]["score"]) < 1e-9 for i, _ in labels), "the number of partitions changes nothing"
    untrained = quality_model.classify(docs, marks.filter("false")).collect()
    assert {r["score"] for r in untrained} == {0.5}
    assert quality_model.classify(empty_documents(spark), marks).count() == 0


def plain_features(text):
    """Hashed grams one at a time; a token counts as word and as shape."""
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text)
    words = [xxhash.xxh64_intdigest(w.lower(), 1) for w in tokens]
    shapes = [xxhash.xxh64_intdigest(quality_model.shape(w), 2) ^ (0x5851F42D4C957F2D if n and w.lower() == tokens[n - 1].lower() else 0) for n, w in enumerate(tokens)]
    out = Counter()
    for stream, longest in ((words, 2), (shapes, 3)):
        for n in range(1, longest + 1):
            for i in range(len(stream) - n + 1):
                gram = stream[i]
                for k in range(1, n):
                    gram = (gram * 0x9E3779B97F4A7C15 % 2**64) ^ stream[i + k]
                out[((gram + n) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - quality_model.BITS)] += 1
    return out


def plain_ftrl(rows, t):
    """Weights by feature after one pass; a row is (counts, label)."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= t.l1 else -math.copysign(abs(z[f]) - t.l1, z[f]) / ((t.beta + math.sqrt(n[f])) / t.alpha + t.l2)

    for counts, label in rows:
        total = sum(counts.values())
        x = {f: c / math.sqrt(max(1, total)) for f, c in counts.items()} | {1 << quality_model.BITS: 1.0}
        w = {f: weight(f) for f in x}
        p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
        for f, v in x.items():
            g = (p - label) * v
            z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / t.alpha * w[f]
            n[f] += g * g
    return {f: weight(f) for f in n if weight(f)}


def quality_rows(n=90, seed=31):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(5, 30)) + (" ### 12" if i % 3 else "!"), "en", "s", 1) for i in range(n)]
    return rows, [(i, int(i % 3 == 0)) for i in range(n)]


@pytest.mark.parametrize("shards", [1, 3, 64])
def test_training_and_scores_against_plain_ftrl(spark, shards):
    rows, labels = quality_rows()
    docs, marks = odd_documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")
    t = quality_model.Training(shards=shards)
    picked = quality_model.labelled(docs, marks, t).withColumn("shard", F.pmod("h", F.lit(shards))).orderBy("h", "text").collect()
    assert {r["text"] for r in picked} == {x for i, x, *_ in rows if not held_out(i)}
    expected = defaultdict(float)
    for shard in {r["shard"] for r in picked}:
        own = [(plain_features(r["text"]), r["label"]) for r in picked if r["shard"] == shard]
        for f, w in plain_ftrl(own, t).items():
            expected[f] += w * len(own) / len(picked)
    model = quality_model.train(docs, marks, t)
    got = {r["feature"]: r["weight"] for r in model.collect()}
    assert set(got) == set(expected) and all(abs(got[f] - w) < 1e-9 for f, w in expected.items())
    texts = {i: x for i, x, *_ in rows}
    for r in quality_model.score(docs, model).collect():
        counts = plain_features(texts[r["doc_id"]])
        logit = expected[1 << quality_model.BITS] + sum(c * expected[f] for f, c in counts.items()) / math.sqrt(max(1, sum(counts.values())))
        assert abs(r["score"] - 1 / (1 + math.exp(-logit))) < 1e-9


def test_training_rows_are_bounded_after_the_join(spark):
    """Ids and labels that repeat on either side don't multiply the rows learned from."""
    rows = [(i % 3 * 3, f"text {i} of many", "en", "s", 1) for i in range(300)] + [(0, "same", "en", "s", 1)] * 50
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (3, 1), (6, 0)], "doc_id bigint, quality int")
    docs = odd_documents(spark, rows)
    allowed = [i for i in (0, 3, 6) if not held_out(i)]
    every = len({(i, x, q) for i, x, *_ in rows for q in ((0, 1) if i == 0 else (1,)) if i in allowed})
    assert quality_model.labelled(docs, labels, quality_model.Training()).count() == every > 5
    assert quality_model.labelled(docs, labels, quality_model.Training(max_rows=5)).count() == 5
    odd = quality_model.classify(odd_documents(spark), spark.createDataFrame([(7, 1), (7, 1), (6, 0), (9, 0)], "doc_id bigint, quality int"))
    scores = {(r["doc_id"], round(r["score"], 12)) for r in odd.filter("doc_id = 7").collect()}
    assert odd.count() == len(odd_rows()) and len(scores) == 1, "a long text, nulls and repeated rows"


def test_features_do_not_cross_texts():
    a, b = "one two three", "Four five!! 6"
    apart = [sorted(quality_model.features([t])[0].tolist()) for t in (a, b)]
    both, owner = quality_model.features([a, "", b])
    assert [sorted(both[owner == n].tolist()) for n in range(3)] == [apart[0], [], apart[1]]


def test_languages(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdefg", "bb": "ghijklmn", "cc": "αβγδ"}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(rng.randint(5, 60))), lang, "s", 1))
    odd = [(1000, None, None, None, None), (1001, "123 !?", "aa", None, None), (1002, "", "bb", None, None), (None, "abc abc", "cc", None, None), (1003, "a", None, None, None)]
    docs = odd_documents(spark, rows + odd)
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.profiles(docs)).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if held_out(i)]) > 0.97
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.identify(docs, language_id.profiles(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language_id.identify(empty_documents(spark), language_id.profiles(docs)).count() == 0


def plain_vector(text):
    """A trigram at a time; anything between letters is one boundary."""
    out = np.zeros(language_id.DIMENSIONS)
    runs = "".join(c if c.isalpha() else "\0" for c in (text or "").lower())
    runs = "\0" + re.sub("\0+", "\0", runs).strip("\0") + "\0"
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        if b != "\0":
            v = [language_id.letter(0 if x == "\0" else ord(x)).astype(float) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_profiles_and_choice_against_a_plain_version(spark):
    """Sums per language, cosines, and the first by name of languages that tie; repeated rows count once."""
    rng = random.Random(37)
    rows = [(i, sentence(rng, rng.randint(1, 9)), ["xx", "yy", None][i % 3], "s", 1) for i in range(60)]
    same = [(i, "tie tie", lang, "s", 1) for i, lang in ((100, "bb"), (101, "aa"), (102, "bb"), (103, "aa"), (104, "aa"), (105, "bb"))]
    rows += same + rows[:5] + rows[:5] + [(200, None, "xx", None, None), (201, "", "yy", None, None), (202, sentence(rng, 20_000), "xx", "s", 1)]
    docs = odd_documents(spark, rows)
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    expected = {}
    for i, t, lang in {(i, t, lang) for i, t, lang, *_ in rows if lang and not held_out(i)}:
        expected[lang] = expected.get(lang, 0) + unit(plain_vector(t))
    learned = language_id.profiles(docs)
    got = defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for r in learned.collect():
        got[r["lang"]][r["dimension"]] = r["value"]
    assert set(got) == set(expected) and all(np.allclose(got[k], v, atol=1e-3) for k, v in expected.items())
    names = sorted(expected)
    table = np.array([unit(expected[k]) for k in names])
    texts = {i: t for i, t, *_ in rows}
    for r in language_id.identify(docs, learned).collect():
        v = unit(plain_vector(texts[r["doc_id"]]))
        near = table @ v
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert abs(r["score"] - max(0, near.max())) < 1e-5 and near[names.index(r["lang_pred"])] > near.max() - 1e-5
        if texts[r["doc_id"]] == "tie tie":
            assert r["lang_pred"] == "aa"
    assert language_id.profiles(docs, max_rows=3).groupBy("lang").count().count() <= 3


def test_vectors_are_sums_of_bound_trigrams():
    one = lambda c: language_id.letter(ord(c) if c != "_" else 0).astype(np.float32)
    bound = lambda g: np.roll(one(g[0]), 2) * np.roll(one(g[1]), 1) * one(g[2])
    expected = bound("_ab") + bound("ab_") + bound("_c_")
    got = language_id.vectors(["1 Ab, c!", "", "??"])
    assert np.array_equal(got[0], expected) and not got[1:].any()


def test_a_table_of_turns_keeps_its_turns_whatever_else_it_has(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({c: F.lit(c[0]) for c in ("instruction", "input", "output", "system", "prompt", "completion", "layout", "fp", "v")})
    got = collected(chat_format.turns_of_frame(df), "conv_id", "turn", "role", "text")
    assert got == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]


def test_records_meet_a_small_plan_and_take_long_texts_and_no_rows(spark):
    """The fingerprint is worked out once per record: the plan stays small; clashing columns are left alone."""
    long = "word </s> " * 100_000
    rows = [(1, json.dumps({"prompt": long, "completion": None})), (2, json.dumps({"messages": [{"role": "user", "content": long}]})), (3, "{"), (4, None), (5, "[1]"), (6, "{}")]
    df = spark.createDataFrame(rows, "conv_id bigint, record string").withColumns({c: F.lit(7) for c in ("fp", "layout", "has", "filled", "v", "turns", "messages")})
    turns = chat_format.turns_of_records(df)
    assert len(turns._jdf.queryExecution().executedPlan().toString()) < 150_000
    assert collected(turns) == [(1, 0, "user", long), (1, 1, "assistant", ""), (2, 0, "user", long)]
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert back[2]["turns"][0]["text"] == long and back[1]["loss_text"] == ""
    assert {(r["conv_id"], r["reason"]) for r in chat_format.unmatched_records(df).collect()} == {(3, "no json"), (4, "no json"), (5, "no layout"), (6, "no layout")}
    assert chat_format.turns_of_records(df.filter("false")).count() == 0
    assert chat_format.format_turns(turns.filter("false")).count() == 0 and chat_format.unmatched_records(df.filter("false")).count() == 0


def test_vectors_of_wide_alphabets_take_bounded_memory():
    """64 texts of random characters of a large alphabet: what each text has does not depend on the others, nor memory."""
    import tracemalloc

    rng = random.Random(4)
    texts = ["".join(map(chr, rng.choices(range(0x4E00, 0x9FA0), k=4000))) for _ in range(64)]
    tracemalloc.start()
    got = language_id.vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert (got[[0, 31, 63]] == np.concatenate([language_id.vectors([texts[i]]) for i in (0, 31, 63)])).all()
