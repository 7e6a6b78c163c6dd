"""The pipeline against brute force, stage by stage, and the operators' SQL."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, empty_documents, odd_documents, odd_rows
from oracle import DATA, assert_same
from test_rules_and_dedup import measured, plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from meterglass.llm import mixing, quality_rules, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, str(DATA)), queries.ORACLES[name])


def base_ok(text):
    n, _, _, _, repeated = measured(text)
    return not (n < 50 or 100 * repeated > 50 * n)


def brute_force(rows, keeps):
    """(doc_id, ids) of the last stage; ``keeps`` tells which texts the rules' policy keeps."""
    rows = [r for r in rows if keeps(r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r)
    rows = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    own = plain_components([plain_fingerprint(r[1]) for r in rows])
    named = {}
    for r, c in zip(rows, own):
        if c not in named or (r[0] is not None, -(r[0] or 0)) > (named[c][0] is not None, -(named[c][0] or 0)):
            named[c] = r
    rows = list(named.values())
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = odd_rows()
    docs = odd_documents(spark, rows)
    verdicts = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.POLICIES["web"])
    kept = {(r["doc_id"], r["n_words"]) for r in verdicts.filter("kept").collect()}
    assert all(not k or base_ok(t) for t, k in ((t, (i, measured(t)[0]) in kept) for i, t, *_ in rows))
    expected = brute_force(rows, lambda t: any((i, measured(t)[0]) in kept for i, x, *_ in rows if x == t))
    names = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        names.append(name)
        if len(names) < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        # Parquet takes no column of nulls without a type, so the file is the next stage's input.
        out.write.parquet(str(tmp_path / str(len(names))))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(len(names))))
        if len(names) == 3:
            assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter((r[0], r[1]) for r in expected)
    mixed = Counter(r["doc_id"] for r in before.collect())
    assert mixed == Counter(r["doc_id"] for r in mixing.mix_sources(spark.read.parquet(str(tmp_path / "3"))).collect())
    texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = docs.collect()
    assert Counter(r["doc_id"] for r in got) == mixed
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_is_its_stages(spark, tmp_path):
    rows = [(n, *r[1:]) for n, r in enumerate(odd_rows())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
    key = lambda df: sorted((r["doc_id"], hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_an_empty_table(spark):
    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
