"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a versioned mask of the bits that reject. Changing a policy, comparing two of
them or leaving a rule out reads only the masks, which an aggregation reduces to a few rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import per_text, struct_of, whole_text

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Characters of text that a worker measures at once.
SLICE = 1 << 19

#: Rule name -> SQL over the measurements, true where the document fails. The place is the bit.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "capitals": "n_letters >= 50 and 10 * n_upper > 5 * n_letters",
    "few_letters": "2 * n_letters < word_chars",
    "too_many_words": "n_words > 1000000",
}
BASE = ("too_few_words", "repeated_words")


def mask(*rules: str) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


@dataclass(frozen=True)
class Policy:
    """Documents that fail any of ``rules`` are rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    def rejects(self) -> Column:
        return F.col("failed").bitwiseAND(F.lit(mask(*self.rules))) != 0


POLICIES = {
    p.name: p
    for p in (
        Policy("base", 1, BASE),
        # Length alone is no fault: it is measured, and its bit stays in the ledger for policies that ask for it.
        Policy("web", 3, (*BASE, "word_length", "symbols", "duplicate_lines", "capitals", "few_letters")),
        # What the pipeline applies.
        Policy("corpus", 1, (*BASE, "word_length", "symbols", "duplicate_lines", "capitals", "few_letters")),
    )
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper"]


@cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """True for the code points of letters, and of upper-case ones."""
    kind = [unicodedata.category(chr(c)) for c in range(0x110000)]
    return np.array([k[0] == "L" for k in kind]), np.array([k == "Lu" for k in kind])


def members(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


SPACE, SYMBOL = members(SPACES), members(SYMBOLS)


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the words in windows of three that it has twice or more; ``ids`` are the words of all."""
    covered = np.zeros(len(ids), bool)
    if len(ids) > 2:
        k = int(ids.max()) + 1
        pair = ids[:-1] * k + ids[1:]
        if k >= 1 << 21:  # three of them don't fit into one number
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * k + ids[2:]
        at = np.flatnonzero(doc[:-2] == doc[2:])
        # Documents lie in order, so equal windows of one of them are next to each other.
        at = at[np.argsort(window[at], kind="stable")]
        same = (window[at[1:]] == window[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
        for again in (at[1:][same], at[:-1][same]):
            for i in range(3):
                covered[again + i] = True
    return np.bincount(doc[covered], minlength=n_docs)


def measure(texts: list[str]) -> list[np.ndarray]:
    """The MEASURES of whole texts, all of them together on arrays of bytes and of code points."""
    raw = [t.encode() for t in texts]
    n = len(raw)
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)

    def count(flags: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), np.r_[0, upto]))

    space = SPACE[data]
    places = np.flatnonzero(np.r_[True, space[1:] != space[:-1]])
    edges = pa.py_buffer(np.append(places, len(data)).astype(np.int32))
    shown = ~space[places]
    words = pa.Array.from_buffers(pa.binary(), len(places), [None, edges, pa.py_buffer(data)]).filter(pa.array(shown))
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.searchsorted(ends, places[shown], "right")
    lines = [[x for x in r.split(b"\n") if x.strip(SPACES)] for r in raw]
    letter, upper = kinds()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    text_ends = np.cumsum(lengths)
    return [
        np.bincount(doc, minlength=n),
        lengths - (count(space, ends) - 1),
        count(SYMBOL[data], ends),
        np.array([len(x) - len(set(x)) for x in lines]),
        repeated_words(ids, doc, n),
        np.array([len(x) for x in lines]),
        count(letter[codes], text_ends),
        count(upper[codes], text_ends),
    ]


def slices(texts: pa.Array):
    """Lists of texts of about SLICE characters together, or of one longer text."""
    own, size = [], 0
    for t in texts:
        own.append(t.as_py())
        size += len(own[-1])
        if size >= SLICE:
            yield own
            own, size = [], 0
    if own:
        yield own


def measures() -> Column:
    """A struct of the MEASURES of the column ``text``; null counts as empty."""

    @per_text("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def run(texts: pa.Array) -> pa.Array:
        found = [measure(part) for part in slices(texts)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * len(MEASURES)
        return struct_of(MEASURES, [pa.array(c, pa.int64()) for c in columns])

    return run(whole_text())


def failures(m: str = "") -> Column:
    """The bits of the failed rules, from the measurements in the struct ``m`` or in columns."""
    bits = F.lit(0)
    for bit, sql in enumerate(RULES.values()):
        for name in MEASURES if m else ():
            sql = re.sub(rf"\b{name}\b", f"{m}.{name}", sql)
        bits = bits.bitwiseOR(F.when(F.expr(sql), 1 << bit).otherwise(0))
    return bits.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that the document fails.

    A null text has no words, as an empty one, and fails too_few_words. Rows are judged one by one:
    repeated rows repeat in the result, a null doc_id stays null, an empty table gives no rows. A very
    long text is measured in one piece, in some 30 bytes of memory for each of its.
    """
    rows = docs.select("doc_id", measures().alias("m")).select("doc_id", "m.*")
    return rows.withColumn("failed", failures())


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under ``policy``."""
    return book.withColumns({"base_failed": POLICIES["base"].rejects(), "kept": ~policy.rejects()})


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, how many only it rejects.

    The ledger is reduced to one row per distinct mask first; the rules meet those rows only.
    """
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    own = mask(*policy.rules)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask(r)).alias("bit")) for r in policy.rules]))
    each = masks.select("n", F.col("failed").bitwiseAND(F.lit(own)).alias("hit"), rules.alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.lit(f"{policy.name}.v{policy.version}").alias("policy"),
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES["corpus"]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the policy keeps; nothing is shuffled.

    Null and empty texts have no words and go; repeated rows stay or go together, a null doc_id is
    like any other, an empty table stays empty, and no text goes for its length alone.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measures().alias("m"))
    rows = rows.withColumn("failed", failures("m"))
    return rows.filter(~policy.rejects()).select("row.*")
