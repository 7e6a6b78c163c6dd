"""Fixtures that every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHING = ("row", "key", "fp", "digest", "prefix", "n_bytes", "count", "words", "hits", "block", "weight", "m", "failed", "component_id", "ids", "score", "label", "h1", "start", "plan_source", "a.b")


def sentence(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "river", "stone", "light", "makes", "under", "seven", "paper", "quiet", "house", "größe", "naïve", "corre"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n))


def odd_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    long = sentence(rng, 20_000)
    shared = sentence(rng, 60)
    copy = sentence(rng, 120)
    near = copy.split()
    near[7] = "altered"
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "!"), (5, "one two"), (6, long), (7, copy), (8, copy), (9, copy), (10, " ".join(near)),
        (11, sentence(rng, 80) + " " + shared + " " + sentence(rng, 80)), (12, sentence(rng, 90) + " " + shared), (13, "Licensed under CC BY-NC 4.0. " + sentence(rng, 60)),
        (14, "word " * 300), (15, "\n".join(["a line that repeats"] * 40)), (16, "LOUD!! " * 70), (None, copy), (None, "no id " + sentence(rng, 70)), (18, None), (19, ""),
    ]
    texts += [(100 + i, sentence(rng, rng.randint(1, 200))) for i in range(60)]
    texts += [texts[20], texts[20], (7, copy), (21, "\U0001f600 emoji é é <|endoftext|> ΣΣ"), (22, "\x00\x01 control \x85 next")]
    return [
        (i, t, [None, "en", "de"][n % 3], [None, "hot", "hot", "cold"][n % 4] if n % 7 else "rare", None if n % 5 == 0 else 3)
        for n, (i, t) in enumerate(texts)
    ]


def odd_documents(spark, rows=None):
    """The rows with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) if n % 2 else F.lit(None).cast("string") for n, c in enumerate(CLASHING)})


def empty_documents(spark):
    return odd_documents(spark, []).filter("false")


def collected(df, *columns):
    """Rows as sorted tuples; nulls sort first."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in r))
