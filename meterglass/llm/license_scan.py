"""Licence notices by a positional index of rare words, in DataFrame operations only.

Each template is indexed by its words of highest inverse document frequency, counted over all
documents: the postings are rows of word, template and place. A document looks up every word of that
index that it has; a hit proposes a start for a template (its place less the template's), where the
template's other rare words must stand at their places and its key phrases must stand word for word.

The first pass over the texts notes which template words each one has, as a narrow table. Only texts
with an index word are read again: their words are exploded, the hits meet the postings, a table of
some hundred rows, in a broadcast join, and a hit carries on no more of its text than the window that
the template covers. More templates are more rows, not a larger plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import broadcast_if_small, fold_ascii, text_key, whole_text, write_out

#: Words are what stands between runs of these.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template in the index.
RARE = 5
#: The part of a template's rare words, by weight, that must stand at their places.
LEAST = 0.6


@dataclass(frozen=True)
class Template:
    """``phrases`` are mandatory and parts of ``text``, words in lower-case ASCII; a base template is its own phrase."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def required(self) -> list[tuple[int, str]]:
        """Places and words of the phrases."""
        out = {}
        for p in self.phrases:
            own = p.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(own)] == own)
            out |= {at + i: w for i, w in enumerate(own)}
        return sorted(out.items())


def base(phrase: str, label: str) -> Template:
    return Template(label, phrase, (phrase,), True)


#: The base phrases, short notices, and the paragraphs of licences and of their notices.
TEMPLATES = (
    base("cc by", "cc-by"),
    base("general public license", "gpl"),
    base("all rights reserved", "reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("the apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        ("to deal in the software without restriction",),
    ),
    Template(
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software",
        ("the software is provided as is",),
    ),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
        ("must reproduce the above copyright notice",),
    ),
    Template(
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
        "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
        ("by the copyright holders and contributors",),
    ),
    Template(
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("may be used to endorse or promote products",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations "
        "under the license",
        ("except in compliance with the license",),
    ),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 2 of the license or at your option any later version",
        ("either version 2 of the license",),
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        ("either version 3 of the license",),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
        "by the free software foundation",
        ("lesser general public license",),
    ),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
        ("a copy of the mpl was not distributed",),
    ),
    Template(
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
        ("eclipse public license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    Template(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions",
        ("to alter it and redistribute it freely",),
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered "
        "by this license the software to use reproduce display distribute execute and transmit the software",
        ("any person or organization obtaining a copy",),
    ),
    Template(
        "cc0",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work "
        "worldwide under copyright law",
        ("dedicated the work to the public domain",),
    ),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)


def words_of() -> Column:
    """The words of the whole text, A-Z lower-cased.

    The faster ``lower`` goes beyond A-Z, but of other letters only the Kelvin sign becomes an ASCII
    letter, and none a break: for words of ASCII letters it is the same.
    """
    text = whole_text()
    low = F.when(F.contains(text, F.lit("\u212a")), fold_ascii(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BREAKS), "")


def vocabulary_of(templates) -> list[str]:
    words = sorted({w for t in templates for w in t.words})
    if not all(w.isascii() and w.isalnum() and w == w.lower() for w in words):
        raise ValueError("templates are words of a-z and 0-9")
    return words


def noted(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, key, n_words and ``known``, the distinct template words of every whole text, written out."""
    rows = docs.select("doc_id", text_key().alias("key"), words_of().alias("words"))
    known = F.array_intersect("words", F.array(*map(F.lit, vocabulary_of(templates))))
    return write_out(rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), known.alias("known")))


def rarity(notes: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Each template word's inverse document frequency over all documents, in millionths.

    The counts come back as one row per word of the templates, however many documents there are.
    """
    seen = notes.select(F.explode(F.concat(F.array(F.lit("")), "known")).alias("word"))
    n = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    return {w: round(math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) * 1e6) for w in vocabulary_of(templates)}


def rare_words(t: Template, idf: dict[str, int]) -> list[tuple[int, str]]:
    """Places and words of the template's words of highest idf, ties by the alphabet."""
    distinct = sorted(set(t.words), key=lambda w: (-idf[w], w))
    own = set(distinct[: min(RARE, max(1, len(t.words) // 2))])
    return [(i, w) for i, w in enumerate(t.words) if w in own]


def postings(spark, templates, idf: dict[str, int]) -> DataFrame:
    """word, place, template and what the template asks for: a row per place of a rare word."""
    rows = []
    for k, t in enumerate(templates):
        rare = [(i, w, max(1, idf[w])) for i, w in rare_words(t, idf)]
        rows += [(w, i, k, t.label, t.base, len(t.words), rare, t.required()) for i, w, _ in rare]
    asks = "rare array<struct<at:int,word:string,weight:long>>, required array<struct<at:int,word:string>>"
    return spark.createDataFrame(rows, f"word string, place int, template int, label string, base boolean, length int, {asks}")


def places(docs: DataFrame, index: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, key, template, label, base, start, part: where a template of the index is accepted."""
    rows = docs.select("doc_id", text_key().alias("key"), words_of().alias("words"))
    hits = rows.select("doc_id", "key", "words", F.posexplode("words").alias("i", "word")).filter(F.col("word").isin(words))
    hits = hits.join(F.broadcast(index), "word")  # as many rows as the templates have rare words
    start = F.col("i") - F.col("place")
    first = F.greatest(start, F.lit(0))
    hits = hits.select(
        "doc_id", "key", "template", "label", "base", "rare", "required", start.alias("start"),
        (first - start).alias("missing"), F.slice("words", first + 1, F.col("length")).alias("window"),
    )

    def stands(x: Column) -> Column:
        return F.coalesce(F.get("window", x["at"] - F.col("missing")) == x["word"], F.lit(False))

    def weight(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda total, x: total + x["weight"])

    held, whole = weight(F.filter("rare", stands)), weight(F.col("rare"))
    accepted = F.forall("required", stands) & (held >= F.ceil(F.lit(LEAST) * whole))
    found = hits.filter(accepted).select("doc_id", "key", "template", "label", "base", "start", (held / whole).alias("part"))
    return found.distinct()


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no places and score 0. The score is the largest part of a
    found template's rare words, by weight, that stands in the text: 1 where a base phrase does.
    Repeated rows give repeated rows, a null doc_id stays null, an empty table gives no rows. A very
    long text is exploded word by word in one task; a hit takes a window of it along.
    """
    notes = noted(docs, templates)
    idf = rarity(notes, templates)
    index = sorted({w for t in templates for _, w in rare_words(t, idf)})
    hit = notes.filter(F.arrays_overlap("known", F.array(*map(F.lit, index)))).select("doc_id", "key").distinct()
    hit = broadcast_if_small(hit)
    texts = docs.select("doc_id", "text", text_key().alias("key"))
    texts = texts.join(hit, texts["doc_id"].eqNullSafe(hit["doc_id"]) & (texts["key"] == hit["key"]), "left_semi")
    found = places(texts.dropDuplicates(["doc_id", "key"]), postings(docs.sparkSession, templates, idf), index)
    base = F.when(F.col("base"), F.col("start"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = found.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        names("label").alias("labels"),
        F.max("part").alias("score"),
    )
    found = broadcast_if_small(found)
    rows = notes.join(found, notes["doc_id"].eqNullSafe(found["id"]) & (notes["key"] == found["k"]), "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
