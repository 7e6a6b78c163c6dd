"""Exact duplicates by progressive refinement, in DataFrame operations only.

Lengths are counted first; only texts of a shared length have a hash of their first characters
taken, and only those that share it too are hashed in full. Each level counts with a partial
aggregation, so a group with a third of all rows crosses the network as one row per task, and joins
the rows to one row per group, a join whose hot keys Spark splits at run time. A level's groups are
broadcast if they are few, which is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import anew, broadcast_if_small, cut_lineage, take_out, text_key, whole_text


KEY = ["n_bytes", "prefix", "digest"]


def prefix_of(chars: int) -> Column:
    return F.xxhash64(F.substring("text", 1, chars))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_bytes of every row."""
    return docs.select("doc_id", whole_text().alias("text")).withColumn("n_bytes", F.octet_length("text"))


def shared_lengths(rows: DataFrame) -> DataFrame:
    """The lengths that two rows or more have."""
    return broadcast_if_small(anew(rows.groupBy("n_bytes").count().filter("count > 1").select("n_bytes"), "n_bytes"))


def shared_prefixes(rows: DataFrame, lengths: DataFrame, chars: int) -> DataFrame:
    """The (n_bytes, prefix) that two rows or more have; prefixes are read of shared lengths only."""
    met = rows.join(lengths, "n_bytes", "left_semi").withColumn("prefix", prefix_of(chars))
    met = met.groupBy("n_bytes", "prefix").count().filter("count > 1").select("n_bytes", "prefix")
    return broadcast_if_small(anew(met, "prefix"))


def exact_groups(docs: DataFrame, prefix_chars: int = 256, with_digest: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept (and text_sha256 ``with_digest``).

    Texts are equal when identical, null counting as empty. Of equal texts the row with the largest
    doc_id stays; a null id is smaller than any other. Rows that repeat both id and text tie: one of
    them stays. An empty table gives no rows; further columns of ``docs`` are left alone. A very long
    text is read up to its prefix unless another shares length and prefix.
    """
    rows = sized(docs)
    lengths = shared_lengths(rows)
    partners = shared_prefixes(rows, lengths, prefix_chars).withColumn("partner", F.lit(True))
    full = F.sha2("text", 256)
    rows = rows.join(lengths.withColumn("met", F.lit(True)), "n_bytes", "left")
    rows = rows.withColumn("prefix", F.when(F.col("met"), prefix_of(prefix_chars)))
    rows = rows.join(partners, ["n_bytes", "prefix"], "left").select(
        "doc_id",
        "n_bytes",
        "prefix",
        F.when(F.col("partner"), full).alias("digest"),
        (full if with_digest else F.lit(None).cast("string")).alias("sha"),
    )
    # Rows that repeat id and text become one row with a count.
    rows = rows.groupBy("doc_id", *KEY, "sha").agg(F.count("*").alias("copies"))
    groups = (
        rows.filter("digest is not null")
        .groupBy(*KEY)
        .agg(F.sum("copies").alias("size"), F.max("doc_id").alias("best"))
    )
    rows = rows.join(anew(groups, "prefix"), KEY, "left").select(
        "doc_id",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
        "sha",
    )
    rows = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
    rows = rows.select("doc_id", "keep_id", "group_size", "kept", "sha")
    return rows.withColumnRenamed("sha", "text_sha256") if with_digest else rows.drop("sha")


def drop_exact(docs: DataFrame, prefix_chars: int = 256) -> DataFrame:
    """``docs`` with one row of each group of equal texts, as ``exact_groups`` decides.

    All columns come back in their order. Only texts that share length and prefix are hashed in full,
    and the decision is made on narrow rows. Nulls, repeated rows, empty tables and long texts are
    treated as there; a null text that stays is still null.
    """
    rows = sized(docs)
    lengths = shared_lengths(rows)
    partners = shared_prefixes(rows, lengths, prefix_chars)
    met = rows.join(lengths, "n_bytes", "left_semi").withColumn("prefix", prefix_of(prefix_chars))
    met = met.join(partners, ["n_bytes", "prefix"]).withColumns({"digest": F.sha2("text", 256), "key": text_key()})
    met = cut_lineage(met.groupBy("doc_id", "key", *KEY).agg(F.count("*").alias("copies")))
    best = met.groupBy(*KEY).agg(F.max("doc_id").alias("best"))
    met = met.join(anew(best, "prefix"), KEY).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best")))
    return take_out(docs, met.filter("not stays"), met.filter("stays and copies > 1"))
