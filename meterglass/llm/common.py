"""Small pieces that the corpus operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.session import cut_lineage, ship_package, write_out

__all__ = ["cut_lineage", "ship_package", "write_out"]

#: A word is a run of anything but ASCII white space; ``bytes.split()`` splits UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper-case ASCII letters to lower case, for ``bytes.translate``.
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def whole_text(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that no model may learn from; a null id counts as ''."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3) == 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Tables of up to so many narrow rows are broadcast, some 60 MB; longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, written out once, to be broadcast if it has at most ``limit`` rows."""
    df = cut_lineage(df)
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_key() -> Column:
    """A hash of id and text, by which a row is found again."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", whole_text())


def distinct_rows(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id and others) with one of each that repeat doc_id and ``key``, a hash of their text.

    Only rows that do repeat are shuffled; they are found on narrow rows.
    """
    repeated = rows.groupBy("doc_id", key).count().filter("count > 1").select(F.col("doc_id").alias("id"), F.col(key).alias("k"))
    repeated = broadcast_if_small(repeated)
    same = rows["doc_id"].eqNullSafe(repeated["id"]) & (rows[key] == repeated["k"])
    once = rows.join(repeated, same, "left_anti")
    return once.union(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key]))


def take_out(docs: DataFrame, lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows ``lost`` and with one of each of the rows ``repeated``.

    Both name rows by ``key`` (text_key) and doc_id. What goes is mostly the smaller part: it is
    broadcast if it is small, so no text is shuffled; else every text crosses the network once.
    """
    named = lost.select("key", "doc_id", F.lit(False).alias("one")).union(repeated.select("key", "doc_id", F.lit(True)))
    named = broadcast_if_small(named.distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, text_key().alias("key")).withColumn("id", F.col("row.doc_id"))

    def same(other: DataFrame) -> Column:
        return (rows["key"] == other["key"]) & rows["id"].eqNullSafe(other["doc_id"])

    one = named.filter("one")
    stay = rows.join(named, same(named), "left_anti")
    again = rows.join(one, same(one), "left_semi").dropDuplicates(["key", "id"])
    return stay.select("row").union(again.select("row")).select("row.*")


def anew(df: DataFrame, key: str) -> DataFrame:
    """``df`` without the knowledge that it is partitioned by the integer column ``key``.

    Spark splits the hot key of a join only where both sides come straight from a shuffle; the result
    of an aggregation by that key would not be shuffled again.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def per_text(returns: str):
    """An Arrow UDF over whole texts, called once per row.

    It is marked nondeterministic, which it isn't, so that the optimizer keeps one call where a
    filter and a projection both use the result.
    """

    def wrap(f):
        ship_package(SparkSession.active())
        return F.arrow_udf(f, returns).asNondeterministic()

    return wrap


def struct_of(names: list[str], arrays: list) -> pa.StructArray:
    return pa.StructArray.from_arrays(arrays, names=names)
