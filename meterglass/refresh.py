"""Usage sums kept file by file, so that a refresh reads the files that changed and no others.

A store holds for each session file its size and time, and what it gave: sums by day, source, provider and
model. A refresh lists the files, takes those whose size or time differ, decodes them, and replaces what
they gave before; a file that is gone takes its sums with it. Reports are made of the kept sums, which are
a few rows a file, however many messages it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.operators.pricing import priced_sums, summed_usage
from meterglass.operators.reports import exact_sum
from meterglass.schema import TOKENS
from meterglass.session import cut_lineage
from meterglass.sources import sessions
from meterglass.sources.files import PLACES, listing, roots
from meterglass.store import Store

FILES = "path string, source string, size bigint, modified bigint"
SUMS = "path string, date date, source string, provider_id string, model_id string, kinds int, " + ", ".join(f"{t} bigint" for t in TOKENS) + ", messages bigint, cost double"


def usage_store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    return Store(spark, root, {"files": FILES, "sums": SUMS}, key="path", buckets=buckets)


def one_form(path: Column) -> Column:
    """A local file's name as Spark's columns of paths have it, whichever way it came."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def current_files(spark: SparkSession, where: dict[str, str]) -> DataFrame:
    """source, path, size, modified of every session file; droid's settings have their log's size and time within."""
    found = spark.createDataFrame([], FILES).select("source", "path", "size", "modified")
    for source, root in where.items():
        rows = listing(spark, root, PLACES[source].pattern)
        if source == "droid":
            logs = listing(spark, root, "*.jsonl").withColumn("path", F.regexp_replace("path", r"\.jsonl$", ".settings.json"))
            logs = logs.select("path", F.col("size").alias("log_size"), F.col("modified").alias("log_modified"))
            rows = rows.join(logs, "path", "left").select("path", (F.col("size") + F.coalesce("log_size", F.lit(0))).alias("size"), F.greatest("modified", "log_modified").alias("modified"))
        found = found.unionByName(rows.select(F.lit(source).alias("source"), one_form(F.col("path")).alias("path"), "size", "modified"))
    return found


@dataclass(frozen=True)
class Refreshed:
    """The store's version, the files that were read, and those that are gone."""

    version: int
    read: list[str]
    gone: list[str]


def refresh(store: Store, home: str, sources: list[str] | None = None, **where) -> Refreshed:
    """Bring the store up to date with the files of the named sources (None is all) below a home folder.

    The driver knows the names of the files that changed, as Spark does of those that it reads. A file that
    changes while it is read is read again by the next refresh, as its size and time were taken before.
    """
    spark, places = store.spark, roots(home, sources, **where)
    now = cut_lineage(current_files(spark, places))
    old = store.read("files").filter(F.col("source").isin(*places))
    same = now.join(old, ["source", "path", "size", "modified"], "left_semi").select("path")
    changed = now.join(same, "path", "left_anti")
    lost = old.join(now, ["source", "path"], "left_anti").select("path")
    read, gone = changed.select("source", "path").collect(), [r["path"] for r in lost.collect()]
    if not read and not gone:
        return Refreshed(store.live()["version"], [], [])
    sums = spark.createDataFrame([], SUMS)
    for source in places:
        files = [r["path"] for r in read if r["source"] == source]
        if files:
            messages = sessions.by_file(spark, source, files)
            sums = sums.unionByName(summed_usage(messages, "path").select(sums.columns))
    sums = cut_lineage(sums.withColumn("path", one_form(F.col("path"))))
    paths = [r["path"] for r in read] + gone
    touched = spark.createDataFrame([(p,) for p in paths], "path string")

    def replaced(before: dict[str, DataFrame]) -> dict[str, DataFrame]:
        files = before["files"].join(touched, "path", "left_anti").unionByName(changed.select("path", "source", "size", "modified"))
        return {"files": files, "sums": before["sums"].join(touched, "path", "left_anti").unionByName(sums)}

    return Refreshed(store.merge(touched, replaced), [r["path"] for r in read], gone)


def kept_usage(store: Store, prices: DataFrame) -> DataFrame:
    """Priced sums of all that the store keeps, which every report takes in place of messages."""
    rows = store.read("sums").groupBy("date", "source", "provider_id", "model_id", "kinds")
    sums = rows.agg(*[exact_sum(t).alias(t) for t in TOKENS], F.sum("messages").alias("messages"), F.sum("cost").alias("cost"))
    return priced_sums(cut_lineage(sums), prices)
