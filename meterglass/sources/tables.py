"""The server's tables by SQL connection, as the community operators take them.

A database is attached as a catalog, so that filters, sums, limits and offsets of a plan become part of the
query that the database answers, as far as Spark's dialect of it goes. A large table is read in parts by ranges of a whole-number column; each part
then sums by itself, and Spark joins the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the database answers in Spark's place.
PUSHED = ("pushDownAggregate", "pushDownLimit", "pushDownOffset", "pushDownPredicate")


def attach(spark: SparkSession, name: str, url: str, **options: str) -> None:
    """Make the database of a JDBC URL the catalog ``name`` of the session; options are driver, user, password and so on."""
    key = f"spark.sql.catalog.{name}"
    spark.conf.set(key, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for option, value in {"url": url, **dict.fromkeys(PUSHED, "true"), **options}.items():
        spark.conf.set(f"{key}.{option}", value)


def server_table(spark: SparkSession, table: str, split_by: str | None = None, parts: int = 8, lists: tuple[str, ...] = ()) -> DataFrame:
    """A table (catalog.schema.name) with its columns' names in lower case.

    ``split_by`` names a whole-number column by whose ranges the table is read in ``parts``; the least and the
    largest are asked of the database first, and rows without one come with the first part. ``lists`` are
    columns of JSON texts that hold lists of texts.
    """
    reader = spark.read
    if split_by is not None:
        least, most = spark.read.table(table).agg(F.min(split_by), F.max(split_by)).first()
        if least is not None:
            reader = reader.options(partitionColumn=split_by, lowerBound=int(least), upperBound=int(most) + 1, numPartitions=max(1, min(parts, int(most) - int(least) + 1)))
    rows = reader.table(table)
    rows = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in lists})
