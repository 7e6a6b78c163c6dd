"""Submitted JSON documents: what is wrong with their form, and the daily rows that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.operators.submissions import Submitted, submit
from meterglass.schema import SUBMITTABLE, TOKENS
from meterglass.store import Store

#: The fields of each level and what they hold.
KINDS = dict(zip(TOKENS, ("input", "output", "cacheRead", "cacheWrite", "reasoning")))
RANGE = {"start": "date", "end": "date"}
DOCUMENT = {
    "meta.generatedAt": "text",
    "meta.version": "text",
    **{f"meta.dateRange.{k}": kind for k, kind in RANGE.items()},
    "summary.totalTokens": "count",
    "summary.totalCost": "amount",
    "summary.totalDays": "count",
    "summary.activeDays": "count",
    "summary.averagePerDay": "amount",
    "summary.maxCostInSingleDay": "amount",
    "summary.sources": "sources",
    "summary.models": "texts",
    "years": "list",
    "contributions": "list",
}
YEAR = {"year": "year", "totalTokens": "count", "totalCost": "amount", **{f"range.{k}": kind for k, kind in RANGE.items()}}
DAY = {
    "date": "date",
    "totals.tokens": "count",
    "totals.cost": "amount",
    "totals.messages": "count",
    "intensity": "level",
    **{f"tokenBreakdown.{k}": "count" for k in KINDS.values()},
    "sources": "list",
}
PART = {"source": "source", "modelId": "name", "providerId": "maybe text", **{f"tokens.{k}": "count" for k in KINDS.values()}, "cost": "amount", "messages": "count"}


def _holds(v: str, path: str, kind: str) -> str:
    """SQL: whether a field of a JSON value is there and of its kind."""
    field = f"try_variant_get({v}, '$.{path}', 'variant')"
    shape, text, number = f"coalesce(schema_of_variant({field}), '')", f"try_variant_get({v}, '$.{path}', 'string')", f"try_variant_get({v}, '$.{path}', 'double')"
    numeric = f"({shape} IN ('BIGINT', 'DOUBLE') OR startswith({shape}, 'DECIMAL'))"
    names = ", ".join(f"'{s}'" for s in SUBMITTABLE)
    listed = f"coalesce(try_variant_get({v}, '$.{path}', 'array<variant>'), array())"
    each = "coalesce(schema_of_variant(x), '') = 'STRING'"
    rules = {
        "count": f"{numeric} AND {number} >= 0 AND {number} = floor({number})",
        "amount": f"{numeric} AND {number} >= 0",
        "level": f"{numeric} AND {number} IN (0, 1, 2, 3, 4)",
        "text": f"{shape} = 'STRING'",
        "maybe text": f"{shape} IN ('', 'STRING')",
        "name": f"{shape} = 'STRING' AND {text} <> ''",
        "date": f"{shape} = 'STRING' AND {text} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'",
        "year": f"{shape} = 'STRING' AND {text} RLIKE '^[0-9]{{4}}$'",
        "source": f"{shape} = 'STRING' AND {text} IN ({names})",
        "list": f"startswith({shape}, 'ARRAY')",
        "texts": f"startswith({shape}, 'ARRAY') AND forall({listed}, x -> {each})",
        "sources": f"startswith({shape}, 'ARRAY') AND forall({listed}, x -> {each} AND coalesce(try_variant_get(x, '$', 'string'), '') IN ({names}))",
    }
    return f"coalesce({rules[kind]}, false)"


def _broken(rows: DataFrame, fields: dict[str, str], before: str) -> DataFrame:
    """user_id, place of every field of ``v`` that is not as it should be; ``before`` is SQL for the place of ``v``."""
    each = ", ".join(f"CASE WHEN NOT {_holds('v', path, kind)} THEN '{path}' END" for path, kind in fields.items())
    found = rows.selectExpr("user_id", f"{before} AS before", f"explode(array_compact(array({each}))) AS field")
    return found.select("user_id", F.concat("before", "field").alias("place"))


def _items(rows: DataFrame, path: str, *also: str) -> DataFrame:
    return rows.selectExpr("user_id", *also, f"posexplode(try_variant_get(v, '$.{path}', 'array<variant>')) AS (n, v)")


def faults(documents: DataFrame) -> DataFrame:
    """user_id, place: every field of the documents (user_id, document) that is missing or of another kind than it must be.

    A document that is no JSON object has the place "$". A number is not a text of digits, nor the other way round.
    """
    rows = documents.select("user_id", F.try_parse_json("document").alias("v"))
    whole = rows.filter("coalesce(startswith(schema_of_variant(v), 'OBJECT'), false)")
    none = rows.filter("not coalesce(startswith(schema_of_variant(v), 'OBJECT'), false)").select("user_id", F.lit("$").alias("place"))
    days = _items(whole, "contributions").withColumnRenamed("n", "day")
    return (
        none.union(_broken(whole, DOCUMENT, "''"))
        .union(_broken(_items(whole, "years"), YEAR, "concat('years[', n, '].')"))
        .union(_broken(days, DAY, "concat('contributions[', day, '].')"))
        .union(_broken(_items(days, "sources", "day"), PART, "concat('contributions[', day, '].sources[', n, '].')"))
    )


def rows_of_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daily rows of documents without faults, and the sources (user_id, source) that they list."""
    rows = documents.select("user_id", F.try_parse_json("document").alias("v"))
    listed = rows.selectExpr("user_id", "explode(try_variant_get(v, '$.summary.sources', 'array<string>')) AS source").distinct()
    days = _items(rows, "contributions").selectExpr("user_id", "v", "try_variant_get(v, '$.date', 'string') AS date").drop("n")
    parts = _items(days, "sources", "date")
    kinds = {t: f"try_variant_get(v, '$.tokens.{k}', 'bigint') AS {t}" for t, k in KINDS.items()}
    held = parts.selectExpr(
        "user_id", "try_cast(date AS date) AS date", "try_variant_get(v, '$.source', 'string') AS source", "try_variant_get(v, '$.modelId', 'string') AS model_id",
        "try_variant_get(v, '$.cost', 'double') AS cost", *kinds.values(), "try_variant_get(v, '$.messages', 'bigint') AS messages",
    )
    return held.withColumn("tokens", sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))), listed


def submit_documents(store: Store, documents: DataFrame, as_of: str, batch: tuple[str, int] | None = None) -> Submitted:
    """Submit documents (user_id, document), one a user; those with a fault are refused, and their faults come with the rules' violations."""
    bad = faults(documents).select(F.col("user_id").alias("submission_id"), F.lit("V1").alias("rule"), F.lit("error").alias("severity"), F.col("place").alias("subject"))
    good = documents.join(bad.select(F.col("submission_id").alias("user_id")).distinct(), "user_id", "left_anti")
    rows, listed = rows_of_documents(good)
    done = submit(store, rows, as_of, submitted=listed, batch=batch)
    return Submitted(done.version, bad.unionByName(done.found))
