"""The price list from its JSON file: one object, a record of prices per model key."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    "price_input": "input_cost_per_token",
    "price_output": "output_cost_per_token",
    "price_cache_read": "cache_read_input_token_cost",
    "price_cache_write": "cache_creation_input_token_cost",
}


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """model_key and prices per token; fields that are no numbers count as missing."""
    text = spark.read.text(path, wholetext=True)
    table = F.from_json("value", "map<string, string>")
    rows = text.select(F.explode(table).alias("model_key", "json")).withColumn("v", F.try_parse_json("json"))
    return rows.select("model_key", *[F.try_variant_get("v", f"$.{f}", "double").alias(c) for c, f in FIELDS.items()])


def is_fresh(modified_ms: int, now_ms: int | None = None, ttl_s: int = 3600) -> bool:
    """Whether a cached price list is younger than its time to live."""
    return (now_ms if now_ms is not None else time.time() * 1000) - modified_ms < ttl_s * 1000
