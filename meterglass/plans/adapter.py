"""The usage relations over the driver's tables, so that the operators run where no session files are.

Costs are whole nano-dollars, which sum exactly in any order. Each function has its SQL twin in
``SQL``, which the queries' own SQL is built on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.functions.names import SHORT_NAMES
from meterglass.functions.values import millis_of_wall_time
from meterglass.operators.pricing import HELD, HOLDS, PREFIXES
from meterglass.schema import SOURCES, TOKENS

#: Model names as tools write them; some are short, one is unknown to the price list.
MODELS = (
    "claude-3-5-sonnet-20241022",
    "gpt-4o",
    "gemini-2.5-pro",
    "claude-4.5-opus-high-thinking",
    "o3",
    "Sonnet 4.5",
    "gpt-5-codex",
    "mystery-model",
)
#: model_key and nano-dollars per token: input, output, cache read, cache write.
PRICES = (
    ("anthropic/claude-3-5-sonnet-20241022", 3000, 15000, 300, 3750),
    ("openai/gpt-4o", 2500, 10000, 1250, 0),
    ("gemini-2.5-pro", 1250, 10000, 310, 0),
    ("claude-opus-4-5", 5000, 25000, 500, 6250),
    ("claude-sonnet-4-5", 3000, 15000, 300, 3750),
    ("o3", 2000, 8000, 500, 0),
    ("azure/gpt-5", 1250, 10000, 125, 0),
    ("gpt-5", 1250, 10000, 125, 0),
)
AGENTS = ("OmO", "omo-plan", "explore", "Planner-Sisyphus", "build", "sisyphus", "plan-b")
AS_OF = "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRICE_KINDS = "price_input", "price_output", "price_cache_read", "price_cache_write"


def prices(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{k}', {', '.join(f'{x}L' for x in numbers)})" for k, *numbers in PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model_key, {', '.join(PRICE_KINDS)})")


#: Models and price keys made of the names of parts, so that every tier is met: some keys stand for themselves, some
#: behind a prefix, some hold a name or are held by one between or inside words.
PART_MODELS = """SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'x/' || replace(p_name, ' ', '_') || '-v2'
  WHEN 2 THEN split_part(p_name, ' ', 2) || p_partkey % 3 ELSE upper(replace(p_name, ' ', '.')) END AS model_id FROM part
  UNION SELECT DISTINCT split_part(p_name, ' ', 1) || '-claude-' || CASE p_size % 3 WHEN 0 THEN 'opus-4.5' WHEN 1 THEN 'sonnet-3-7' ELSE 'haiku-4-5' END FROM part"""
PART_KEYS = """SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'openai/' || replace(p_name, ' ', '-')
  WHEN 2 THEN 'azure/' || replace(p_name, ' ', '-') || '-large' WHEN 3 THEN split_part(p_name, ' ', 2) ELSE 'y' || split_part(p_name, ' ', 2) || '/' || replace(p_name, ' ', '_') END AS model_key
  FROM part UNION SELECT DISTINCT 'anthropic/' || CASE p_size % 2 WHEN 0 THEN 'opus-4-5' ELSE 'claude-sonnet-3-7' END FROM part"""


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from the table events, without costs."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    user, k = F.col("user_id"), F.col("k")
    source = _pick(SOURCES, user)
    return events.select(
        source.alias("source"),
        _pick(MODELS, k).alias("model_id"),
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider_id"),
        user.cast("string").alias("session_id"),
        millis_of_wall_time("ts").alias("timestamp_ms"),
        F.col("ts").cast("date").alias("date"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output"),
        (k * 50).alias("cache_read"),
        F.when(k % 5 == 0, k * 7).otherwise(0).cast("bigint").alias("cache_write"),
        F.when(F.col("event_type") == "error", k).otherwise(0).cast("bigint").alias("reasoning"),
        (k * 1000).alias("cost"),
        F.when(source == "opencode", _pick(AGENTS, k)).alias("agent"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def resolver_sql(models: str, keys: str) -> str:
    """The price list's answers as a common table expression: every name is tried against every key."""
    lower = "lower(model_id)"
    short = " ".join(
        f"WHEN regexp_matches({lower}, '{family.removesuffix('.*')}')" + (f" AND regexp_matches({lower}, '{version}')" if version else "") + f" THEN '{name}'"
        for family, version, name in SHORT_NAMES
    )
    prefixes = ", ".join(f"({n}, '{p}')" for n, p in enumerate(PREFIXES))

    def holds(hay: str, needle: str) -> str:
        at, edge = f"instr({hay}, {needle})", r"'^[\pL\pN]$'"
        before = f"({at} = 1 OR NOT regexp_matches(substr({hay}, {at} - 1, 1), {edge}))"
        return f"{at} > 0 AND {before} AND NOT regexp_matches(substr({hay}, {at} + length({needle}), 1), {edge})"

    return f"""resolved AS (SELECT model_id, best.tier AS tier, best.model_key AS model_key FROM (
  SELECT model_id, min(struct_pack(tier, model_key)) AS best FROM (
    WITH n AS (SELECT model_id, CASE {short} END AS short FROM ({models})), k AS (SELECT DISTINCT model_key FROM ({keys})),
    form AS (SELECT model_id, lower(model_id) AS f FROM n UNION SELECT model_id, lower(short) FROM n WHERE short IS NOT NULL)
    SELECT model_id, p.i AS tier, model_key FROM n, (VALUES {prefixes}) p(i, prefix), k WHERE model_key = prefix || model_id
    UNION ALL SELECT model_id, {len(PREFIXES)} + p.i, model_key FROM n, (VALUES {prefixes}) p(i, prefix), k WHERE model_key = prefix || short
    UNION ALL SELECT model_id, {HOLDS}, model_key FROM form, k WHERE {holds("lower(model_key)", "f")}
    UNION ALL SELECT model_id, {HELD}, model_key FROM form, k WHERE {holds("f", "lower(model_key)")}) GROUP BY model_id))"""


#: Common table expressions; a query's SQL starts with those that it names.
SQL = {
    "usage": f"""usage AS (
  SELECT s.*, CASE WHEN source = 'opencode' THEN {_sql_list(AGENTS)}[k % {len(AGENTS)} + 1] END AS agent FROM (
    SELECT {_sql_list(SOURCES)}[user_id % 7 + 1] AS source, {_sql_list(MODELS)}[k % 8 + 1] AS model_id,
      'p' || (k % 3) AS provider_id, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS timestamp_ms,
      CAST(ts AS DATE) AS date, CAST(floor(value * 100) AS BIGINT) AS input, CAST(floor(value * 10) AS BIGINT) AS output,
      k * 50 AS cache_read, CASE WHEN k % 5 = 0 THEN k * 7 ELSE 0 END AS cache_write,
      CASE WHEN event_type = 'error' THEN k ELSE 0 END AS reasoning, k * 1000 AS own_cost, user_id, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) s)""",
    "prices": "prices(model_key, p_in, p_out, p_read, p_write) AS (VALUES "
    + ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, a, b, c, d in PRICES)
    + ")",
    "resolved": resolver_sql("SELECT DISTINCT model_id FROM usage", "SELECT model_key FROM prices"),
    "costed": """costed AS (
  SELECT u.* EXCLUDE (own_cost), CASE WHEN source IN ('cursor', 'amp') AND listed <= 0 THEN own_cost ELSE listed END AS cost
  FROM (SELECT u.*, coalesce(input * p_in + (output + reasoning) * p_out
      + CASE WHEN source = 'gemini' THEN 0 ELSE cache_read * p_read + cache_write * p_write END, 0) AS listed
    FROM usage u LEFT JOIN resolved USING (model_id) LEFT JOIN prices USING (model_key)) u)""",
    "day_totals": """day_totals AS (
  SELECT date, CAST(sum(input + output + cache_read + cache_write + reasoning) AS BIGINT) AS tokens,
    CAST(sum(cost) AS BIGINT) AS cost, count(*) AS messages FROM costed GROUP BY date)""",
}
COSTED = ("usage", "prices", "resolved", "costed")


def with_sql(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body


def sql_sums(*names: str, prefix: str = "") -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {prefix}{n}" for n in names or TOKENS)
