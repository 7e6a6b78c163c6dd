"""Prices: matching model names to the price list, and costs.

The list's keys are matched in tiers, the best of which wins: the name itself, the name behind a
provider prefix, the same for the short name, then keys that hold the name between word boundaries,
then keys that the name holds. Each tier is an equi-join: exact tiers on the candidate strings, the
others on the first word of what is held, which must be a word of what holds it. So the work grows
with distinct models and keys, not with their product, and messages meet one row per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.functions.names import short_name
from meterglass.operators.reports import exact_sum
from meterglass.schema import PRICE_COLUMNS, TOKENS
from meterglass.session import cut_lineage

#: The prefixes that are tried before a name.
PREFIXES = ("", "anthropic/", "openai/", "google/", "bedrock/")
HOLDS, HELD = 10, 11
#: Resolved models up to so many are broadcast to the messages.
BROADCAST_MODELS = 10_000
BREAK = r"[^\p{IsAlphabetic}\p{N}]+"


def holds(hay: Column, needle: Column) -> Column:
    """Whether the first place of ``needle`` in ``hay`` has no letter or digit on either side."""
    at = F.call_function("instr", hay, needle)
    edge = F.concat(
        F.when(at > 1, F.substring(hay, at - 1, F.lit(1))).otherwise(""),
        F.substring(hay, at + F.length(needle), F.lit(1)),
    )
    return (at > 0) & ~edge.rlike(r"[\p{IsAlphabetic}\p{N}]")


def _first_word(text: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(text, BREAK), lambda w: w != ""), F.lit(0)), F.lit(""))


def _words(text: Column) -> Column:
    """The distinct words, and the empty one for needles without words."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(text, BREAK)))


def resolve_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """model_id, tier, model_key for each distinct ``model_id`` that the price list answers.

    A null name has no price. Ties within a tier go to the key that is first by bytes.
    """
    return _answers(models, prices.select("model_key"), ())


def _answers(models: DataFrame, prices: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``resolve_models`` with ``columns`` of the list; of rows that repeat a key the least by those counts."""
    names = small(models.select("model_id").filter("model_id is not null").distinct())
    names = names.withColumn("short", short_name(F.col("model_id")))
    keys = prices.select("model_key", F.struct(*columns).alias("own") if columns else F.lit(None).alias("own"))
    exact = [(n, F.concat(F.lit(p), F.col("model_id"))) for n, p in enumerate(PREFIXES)]
    exact += [(n + len(PREFIXES), F.concat(F.lit(p), F.col("short"))) for n, p in enumerate(PREFIXES)]
    tried = F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), c.alias("key")) for n, c in exact]))
    by_string = names.select("model_id", tried.alias("t")).filter("t.key is not null")
    found = by_string.join(keys, F.col("t.key") == F.col("model_key")).select("model_id", "t.tier", "model_key", "own")

    forms = names.select("model_id", F.explode(F.array_compact(F.array(F.lower("model_id"), F.lower("short")))).alias("form"))
    lower = keys.select("model_key", "own", F.lower("model_key").alias("key"))
    holding = (
        forms.withColumn("word", _first_word(F.col("form")))
        .join(lower.withColumn("word", F.explode(_words(F.col("key")))), "word")
        .filter(holds(F.col("key"), F.col("form")))
        .select("model_id", F.lit(HOLDS).alias("tier"), "model_key", "own")
    )
    held = (
        lower.withColumn("word", _first_word(F.col("key")))
        .join(forms.withColumn("word", F.explode(_words(F.col("form")))), "word")
        .filter(holds(F.col("form"), F.col("key")))
        .select("model_id", F.lit(HELD).alias("tier"), "model_key", "own")
    )
    best = found.union(holding).union(held).groupBy("model_id").agg(F.min(F.struct("tier", "model_key", "own")).alias("b"))
    return best.select("model_id", "b.tier", "b.model_key", *[F.col(f"b.own.{c}").alias(c) for c in columns])


def cost_of(*prices: Column) -> Column:
    """Tokens times prices (input, output, cache read, cache write); reasoning is paid as output."""
    per_input, per_output, per_read, per_write = (F.coalesce(p, F.lit(0)) for p in prices)
    return (
        F.col("input") * per_input
        + F.col("output") * per_output
        + F.col("reasoning") * per_output
        + F.col("cache_read") * per_read
        + F.col("cache_write") * per_write
    )


def small(table: DataFrame, limit: int = BROADCAST_MODELS) -> DataFrame:
    """``table`` to be broadcast if it has at most ``limit`` rows, else as it is.

    Up to ``limit`` rows are fetched, so the plan that made them isn't run again and the messages are
    not shuffled; a longer table is joined by shuffle.
    """
    rows = table.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


#: Sources that keep the cost that they state where the price list gives none.
STATING = ("cursor", "amp")
#: What a price may be paid for, in the order of PRICE_COLUMNS.
PAID = ("input > 0", "output > 0 or reasoning > 0", "cache_read > 0", "cache_write > 0")


def _prices_of(rows: DataFrame, prices: DataFrame) -> DataFrame:
    table = _answers(rows, prices, PRICE_COLUMNS).select("model_id", *PRICE_COLUMNS)
    return rows.join(small(table), "model_id", "left")


def _listed() -> Column:
    """The cost by the price list; gemini's cache is free."""
    free = F.col("source") == "gemini"
    read, write = (F.when(free, 0).otherwise(F.col(c)) for c in PRICE_COLUMNS[2:])
    return cost_of(F.col(PRICE_COLUMNS[0]), F.col(PRICE_COLUMNS[1]), read, write)


def with_cost(messages: DataFrame, prices: DataFrame) -> DataFrame:
    """``messages`` with ``cost`` by each source's rule; models without a price cost 0.

    gemini's cache is free; cursor and amp keep the cost that they state where the price list gives
    none; the others' own costs are replaced. Messages are read once more for their models' names:
    reports take ``priced_usage``, which reads them once.
    """
    listed = _listed()
    own = F.when(F.col("source").isin(*STATING) & ~(listed > 0), F.coalesce("cost", F.lit(0)))
    return _prices_of(messages, prices).withColumn("cost", F.coalesce(own, listed)).select(*messages.columns)


def usage_sums(messages: DataFrame) -> DataFrame:
    """``summed_usage`` written out."""
    return cut_lineage(summed_usage(messages))


def summed_usage(messages: DataFrame, *also: str) -> DataFrame:
    """Sums per date, source, provider and model, with their number of messages, and per further columns.

    It is the one read of the messages that all reports need, and grows with days and models only.
    ``kinds`` are bits of what is above 0 in a message of a source that states costs, as those
    decide message by message which cost counts.
    """
    bits = sum((F.when(F.expr(paid), 1 << n).otherwise(0) for n, paid in enumerate(PAID)), F.lit(0))
    kinds = F.when(F.col("source").isin(*STATING), bits).otherwise(0).alias("kinds")
    sums = messages.groupBy(*also, "date", "source", "provider_id", "model_id", kinds).agg(
        *[exact_sum(t).alias(t) for t in TOKENS], F.count("*").alias("messages"), F.sum(F.coalesce("cost", F.lit(0))).alias("cost")
    )
    return sums


def priced_sums(sums: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage_sums`` with ``cost`` as ``with_cost`` has it: a cost is linear in the tokens of a model.

    Numbers of tokens and prices are not below 0.
    """
    charged = F.lit(False)
    for n, price in enumerate(PRICE_COLUMNS):
        charged = charged | ((F.col("kinds").bitwiseAND(F.lit(1 << n)) != 0) & F.coalesce(F.col(price) > 0, F.lit(False)))
    own = F.when(F.col("source").isin(*STATING) & ~charged, F.col("cost"))
    rows = _prices_of(sums, prices).withColumn("cost", F.coalesce(own, _listed()))
    return rows.select("date", "source", "provider_id", "model_id", *TOKENS, "messages", "cost")


def priced_usage(messages: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced sums of all messages, which every report takes in their place."""
    return priced_sums(usage_sums(messages), prices)
