"""The three reports and their summaries: by model, by month, by day.

All of them sum with partial aggregation before the one shuffle by their key. They take messages or,
so that those are read once for all reports, ``pricing.priced_usage``, whose rows are sums already
and say of how many ``messages``. ``cost`` may be of any numeric type; whole units (nano-dollars) sum
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.schema import TOKENS


def _limbs(columns: tuple[str, ...]) -> tuple[Column, Column]:
    """The upper and the lower 32 bits of bigint columns, added up apart."""
    parts = [(F.shiftright(F.col(c), 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) for c in columns]
    return tuple(sum((p[n] for p in parts[1:]), parts[0][n]) for n in range(2))


def _joined(high: Column, low: Column) -> Column:
    """One bigint of both, held at the largest or smallest one where they don't fit."""
    upper = high + F.shiftright(low, 32)
    whole = F.shiftleft(upper, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(upper >= 1 << 31, F.lit((1 << 63) - 1)).when(upper < -(1 << 31), F.lit(-(1 << 63))).otherwise(whole)


def exact_sum(*columns: str) -> Column:
    """The sum of bigint columns over a group, held at the largest or smallest bigint instead of failing.

    Upper and lower 32 bits are summed apart, which two thousand million rows can't overflow, and joined
    once. For numbers not below 0, sums of such sums are the same in any order.
    """
    high, low = _limbs(columns)
    return _joined(F.sum(high), F.sum(low))


def all_tokens() -> Column:
    """All kinds of tokens of a row, held as by ``exact_sum``."""
    return _joined(*_limbs(TOKENS))


def n_messages(rows: DataFrame) -> Column:
    return (F.sum("messages") if "messages" in rows.columns else F.count("*")).alias("messages")


def _sums(rows: DataFrame, tokens=TOKENS) -> list[Column]:
    return [*[exact_sum(t).alias(t) for t in tokens], n_messages(rows), F.sum("cost").alias("cost")]


def by_cost() -> list[Column]:
    """Highest cost first, NaN last."""
    cost = F.col("cost").cast("double")
    return [F.isnan(cost), F.desc("cost")]


def model_report(messages: DataFrame) -> DataFrame:
    """Sums per source, provider and model, the costliest first."""
    keys = ["source", "provider_id", "model_id"]
    return messages.groupBy(*keys).agg(*_sums(messages)).orderBy(*by_cost(), *keys)


def model_totals(report: DataFrame) -> DataFrame:
    """One row over the model report; reasoning is not among its totals."""
    sums = {**{c: exact_sum(c) for c in TOKENS[:4]}, **{c: F.sum(c) for c in ("messages", "cost")}}
    return report.agg(*[x.alias(f"total_{c}") for c, x in sums.items()])


def monthly_report(messages: DataFrame) -> DataFrame:
    """Sums per month with its distinct models in order; rows without a date are left out."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    rows = messages.filter("date is not null").groupBy(month)
    return rows.agg(F.array_sort(F.collect_set("model_id")).alias("models"), *_sums(messages, TOKENS[:4])).orderBy("month")


def monthly_with_total(messages: DataFrame) -> DataFrame:
    """The months' sums and, with a null month, their total."""
    rows = messages.filter("date is not null").withColumn("month", F.date_format("date", "yyyy-MM"))
    return rows.rollup("month").agg(*_sums(messages, TOKENS[:4]))


def daily(messages: DataFrame) -> DataFrame:
    """Sums per day."""
    return messages.groupBy("date").agg(*_sums(messages))


def daily_sources(messages: DataFrame) -> DataFrame:
    """Sums per day, source and model; the provider is the first by name."""
    keys = ["date", "source", "model_id"]
    return messages.groupBy(*keys).agg(F.min("provider_id").alias("provider_id"), *_sums(messages))


def daily_contributions(messages: DataFrame, intensity: str = "at_least", order: str = "name") -> DataFrame:
    """One row per day: totals, intensity, token breakdown and the sources as an array of structs.

    The day's parts are its sources and models, so a day's array is bounded by those, not by messages.
    They are in the order of their names or, ``order`` being cost, the costliest first.
    """
    parts = daily_sources(messages)
    breakdown = F.struct(*TOKENS).alias("tokens")
    source = F.struct("source", "model_id", "provider_id", breakdown, "cost", "messages")
    days = parts.groupBy("date").agg(
        exact_sum(*TOKENS).alias("tokens"),
        F.sum("cost").alias("cost"),
        F.sum("messages").alias("messages"),
        F.struct(*[exact_sum(t).alias(t) for t in TOKENS]).alias("token_breakdown"),
        _ordered(F.collect_list(source), order).alias("sources"),
    )
    return with_intensity(days, intensity).orderBy("date")


def _ordered(parts: Column, order: str) -> Column:
    if order == "name":
        return F.array_sort(parts)
    # NaN costs come last, as everywhere.
    rank = lambda s: F.struct(F.isnan(s["cost"].cast("double")).alias("nan"), (-s["cost"]).alias("cost"), s.alias("part"))
    return F.transform(F.array_sort(F.transform(parts, rank)), lambda x: x["part"])


def sorted_by(report: DataFrame, by: str = "cost", name: str = "model_id", descending: bool = True) -> DataFrame:
    """A report by cost, by all tokens of a row or by name; equals by name."""
    tokens = F.col("tokens") if "tokens" in report.columns else all_tokens()
    key = {"cost": F.col("cost"), "tokens": tokens, "name": F.col(name)}[by]
    return report.orderBy(key.desc() if descending else key.asc(), name)


def with_intensity(days: DataFrame, rule: str = "at_least", measure: str = "cost") -> DataFrame:
    """``intensity`` 0 to 4 against the largest day.

    ``at_least``: quarters of the largest, reached; ``strict``: passed; ``ceil``: rounded up, with a
    largest of at least 1. Nothing measured is 0, anything above at least 1. The largest is a scalar
    subquery, so days aren't gathered in one task.
    """
    x = F.nanvl(F.col(measure).cast("double"), F.lit(0.0)) if rule == "ceil" else F.col(measure)
    top = days.agg(F.max(measure)).scalar()
    if rule == "ceil":
        level = F.least(F.lit(4), F.ceil(4 * x / F.greatest(top.cast("double"), F.lit(1.0))))
        return days.withColumn("intensity", F.when(x == 0, 0).otherwise(level).cast("int"))
    reach = {"at_least": lambda n: 4 * x >= n * top, "strict": lambda n: 4 * x > n * top}[rule]
    level = F.when(x <= 0, 0).when(reach(3), 4).when(reach(2), 3).when(reach(1), 2).otherwise(1)
    return days.withColumn("intensity", level.cast("int"))


def summary(days: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: totals, days, active days (cost > 0), average, largest day, sources and models."""
    sets = parts.agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("model_id")).alias("models")
    )
    active = F.count_if(F.col("cost") > 0)
    one = days.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("total_cost"),
        F.count("*").alias("total_days"),
        active.alias("active_days"),
        F.when(active > 0, F.sum("cost") / active).otherwise(0).cast("double").alias("average_per_day"),
        F.greatest(F.coalesce(F.max("cost"), F.lit(0)), F.lit(0)).alias("max_cost_in_single_day"),
    )
    return one.withColumns({c: sets.select(c).scalar() for c in ("sources", "models")})


def years(days: DataFrame) -> DataFrame:
    """Per year: totals and the first and last day with rows."""
    return (
        days.filter("date is not null")
        .groupBy(F.year("date").alias("year"))
        .agg(
            F.sum("tokens").alias("total_tokens"),
            F.sum("cost").alias("total_cost"),
            F.min("date").alias("range_start"),
            F.max("date").alias("range_end"),
        )
        .orderBy("year")
    )


def day_totals(messages: DataFrame) -> DataFrame:
    """date, tokens (all kinds), cost, messages."""
    return messages.groupBy("date").agg(
        exact_sum(*TOKENS).alias("tokens"), F.sum("cost").alias("cost"), n_messages(messages)
    )


def share_of(rows: DataFrame, measure: str = "cost", digits: int = 6) -> DataFrame:
    """``percent`` of the global sum of a measure; a sum of zero divides as one."""
    total = rows.agg(F.sum(measure)).scalar()
    percent = F.col(measure).cast("double") * 100 / F.when(total == 0, 1).otherwise(total)
    return rows.withColumn("percent", F.round(percent, digits))


def year_card(days: DataFrame, year: int) -> DataFrame:
    """One row: the largest and all cost, tokens and active days of a year, the first and last active day as MM/dd."""
    own = days.filter(F.year("date") == year)
    active = F.when(F.col("cost") > 0, F.col("date"))
    return own.agg(
        F.greatest(F.coalesce(F.max("cost"), F.lit(0)), F.lit(0)).alias("max_cost"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("total_cost"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.count(active).alias("active_days"),
        F.coalesce(F.date_format(F.min(active), "MM/dd"), F.lit("")).alias("range_start"),
        F.coalesce(F.date_format(F.max(active), "MM/dd"), F.lit("")).alias("range_end"),
    )


def filtered_summary(parts: DataFrame, sources: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """The summary over the days of some sources or models; totals are of days with a cost above 0 only."""
    own = parts
    for name, wanted in (("source", sources), ("model_id", models)):
        own = own if wanted is None else own.filter(F.col(name).isin(wanted))
    one = summary(day_totals(own).withColumn("tokens", F.when(F.col("cost") > 0, F.col("tokens")).otherwise(0)), own)
    paid = day_totals(own).agg(F.coalesce(F.sum(F.when(F.col("cost") > 0, F.col("cost"))), F.lit(0))).scalar()
    average = F.when(F.col("active_days") > 0, F.col("total_cost") / F.col("active_days")).otherwise(0).cast("double")
    return one.withColumn("total_cost", paid).withColumn("average_per_day", average)


def cost_to_you(you: Column, api: Column) -> Column:
    """What was paid, where that is stated and not 0, else what it would cost."""
    return F.coalesce(F.nullif(you, F.lit(0).cast("double")), api, F.lit(0.0))


def cursor_by_model(messages: DataFrame) -> DataFrame:
    """Sums per model of cursor's messages, the costliest first."""
    own = messages.filter("source = 'cursor'")
    return own.groupBy("model_id").agg(F.min("provider_id").alias("provider_id"), *_sums(own)).orderBy(*by_cost(), "model_id")
