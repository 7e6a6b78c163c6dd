"""Metrics over messages and days: streaks, peaks, favourites, calendars, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.functions.names import PINNED_AGENTS, agent_name, source_label
from meterglass.functions.values import hour_label, span_label
from meterglass.operators.pricing import small
from meterglass.session import cut_lineage


def streaks(days: DataFrame, entity: str, max_gap: int = 1) -> DataFrame:
    """entity, first, last, length of every run of days; ``max_gap`` 2 lets single days be missing.

    Days are made distinct first; an entity's days are bounded by the calendar.
    """
    own = days.select(entity, "date").filter("date is not null").distinct()
    order = Window.partitionBy(entity).orderBy("date")
    gap = F.datediff("date", F.lag("date").over(order))
    opens = F.when(F.coalesce(gap, F.lit(max_gap + 1)) > max_gap, 1).otherwise(0)
    own = own.withColumn("opens", opens)
    own = own.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(entity, "run").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("length")
    )


def longest_streak(days: DataFrame, entity: str) -> DataFrame:
    return streaks(days, entity).groupBy(entity).agg(F.max("length").alias("longest_streak"))


def current_streak(days: DataFrame, entity: str, as_of: str, lenient: bool = False) -> DataFrame:
    """The run that ends today or yesterday, else 0; ``lenient`` lets single days be missing."""
    runs = streaks(days, entity, 2 if lenient else 1)
    alive = F.datediff(F.lit(as_of).cast("date"), F.col("last")).between(0, 1)
    return runs.groupBy(entity).agg(F.max(F.when(alive, F.col("length")).otherwise(0)).alias("current_streak"))


def peak_hour(messages: DataFrame, hour: Column) -> DataFrame:
    """The hour of day with most messages, the earliest of equals, and its label."""
    counts = messages.groupBy(hour.cast("int").alias("hour")).agg(F.count("*").alias("messages"))
    return counts.orderBy(F.desc("messages"), "hour").limit(1).withColumn("label", hour_label(F.col("hour")))


def session_spans(messages: DataFrame) -> DataFrame:
    """session_id, messages, duration_ms of sessions with an id and two messages or more."""
    own = messages.filter("session_id is not null and session_id <> ''").groupBy("session_id")
    spans = own.agg(
        F.count("*").alias("messages"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms")
    )
    return spans.filter("messages >= 2")


def longest_session(messages: DataFrame) -> DataFrame:
    longest = session_spans(messages).agg(F.coalesce(F.max("duration_ms"), F.lit(0)).alias("duration_ms"))
    return longest.withColumn("label", span_label(F.col("duration_ms")))


def favourite_model(messages: DataFrame) -> DataFrame:
    """The model of highest cost above 0, ties by name; N/A if there is none."""
    costs = messages.groupBy("model_id").agg(F.sum("cost").alias("cost")).filter("cost > 0")
    best = F.min(F.struct((-F.col("cost")).alias("c"), "model_id"))
    return costs.agg(F.coalesce(best["model_id"], F.lit("N/A")).alias("favourite_model"))


def top_by_cost(messages: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` keys of highest cost with their tokens (without reasoning), ties by key."""
    tokens = F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens")
    sums = messages.groupBy(key).agg(F.sum("cost").alias("cost"), tokens)
    return sums.orderBy(F.desc("cost"), key).limit(n)


def top_clients(messages: DataFrame, n: int = 3) -> DataFrame:
    return top_by_cost(messages.withColumn("client", source_label(F.col("source"))), "client", n)


def agents(messages: DataFrame, prices: DataFrame) -> DataFrame:
    """agent, cost, tokens, messages of opencode's agents.

    A model's price counts only under its very name, and reasoning is not paid here.
    """
    own = messages.filter("source = 'opencode' and agent is not null and agent <> ''")
    own = own.join(prices.withColumnRenamed("model_key", "model_id"), "model_id", "left")
    price = lambda kind: F.coalesce(f"price_{kind}", F.lit(0))
    cost = sum((F.col(k) * price(k) for k in ("output", "cache_read", "cache_write")), F.col("input") * price("input"))
    tokens = sum((F.col(k) for k in ("output", "cache_read", "cache_write", "reasoning")), F.col("input"))
    own = own.select(agent_name(F.col("agent")).alias("agent"), cost.alias("c"), tokens.alias("t"))
    return own.groupBy("agent").agg(F.sum("c").alias("cost"), F.sum("t").alias("tokens"), F.count("*").alias("messages"))


def top_agents(stats: DataFrame, pin: bool = True) -> DataFrame:
    """Pinned agents in their order, then the two others with most messages; or plainly the top three."""
    if not pin:
        return stats.orderBy(F.desc("messages"), "agent").limit(3)
    place = F.when(F.col("agent") == PINNED_AGENTS[0], 0).when(F.col("agent") == PINNED_AGENTS[1], 1)
    pinned = stats.filter(F.col("agent").isin(*PINNED_AGENTS)).withColumn("place", place)
    others = stats.filter(~F.col("agent").isin(*PINNED_AGENTS)).orderBy(F.desc("messages"), "agent").limit(2)
    both = pinned.unionByName(others.withColumn("place", F.lit(len(PINNED_AGENTS))))
    return both.orderBy("place", F.desc("messages"), "agent").drop("place")


def with_week(days: DataFrame, first: str) -> DataFrame:
    """``days`` with weekday (0 is Sunday) and week, counted from the Sunday on or before ``first``."""
    start = F.date_sub(F.lit(first).cast("date"), F.dayofweek(F.lit(first).cast("date")) - 1)
    week = F.floor(F.datediff("date", start) / 7).cast("int")
    return days.withColumns({"weekday": F.dayofweek("date") - 1, "week": week})


def calendar(spark, first: str, last: str) -> DataFrame:
    """A row per day from first to last with its weekday and week."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")
    return with_week(spark.range(1).select(day), first)


def calendar_grid(days: DataFrame, first: str, last: str) -> DataFrame:
    """The calendar with each day's cost and intensity, 0 where a day has no row."""
    grid = calendar(days.sparkSession, first, last)
    filled = grid.join(days.select("date", "cost", "intensity"), "date", "left")
    return filled.fillna({"intensity": 0}).withColumn("cost", F.coalesce("cost", F.lit(0)))


def month_labels(grid: DataFrame) -> DataFrame:
    """week, label: where the month of a week's first day differs from that of the week before."""
    weeks = grid.groupBy("week").agg(F.min("date").alias("date"))
    month = F.month("date")
    before = F.lag(month).over(Window.orderBy("week"))
    changed = weeks.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != month))
    return changed.select("week", F.date_format("date", "MMM").alias("label"))


def chart_points(messages: DataFrame) -> DataFrame:
    """Tokens (input, output and cache read only) per day and model, with the day's total."""
    tokens = F.sum(F.col("input") + F.col("output") + F.col("cache_read")).alias("tokens")
    points = messages.groupBy("date", "model_id").agg(tokens)
    return points.withColumn("day_tokens", F.sum("tokens").over(Window.partitionBy("date")))


def stacked(points: DataFrame) -> DataFrame:
    """Where each model's bar starts and ends when a day's models are stacked by name."""
    order = Window.partitionBy("date").orderBy("model_id").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("tokens").over(order)
    return points.withColumns({"bar_end": top, "bar_start": top - F.col("tokens")})


def band_model(bars: DataFrame, rows: int) -> DataFrame:
    """For each of ``rows`` equal bands up to the highest day: the model that fills most of it.

    A band that no bar reaches has no row; ties go to the first model by name.
    """
    top = bars.agg(F.max("bar_end")).scalar()
    band = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    cells = bars.withColumn("band", band)
    low, high = F.col("band") * top / rows, (F.col("band") + 1) * top / rows
    overlap = F.least("bar_end", high) - F.greatest("bar_start", low)
    cells = cells.withColumn("overlap", overlap).filter("overlap > 0")
    best = F.min(F.struct((-F.col("overlap")).alias("o"), "model_id"))
    return cells.groupBy("date", "band").agg(best["model_id"].alias("model_id"))


#: Values of a group that are put in order at once; bits of a value that one pass decides.
FEW, DIGIT = 4096, 11


def ordered_bits(x: Column) -> Column:
    """A double as a bigint of the same order: its bits, those of a negative one turned round; NaN is the largest."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def of_ordered_bits(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_quantile(rows: DataFrame, key: str, value: str, share: float = 0.5, name: str = "median", few: int = FEW) -> DataFrame:
    """``key`` and the value that ``share`` of a group's values lie below, between the two next to it; nulls don't count.

    The place is found digit by digit: a pass counts, for each group, the values that share the digits
    found so far by their next DIGIT bits, and keeps the digit that the place falls into. Counts are
    partial before the shuffle and at most two thousand a group, whatever its size. Once no more than
    ``few`` values are left around each place, those are put in order.
    """
    own = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("g"), ordered_bits(F.col(value)).alias("v"))
    at = (F.col("n") - 1) * F.lit(float(share))
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    wanted = own.groupBy("g").agg(F.count("*").alias("n")).withColumn("part", at - F.floor(at)).withColumn("rank", F.explode(ranks))
    # What is left: the values whose bits above ``shift`` are ``head``; ``skip`` of the group's lie below them.
    wanted = cut_lineage(wanted.select("g", "rank", "part", F.lit(0).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("skip"), F.col("n").alias("left")))
    shift = 64
    while shift > 0 and wanted.filter(F.col("left") > few).limit(1).count():
        lower = max(0, shift - DIGIT)
        met = _among(own, wanted.select("g", "rank", "head", "skip", "part"), shift)
        bins = met.groupBy("g", "rank", "part", "skip", F.shiftright("v", lower).alias("head")).agg(F.count("*").alias("left"))
        order = Window.partitionBy("g", "rank").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("skip", F.col("skip") + F.coalesce(F.sum("left").over(order), F.lit(0)))
        inside = (F.col("skip") <= F.col("rank")) & (F.col("rank") < F.col("skip") + F.col("left"))
        wanted = cut_lineage(bins.filter(inside).select("g", "rank", "part", "head", "skip", "left"))
        shift = lower
    if shift == 0:
        found = wanted.select("g", "rank", "part", F.col("head").alias("v"))
    else:
        rest = _among(own, wanted.select("g", "rank", "part", "head", "skip"), shift).groupBy("g", "rank", "part", "skip")
        rest = rest.agg(F.array_sort(F.collect_list("v")).alias("vs"))
        found = rest.select("g", "rank", "part", F.get("vs", (F.col("rank") - F.col("skip")).cast("int")).alias("v"))
    ends = found.groupBy("g").agg(F.min_by("v", "rank").alias("lo"), F.max_by("v", "rank").alias("hi"), F.max("part").alias("part"))
    lo, hi = of_ordered_bits(F.col("lo")), of_ordered_bits(F.col("hi"))
    between = F.when(F.col("lo") == F.col("hi"), lo).otherwise(lo * (1 - F.col("part")) + hi * F.col("part"))
    return ends.select(F.col("g").alias(key), between.alias(name))


def _among(own: DataFrame, wanted: DataFrame, shift: int) -> DataFrame:
    """The values that a group still has to look at: those that share the bits above ``shift``."""
    other = small(wanted.withColumnRenamed("g", "h"))
    met = F.col("g").eqNullSafe(F.col("h"))
    if shift < 64:
        met = met & (F.shiftright("v", shift) == F.col("head"))
    return own.join(other, met).drop("h", "head")


def bench_stats(runs: DataFrame, key: str, value: str) -> DataFrame:
    """min, max, median (the mean of the middle two), mean and population deviation per key."""
    sums = runs.groupBy(key).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"))
    middle = exact_quantile(runs, key, value).withColumnRenamed(key, "of")
    rows = sums.join(middle, F.col(key).eqNullSafe(F.col("of")), "left").drop("of")
    return rows.select(key, "min", "max", "median", "mean", "std_dev")


def best_day(days: DataFrame) -> DataFrame:
    """The day of highest cost, the first of equals."""
    best = F.min(F.struct((-F.col("cost")).alias("c"), "date"))
    return days.agg(best["date"].alias("date"), F.max("cost").alias("cost"))


def day_panel(parts: DataFrame) -> DataFrame:
    """Per day and source: cost, distinct models and the models' names by tokens (without reasoning), most first."""
    tokens = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    ordered = F.array_sort(F.collect_list(F.struct((-tokens).alias("t"), "model_id")))
    return parts.groupBy("date", "source").agg(
        F.sum("cost").alias("cost"),
        F.count_distinct("model_id").alias("n_models"),
        F.transform(ordered, lambda x: x["model_id"]).alias("models"),
    )
