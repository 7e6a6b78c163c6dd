"""Submitted daily data: validation, merging by source, leaderboard and profiles.

Submissions are held as rows of (user_id, date, source, model_id) rather than as maps of maps: a
merge is then an anti-join and a union, and every sum has map-side aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.functions.values import djb2
from meterglass.operators.reports import exact_sum, with_intensity
from meterglass.schema import SUBMITTABLE, TOKENS


def clean_model(model: Column) -> Column:
    """A submitted model's name: trimmed, ``unknown`` if there is none."""
    return F.coalesce(F.nullif(F.trim(model), F.lit("")), F.lit("unknown"))


def merge_sources(existing: DataFrame, incoming: DataFrame, submitted: DataFrame) -> DataFrame:
    """The daily rows after a submission.

    All have user_id and source, the first two date as well. On the days of the payload, rows of
    submitted sources are replaced, or deleted if the payload has none; sources that were not
    submitted and other days stay. A source that the payload has but didn't list counts only on days
    that had no rows.
    """
    listed = submitted.select("user_id", "source").distinct()
    days = incoming.select("user_id", "date").distinct()
    replaced = days.join(listed, "user_id")
    kept = existing.join(replaced, ["user_id", "date", "source"], "left_anti")
    known_days = existing.select("user_id", "date").distinct()
    wanted = incoming.join(listed, ["user_id", "source"], "left_semi")
    unlisted = incoming.join(listed, ["user_id", "source"], "left_anti").join(known_days, ["user_id", "date"], "left_anti")
    return kept.unionByName(wanted).unionByName(unlisted)


def day_rows(rows: DataFrame) -> DataFrame:
    """Per user and day: tokens, cost, input, output."""
    return rows.groupBy("user_id", "date").agg(
        *[F.sum(c).alias(c) for c in ("tokens", "cost", "input", "output")], F.sum("messages").alias("messages")
    )


#: The numbers of a source's or model's entry in a stored map.
NUMBERS = ("tokens", "cost", "input", "output", "cache_read", "cache_write", "reasoning", "messages")


def source_map(rows: DataFrame) -> DataFrame:
    """Per user and day a map from source to its sums and the map of its models' sums.

    A day has few sources and models, so each map is small whatever the number of messages.
    """
    numbers = [n for n in NUMBERS if n in rows.columns]
    models = rows.groupBy("user_id", "date", "source", "model_id").agg(*[F.sum(n).alias(n) for n in numbers])
    sources = models.groupBy("user_id", "date", "source").agg(
        F.struct(
            *[F.sum(n).alias(n) for n in numbers],
            F.map_from_entries(F.collect_list(F.struct("model_id", F.struct(*numbers).alias("v")))).alias("models"),
        ).alias("data")
    )
    return sources.groupBy("user_id", "date").agg(F.map_from_entries(F.collect_list(F.struct("source", "data"))).alias("source_breakdown"))


def sources_of_maps(days: DataFrame, column: str = "source_breakdown") -> DataFrame:
    """The rows of ``days`` once per source of their map: its numbers, 0 where one is missing, models and model_id.

    ``model_id`` is what older entries have in place of a map of models. A null or empty map gives no rows.
    """
    rows = days.select(*[c for c in days.columns if c != column], F.explode(column).alias("source", "entry"))
    held = rows.schema["entry"].dataType.names
    number = lambda n: F.coalesce(F.col(f"entry.{n}"), F.lit(0)).alias(n)
    own = [number(n) for n in NUMBERS if n in held]
    legacy = F.col("entry.model_id") if "model_id" in held else F.lit(None).cast("string")
    return rows.select(*[F.col(c) for c in rows.columns if c not in ("entry", *NUMBERS)], *own, F.col("entry.models").alias("models"), legacy.alias("model_id"))


def models_of_maps(days: DataFrame, column: str = "source_breakdown") -> DataFrame:
    """The rows of ``days`` once per source and model of their map: source, model_id and the numbers.

    An entry without a map of models stands for its own ``model_id``, and for none without one.
    """
    rows = sources_of_maps(days, column)
    numbers = [n for n in NUMBERS if n in rows.columns]
    keys = [c for c in rows.columns if c not in (*numbers, "models", "model_id")]
    given = rows.filter("models is not null").select(*keys, F.explode("models").alias("model_id", "v"))
    given = given.select(*keys, "model_id", *[F.coalesce(F.col(f"v.{n}"), F.lit(0)).alias(n) for n in numbers])
    old = rows.filter("models is null and model_id is not null and model_id <> ''")
    return given.unionByName(old.select(*keys, "model_id", *numbers))


def totals_of_map(entries: Column, number: str) -> Column:
    """The sum of a number over a map's sources; a missing one is 0."""
    each = F.transform(F.map_values(entries), lambda s: F.coalesce(s[number].cast("decimal(38,9)"), F.lit(0).cast("decimal(38,9)")))
    return F.aggregate(each, F.lit(0).cast("decimal(38,9)"), lambda total, x: (total + x).cast("decimal(38,9)"))


def day_totals_of_maps(days: DataFrame, column: str = "source_breakdown") -> DataFrame:
    """``days`` with the sums over their map's sources, row by row; a null map has sums of 0."""
    held = days.schema[column].dataType.valueType
    sums = {n: F.coalesce(totals_of_map(F.col(column), n), F.lit(0)).cast(held[n].dataType) for n in NUMBERS if n in held.names}
    return days.withColumns(sums)


def model_tokens_of_maps(days: DataFrame, column: str = "source_breakdown", key: tuple[str, ...] = ("user_id", "date")) -> DataFrame:
    """Tokens of each model over all sources of a day's map."""
    rows = models_of_maps(days.select(*key, column), column)
    return rows.groupBy(*key, "model_id").agg(F.sum("tokens").alias("tokens"))


def used_in_maps(days: DataFrame, column: str = "source_breakdown") -> DataFrame:
    """Per user: the distinct sources and models of all maps, in order, and the sums of their numbers."""
    sources = sources_of_maps(days.select("user_id", column), column)
    sums = sources.groupBy("user_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources_used"), *[F.sum(n).alias(n) for n in NUMBERS if n in sources.columns]
    )
    models = models_of_maps(days.select("user_id", column), column)
    return sums.join(models.groupBy("user_id").agg(F.array_sort(F.collect_set("model_id")).alias("models_used")), "user_id", "left")


def profile_days(days: DataFrame, column: str = "source_breakdown") -> DataFrame:
    """Per date over the rows of ``days``: their own sums, and their maps merged source by source and model by model.

    ``sources`` maps a source to its sums and the map of its models' sums, ``models`` a model to its
    tokens and cost over all sources.
    """
    numbers = [n for n in NUMBERS if n in days.schema[column].dataType.valueType.names]
    own = days.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("tokens", "cost", "input", "output")])
    rows = sources_of_maps(days.select("date", column), column)
    parts = models_of_maps(days.select("date", column), column)
    sums = [F.sum(n).alias(n) for n in numbers]
    merged = parts.groupBy("date", "source", "model_id").agg(*sums)
    inside = merged.groupBy("date", "source").agg(F.map_from_entries(F.collect_list(F.struct("model_id", F.struct(*numbers)))).alias("models"))
    sources = rows.groupBy("date", "source").agg(*sums).join(inside, ["date", "source"], "left")
    sources = sources.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct(*numbers, "models")))).alias("sources"))
    models = merged.groupBy("date", "model_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    models = models.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("model_id", F.struct("tokens", "cost")))).alias("models"))
    return own.join(sources, "date", "left").join(models, "date", "left").orderBy("date")


def model_breakdown(rows: DataFrame) -> DataFrame:
    """user_id, date, model_id, tokens: a day's models over all its sources."""
    model = clean_model(F.col("model_id")).alias("model_id")
    return rows.groupBy("user_id", "date", model).agg(F.sum("tokens").alias("tokens"))


def submission_totals(rows: DataFrame) -> DataFrame:
    """What a submission's own row is recalculated to from its days."""
    days = rows.groupBy("user_id", "date").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return days.groupBy("user_id").agg(
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.count_if(F.col("tokens") > 0).alias("active_days"),
        F.count("*").alias("row_count"),
    )


def used(rows: DataFrame) -> DataFrame:
    """Per user: the distinct sources and models in order."""
    return rows.groupBy("user_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources_used"),
        F.array_sort(F.collect_set("model_id")).alias("models_used"),
    )


def submission_hash(submissions: DataFrame) -> DataFrame:
    """``submission_hash`` of (sources, start, end, days), by which equal submissions are known."""
    dates = F.array_sort("days")
    quoted = F.array_join(F.transform(F.array_sort("sources"), lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ",")
    text = F.concat(
        F.lit('{"sources":['), quoted, F.lit('],"dateRange":{"start":"'), F.col("start").cast("string"),
        F.lit('","end":"'), F.col("end").cast("string"), F.lit('"},"daysCount":'), F.size("days").cast("string"),
        F.lit(',"firstDay":"'), F.element_at(dates, 1).cast("string"), F.lit('","lastDay":"'),
        F.element_at(dates, -1).cast("string"), F.lit('"}'),
    )
    return submissions.withColumn("submission_hash", djb2(text))


def user_totals(submissions: DataFrame, users: DataFrame) -> DataFrame:
    """Per user of any submission: tokens, cost (four decimals), submissions, the last one's time."""
    sums = submissions.groupBy("user_id").agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum(F.col("total_cost").cast("decimal(12,4)")).alias("total_cost"),
        F.coalesce(F.sum("submit_count"), F.lit(0)).alias("submission_count"),
        F.max("created_at").alias("last_submission"),
    )
    return users.join(sums, "user_id")


#: Users fall into buckets by the logarithm of their tokens, a few thousand whatever their number.
def _bucket(total: str) -> Column:
    return F.floor(F.log2(F.greatest(total, F.lit(1)).cast("double")) * 256).cast("int")


def _before(window) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def leaderboard(submissions: DataFrame, users: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """One page of users by tokens, ties by id, with their places.

    The page is found by counting users per bucket, from the highest on; only the users of the
    buckets that it touches are ordered, each bucket by itself, so a late page costs no more than the
    first.
    """
    page, limit = max(1, page), min(100, max(1, limit))
    first = (page - 1) * limit
    totals = user_totals(submissions, users).withColumn("bucket", _bucket("total_tokens"))
    counts = totals.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", _before(Window.orderBy(F.desc("bucket"))))  # a few thousand rows
    starts = starts.filter((F.col("start") < first + limit) & (F.col("start") + F.col("n") > first)).select("bucket", "start")
    within = Window.partitionBy("bucket").orderBy(F.desc("total_tokens"), "user_id")
    rows = totals.join(F.broadcast(starts), "bucket")
    rows = rows.withColumn("rank", (F.col("start") + F.row_number().over(within)).cast("int"))
    return rows.filter(F.col("rank").between(first + 1, first + limit)).drop("bucket", "start").orderBy("rank")


def leaderboard_stats(submissions: DataFrame, limit: int = 50) -> DataFrame:
    one = submissions.agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum(F.col("total_cost").cast("decimal(12,4)")).alias("total_cost"),
        F.count("*").alias("total_submissions"),
        F.count_distinct("user_id").alias("unique_users"),
    )
    return one.withColumn("total_pages", F.ceil(F.col("unique_users") / limit).cast("bigint"))


def user_rank(submissions: DataFrame, user_id) -> DataFrame:
    """A user's rank by tokens; equals share it. It counts who has more, so nothing is sorted."""
    totals = submissions.groupBy("user_id").agg(F.sum("total_tokens").alias("total"))
    own = totals.filter(F.col("user_id") == user_id).select("total").scalar()
    return totals.agg(
        F.lit(user_id).alias("user_id"),
        (F.count_if(F.col("total") > own) + 1).alias("rank"),
    )


def ranks(submissions: DataFrame) -> DataFrame:
    """user_id, total, rank of all users; equals share a rank.

    A rank is one more than the number of users of higher totals. Users are counted per total, totals
    fall into buckets by their logarithm: the buckets above are summed over a few thousand rows, the
    totals above within each bucket by itself.
    """
    totals = submissions.groupBy("user_id").agg(F.sum("total_tokens").alias("total"))
    counts = totals.groupBy("total").agg(F.count("*").alias("n")).withColumn("bucket", _bucket("total"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"))
    starts = buckets.select("bucket", _before(Window.orderBy(F.desc("bucket"))).alias("start"))
    within = counts.withColumn("inside", _before(Window.partitionBy("bucket").orderBy(F.desc("total"))))
    places = within.join(starts, "bucket").select("total", (F.col("start") + F.col("inside") + 1).alias("rank"))
    return totals.join(places, "total").select("user_id", "total", "rank")


#: What a profile sums over a user's submissions.
PROFILE_SUMS = ("total_tokens", "total_cost", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


def profile_stats(submissions: DataFrame, user_id) -> DataFrame:
    """One row: the sums that ``submissions`` has, 0 without any, how often they were sent, first and last day."""
    own = submissions.filter(F.col("user_id") == user_id)
    return own.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in PROFILE_SUMS if c in submissions.columns],
        F.coalesce(F.max("submit_count"), F.lit(0)).alias("submission_count"),
        F.min("date_start").alias("earliest"),
        F.max("date_end").alias("latest"),
    )


def latest_submission(submissions: DataFrame, user_id) -> DataFrame:
    """sources_used, models_used, updated_at of a user's last submission, the highest id of equals."""
    own = submissions.filter(F.col("user_id") == user_id)
    last = F.max_by(F.struct("sources_used", "models_used", "updated_at"), F.struct("created_at", "id"))
    return own.agg(last.alias("last")).filter("last is not null").select("last.*")


def recent_days(days: DataFrame, submissions: DataFrame, user_id, as_of: str) -> DataFrame:
    """The daily rows of a user's submissions of the year before a day.

    ``days`` has submission_id and date; rows of no submission are left out.
    """
    start = F.add_months(F.lit(as_of).cast("date"), -12)
    own = submissions.filter(F.col("user_id") == user_id).select(F.col("id").alias("submission_id"), "user_id")
    return days.filter(F.col("date") >= start).join(own, "submission_id")


def profile(submissions: DataFrame, days: DataFrame, user_id, as_of: str) -> dict[str, DataFrame]:
    """A user's page: ``stats``, one row with rank and the latest submission's lists, ``days`` and ``models``.

    Without a submission the rank and the lists are null. The days are of one user and one year, so
    they are few; they are merged by date and have an intensity by cost.
    """
    own = recent_days(days, submissions, user_id, as_of)
    stats = profile_stats(submissions, user_id).withColumn("user_id", F.lit(user_id))
    known = submissions.filter(F.col("user_id") == user_id).limit(1).select(F.lit(user_id).alias("user_id"))
    rank = known.join(user_rank(submissions, user_id).withColumn("user_id", F.lit(user_id)), "user_id")
    last = latest_submission(submissions, user_id).withColumn("user_id", F.lit(user_id))
    merged = with_intensity(profile_days(own), "strict")
    models = models_of_maps(own.select("date", "source_breakdown")).withColumn("model_id", clean_model(F.col("model_id")))
    return {"stats": stats.join(rank, "user_id", "left").join(last, "user_id", "left"), "days": merged, "models": profile_models(models)}


def profile_models(rows: DataFrame, digits: int = 6) -> DataFrame:
    """model_id, tokens, cost, percent per model, the costliest first.

    ``<synthetic>`` counts in the whole that percents are of but has no row.
    """
    sums = rows.groupBy("model_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    whole = sums.agg(F.sum("cost")).scalar()
    percent = F.col("cost").cast("double") * 100 / F.when(whole == 0, 1).otherwise(whole)
    sums = sums.withColumn("percent", F.round(percent, digits)).filter("model_id <> '<synthetic>'")
    return sums.orderBy(F.desc("cost"), F.desc("tokens"), "model_id")


def refilter(parts: DataFrame, sources: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Days from the parts of some sources and models only, with intensity by tokens."""
    own = parts
    if sources is not None:
        own = own.filter(F.col("source").isin(sources))
    if models is not None:
        own = own.filter(F.col("model_id").isin(models))
    days = own.groupBy("date").agg(
        exact_sum(*TOKENS).alias("tokens"), F.sum("cost").alias("cost"), F.sum("messages").alias("messages")
    )
    return with_intensity(days, measure="tokens")


def validate(meta: DataFrame, days: DataFrame, parts: DataFrame, years: DataFrame, as_of: str) -> DataFrame:
    """submission_id, rule, severity, subject: a row per violation.

    ``meta`` has submission_id, start, end, total_tokens, total_cost, active_days; ``days``
    submission_id, date, tokens, cost, intensity; ``parts`` submission_id, date, source and the token
    kinds; ``years`` submission_id, year, total_tokens.
    """
    today = F.lit(as_of).cast("date")
    key = "submission_id"
    meta = meta.select(key, "start", "end", "total_tokens", "total_cost", "active_days")

    def broken(rows: DataFrame, *rules: tuple[str, str, Column, Column | str]) -> DataFrame:
        """A row for each rule (name, severity, condition, subject) that a row breaks."""
        subject = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string").alias("subject")
        each = [F.when(bad, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), subject(x))) for r, s, bad, x in rules]
        return rows.select(key, F.explode(F.array_compact(F.array(*each))).alias("v")).select(key, "v.*")

    def off(calculated: str, stated: str, part: float, least: float) -> Column:
        """Whether a sum differs from what is stated by more than a part of that and by more than ``least``."""
        by = F.abs(F.col(calculated) - F.col(stated))
        return (by > F.col(stated) * part) & (by > least)

    below = F.lit(False)
    for number in (*TOKENS, "cost", "messages"):
        if number in parts.columns:
            below = below | F.coalesce(F.col(number) < 0, F.lit(False))
    in_sources = parts.groupBy(key, "date").agg(F.sum(sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))).alias("in_sources"))
    each_day = days.select(key, "date", "tokens", "cost", "intensity").join(in_sources, [key, "date"], "left")
    uneven = (F.abs(F.col("in_sources") - F.col("tokens")) > F.col("tokens") * 0.05) & (F.col("tokens") > 100)
    strange = (F.col("tokens") < 0) | (F.col("cost") < 0) | ~F.col("intensity").between(0, 4) | F.col("date").isNull()
    sums = days.groupBy(key).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.count_if(F.col("tokens") > 0).alias("active"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.count("*").alias("n"),
    )
    by_year = days.groupBy(key, F.year("date").alias("year")).agg(F.sum("tokens").alias("tokens"))
    stated = years.join(by_year, [key, "year"], "left").fillna({"tokens": 0})
    checks = (
        broken(
            each_day,
            ("V1", "error", strange, "date"),
            ("V2", "error", F.col("date") > today, "date"),
            ("V6", "warning", uneven, "date"),
        ),
        broken(
            parts,
            ("V1", "error", ~F.col("source").isin(*SUBMITTABLE), "source"),
            ("V1", "error", below, F.concat_ws(" ", "date", "source")),
        ),
        broken(
            meta.join(sums, key, "left"),
            ("V2", "error", F.col("end") > today, "end"),
            ("V3", "error", off("tokens", "total_tokens", 0.01, 100), "tokens"),
            ("V4", "warning", off("cost", "total_cost", 0.01, 0.1), F.lit("cost")),
            ("V5", "warning", F.col("active") != F.col("active_days"), "active"),
            ("V7", "warning", F.col("first") < F.col("start"), "first"),
            ("V7", "warning", F.col("last") > F.col("end"), "last"),
            ("V10", "error", F.col("n").isNull(), F.lit("no contributions")),
        ),
        broken(days.groupBy(key, "date").count(), ("V8", "error", F.col("count") > 1, "date")),
        broken(stated, ("V9", "warning", (F.abs(F.col("tokens") - F.col("total_tokens")) > F.col("total_tokens") * 0.01) & (F.col("tokens") > 1000), "year")),
    )
    result = checks[0]
    for c in checks[1:]:
        result = result.unionByName(c)
    return result


def fixed_maps(days: DataFrame, column: str = "source_breakdown") -> DataFrame:
    """``days`` with each source's tokens made anew from its kinds of tokens, and the day's from its sources'.

    Reasoning is not held in older maps and doesn't count. A day without a map stays as it is.
    """
    held = days.schema[column].dataType.valueType.names
    kinds = [k for k in ("input", "output", "cache_read", "cache_write") if k in held]
    tokens = lambda v: sum((F.coalesce(v[k], F.lit(0)) for k in kinds[1:]), F.coalesce(v[kinds[0]], F.lit(0))).cast("long")
    fixed = F.transform_values(column, lambda _, v: v.withField("tokens", tokens(v)))
    whole = F.aggregate(F.map_values(fixed), F.lit(0).cast("long"), lambda total, v: total + v["tokens"])
    return days.withColumns({column: fixed, "tokens": F.coalesce(whole, "tokens")})


def fixed_totals(submissions: DataFrame, days: DataFrame) -> DataFrame:
    """``submissions`` with total_tokens as the sum over the days of each (submission_id), 0 without any."""
    sums = days.groupBy(F.col("submission_id").alias("of")).agg(exact_sum("tokens").alias("fixed"))
    rows = submissions.drop("total_tokens").join(sums, F.col("id") == F.col("of"), "left")
    return rows.withColumn("total_tokens", F.coalesce("fixed", F.lit(0).cast("long"))).select(submissions.columns)


def fix_tokens(submissions: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The data fix in its three steps: sources in the stored maps, then days, then the submissions of those."""
    fixed = fixed_maps(days)
    return fixed_totals(submissions, fixed), fixed
