"""Submissions kept in a store: what a user sends is checked, merged into their days and summed up again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterglass.operators import community, reports
from meterglass.schema import SUBMITTABLE, TOKENS
from meterglass.session import write_out
from meterglass.store import Store

DAYS = (
    "user_id bigint, date date, source string, model_id string, tokens bigint, cost double, "
    + ", ".join(f"{t} bigint" for t in TOKENS)
    + ", messages bigint"
)
SUMS = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cache_read", "cache_creation_tokens": "cache_write", "reasoning_tokens": "reasoning"}
SUBMISSIONS = (
    "user_id bigint, total_tokens bigint, total_cost decimal(18,4), "
    + ", ".join(f"{c} bigint" for c in SUMS)
    + ", date_start date, date_end date, active_days bigint, row_count bigint, sources_used array<string>, models_used array<string>,"
    " cli_version string, submission_hash string, submit_count bigint"
)
NUMBERS = ("tokens", "cost", *TOKENS, "messages")


def submission_store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """A store of daily rows, and of one submission per user for the leaderboard and profiles."""
    return Store(spark, root, {"days": DAYS, "submissions": SUBMISSIONS}, buckets=buckets)


def rows_of_usage(priced: DataFrame, user_id: int) -> DataFrame:
    """What a user submits of priced sums: a row per day, source and model, of sources that may be submitted."""
    rows = reports.daily_sources(priced.filter(F.col("source").isin(*SUBMITTABLE)))
    return rows.withColumns({"user_id": F.lit(user_id).cast("long"), "tokens": reports.all_tokens()})


def violations(rows: DataFrame, as_of: str) -> DataFrame:
    """What the rules say against the rows of each user, who is its submission_id."""
    own = rows.withColumnRenamed("user_id", "submission_id")
    days = own.groupBy("submission_id", "date").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")).withColumn("intensity", F.lit(0))
    meta = days.groupBy("submission_id").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.sum("tokens").alias("total_tokens"), F.sum("cost").alias("total_cost"), F.count_if(F.col("tokens") > 0).alias("active_days")
    )
    years = days.groupBy("submission_id", F.year("date").alias("year")).agg(F.sum("tokens").alias("total_tokens"))
    return community.validate(meta, days, own, years, as_of)


@dataclass(frozen=True)
class Submitted:
    """The store's version, and what was found; users with an error among it have been refused whole."""

    version: int
    found: DataFrame


def _summed(days: DataFrame, users: DataFrame, payload: DataFrame, before: DataFrame, cli_version: str) -> DataFrame:
    """The submissions of ``users`` from all their days: sums of days, whose costs are rounded first, and what they name."""
    mine = days.join(users, "user_id", "left_semi").groupBy("user_id", "date")
    sums = {"total_tokens": "tokens", **SUMS}
    each = mine.agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], F.sum("cost").cast("decimal(18,4)").alias("total_cost"),
        F.collect_set("source").alias("sources_used"), F.collect_set("model_id").alias("models_used"),
    )
    # A user has a day's names for each of their days, which the calendar bounds.
    named = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    totals = each.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("total_cost").cast("decimal(18,4)").alias("total_cost"), F.min("date").alias("date_start"), F.max("date").alias("date_end"),
        F.count_if(F.col("total_tokens") > 0).alias("active_days"), F.count("*").alias("row_count"), named("sources_used"), named("models_used"),
    )
    dated = payload.groupBy("user_id").agg(F.collect_set("source").alias("sources"), F.min("date").alias("start"), F.max("date").alias("end"), F.collect_set(F.col("date").cast("string")).alias("days"))
    hashes = community.submission_hash(dated).select("user_id", "submission_hash")
    sent = before.select("user_id", F.col("submit_count").alias("sent"))
    out = users.join(totals, "user_id", "left").join(hashes, "user_id", "left").join(sent, "user_id", "left")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("total_cost", *sums, "active_days", "row_count")}
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("sources_used", "models_used")}
    return out.withColumns(numbers | lists | {"cli_version": F.lit(cli_version), "submit_count": F.coalesce("sent", F.lit(0)) + 1})


def submit(store: Store, rows: DataFrame, as_of: str, submitted: DataFrame | None = None, cli_version: str = "", batch: tuple[str, int] | None = None) -> Submitted:
    """Merge users' daily rows into the store.

    ``rows`` has what DAYS has; rows of one day, source and model are summed, a null number is 0, a model
    without a name is ``unknown``. ``submitted`` (user_id, source) lists the sources that are replaced on
    the days of ``rows``, by default those that it has. A user whose rows break a rule with an error is
    refused. The rows are written out once, as a merge may have to begin again.
    """
    named = rows.withColumn("model_id", community.clean_model(F.col("model_id"))).groupBy("user_id", "date", "source", "model_id")
    own = write_out(named.agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in NUMBERS]))
    found = write_out(violations(own, as_of))
    refused = found.filter("severity = 'error'").select(F.col("submission_id").alias("user_id")).distinct()
    own = own.join(refused, "user_id", "left_anti")
    listed = (own if submitted is None else submitted.join(refused, "user_id", "left_anti")).select("user_id", "source").distinct()
    users = own.select("user_id").distinct()

    def merged(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
        days = community.merge_sources(old["days"], own.select(old["days"].columns), listed)
        new = _summed(days, users, own, old["submissions"], cli_version).select(old["submissions"].columns)
        return {"days": days, "submissions": old["submissions"].join(users, "user_id", "left_anti").unionByName(new)}

    return Submitted(store.merge(users, merged, batch), found)


def submit_stream(payloads: DataFrame, store: Store, as_of: str, name: str, checkpoint: str) -> StreamingQuery:
    """Submit a stream of daily rows batch by batch; a batch that is run again after a failure changes nothing."""

    def one(rows: DataFrame, batch_id: int) -> None:
        submit(store, rows, as_of, batch=(name, batch_id))

    return payloads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
