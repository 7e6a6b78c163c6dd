"""JSON documents of the reports. Each is one document, whose size is bounded by days and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass import __version__
from meterglass.functions.names import table_labels
from meterglass.functions.values import currency, thousands
from meterglass.operators import metrics, reports

TOKENS_JSON = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "reasoning": "reasoning"}


def _tokens(name: str):
    return F.struct(*[F.col(f"{name}.{k}").alias(v) for k, v in TOKENS_JSON.items()])


def contributions(days: DataFrame) -> DataFrame:
    """Days in the document's field names, as one JSON string each."""
    source = lambda s: F.struct(
        s["source"].alias("source"),
        s["model_id"].alias("modelId"),
        s["provider_id"].alias("providerId"),
        F.struct(*[s["tokens"][k].alias(v) for k, v in TOKENS_JSON.items()]).alias("tokens"),
        s["cost"].alias("cost"),
        s["messages"].alias("messages"),
    )
    day = F.struct(
        F.col("date").cast("string").alias("date"),
        F.struct("tokens", "cost", "messages").alias("totals"),
        "intensity",
        _tokens("token_breakdown").alias("tokenBreakdown"),
        F.transform("sources", source).alias("sources"),
    )
    return days.orderBy("date").select(F.to_json(day).alias("json"))


def graph_document(messages: DataFrame, generated_at: str) -> dict:
    """The graph: meta, summary, years and contributions of priced messages or their sums."""
    days = reports.daily_contributions(messages)
    totals = reports.day_totals(messages)
    one = reports.summary(totals, messages.select("source", "model_id")).first()
    own = [json.loads(r["json"]) for r in contributions(days).toLocalIterator()]
    years = [
        {
            "year": str(r["year"]),
            "totalTokens": r["total_tokens"],
            "totalCost": r["total_cost"],
            "range": {"start": str(r["range_start"]), "end": str(r["range_end"])},
        }
        for r in reports.years(totals).toLocalIterator()
    ]
    return {
        "meta": {
            "generatedAt": generated_at,
            "version": __version__,
            "dateRange": {"start": own[0]["date"] if own else None, "end": own[-1]["date"] if own else None},
        },
        "summary": {
            "totalTokens": one["total_tokens"],
            "totalCost": one["total_cost"],
            "totalDays": one["total_days"],
            "activeDays": one["active_days"],
            "averagePerDay": one["average_per_day"],
            "maxCostInSingleDay": one["max_cost_in_single_day"],
            "sources": one["sources"],
            "models": one["models"],
        },
        "years": years,
        "contributions": own,
    }


def rows_document(rows: DataFrame, name: str = "entries") -> dict:
    """A report's rows under one name."""
    return {name: [json.loads(r) for r in rows.toJSON().toLocalIterator()]}


#: Columns of a usage table and those of a narrow one.
HEAD = ("Models", "Input", "Output", "Cache Write", "Cache Read", "Total", "Cost")
NARROW_HEAD = ("Models", "Input", "Output", "Cost")
NARROW = 100


def usage_table(report: DataFrame, first: str, title: str, models: str = "models") -> DataFrame:
    """A report's rows as texts under HEAD, the first column named ``title``, and their total as the last row."""
    four = ("input", "output", "cache_write", "cache_read")
    labels = table_labels(F.col(models)) if models in report.columns else F.lit("")
    rows = report.select(F.coalesce(F.col(first).cast("string"), F.lit("")).alias(title), labels.alias("Models"), *four, "cost")
    sums = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*four, "cost")])
    sums = sums.select(F.lit("Total").alias(title), F.lit("").alias("Models"), *four, "cost")
    both = rows.withColumn("last", F.lit(False)).unionByName(sums.withColumn("last", F.lit(True)))
    shown = {"Input": F.col("input"), "Output": F.col("output"), "Cache Write": F.col("cache_write"), "Cache Read": F.col("cache_read")}
    shown["Total"] = sum((F.col(c) for c in four[1:]), F.col("input"))
    texts = [thousands(c).alias(n) for n, c in shown.items()]
    return both.orderBy("last", title).select(title, "Models", *texts, currency(F.col("cost")).alias("Cost"))


def console_text(table: DataFrame, width: int = 120) -> str:
    """A usage table as lines; below NARROW characters of width only the narrow columns.

    A table has a row per month or model, so it is fetched.
    """
    title = table.columns[0]
    head = [title, *(HEAD if width >= NARROW else NARROW_HEAD)]
    cells = [head]
    for row in table.select(*head).collect():
        lines = (row["Models"] or "").split("\n")
        cells.append([row[c] if c != "Models" else lines[0] for c in head])
        cells += [["", x, *[""] * (len(head) - 2)] for x in lines[1:]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) if i < 2 else x.rjust(w) for i, (x, w) in enumerate(zip(r, widths))).rstrip() for r in cells)


def full_export(messages: DataFrame, exported_at: str) -> dict:
    """Models, days, statistics and totals of priced messages or their sums in one document."""
    report, days = reports.model_report(messages), reports.day_totals(messages)
    models = rows_document(report, "models")
    one = json.loads(reports.summary(days, messages).toJSON().first())
    return {
        "exportedAt": exported_at,
        "totalCost": one["total_cost"],
        "modelCount": len(models["models"]),
        **models,
        **rows_document(days.orderBy(F.desc("date")), "daily"),
        "stats": one | json.loads(metrics.favourite_model(messages).toJSON().first()) | _streaks(days),
    }


def _streaks(days: DataFrame) -> dict:
    longest = metrics.longest_streak(days.filter("cost > 0").withColumn("one", F.lit(1)), "one").first()
    return {"longest_streak": longest["longest_streak"] if longest else 0}
