"""python -m meterglass models|monthly|graph|scan|review|export|submit --home DIR [--prices FILE] [filters]: JSON on stdout.

submit merges the days into the store in --store as those of --user.
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from meterglass import export
from meterglass import __version__
from meterglass.operators import filters, metrics, pricing, reports, submissions
from meterglass.schema import PRICES, SOURCES
from meterglass.session import session
from meterglass.sources.files import roots, scan_stats
from meterglass.sources.prices import read_prices
from meterglass.sources.sessions import load_usage


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="meterglass", description=__doc__)
    parser.add_argument("command", choices=("models", "monthly", "graph", "scan", "review", "export", "submit"))
    parser.add_argument("--home", required=True)
    parser.add_argument("--prices")
    parser.add_argument("--table", type=int, metavar="WIDTH", help="models and monthly as a table of this width")
    parser.add_argument("--store", help="submit: the folder of the store")
    parser.add_argument("--user", type=int, help="submit: whose days they are")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--as-of", type=date.fromisoformat, default=datetime.now(UTC).date())
    for source in SOURCES:
        parser.add_argument(f"--{source}", action="store_true")
    for span in ("today", "week", "month"):
        parser.add_argument(f"--{span}", action="store_true")
    for name in ("since", "until", "year"):
        parser.add_argument(f"--{name}")
    return parser


def submitted(args: argparse.Namespace, spark, priced) -> dict:
    """Merge what was used into the store; what it says of the user then."""
    store = submissions.submission_store(spark, args.store)
    done = submissions.submit(store, submissions.rows_of_usage(priced, args.user), str(args.as_of), cli_version=__version__)
    found = export.rows_document(done.found.orderBy("severity", "rule", "subject"), "violations")
    if any(v["severity"] == "error" for v in found["violations"]):
        return {"accepted": False, **found}
    own = store.read("submissions").filter(F.col("user_id") == args.user)
    return {"accepted": True, "version": done.version, **found, **export.rows_document(own, "submission")}


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = session(master=args.master)
    sources = [s for s in SOURCES if getattr(args, s)] or None
    if args.command == "scan":
        print(json.dumps(export.rows_document(scan_stats(spark, roots(args.home, sources)), "sources")))
        return
    span = filters.shortcut(args.as_of, args.today, args.week, args.month) or {"since": args.since, "until": args.until, "year": args.year}
    rows = filters.by_date(load_usage(spark, args.home, sources), **span)
    prices = read_prices(spark, args.prices) if args.prices else spark.createDataFrame([], PRICES)
    messages, rows = rows, pricing.priced_usage(rows, prices)
    now = datetime.now(UTC).isoformat()
    if args.command == "submit":
        if args.store is None or args.user is None:
            raise SystemExit("submit needs --store and --user")
        print(json.dumps(submitted(args, spark, rows)))
        return
    if args.table and args.command in ("models", "monthly"):
        report = reports.monthly_report(rows) if args.command == "monthly" else reports.model_report(rows)
        first = {"monthly": ("month", "Month"), "models": ("model_id", "Model")}[args.command]
        print(export.console_text(export.usage_table(report, *first), args.table))
        return
    if args.command == "models":
        out = export.rows_document(reports.model_report(rows))
    elif args.command == "monthly":
        out = export.rows_document(reports.monthly_report(rows))
    elif args.command == "graph":
        out = export.graph_document(rows, now)
    elif args.command == "export":
        out = export.full_export(rows, now)
    else:
        days = reports.with_intensity(reports.day_totals(rows)).withColumn("one", F.lit(1))
        paid = days.filter("cost > 0")
        year = args.as_of.year
        out = {
            **export.rows_document(metrics.top_by_cost(rows, "model_id"), "topModels"),
            **export.rows_document(metrics.top_clients(rows), "topClients"),
            **export.rows_document(metrics.top_agents(metrics.agents(messages, prices)), "topAgents"),
            **export.rows_document(metrics.longest_session(messages), "longestSession"),
            **export.rows_document(metrics.peak_hour(messages, (messages.timestamp_ms / 3_600_000 % 24)), "peakHour"),
            **export.rows_document(metrics.longest_streak(paid, "one").drop("one"), "longestStreak"),
            **export.rows_document(metrics.current_streak(paid, "one", str(args.as_of)).drop("one"), "currentStreak"),
            **export.rows_document(reports.year_card(days, year), "year"),
            **export.rows_document(metrics.calendar_grid(days, f"{year}-01-01", f"{year}-12-31").orderBy("date"), "grid"),
            **export.rows_document(metrics.favourite_model(rows), "favouriteModel"),
        }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
