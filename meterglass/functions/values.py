"""Times, money and numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def millis_of_rfc3339(text: Column) -> Column:
    """Epoch milliseconds of a date-time with zone; null for anything else."""
    upper = F.upper(text)
    return F.when(upper.rlike(RFC3339), F.unix_millis(upper.try_cast("timestamp")))


def date_of_millis(ms: Column) -> Column:
    """The UTC day."""
    return F.timestamp_millis(ms).cast("date")


def millis_of_wall_time(name: str) -> Column:
    """Epoch milliseconds of the zone-less time in a column, read as UTC and cut rather than rounded."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}) div 1000")


def millis_of_csv_date(text: Column) -> Column:
    """Date-times with or without zone mark, as UTC; a bare date is noon; 0 for anything else."""
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z?$")
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = F.concat(F.regexp_replace(text, "Z$", ""), F.lit("Z"))
    noon = F.concat(text, F.lit("T12:00:00Z"))
    parsed = F.when(full, F.unix_millis(zoned.try_cast("timestamp"))).when(day, F.unix_millis(noon.try_cast("timestamp")))
    return F.coalesce(parsed, F.lit(0).cast("bigint"))


def money(text: Column) -> Column:
    """``$1,234.56`` as a double; empty, NaN and what is no number are 0."""
    bare = F.trim(F.regexp_replace(text, "[$,]", ""))
    value = F.when(F.lower(bare).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), bare.try_cast("double"))
    return F.coalesce(value, F.lit(0.0))


def whole(text: Column) -> Column:
    """A whole number from text, 0 if it is none."""
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def fixed(x: Column, digits: int, even: bool = False) -> Column:
    """A double with so many digits, rounded by its exact binary value: 411.645 lies below that and is 411.64.

    ``format_number`` does that, but takes halves that a double can hold to the even digit. Unless ``even`` is set, those are
    lifted first, away from zero.
    """
    half = F.abs(x * 2 ** (digits + 1)) % 2 == 1
    lifted = x if even else F.when(half, x + F.signum(x) * 10.0 ** -(digits + 1)).otherwise(x)
    return F.when(x >= 1e12, F.format_string(f"%.{digits}f", x)).otherwise(F.replace(F.format_number(lifted, digits), F.lit(",")))


MARKS = {"B": 10**9, "M": 10**6, "K": 10**3}


def compact(n: Column, digits: int = 1, large: int | None = None, top: str = "B") -> Column:
    """1.2K, 3.4M, 5.6B; smaller numbers as they are. ``large`` is the number of digits of M and B, where it differs.

    ``top`` is the largest mark: with M, 5.6B is 5600.0M.
    """
    scaled = F.lit(None).cast("string")
    for mark, limit in MARKS.items():
        if limit > MARKS[top]:
            continue
        shown = digits if large is None or mark == "K" else large
        scaled = F.coalesce(scaled, F.when(n >= limit, F.concat(fixed(n.cast("double") / limit, shown), F.lit(mark))))
    return F.coalesce(scaled, n.cast("string"))


def dollars(cost: Column) -> Column:
    """$1.2K from a thousand on, else two digits."""
    small = F.concat(F.lit("$"), F.format_string("%.2f", cost.cast("double")))
    return F.when(cost >= 1000, F.concat(F.lit("$"), F.format_string("%.1f", cost.cast("double") / 1000), F.lit("K"))).otherwise(small)


def thousands(n: Column) -> Column:
    """1,234,567."""
    return F.format_number(n.cast("bigint"), 0)


def currency(cost: Column, kilo: bool = False, even: bool = False) -> Column:
    """$1234.50; with ``kilo`` $1.23K from a thousand on. Halves go up: 1125 is $1.13K, with ``even`` $1.12K."""
    cost = cost.cast("double")
    plain = F.concat(F.lit("$"), fixed(cost, 2, even))
    if not kilo:
        return plain
    return F.when(cost >= 1000, F.concat(F.lit("$"), fixed(cost / 1000, 2, even), F.lit("K"))).otherwise(plain)


def day_label(day: Column, full: bool = False) -> Column:
    """Jan 5, 2024, or January 5, 2024."""
    return F.date_format(day, "MMMM d, yyyy" if full else "MMM d, yyyy")


def weekday_label(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def days_between(first: Column, last: Column) -> Column:
    """Whole days from one day to another, whichever comes first."""
    return F.abs(F.datediff(last, first))


def hour_label(hour: Column) -> Column:
    """0 as 12am, 15 as 3pm."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("int").cast("string"), F.when(hour < 12, "am").otherwise("pm"))


def span_label(ms: Column) -> Column:
    """2h 5m, 7m or 9s; nothing long is N/A."""
    s = (ms / 1000).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(F.coalesce(ms, F.lit(0)) <= 0, "N/A")
        .when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm", m))
        .otherwise(F.format_string("%ds", s))
    )


def djb2(text: Column) -> Column:
    """The 32-bit djb2 hash of ASCII text as 16 hexadecimal digits of its absolute value."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    mixed = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(mixed >= 1 << 31, mixed - (1 << 32)).otherwise(mixed)
    return F.lpad(F.lower(F.hex(F.abs(signed))), 16, "0")
