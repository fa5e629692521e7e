"""Labels and numbers as the dashboard shows them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgauge.functions.times import as_of_column

# Fixed values.
DASH = "—"
UNKNOWN_TOKENS = "?"
UNTITLED = "Untitled"
ALERT_RATE = 0.05


def fixed_point(value: Column, digits: int) -> Column:
    """A non-negative double with 0 or 1 decimals, rounded on its exact binary value.

    Ties go up. ``format_string`` rounds the shortest decimal text instead, which
    turns 0.15 (a little less than 15/100 in binary) into 0.2.
    """
    unit = 10**digits
    whole = F.floor(value)
    # The fraction as a count of 2^-58, exact wherever it could be near a tie.
    parts = ((value - whole) * F.lit(float(2**58))).cast("bigint")
    rounded = F.shiftright(parts * F.lit(unit) + F.lit(2**57), 58)
    units = whole * F.lit(unit) + rounded
    if digits == 0:
        return units.cast("string")
    last = F.pmod(units, F.lit(unit))
    return F.concat(((units - last) / unit).cast("bigint").cast("string"), F.lit("."), last.cast("string"))


def percent_label(rate: Column) -> Column:
    return F.when(rate == 0, "0%").otherwise(F.concat(fixed_point(rate * 100, 1), F.lit("%")))


def rounded_label(value: Column) -> Column:
    return F.when(value.isNull(), DASH).otherwise(fixed_point(value, 0))


def health_class(rate: Column) -> Column:
    return F.when(rate > ALERT_RATE, "bad").when(rate == 0, "good").otherwise("neutral")


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def relative_age(ts: Column, as_of: datetime | Column | None) -> Column:
    """just now, Nm ago, Nh ago, Nd ago, else the ISO date; each unit rounded down."""
    micros = F.timestamp_diff("MICROSECOND", ts, as_of_column(as_of))
    minutes = F.floor(micros / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
