"""Time helpers. Stored times have no zone and mean UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_column(as_of: datetime | Column | None) -> Column:
    """The moment a report is taken at; the current time unless one is given."""
    if as_of is None:
        return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    if isinstance(as_of, datetime):
        return F.expr(f"timestamp_ntz'{as_of.isoformat(sep=' ')}'")
    return as_of


def iso_utc(ts: Column | str) -> Column:
    """RFC 3339 text with 0, 3 or 6 decimals, whichever loses nothing."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    decimals = (
        F.when(micros == "000000", "")
        .when(F.substring(micros, 4, 3) == "000", F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(seconds, decimals, F.lit("Z"))


def elapsed_ms(start: str, end: str) -> Column:
    """Whole milliseconds from ``start`` to ``end``, cut off."""
    return F.expr(f"timestampdiff(MILLISECOND, {start}, {end})")
