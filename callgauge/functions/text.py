"""Plain text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends as a browser's trim knows them.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \xa0"
    + chr(0x1680)
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + chr(0x2028)
    + chr(0x2029)
    + chr(0x202F)
    + chr(0x205F)
    + chr(0x3000)
    + chr(0xFEFF)
)


def trimmed(text: Column | str) -> Column:
    """Text without white space at both ends (one linear pass, no pattern)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def error_text(kind: Column, detail: Column, status: Column) -> Column:
    """The message of a failed call by kind: http, api, malformed, internal."""
    return (
        F.when(kind == "http", F.concat(F.lit("http error: "), detail))
        .when(kind == "api", F.concat(F.lit("provider returned "), status.cast("string"), F.lit(": "), detail))
        .when(kind == "malformed", F.concat(F.lit("malformed stream chunk: "), detail))
        .when(kind == "internal", F.concat(F.lit("internal: "), detail))
    )
