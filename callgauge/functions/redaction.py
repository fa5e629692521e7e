"""Removal of personal data and secrets from text.

Six passes, each over the result of the one before, so a later rule sees the
placeholders of an earlier one. Every pattern runs with Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes and placeholders that stored previews depend on.
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"
KEY = r"(?U)\b(?:sk|pk|api|key|token|xox[baprs])-[A-Za-z0-9_\-]{8,}\b"
BEARER = r"(?U)\bBearer\s+[A-Za-z0-9._\-]{10,}\b"
GOOGLE_KEY = r"(?U)\bAIza[0-9A-Za-z_\-]{10,}\b"
PHONE = r"(?U)\+\d{1,3}[\d .\-()]{8,16}\d|\b\d{10}\b"
CARD_TAG = "[REDACTED:card]"
EMAIL_TAG = "[REDACTED:email]"
SECRET_TAG = "[REDACTED:secret]"
PHONE_TAG = "[REDACTED:phone]"
PREVIEW_CHARS = 500

# An email is  \b [\w.+%-]+ @ [\w-]+ (\.[\w-]+)+ \b.  Written like that, Java's
# matcher recurses once per domain label (stack overflow on a long one) and
# retries the local part at every word border (quadratic on a long dotted run).
# This form matches the same strings without either: it is tried only where a
# run of local-part characters starts, or where the last match ended; what
# stands before the first word border is put back by the replacement ($1); and
# all loops are possessive.
EMAIL = (
    r"(?U)(?:\G|(?<![\w.+%-]))((?:(?!\b)[\w.+%-])*+)"
    r"\b[\w.+%-]++@"
    r"(?=[\w-]++\.(?:-++\.)*+-*+\w)(?:(?:-|\.(?=[\w-]))*+\w++)++"
)


def redact(text: Column | str) -> Column:
    """Text with every card, email, secret and phone replaced by a placeholder.

    The email pass is the only dear one, so texts without an at sign skip it.
    No other pass adds or removes one, so the source text can be asked.
    """
    source = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(source, CARD, CARD_TAG)
    emails = F.regexp_replace(out, EMAIL, "$1" + EMAIL_TAG)
    out = F.when(F.contains(source, F.lit("@")), emails).otherwise(out)
    out = F.regexp_replace(out, KEY, SECRET_TAG)
    out = F.regexp_replace(out, BEARER, SECRET_TAG)
    out = F.regexp_replace(out, GOOGLE_KEY, SECRET_TAG)
    return F.regexp_replace(out, PHONE, PHONE_TAG)


def truncate(text: Column | str, limit: int) -> Column:
    """First ``limit`` code points."""
    return F.substring(text, 1, limit)


def preview(text: Column | str, limit: int = PREVIEW_CHARS) -> Column:
    """Redact the whole text, then cap it; never the other way round."""
    return truncate(redact(text), limit)


# Beginnings of a text that are tried, in code points, before the whole text is taken.
BEGINNINGS = (1024, 16384)
# A letter before white space, where no match reaches across: cards and phones hold no
# letters, emails and keys no white space, and Bearer is the one word that goes on after it.
BORDER = r"(?s)\A(.*(?<=\p{L})(?<!Bearer))(?=[ \t\r\n])"


def preview_source(text: Column | str, limit: int = PREVIEW_CHARS) -> Column:
    """A beginning of the text that settles its preview, whatever follows.

    It ends at a border that no match crosses and has at least ``limit`` code points after
    redaction, so every longer beginning of the text has the same preview. If the tried
    beginnings have no such border it is the whole text.
    """
    source = F.col(text) if isinstance(text, str) else text
    out = source
    for size in reversed(BEGINNINGS):
        start = F.regexp_extract(F.substring(source, 1, size), BORDER, 1)
        out = F.when(F.length(source) <= size, source).when(F.length(redact(start)) >= limit, start).otherwise(out)
    return out
