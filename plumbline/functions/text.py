"""Formatting and normalising of text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import stripped

# Seconds in a duration's units.
UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000}
# What a log line's key puts in place of moments, identifiers and numbers, in order.
LOG_KEY = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([,.][0-9]+)?", "{TS}"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "{ID}"),
    (r"\b0x[0-9a-f]{4,}\b", "{ID}"),
    (r"\b[0-9]+(\.[0-9]+)?\b", "{N}"),
)


def log_key(message: Column) -> Column:
    """The key under which a log line repeats. It is lower-cased first, so moments with a T keep their letters."""
    out = stripped(F.lower(message))
    for pattern, put in LOG_KEY:
        out = F.regexp_replace(out, pattern, put)
    return out


def duration_seconds(c: Column) -> Column:
    """Seconds of texts such as 90m, 2h, 7d, 2w, 3mo, 1y; null for others."""
    n = F.regexp_extract(stripped(c), r"^([0-9]+)(mo|m|h|d|w|y)$", 1).try_cast("long")
    unit = F.regexp_extract(stripped(c), r"^([0-9]+)(mo|m|h|d|w|y)$", 2)
    out = F.lit(None).cast("long")
    for name, seconds in UNITS.items():
        out = F.when(unit == name, n * seconds).otherwise(out)
    return out


def size_bytes(c: Column) -> Column:
    """Bytes of texts such as 500, 10 KB, 1.5MB, 2gb, by 1024; null for others."""
    pattern = r"^([0-9.]+)\s*([Bb]|[KkMmGg][Bb])?$"
    n = F.regexp_extract(stripped(c), pattern, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(stripped(c), pattern, 2))
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1)
    return F.floor(n * factor).cast("long")


def age(seconds: Column) -> Column:
    """How long ago: just now, minutes, hours, days to 6, weeks to 27 days, months of 30 days (0mo below), years of 365."""
    whole = lambda unit: F.floor(seconds / unit).cast("long").cast("string")
    days = F.floor(seconds / 86400)
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(whole(60), F.lit("m")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h"))).when(days < 7, F.concat(whole(86400), F.lit("d")))
        .when(days < 28, F.concat(whole(604800), F.lit("w"))).when(days < 365, F.concat(whole(2592000), F.lit("mo")))
        .otherwise(F.concat(whole(31536000), F.lit("y")))
    )


def human_size(n: Column, gb_digits: int = 2) -> Column:
    """Bytes by 1024: whole bytes, else one decimal of KB or MB, and gb_digits of GB."""
    by = lambda k, digits, name: F.format_string(f"%.{digits}f {name}", F.bround(n / float(1024**k), digits))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, by(1, 1, "KB")).when(n < 1024**3, by(2, 1, "MB")).otherwise(by(3, gb_digits, "GB"))


def compact_count(n: Column) -> Column:
    """A count as it is, or in thousands or millions with one decimal."""
    return (
        F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.format_string("%.1fk", F.bround(n / 1000.0, 1)))
        .otherwise(F.format_string("%.1fM", F.bround(n / 1_000_000.0, 1)))
    )


def cell(c: Column, width: int = 80) -> Column:
    """A text as a table's cell: bars escaped, line ends blank, cut to a width with an ellipsis."""
    flat = F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def last_overprint(line: Column) -> Column:
    """What a terminal shows of a line with carriage returns: its last part that isn't empty."""
    parts = F.filter(F.split(line, "\r"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def stream_key(line: Column) -> Column:
    """The key under which an output line repeats: no colours, single blanks, # for digits."""
    plain = F.regexp_replace(line, r"\x1b\[[0-9;]*m", "")
    return F.regexp_replace(stripped(F.regexp_replace(plain, r"\s+", " ")), r"[0-9]+", "#")


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def package_name(c: Column) -> Column:
    """A package's name in its normal form."""
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))
