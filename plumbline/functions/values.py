"""Kinds of values in untyped text, and how a column's kinds merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that count as numbers, booleans and dates.
INT = r"^-?[0-9]+$"
FLOAT = r"^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$|^-?[0-9]+([eE][+-]?[0-9]+)?$"
BOOL = r"^([Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee])$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
#: Kinds in order, each a bit when a column's kinds are gathered.
KINDS = ("null", "bool", "int", "float", "datetime", "string")


def stripped(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_null(c: Column) -> Column:
    """Null or blank text."""
    return c.isNull() | (stripped(c) == "")


def kind(c: Column) -> Column:
    """The kind of a text, the first that fits of KINDS."""
    s = stripped(c)
    return (
        F.when(is_null(c), "null").when(s.rlike(BOOL), "bool").when(s.rlike(INT), "int").when(s.rlike(FLOAT), "float")
        .when(s.rlike(DATE), "datetime").otherwise("string")
    )


def number(c: Column, kind_: Column) -> Column:
    """The number that an int or float text stands for, else null."""
    return F.when(kind_.isin("int", "float"), stripped(c).try_cast("double"))


def date_text(c: Column, kind_: Column) -> Column:
    """The stripped text of a date, which sorts by time, else null."""
    return F.when(kind_ == "datetime", stripped(c))


def kind_bit(kind_: Column) -> Column:
    out = F.when(kind_ == KINDS[0], 1)
    for k, name in enumerate(KINDS[1:], 1):
        out = out.when(kind_ == name, 1 << k)
    return out


def merged_kind(bits: Column) -> Column:
    """A column's kind from the bits of its values: nulls don't count, int with float is float, else mixed."""
    seen = bits.bitwiseAND(62)
    out = F.when(seen == 0, "null").when(seen == 12, "float")
    for k, name in enumerate(KINDS[1:], 1):
        out = out.when(seen == 1 << k, name)
    return out.otherwise("mixed")


def sql_kind(declared: Column, inferred: Column) -> Column:
    """The kind of a database column: its declared type, where values alone don't tell."""
    d = F.upper(declared)
    has = lambda *names: F.greatest(*(d.contains(n).cast("int") for n in (*names, *names))) == 1
    by_name = (
        F.when(has("INT"), "int").when(has("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL"), "float")
        .when(has("DATE", "TIME"), "datetime").when(has("BOOL"), "bool").otherwise("string")
    )
    return F.when(inferred.isin("mixed", "null", "string") & (F.coalesce(d, F.lit("")) != ""), by_name).otherwise(inferred)
