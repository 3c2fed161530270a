"""Column profiles: kinds, nulls, numbers, dates, distinct and frequent values.

Typed tables take one wide aggregate whose columns become rows; untyped text goes through cells, a row
for each value, grouped by column. Exact distinct counts need a group for each value, so they are worked
out only for columns that can have an answer: a sketch in the wide aggregate first rules out columns
with far more values than the cap.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import date_text, is_null, kind, kind_bit, merged_kind, number


@dataclass(frozen=True)
class Options:
    """Limits of a profile; the defaults are those of the command line."""

    head: int = 5
    tail: int = 5
    max_distinct: int = 100
    top_k: int = 5
    max_rows: int | None = 100_000
    max_columns: int = 50
    max_tables: int = 20
    median: bool = False
    columns: tuple[str, ...] | None = None
    max_json_bytes: int = 50 * 1024 * 1024

    def with_(self, **changes) -> Options:
        return replace(self, **changes)


#: Times the cap by which a sketch's count must exceed it to rule a column out; its error is a few hundredths.
SURE = 1.5
WIDE = "column string, dtype string, row_count long, non_null_count long, _about long, min double, max double, mean double, std double, median double, min_date string, max_date string"
COLUMNS = [
    "column", "dtype", "nullable", "row_count", "non_null_count", "null_count", "null_pct", "distinct_count",
    "min", "max", "mean", "std", "median", "min_date", "max_date",
]


def pick_columns(names: list[str], options: Options) -> list[str]:
    """Columns to profile: in source order, unknown names ignored, cut at the cap."""
    own = [c for c in names if options.columns is None or c in options.columns]
    return own[: options.max_columns]


def rows_up_to(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by a column that numbers them from 1."""
    return df if n is None else df.where(F.col(order) <= n)


def type_label(kind_: T.DataType) -> str:
    if isinstance(kind_, T.BooleanType):
        return "bool"
    if isinstance(kind_, T.IntegralType):
        return "int"
    if isinstance(kind_, T.FractionalType):
        return "float"
    return "datetime" if isinstance(kind_, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def typed_profile(df: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each column of a typed table, columns COLUMNS.

    NaN and blank text count as null. distinct_count is null above options.max_distinct. The wide
    aggregate, a row whatever the size of the table, is computed at once; columns that its sketches
    leave in question are then counted exactly.
    """
    names = pick_columns(df.columns, options)
    parts, schema = [], {f.name: f.dataType for f in df.schema.fields}
    for name in names:
        c, label = F.col(f"`{name}`"), type_label(schema[name])
        null = c.isNull() | F.isnan(c) if label == "float" and not isinstance(schema[name], T.DecimalType) else c.isNull()
        null = is_null(c) if isinstance(schema[name], T.StringType) else null
        value = F.when(~null, c)
        numeric = value.cast("double") if label in ("int", "float") else F.lit(None).cast("double")
        moment = F.date_format(value, "yyyy-MM-dd HH:mm:ss") if label == "datetime" else F.lit(None).cast("string")
        countable = not isinstance(schema[name], (T.MapType, T.VariantType))
        parts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(label).alias("dtype"),
                F.count(F.lit(1)).alias("row_count"),
                F.count(value).alias("non_null_count"),
                (F.approx_count_distinct(value) if countable else F.lit(None).cast("long")).alias("_about"),
                F.min(numeric).alias("min"), F.max(numeric).alias("max"), F.avg(numeric).alias("mean"), F.stddev_samp(numeric).alias("std"),
                (F.median(numeric) if options.median and label in ("int", "float") else F.lit(None).cast("double")).alias("median"),
                F.min(moment).alias("min_date"), F.max(moment).alias("max_date"),
            ).alias(f"_{len(parts)}")
        )
    wide = df.agg(*parts)
    (row,) = wide.collect()
    rows = df.sparkSession.createDataFrame([tuple(r) for r in row], wide.schema[0].dataType if parts else WIDE)
    few = [r["column"] for r in row if r["_about"] is not None and r["_about"] <= SURE * options.max_distinct + 10]
    counted = distinct_counts(df, few, options.max_distinct)
    rows = rows.join(F.broadcast(counted), "column", "left")  # a row for each column
    nulls = F.col("row_count") - F.col("non_null_count")
    low = F.when(F.col("non_null_count") == 0, F.lit(0).cast("long")).otherwise(F.col("distinct_count"))
    pct = F.when(F.col("row_count") > 0, 100.0 * nulls / F.col("row_count")).otherwise(0.0)
    rows = rows.withColumns({"null_count": nulls, "null_pct": pct, "nullable": nulls > 0, "distinct_count": low})
    return rows.select(*COLUMNS)


def distinct_counts(df: DataFrame, names: list[str], cap: int) -> DataFrame:
    """column, distinct_count of columns with at most cap different values that aren't null.

    Meant for columns with few values: each partition sends each of its values once.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column string, distinct_count long")
    counts = values(df, names).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    return counts.where(F.col("distinct_count") <= cap)


def values(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value (as text) of each cell that isn't null, NaN or blank."""
    pairs = [F.struct(F.lit(n).alias("column"), _text(df, n).alias("value")) for n in names]
    cells = df.select(F.explode(F.array(*pairs)).alias("c")).select("c.*")
    return cells.where(~is_null(F.col("value")) & (F.col("value") != "NaN"))


def _text(df: DataFrame, name: str) -> Column:
    kind_ = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return F.to_json(c) if isinstance(kind_, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else c.cast("string")


def top_values(df: DataFrame, names: list[str], k: int = 5, first_by: Column | None = None) -> DataFrame:
    """column, rank, value, n: the k most frequent values of each column; ties by first occurrence, else by value.

    first_by is a column that orders rows. Ranks are limited in each partition before the shuffle.
    """
    pairs = [F.struct(F.lit(n).alias("column"), _text(df, n).alias("value")) for n in names]
    order = first_by if first_by is not None else F.lit(0)
    cells = df.select(order.alias("_at"), F.explode(F.array(*pairs)).alias("c")).select("_at", "c.*")
    cells = cells.where(~is_null(F.col("value")) & (F.col("value") != "NaN"))
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    by = Window.partitionBy("column").orderBy(F.desc("n"), "_at", "value")
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def top_values_of_prefix(df: DataFrame, column: str, order: str, cap: int = 100, k: int = 5) -> DataFrame:
    """rank, value, n as an accumulator counts them that stops at the row in which value cap + 1 first occurs.

    Only first occurrences are ranked, and no more than cap + 1 of them leave a partition.
    """
    cells = df.select(F.col(order).alias("_at"), F.col(column).cast("string").alias("value")).where(~is_null(F.col("value")))
    firsts = cells.groupBy("value").agg(F.min("_at").alias("_first"))
    ranked = firsts.withColumn("_rank", F.row_number().over(Window.orderBy("_first"))).where(F.col("_rank") <= cap + 1)
    stop = ranked.agg(F.max(F.when(F.col("_rank") == cap + 1, F.col("_first"))).alias("_stop"))
    held = cells.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))  # one row
    counted = held.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    by = Window.orderBy(F.desc("n"), "_at")
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("rank", "value", "n")


def to_cells(df: DataFrame, order: str, names: list[str] | None = None) -> DataFrame:
    """row_id, col_ord, column, raw: a row for each value of a table, as text."""
    names = names or [c for c in df.columns if c != order]
    pairs = [F.struct(F.lit(k).alias("col_ord"), F.lit(n).alias("column"), _text(df, n).alias("raw")) for k, n in enumerate(names)]
    return df.select(F.col(order).alias("row_id"), F.explode(F.array(*pairs)).alias("c")).select("row_id", "c.*")


def text_profile(cells: DataFrame, options: Options = Options(), row_count: int | None = None) -> DataFrame:
    """COLUMNS of a table whose values are text, from its cells; values tell the kinds.

    row_count is the table's, where cells don't have a row for each missing value (a key that some
    records lack): what is missing counts as null.
    """
    k = kind(F.col("raw"))
    own = cells.withColumn("_kind", k)
    own = own.withColumns({"_num": number(F.col("raw"), F.col("_kind")), "_date": date_text(F.col("raw"), F.col("_kind"))})
    value = F.when(F.col("_kind") != "null", F.col("raw"))
    total = F.count(F.lit(1)) if row_count is None else F.lit(row_count).cast("long")
    rows = own.groupBy("col_ord", "column").agg(
        merged_kind(F.bit_or(kind_bit(F.col("_kind")))).alias("dtype"),
        total.alias("row_count"),
        F.count(value).alias("non_null_count"), F.approx_count_distinct(value).alias("_about"),
        F.min("_num").alias("min"), F.max("_num").alias("max"), F.avg("_num").alias("mean"), F.stddev_samp("_num").alias("std"),
        (F.median("_num") if options.median else F.lit(None).cast("double")).alias("median"),
        F.min("_date").alias("min_date"), F.max("_date").alias("max_date"),
    )
    # columns whose sketch rules out few values aren't counted further; the list has a row for each column
    few = rows.where(F.col("_about") <= SURE * options.max_distinct + 10).select("column")
    counted = own.where("_kind <> 'null'").join(F.broadcast(few), "column").select("column", "raw").distinct()
    counts = counted.groupBy("column").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(F.broadcast(counts), "column", "left")  # a row for each column
    nulls = F.col("row_count") - F.col("non_null_count")
    pct = F.when(F.col("row_count") > 0, 100.0 * nulls / F.col("row_count")).otherwise(0.0)
    distinct = F.when(F.col("non_null_count") == 0, F.lit(0).cast("long")).when(F.col("_n") <= options.max_distinct, F.col("_n"))
    rows = rows.withColumns({"null_count": nulls, "null_pct": pct, "nullable": nulls > 0, "distinct_count": distinct})
    return rows.select("col_ord", *COLUMNS)


def head_tail(df: DataFrame, order: str, head: int = 5, tail: int = 5) -> DataFrame:
    """part (head or tail), row_id and all columns: the first and last rows; no tail where both would cover all.

    Both ends are limited before anything is sorted as a whole.
    """
    first = df.orderBy(order).limit(head).withColumn("part", F.lit("head"))
    if not tail:
        return first
    # a tail is shown only if there are more rows than head and tail hold together
    ends = df.orderBy(F.desc(order)).limit(head + tail + 1)
    enough = F.count(F.lit(1)).over(Window.partitionBy()) > head + tail
    rank = F.row_number().over(Window.orderBy(F.desc(order)))
    last = ends.withColumns({"_enough": enough, "_rank": rank}).where(F.col("_enough") & (F.col("_rank") <= tail))
    return first.unionByName(last.drop("_enough", "_rank").withColumn("part", F.lit("tail")))
