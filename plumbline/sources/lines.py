"""Text files as numbered lines: source, line_number (from 1), raw."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbers import numbered

LINES = "source string, line_number long, raw string"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or more files, numbered within each. Splits are numbered by their place in the file and
    lines within a split by the order in which they are read, so a long file is never sorted as a whole."""
    raw = spark.read.option("lineSep", "\n").text(path)
    own = raw.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", r"\r+$", "").alias("raw"),
    )
    return numbered(own, [F.col("_start"), F.col("_at")], "line_number", ["source"]).select("source", "line_number", "raw")


def lines_of(spark: SparkSession, text: str, source: str = "stdin") -> DataFrame:
    rows = [(source, k, line.rstrip("\r")) for k, line in enumerate(text.removesuffix("\n").split("\n"), 1)] if text else []
    return spark.createDataFrame(rows, LINES)


def window_of(lines: DataFrame, head: int | None = None, tail: int | None = None) -> DataFrame:
    """The first or (stronger) last lines of each source, numbered anew from 1."""
    if tail:
        last = lines.groupBy("source").agg(F.max("line_number").alias("_last"))
        kept = lines.join(last, "source").where(F.col("line_number") > F.col("_last") - tail).drop("_last")
        return kept.withColumn("line_number", F.row_number().over(Window.partitionBy("source").orderBy("line_number")).cast("long"))
    return lines.where(F.col("line_number") <= head) if head else lines


def log_files(root: Path, pattern: str = "*.log", recursive: bool = False) -> list[Path]:
    return sorted(p for p in (root.rglob(pattern) if recursive else root.glob(pattern)) if p.is_file())
