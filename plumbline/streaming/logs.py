"""Log operators on streams: lines as they are written, counts by window with late lines dropped, repeats with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail_lines(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of lines of files as they appear in a folder: source, raw."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", r"\r+$", "").alias("raw"))


def window_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, by, n: rows in each window of event time; rows later than the watermark are dropped."""
    own = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = own.groupBy(F.window(at, window, slide or window), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def session_counts(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, by, n: rows in each run of events that are no more than a gap apart."""
    own = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = own.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def suppress_repeats(stream: DataFrame, threshold: int = 3, window: int = 100) -> DataFrame:
    """source, line_number, raw, suppressed of a stream of source, line_number, raw, key.

    A source's last `window` keys are its state; lines without a key pass and aren't counted. Lines of a
    trigger are taken by line_number.
    """

    def run(source: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0] if state.exists else [], maxlen=window)
        rows = pd.concat(list(frames)).sort_values("line_number")
        marks = []
        for key in rows["key"]:
            if key is None:
                marks.append(False)
                continue
            recent.append(key)
            marks.append(recent.count(key) > threshold)
        state.update((list(recent),))
        yield rows[["source", "line_number", "raw"]].assign(suppressed=marks)

    out = "source string, line_number long, raw string, suppressed boolean"
    return stream.groupBy("source").applyInPandasWithState(run, out, "keys array<string>", "append", GroupStateTimeout.NoTimeout)
