"""Streaming queries, run over a finite stream of events to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import log_key
from ..sources.scratch import new_folder
from ..streaming.logs import session_counts, suppress_repeats, tail_lines, window_counts

QUERIES, SQL = {}, {}


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a finite stream gives, as files; they and its state lie in the session's shared folder."""
    spark = stream.sparkSession
    state, out = new_folder(spark, f"{name}-state"), new_folder(spark, name)
    if mode == "complete":  # each batch replaces what the one before has said
        put = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete")
    else:
        put = stream.writeStream.format("parquet").option("path", out).outputMode(mode)
    put.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counts = drained(window_counts(stream, "ts", "event_type", "1 day"), "event_window", "complete")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES["stream_event_window"] = stream_event_window
SQL["stream_event_window"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a type's events with no gap of an hour; a second, later file of one event closes all of them."""
    counts = drained(session_counts(events_stream(spark, sf_dir), "ts", "event_type", "1 hour"), "sessions", "complete")
    return counts.groupBy("event_type").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").cast("long").alias("n"))


QUERIES["stream_sessions"] = stream_sessions
SQL["stream_sessions"] = """SELECT event_type, sum(fresh)::BIGINT AS sessions, count(*) AS n FROM (SELECT event_type,
  CASE WHEN lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events) GROUP BY 1"""


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines suppressed by state: a source's keys in its last 100 lines."""
    own = events_stream(spark, sf_dir).select(
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("source"), F.col("event_id").alias("line_number"), F.col("event_type").alias("raw"),
        log_key(F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string"))).alias("key"),
    )
    return drained(suppress_repeats(own), "repeats").select("source", "line_number", "suppressed")


QUERIES["stream_repeats"] = stream_repeats
SQL["stream_repeats"] = """WITH l AS (SELECT 'u' || (user_id % 4)::VARCHAR AS source, event_id AS line_number, event_type AS key, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq FROM events)
  SELECT source, line_number, count(*) OVER (PARTITION BY source, key ORDER BY seq RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) > 3 AS suppressed FROM l"""


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files as a stream finds them in a folder."""
    folder = new_folder(spark, "tailed")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nations.select(F.concat("n_name", F.lit(" "), F.col("n_nationkey").cast("string"), F.lit("\r")).alias("value")).write.text(folder)
    return drained(tail_lines(spark, folder).select("raw"), "tail")


QUERIES["stream_tail"] = stream_tail
SQL["stream_tail"] = "SELECT n_name || ' ' || n_nationkey AS raw FROM nation"
