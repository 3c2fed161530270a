"""Log queries over lines made from events, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_overprint, log_key, stream_key
from ..operators import logs
from ..streaming.logs import window_counts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# lines as an application would write them: the user is the source, a third of the types repeat
PYTHON_SQL = """SELECT 'user' || (user_id % 7)::VARCHAR AS source, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS line_number,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000 - shop.' || event_type || ' - ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END
  || ' - ' || event_type || ' took ' || (event_id % 50)::VARCHAR || ' ms' AS raw FROM events"""


def python_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return events(spark, sf_dir).selectExpr("event_id", "event_type", "ts", "user_id % 7 AS u").select(
        F.concat(F.lit("user"), F.col("u").cast("string")).alias("source"),
        F.expr("cast(row_number() OVER (PARTITION BY u ORDER BY event_id) AS bigint)").alias("line_number"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - shop."), F.col("event_type"), F.lit(" - "), level, F.lit(" - "), F.col("event_type"),
            F.lit(" took "), (F.col("event_id") % 50).cast("string"), F.lit(" ms"),
        ).alias("raw"),
    )


A = "^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]+)\\s*-\\s*([\\w.]+)\\s*-\\s*(DEBUG|INFO|WARNING|ERROR|CRITICAL)\\s*-\\s*(.+)$"
PARSED_SQL = f"""SELECT source, line_number, regexp_extract(raw, '{A}', 3) AS level, regexp_extract(raw, '{A}', 4) AS message,
  CASE regexp_extract(raw, '{A}', 3) WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS category FROM ({PYTHON_SQL})"""
KEY_SQL = r"regexp_replace(lower({c}), '\b[0-9]+(\.[0-9]+)?\b', '{{N}}', 'g')"
DEDUP_SQL = f"""SELECT *, key IS NOT NULL AND count(*) OVER (PARTITION BY source, key ORDER BY seq RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) > 3 AS suppressed FROM (
  SELECT *, sum(CASE WHEN category = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY line_number) AS seq,
    CASE WHEN category <> 'error' THEN {KEY_SQL.format(c="message")} END AS key FROM ({PARSED_SQL}))"""


@query(f"SELECT source, line_number, level, message, category, 'shop.' || split_part(message, ' ', 1) AS log_source FROM ({PARSED_SQL})")
def log_parse_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(python_lines(spark, sf_dir), "python_logging").select("source", "line_number", "level", "message", "category", "log_source")


@query(
    """SELECT event_id AS line_number, CASE WHEN regexp_matches(raw, '(?i)\\b(error|exception|fatal|critical|fail(ed|ure)?|crash(ed)?|abort(ed)?|panic|segfault|killed|oom)\\b')
      THEN 'error' WHEN regexp_matches(raw, '(?i)\\b(warn(ing)?|deprecated|caution|notice)\\b') THEN 'warning' ELSE 'info' END AS category, raw AS message
    FROM (SELECT event_id, event_type || CASE WHEN event_id % 9 = 0 THEN ' Notice' ELSE '' END || ' props ' || props AS raw FROM events)"""
)
def log_parse_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("event_type"), F.when(F.col("event_id") % 9 == 0, " Notice").otherwise(""), F.lit(" props "), F.col("props"))
    lines = events(spark, sf_dir).select(F.lit("e").alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))
    return logs.parse_lines(lines, "generic").select("line_number", "category", "message")


@query(
    """SELECT event_id AS line_number, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING' END AS level,
      'GET /' || event_type || CASE event_type WHEN 'error' THEN ' 502' WHEN 'signup' THEN ' 404' ELSE ' 200' END AS message,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS category, '10.0.0.' || (user_id % 250)::VARCHAR AS log_source FROM events"""
)
def log_parse_webserver(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "502").when(F.col("event_type") == "signup", "404").otherwise("200")
    raw = F.concat(
        F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(' - - [12/May/2025:10:00:00 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '),
        status, F.lit(' 512 "-" "agent"'),
    )
    lines = e.select(F.lit("w").alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))
    return logs.parse_lines(lines, "webserver").select("line_number", "level", "message", "category", "log_source")


@query(
    """SELECT event_id AS line_number, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level, 'did ' || event_type AS message,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS category, user_id::VARCHAR AS timestamp FROM events"""
)
def log_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    record = F.to_json(F.struct(level.alias("severity"), F.concat(F.lit("did "), "event_type").alias("msg"), F.col("user_id").alias("ts"), F.col("value").alias("x")))
    lines = events(spark, sf_dir).select(F.lit("j").alias("source"), F.col("event_id").alias("line_number"), record.alias("raw"))
    return logs.parse_lines(lines, "json_lines").select("line_number", "level", "message", "category", "timestamp")


@query("SELECT * FROM (VALUES ('json', 'json_lines', 1.0::DOUBLE), ('plain', 'generic', 0.1::DOUBLE), ('python', 'python_logging', 1.0::DOUBLE), ('train', 'training', 1.0::DOUBLE), ('web', 'webserver', 1.0::DOUBLE)) AS t(source, log_format, score)")
def log_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    number = F.col("event_id") + 1
    forms = {
        "json": F.to_json(F.struct("event_type", "user_id")),
        "plain": F.concat(F.lit("a "), "event_type", F.lit(" came")),
        "python": F.concat(F.lit("INFO:shop:"), "event_type"),
        "train": F.concat(F.lit("Epoch "), number.cast("string"), F.lit("/99 - loss="), F.col("value").cast("string")),
        "web": F.concat(F.lit('1.2.3.4 - - [x] "GET /'), "event_type", F.lit(' HTTP/1.1" 200 5')),
    }
    each = F.array(*(F.struct(F.lit(k).alias("source"), v.alias("raw")) for k, v in forms.items()))
    lines = e.select(number.alias("line_number"), F.explode(each).alias("x")).select("line_number", "x.*")
    return logs.detect_formats(lines).select("source", "log_format", F.round("score", 6).alias("score"))


@query(f"SELECT source, line_number, suppressed FROM ({DEDUP_SQL})")
def log_dedup_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_lines(python_lines(spark, sf_dir), "python_logging")
    return logs.suppressed_lines(parsed).select("source", "line_number", "suppressed")


@query(
    f"""WITH d AS ({DEDUP_SQL}), f AS (SELECT source, key, min(line_number) AS first_line FROM d WHERE suppressed GROUP BY 1, 2)
    SELECT d.source, d.key, count(*) AS count, min(line_number) AS first_line, max(line_number) AS last_line FROM d JOIN f ON d.source = f.source AND d.key = f.key
    WHERE line_number >= f.first_line GROUP BY 1, 2 HAVING count(*) > 3"""
)
def log_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = logs.suppressed_lines(logs.parse_lines(python_lines(spark, sf_dir), "python_logging"))
    return logs.repeat_groups(marked).select("source", "key", "count", "first_line", "last_line")


@query()
def log_normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_number"), log_key(F.col("line")).alias("key"))


@query(
    f"""WITH d AS ({DEDUP_SQL}) SELECT source, count(*) AS total_lines, count(*) FILTER (suppressed) AS suppressed_lines,
      count(*) FILTER (category = 'error' AND NOT suppressed) AS errors, count(*) FILTER (category = 'warning' AND NOT suppressed) AS warnings,
      greatest(count(*) FILTER (category = 'error' AND NOT suppressed) - 50, 0) AS overflow_errors,
      greatest(count(*) FILTER (category = 'warning' AND NOT suppressed) - 20, 0) AS overflow_warnings FROM d GROUP BY 1"""
)
def log_caps_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.overflow(logs.suppressed_lines(logs.parse_lines(python_lines(spark, sf_dir), "python_logging")))


@query(
    f"""SELECT source, rank, line_number, message FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_number)::INT AS rank FROM ({DEDUP_SQL})
      WHERE category = 'error' AND NOT suppressed) WHERE rank <= 10"""
)
def log_first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = logs.suppressed_lines(logs.parse_lines(python_lines(spark, sf_dir), "python_logging"))
    return logs.capped(marked, "error", 10).select("source", "rank", "line_number", "message")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(events(spark, sf_dir), "ts", "event_type", "1 day").select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


TRACE_SQL = """SELECT 'app' || (user_id % 5)::VARCHAR AS source, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS line_number,
  CASE WHEN event_id % 11 = 0 THEN 'Traceback (most recent call last):' WHEN event_type = 'error' THEN 'ValueError: bad ' || user_id::VARCHAR
    WHEN event_id % 7 = 0 THEN '' WHEN event_type = 'click' THEN '  File "a.py", line ' || event_id::VARCHAR || ', in f' ELSE event_type END AS raw FROM events"""


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        F.when(F.col("event_id") % 11 == 0, "Traceback (most recent call last):").when(F.col("event_type") == "error", F.concat(F.lit("ValueError: bad "), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 7 == 0, "").when(F.col("event_type") == "click", F.concat(F.lit('  File "a.py", line '), F.col("event_id").cast("string"), F.lit(", in f")))
        .otherwise(F.col("event_type"))
    )
    return events(spark, sf_dir).select(
        F.concat(F.lit("app"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.expr("cast(row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS bigint)").alias("line_number"), raw.alias("raw"),
    )


@query(
    f"""WITH l AS ({TRACE_SQL}), b AS (SELECT *, sum(CASE WHEN raw LIKE 'Traceback%' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_number) AS block FROM l),
    w AS (SELECT *, min(CASE WHEN raw LIKE 'ValueError%' THEN line_number END) OVER p AS x, min(CASE WHEN raw = '' THEN line_number END) OVER p AS z FROM b WHERE block > 0
      WINDOW p AS (PARTITION BY source, block)),
    i AS (SELECT * FROM w WHERE CASE WHEN x IS NOT NULL AND (z IS NULL OR x < z) THEN line_number <= x ELSE z IS NULL OR line_number < z END)
    SELECT source, min(line_number) AS start_line, max(line_number) AS end_line, max(CASE WHEN raw LIKE 'ValueError%' THEN 'ValueError' END) AS exception_type,
      max(CASE WHEN raw LIKE 'ValueError%' THEN substr(raw, 13) END) AS exception_message, least(count(*) FILTER (raw LIKE '  File%'), 5)::INT AS n_frames FROM i GROUP BY source, block"""
)
def log_traceback_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.tracebacks(trace_lines(spark, sf_dir))
    return found.select("source", "start_line", "end_line", "exception_type", "exception_message", F.size("frames").alias("n_frames"))


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(
        F.lit("Epoch "), (F.col("event_id") % 100).cast("string"), F.lit("/100 - loss="), F.when(F.col("event_id") % 97 == 5, "nan").otherwise(((F.col("user_id") * 37) % 1000).cast("string")),
        F.lit(" other: 3 acc: "), (F.col("event_id") % 10).cast("string"),
    )
    return events(spark, sf_dir).select(F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))


LOSS_SQL = "SELECT 'run' || (user_id % 3)::VARCHAR AS source, event_id AS line_number, event_id % 100 AS step, CASE WHEN event_id % 97 = 5 THEN 'nan' ELSE ((user_id * 37) % 1000)::VARCHAR END AS loss, event_id % 10 AS acc FROM events"


@query(f"SELECT source, line_number, step, 'loss' AS name, loss AS value FROM ({LOSS_SQL}) UNION ALL SELECT source, line_number, step, 'acc', acc::VARCHAR FROM ({LOSS_SQL})")
def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.metrics(training_lines(spark, sf_dir)).select("source", "line_number", "step", "name", "value")


@query(
    f"""WITH l AS ({LOSS_SQL}), v AS (SELECT *, loss::DOUBLE AS x FROM l WHERE loss <> 'nan'),
    u AS (SELECT *, coalesce(x > lag(x) OVER (PARTITION BY source ORDER BY line_number), false) AS up FROM v),
    r AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY line_number) AS run FROM u),
    n AS (SELECT *, sum(up::INT) OVER (PARTITION BY source, run ORDER BY line_number) AS length FROM r)
    SELECT source, line_number, 'ERROR' AS level FROM l WHERE loss = 'nan'
    UNION ALL SELECT source, min(line_number), 'WARNING' FROM n WHERE length = 3 GROUP BY source"""
)
def log_metric_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.metric_anomalies(logs.metrics(training_lines(spark, sf_dir)), None).select("source", "line_number", "level")


@query(
    """WITH l AS (SELECT 'u' || (user_id % 4)::VARCHAR AS source, event_id AS line_number, event_type AS k FROM events),
    g AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER (PARTITION BY source ORDER BY line_number) THEN 0 ELSE 1 END AS fresh FROM l),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY line_number) AS run FROM g)
    SELECT source, line_number, row_number() OVER (PARTITION BY source, run ORDER BY line_number) > 1 AS suppressed FROM r"""
)
def lines_run_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("event_type", F.lit("  "), F.col("event_id").cast("string"))
    lines = events(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))
    return logs.run_suppression(lines, stream_key(F.col("raw")), 1).select("source", "line_number", "suppressed")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN props ELSE '' END AS shown FROM events")
def cr_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("50%\r"), "event_type", F.lit("\r\r"))).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit("\r"), "props")).otherwise("\r\r")
    return e.select("event_id", last_overprint(line).alias("shown"))
