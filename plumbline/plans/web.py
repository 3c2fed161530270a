"""Queries over pages, response headers and JSON, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..functions.shapes import json_digests, json_kind
from ..functions.text import age, cache_key, cell, compact_count, duration_seconds, human_size
from ..operators.html import extract_pages
from ..sources.tabular import records_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is in fewer pieces than there are: a small file, whose rows take long. Large inputs aren't shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
# the entities that occur in the tables' titles; an ampersand's last, as each is resolved once
SHOWN = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({TITLE}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""


@query(f"SELECT page_id, nullif(left(trim({SHOWN}), 200), '') AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.html_title(F.col("html")).alias("title"))


BARE = r"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, length({BARE}) AS n_text FROM pages")
def page_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(web.bare_text(F.col("html"))).cast("long").alias("n_text"))


@query(f"SELECT page_id, length({BARE}) < 200 OR regexp_matches(html, '{web.SHELL}') AS needs_js FROM pages")
def page_needs_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.needs_script(F.col("html")).alias("needs_js"))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'https://' || regexp_replace(url, '^https?://', '') WHEN page_id % 4 = 2 THEN NULL WHEN page_id % 4 = 3 THEN NULL ELSE url END AS url,
      CASE WHEN page_id % 4 < 2 THEN lower(regexp_extract(url, '^[^:]+://([^:/?#]*)', 1)) END AS host FROM pages"""
)
def page_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    given = F.when(k == 1, F.regexp_replace("url", "^https?://", "")).when(k == 2, "ftp://a/b").when(k == 3, "  ").otherwise(F.concat(F.lit(" "), "url"))
    return table(spark, sf_dir, "pages").select("page_id", web.normal_url(given).alias("url"), web.url_host(given).alias("host"))


@query("SELECT page_id, left(sha256(url), 16) AS cache_key FROM pages")
def page_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", cache_key(F.col("url")).alias("cache_key"))


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'xml' WHEN 3 THEN 'binary' ELSE 'text' END AS format FROM pages"""
)
def body_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    type_ = web.content_type(F.when(k == 0, "Text/HTML; charset=utf-8").when(k == 1, "application/vnd.x+json").when(k == 2, "").when(k == 3, "image/png").otherwise("text/plain"))
    body = F.when(k == 2, "<feed><a/></feed>").when(k == 4, "plain words").otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", web.body_format(type_, body).alias("format"))


@query(
    """SELECT user_id, string_agg(h, '|' ORDER BY k) AS shown FROM (SELECT event_id, user_id, unnest(['Content-Type=' || event_type, 'X-RateLimit-Left=' || (event_id % 9)::VARCHAR,
      'Authorization=<redacted>', 'Set-Cookie=sid=<redacted>; Path=/' || event_type]) AS h, unnest([1, 2, 3, 4]) AS k FROM events) GROUP BY event_id, user_id"""
)
def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_headers(table(spark, sf_dir, "events"))


def shown_headers(events: DataFrame) -> DataFrame:
    pairs = {
        "Content-Type": F.col("event_type"), "X-Other": F.lit("gone"), "X-RateLimit-Left": (F.col("event_id") % 9).cast("string"), "Authorization": F.lit("Bearer abc"),
        "Set-Cookie": F.concat(F.lit("sid=secret;  Path=/"), "event_type"),
    }
    headers = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in pairs.items()))
    shown = F.transform(web.kept_headers(headers), lambda h: F.concat_ws("=", h["name"], h["value"]))
    return events.select("user_id", F.array_join(shown, "|").alias("shown"))


@query("SELECT event_id, 'a=<redacted>; HttpOnly, b=<redacted>, flag; Path=/' || event_type AS cookie FROM events")
def cookie_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("a="), F.col("user_id").cast("string"), F.lit("; HttpOnly, b=2=3, flag; Path=/"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", web.redacted_cookie(value).alias("cookie"))


@query("SELECT 'k' AS key, CASE WHEN event_id % 3 = 0 THEN 'integer' WHEN event_id % 3 = 1 THEN 'array' ELSE 'string' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def json_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, '{"k": [1, "x"]}').otherwise('{"k": "text"}')
    rows = e.select(F.try_parse_json(value).alias("v")).select(F.lit("k").alias("key"), json_kind(F.try_variant_get("v", "$.k", "variant")).alias("kind"))
    return rows.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'k' AS key, count(*) AS n, count(DISTINCT (props->>'$.k')::BIGINT) AS different, min((props->>'$.k')::BIGINT) AS least FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records_table("events", table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.try_parse_json("props").alias("v")), 0).rows
    value = F.col("raw").try_cast("long")
    return rows.groupBy(F.col("column").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("different"), F.min(value).alias("least"))


@query(
    """SELECT event_id, '{k: integer}' AS shape, NULL::BIGINT AS array_len, 2 AS depth FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT event_id, '{total: integer, items: array[2] → {k: integer}}', 2, 4 FROM events WHERE event_id % 2 = 1"""
)
def json_array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"total": 2, "items": ['), "props", F.lit(", "), "props", F.lit("]}")))
    return table(spark, sf_dir, "events").select("event_id", json_digests(text).alias("d")).select("event_id", "d.shape", "d.array_len", "d.depth")


@query()
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(dealt(table(spark, sf_dir, "pages"))).select("page_id", "page.title", "page.extractor", "page.content_text", F.round("page.ratio", 3).alias("ratio"), F.size("page.warnings").alias("n_warnings"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(dealt(table(spark, sf_dir, "pages"))).select("page_id", "page.content_markdown")


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN n * 60 WHEN 1 THEN n * 3600 WHEN 2 THEN n * 86400 WHEN 3 THEN n * 604800 WHEN 4 THEN n * 2592000 ELSE NULL END AS seconds
    FROM (SELECT event_id, user_id % 90 AS n FROM events)"""
)
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ["m", "h", "d", "w", "mo", " x"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", duration_seconds(F.concat((F.col("user_id") % 90).cast("string"), unit)).alias("seconds"))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h'
      WHEN s < 604800 THEN (s // 86400)::VARCHAR || 'd' WHEN s < 2419200 THEN (s // 604800)::VARCHAR || 'w' WHEN s < 31536000 THEN (s // 2592000)::VARCHAR || 'mo'
      ELSE (s // 31536000)::VARCHAR || 'y' END AS age FROM (SELECT event_id, (event_id * event_id * 7) % 90000000 AS s FROM events)"""
)
def age_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", age((F.col("event_id") * F.col("event_id") * 7) % 90000000).alias("age"))


@query(
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576)
      ELSE printf('%.2f GB', n / 1073741824) END AS size, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN printf('%.1fk', n / 1000) ELSE printf('%.1fM', n / 1000000) END AS short
    FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 13) AS n FROM orders)"""
)
def size_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") * 13
    return table(spark, sf_dir, "orders").select("o_orderkey", human_size(n).alias("size"), compact_count(n).alias("short"))


@query("SELECT doc_id, CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END AS cell FROM (SELECT doc_id, replace(replace(text, '|', '\\|'), chr(10), ' ') AS t FROM documents)")
def cell_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cell(F.col("text"), 40).alias("cell"))


@query(
    """SELECT event_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN event_id % 3 <> 0 THEN 'low'
      WHEN event_id % 2 = 0 THEN 'medium' ELSE 'unknown' END AS severity FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 END AS value FROM events)"""
)
def dep_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, F.lit("CVSS:3.1/AV:N")).otherwise(((F.col("event_id") % 100) / 10.0).cast("string"))
    label = F.when(F.col("event_id") % 2 == 0, "MODERATE").otherwise("odd")
    return table(spark, sf_dir, "events").select("event_id", web.severity(F.array(value, F.lit("0.1/x")), label).alias("severity"))
