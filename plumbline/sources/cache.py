"""Pages kept by their URLs' keys, with an age beyond which they don't count, and rules of robots by host."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cache_key
from ..functions.web import url_host
from .scratch import new_folder

TTL = 3600
PAGES = "key string, url string, html string, cached_at long"


class PageCache:
    """A folder of Parquet files that pages are appended to. The newest page of a key counts, until it is too old."""

    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL):
        self.spark, self.path, self.ttl = spark, path, ttl

    def put(self, pages: DataFrame, now: int) -> None:
        """Add pages (url, html) as of a moment."""
        pages.select(cache_key(F.col("url")).alias("key"), "url", "html", F.lit(now).cast("long").alias("cached_at")).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        newest = Window.partitionBy("key").orderBy(F.desc("cached_at"))
        rows = self.spark.read.schema(PAGES).parquet(self.path)
        return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1 AND html IS NOT NULL").drop("_n")

    def get(self, urls: DataFrame, now: int) -> DataFrame:
        """urls (url) with html: null where nothing fresh is kept. Ages are filtered in the scan."""
        fresh = self.entries().where(F.col("cached_at") > now - self.ttl).select("key", "html")
        return urls.withColumn("key", cache_key(F.col("url"))).join(fresh, "key", "left")

    def delete(self, urls: DataFrame, now: int) -> None:
        """Let URLs count as never kept: an entry without a page supersedes them."""
        self.put(urls.select("url", F.lit(None).cast("string").alias("html")), now)

    def clear(self) -> None:
        """Forget all pages."""
        self.spark.createDataFrame([], PAGES).write.mode("overwrite").parquet(self.path)

    def compact(self) -> None:
        """Rewrite the folder with the newest page of each key only, in files of this writing."""
        kept = new_folder(self.spark, "compacted")
        self.entries().write.parquet(kept)
        self.spark.read.schema(PAGES).parquet(kept).write.mode("overwrite").parquet(self.path)

    def stats(self, now: int) -> DataFrame:
        return self.entries().agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"), F.max(F.lit(now) - F.col("cached_at")).alias("oldest_age"))


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url) with allowed. robots has host and text; a host without a text, or with one that can't be read, allows."""
    seen: dict[str, RobotFileParser] = {}

    def may(url: str, text: str | None) -> bool:
        if not text:
            return True
        if text not in seen:
            seen[text] = RobotFileParser()
            seen[text].parse(text.splitlines())
        return seen[text].can_fetch(agent, url)

    def run(links: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([may(u, t) for u, t in zip(links, texts)])

    own = urls.withColumn("host", url_host(F.col("url"))).join(robots.withColumnRenamed("text", "_rules"), "host", "left")
    return own.withColumn("allowed", F.pandas_udf(run, T.BooleanType())(F.col("url"), F.col("_rules"))).drop("_rules", "host")


def spaced(urls: DataFrame, delay: float = 1.0) -> DataFrame:
    """urls with host and wait: seconds after which each may be fetched, so that a host is asked once in `delay`."""
    own = urls.withColumn("host", url_host(F.col("url")))
    place = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    return own.withColumn("wait", (place - 1) * F.lit(delay))
