"""Dependency graphs: declared against locked packages, transitive ones, in-edges, advisories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import package_name
from ..functions.web import severity
from ..sources.manifests import versions_behind
from ..sources.numbers import numbered
from ..sources.scratch import new_folder

SEVERITIES = ("critical", "high", "medium", "low", "unknown")


def key_of(name: Column, ecosystem: Column) -> Column:
    return F.when(ecosystem == "pypi", package_name(name)).otherwise(name)


def first_wins(declared: DataFrame) -> DataFrame:
    """One row for each package: the first that declares it."""
    by = Window.partitionBy("ecosystem", "key").orderBy("ord")
    own = declared.withColumn("key", key_of(F.col("name"), F.col("ecosystem")))
    return own.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def last_wins(lock: DataFrame) -> DataFrame:
    """One row for each locked package, the last, with all versions that occur."""
    own = lock.withColumn("key", key_of(F.col("name"), F.col("ecosystem")))
    row = F.struct("name", "version", "dev", "optional")
    return own.groupBy("ecosystem", "key").agg(F.max_by(row, "ord").alias("r"), F.array_sort(F.collect_set("version")).alias("versions")).select("ecosystem", "key", "r.*", "versions")


def in_edges(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """ecosystem, key, parent (the first that needs it), in_edges, for packages that something needs."""
    own = edges.withColumn("key", key_of(F.col("child"), F.col("ecosystem")))
    known = own.join(packages.select("ecosystem", "key"), ["ecosystem", "key"], "left_semi")
    return known.groupBy("ecosystem", "key").agg(F.min_by("parent", "ord").alias("parent"), F.count(F.lit(1)).alias("in_edges"))


def resolve(declared: DataFrame, lock: DataFrame, edges: DataFrame, include_dev: bool = True, direct_only: bool = False) -> DataFrame:
    """ecosystem, name, declared, resolved, direct, dev, optional, parent, in_edges of all packages.

    Declared packages meet their locked versions by a left join and are for development if either says
    so; locked ones that nobody declares are transitive, by an anti join. Sides are joined by their
    sizes, so small projects broadcast and a registry's worth of them sorts.
    """
    own, locked = first_wins(declared), last_wins(lock)
    if direct_only:
        return own.select("ecosystem", "name", F.col("constraint").alias("declared"), F.lit(None).cast("string").alias("resolved"), F.lit(True).alias("direct"), "dev", "optional", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("in_edges"))
    names = locked.select("ecosystem", "key", F.col("version").alias("resolved"), F.col("dev").alias("_dev"), F.col("optional").alias("_optional"))
    either = lambda a, b: F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    direct = own.join(names, ["ecosystem", "key"], "left").select(
        "ecosystem", "key", "name", F.col("constraint").alias("declared"), "resolved", F.lit(True).alias("direct"), either("dev", "_dev").alias("dev"), either("optional", "_optional").alias("optional")
    )
    transitive = locked.join(own.select("ecosystem", "key"), ["ecosystem", "key"], "left_anti").select(
        "ecosystem", "key", "name", F.lit(None).cast("string").alias("declared"), F.col("version").alias("resolved"), F.lit(False).alias("direct"), "dev", "optional"
    )
    both = direct.unionByName(transitive).join(in_edges(edges, locked), ["ecosystem", "key"], "left")
    both = both.withColumns({"in_edges": F.coalesce("in_edges", F.lit(0)), "parent": F.when(~F.col("direct"), F.col("parent"))}).drop("key")
    return both if include_dev else both.where("NOT dev")


def top_transitives(resolved: DataFrame, k: int = 10) -> DataFrame:
    """The k transitive packages of each ecosystem that most others need, ties by name."""
    by = Window.partitionBy("ecosystem").orderBy(F.desc("in_edges"), "name")
    own = resolved.where("NOT direct").withColumn("rank", F.row_number().over(by))
    return own.where(F.col("rank") <= k).select("ecosystem", "rank", "name", "in_edges")


def with_latest(resolved: DataFrame, latest: DataFrame) -> DataFrame:
    """resolved with latest and outdated; latest is a table of ecosystem, name, latest."""

    def behind(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(versions_behind(zip(a, b))), dtype="object")

    own = resolved.join(latest, ["ecosystem", "name"], "left")
    return own.withColumn("outdated", F.pandas_udf(behind, T.BooleanType())(F.col("resolved"), F.col("latest")))


def zipped(asked: DataFrame, asked_at: str, answers: DataFrame, answers_at: str) -> DataFrame:
    """Both tables' rows by their places in order (from 0, as place): the first asked meets the first answer.

    Places are numbered by ranges of the order, written once, so neither side is sorted in one task; what has no
    counterpart meets nulls.
    """

    def placed(df: DataFrame, at: str) -> DataFrame:
        spark, path = df.sparkSession, new_folder(df.sparkSession, "ranges")
        own = df.repartitionByRange(at).select("*", F.spark_partition_id().alias("_part"))
        own.write.parquet(path)
        own = numbered(spark.read.schema(own.schema).parquet(path), [F.col("_part"), F.col(at)], "_place")
        return own.select((F.col("_place") - 1).alias("place"), *(c for c in df.columns if c != at))

    return placed(asked, asked_at).join(placed(answers, answers_at), "place", "full")


def normal_advisories(raw: DataFrame, details: DataFrame) -> DataFrame:
    """id, severity, summary, fixed_in, url of each package's advisories, one for each id.

    raw has ecosystem, name, vuln_id; details has vuln_id and text, the advisory as JSON. Advisories
    without details have an unknown severity.
    """
    score = "array<struct<score:string>>"
    schema = (
        f"aliases array<string>, summary string, details string, severity {score}, database_specific struct<severity:string>, "
        f"affected array<struct<severity:{score},ranges:array<struct<events:array<struct<fixed:string>>>>>>, references array<struct<type:string,url:string>>"
    )
    known = details.select("vuln_id", F.from_json("text", schema).alias("d"))
    own = raw.dropDuplicates(["ecosystem", "name", "vuln_id"]).join(known, "vuln_id", "left").select("ecosystem", "name", "vuln_id", "d.*")
    first = lambda a: F.get(a, F.lit(0))
    none = F.array().cast("array<string>")
    cve = first(F.filter("aliases", lambda a: a.startswith("CVE-")))
    scores = F.concat(
        F.coalesce(F.transform("severity", lambda s: s["score"]), none),
        F.coalesce(F.flatten(F.transform("affected", lambda a: F.coalesce(F.transform(a["severity"], lambda s: s["score"]), none))), none),
    )
    events = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = first(F.filter(F.transform(events, lambda e: e["fixed"]), lambda f: f.isNotNull() & (f != "")))
    link = first(F.filter("references", lambda r: r["type"].isin("WEB", "ADVISORY")))["url"]
    text = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.trim(F.substring("details", 1, 200)))
    return own.select(
        "ecosystem", "name", F.coalesce(cve, "vuln_id").alias("id"), severity(scores, F.col("database_specific.severity")).alias("severity"),
        F.when(F.coalesce(text, F.lit("")) == "", "(no summary)").otherwise(text).alias("summary"), fixed.alias("fixed_in"), link.alias("url"),
    )


def by_severity(advisories: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Advisories of allowed severities, the worst first, then by name."""
    own = advisories.where(F.col("severity").isin([s.lower() for s in allow])) if allow else advisories
    return own.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "name", "id")
