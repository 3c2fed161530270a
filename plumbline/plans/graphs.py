"""Queries over dependency, history and tree relations made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deps, repo

QUERIES, SQL = {}, {}
NOW = 1_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as packages: every third is declared, each order's first line needs its other lines' parts."""
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    common = [F.lit("npm").alias("ecosystem"), F.col("p_partkey").cast("int").alias("ord"), name.alias("name")]
    declared = part.where("p_partkey % 3 = 0").select(*common, F.lit("^1").alias("constraint"), (F.col("p_partkey") % 2 == 0).alias("dev"), F.lit(False).alias("optional"))
    lock = part.where("p_partkey % 5 <> 0").select(*common, F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), (F.col("p_partkey") % 7 == 0).alias("dev"), F.lit(False).alias("optional"))
    edges = items.select(F.lit("npm").alias("ecosystem"), F.col("l_orderkey").cast("int").alias("ord"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("child"))
    return declared, lock, edges


@query(
    """SELECT 'p' || p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 5 <> 0 THEN '1.' || p_size::VARCHAR END AS resolved, p_partkey % 2 = 0 OR (p_partkey % 7 = 0 AND p_partkey % 5 <> 0) AS dev
    FROM part WHERE p_partkey % 3 = 0"""
)
def dep_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.resolve(*graph(spark, sf_dir)).where("direct").select("name", "resolved", "dev")


@query(
    """SELECT 'p' || p_partkey::VARCHAR AS name, '1.' || p_size::VARCHAR AS resolved, coalesce(n, 0) AS in_edges FROM part
    LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0"""
)
def dep_transitives_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.resolve(*graph(spark, sf_dir)).where("NOT direct").select("name", "resolved", "in_edges")


@query(
    """SELECT rank, name, in_edges FROM (SELECT row_number() OVER (ORDER BY n DESC, name)::INT AS rank, name, n AS in_edges FROM (
      SELECT 'p' || p_partkey::VARCHAR AS name, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 GROUP BY 1)) WHERE rank <= 10"""
)
def dep_in_edges_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.top_transitives(deps.resolve(*graph(spark, sf_dir))).select("rank", "name", "in_edges")


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string")).alias("path")).distinct()


TOUCHED = "(SELECT DISTINCT l_orderkey AS c, 's' || (l_suppkey % 50)::VARCHAR AS path FROM lineitem)"


@query(
    f"""SELECT path, n FROM (SELECT path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, path) AS r FROM {TOUCHED}
    WHERE c IN (SELECT c FROM {TOUCHED} WHERE path = 's7') AND path <> 's7' GROUP BY 1) WHERE r <= 5"""
)
def git_related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.related_files(touched(spark, sf_dir), "s7")


@query(
    f"""SELECT path, other, n, rank FROM (SELECT a.path AS path, b.path AS other, count(*) AS n, row_number() OVER (PARTITION BY a.path ORDER BY count(*) DESC, b.path)::INT AS rank
    FROM {TOUCHED} a JOIN {TOUCHED} b ON a.c = b.c AND a.path <> b.path GROUP BY 1, 2) WHERE rank <= 5"""
)
def git_co_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.co_changes(touched(spark, sf_dir)).select("path", "other", "n", "rank")


@query(f"SELECT path, commits FROM (SELECT path, count(*) AS commits, row_number() OVER (ORDER BY count(*) DESC, path) AS r FROM {TOUCHED} GROUP BY 1) WHERE r <= 10")
def git_active_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.active_files(touched(spark, sf_dir))


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("line_number"), F.concat(F.lit("a"), (F.col("o_custkey") % 20).cast("string")).alias("author"),
        F.unix_timestamp("o_orderdate").alias("ts"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"),
    )


BLAME = "(SELECT o_orderkey AS line_number, 'a' || (o_custkey % 20)::VARCHAR AS author, epoch(o_orderdate)::BIGINT AS ts, 'h' || o_orderkey::VARCHAR AS hash FROM orders)"


@query(
    f"SELECT author, count(*) AS lines, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1)::DOUBLE AS pct, max(ts) AS last_ts, arg_max(hash, (ts, hash)) AS last_commit FROM {BLAME} GROUP BY 1"
)
def git_author_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.author_shares(blame(spark, sf_dir))


@query(
    f"""SELECT count(*) FILTER (d < 7) AS days_7, count(*) FILTER (d >= 7 AND d < 30) AS days_30, count(*) FILTER (d >= 30 AND d < 91) AS days_91, count(*) FILTER (d >= 91 AND d < 365) AS days_365,
      count(*) FILTER (d >= 365) AS older FROM (SELECT ({NOW} - ts) / 86400 AS d FROM {BLAME})"""
)
def git_age_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.age_histogram(blame(spark, sf_dir), NOW)


@query(f"SELECT line_number, author, ts FROM {BLAME} WHERE ts >= 800000000 ORDER BY ts DESC, line_number LIMIT 20")
def git_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.recent_lines(blame(spark, sf_dir), 800_000_000).select("line_number", "author", "ts")


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    mark = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    row = F.expr("cast(row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey) AS bigint)")
    return items.select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 4).alias("hunk"), row.alias("place"), mark.alias("type"), F.lit(10).cast("long").alias("old_start"), F.lit(20).cast("long").alias("new_start"))


DIFF = """(SELECT l_suppkey AS path, l_orderkey % 4 AS hunk, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey) AS place,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END AS type FROM lineitem)"""


@query(
    f"""SELECT path, hunk, place, CASE WHEN type <> '+' THEN 10 + o END AS old_no, CASE WHEN type <> '-' THEN 20 + n END AS new_no FROM (SELECT *,
      coalesce(sum((type <> '+')::INT) OVER w, 0)::BIGINT AS o, coalesce(sum((type <> '-')::INT) OVER w, 0)::BIGINT AS n FROM {DIFF}
      WINDOW w AS (PARTITION BY path, hunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
)
def diff_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.number_diff_lines(diff(spark, sf_dir)).select("path", "hunk", "place", "old_no", "new_no")


@query(f"SELECT path, count(*) FILTER (type = '+') AS added, count(*) FILTER (type = '-') AS removed FROM {DIFF} GROUP BY 1")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.diff_totals(diff(spark, sf_dir))


@query(
    f"""SELECT path, hunk, place, r = 200 AND more AS cut FROM (SELECT path, hunk, place, row_number() OVER w AS r, lead(1) OVER w IS NOT NULL AS more FROM {DIFF}
      WINDOW w AS (PARTITION BY path ORDER BY hunk, place)) WHERE r <= 200"""
)
def diff_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.within_budget(diff(spark, sf_dir), "path", ["hunk", "place"]).select("path", "hunk", "place", "cut")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as folders, customers as files."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    region = r.select(F.col("r_name").alias("path"), F.lit("").alias("parent"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    pair = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 rows by 5
    nation = pair.select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("parent"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    folder = pair.select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("parent"))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".py").otherwise(".txt"))
    file = c.join(F.broadcast(folder), c.c_nationkey == folder.n_nationkey)  # 25 rows
    files = file.select(F.concat_ws("/", "parent", name).alias("path"), "parent", name.alias("name"), F.lit(False).alias("is_dir"), (F.col("c_custkey") * 1000).alias("size"), (F.lit(NOW) - F.col("c_custkey") * 3600).alias("mtime"))
    return region.unionByName(nation).unionByName(files)


NODES = f"""(SELECT r_name AS path, '' AS parent, r_name AS name, true AS is_dir, 0::BIGINT AS size, 0::BIGINT AS mtime FROM region
  UNION ALL SELECT r_name || '/' || n_name, r_name, n_name, true, 0, 0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name || '/' || n_name || '/' || f, r_name || '/' || n_name, f, false, c_custkey * 1000, {NOW} - c_custkey * 3600 FROM
    (SELECT *, c_name || CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.txt' END AS f FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    f"""WITH t AS {NODES} SELECT d.path, count(*) FILTER (NOT f.is_dir AND starts_with(f.path, d.path || '/')) AS n_files,
      coalesce(sum(f.size) FILTER (NOT f.is_dir AND f.parent = d.path), 0)::BIGINT AS bytes, count(*) FILTER (f.parent = d.path) AS n_children FROM t d CROSS JOIN t f WHERE d.is_dir GROUP BY 1"""
)
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.roll_up(nodes(spark, sf_dir))


@query(
    f"""SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS folders, sum(size)::BIGINT AS bytes, count(*) FILTER (NOT is_dir AND mtime >= {NOW - repo.RECENT}) AS recent,
      count(*) FILTER (NOT is_dir AND size > 1048576) AS large FROM {NODES}"""
)
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.tree_totals(nodes(spark, sf_dir), NOW)


@query(f"SELECT path, size FROM {NODES} WHERE NOT is_dir AND mtime >= {NOW - 900000} AND size <= 200000 AND path LIKE '%.py' AND regexp_matches(path, '^[^/]*/[^/]*/Customer[^/]*$')")
def tree_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repo.filter_nodes(nodes(spark, sf_dir), since=NOW - 900_000, max_size=200_000, extensions=["py"], kind="files", dotfiles=False, focus="*/*/Customer*")
    return kept.select("path", "size")


@query(
    f"""SELECT path, shown, last FROM (SELECT path, CASE WHEN NOT is_dir AND r = 11 THEN '… ' || (n - 10)::VARCHAR || ' more' ELSE name END AS shown, lead(name) OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) IS NULL AS last
      FROM (SELECT *, row_number() OVER (PARTITION BY parent, is_dir ORDER BY lower(name), name) AS r, count(*) OVER (PARTITION BY parent, is_dir) AS n FROM {NODES}) WHERE is_dir OR r <= 11)"""
)
def tree_children_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.limit_children(nodes(spark, sf_dir), 10).select("path", "shown", "last")
