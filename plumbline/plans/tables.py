"""Profile queries over the star schema, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import date_text, kind, number
from ..operators.profile import Options, head_tail, pick_columns, rows_up_to, text_profile, to_cells, top_values, top_values_of_prefix, typed_profile
from ..plans.sqlguard import run_select

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 4).alias(c) if kind_ == "double" else F.col(c) for c, kind_ in df.dtypes))


PROFILE = ["column", "dtype", "row_count", "null_count", "min", "max", "mean", "std"]


def _numeric_sql(table: str, columns: dict[str, str]) -> str:
    one = """SELECT '{c}' AS "column", '{k}' AS dtype, count(*)::BIGINT AS row_count, (count(*) - count({c}))::BIGINT AS null_count,
      round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c})::DOUBLE, 4) AS mean,
      round(stddev_samp({c}::DOUBLE), 4) AS std FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, k=k, t=table) for c, k in columns.items())


LINEITEM = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float"}
ORDERS = {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "float"}
CUSTOMER = {"c_custkey": "int", "c_nationkey": "int", "c_acctbal": "float"}


@query(_numeric_sql("lineitem", LINEITEM))
def profile_lineitem_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "lineitem")
    return _rounded(typed_profile(df.select(*LINEITEM)).select(*PROFILE))


@query(_numeric_sql("orders", ORDERS))
def profile_orders_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "orders")
    return _rounded(typed_profile(df.select(*ORDERS)).select(*PROFILE))


@query(_numeric_sql("customer", CUSTOMER))
def profile_customer_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "customer")
    return _rounded(typed_profile(df.select(*CUSTOMER)).select(*PROFILE))


@query(
    """SELECT 'l_quantity' AS "column", median(l_quantity) AS median FROM lineitem
    UNION ALL SELECT 'l_extendedprice', median(l_extendedprice) FROM lineitem"""
)
def profile_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "lineitem")
    return typed_profile(df.select("l_quantity", "l_extendedprice"), Options(median=True)).select("column", "median")


@query(
    """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date,
      strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date FROM orders
    UNION ALL SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem"""
)
def profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = read(spark, sf_dir, "orders", "lineitem")
    both = typed_profile(orders.select("o_orderdate")).unionByName(typed_profile(items.select("l_shipdate")))
    return both.select("column", "min_date", "max_date")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) <= 100 THEN count(DISTINCT {c}) END AS distinct_count FROM part"""
        for c in ("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    )
)
def distinct_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "part")
    return typed_profile(df.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")).select("column", "distinct_count")


@query(
    """SELECT "column", rank, value, n FROM (
      SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, min(o_orderkey), value)::INT AS rank
      FROM (SELECT o_orderkey, 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders
            UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders) GROUP BY "column", value) WHERE rank <= 5"""
)
def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "orders")
    return top_values(df, ["o_orderpriority", "o_orderstatus"], 5, F.col("o_orderkey"))


@query(
    """WITH f AS (SELECT user_id::VARCHAR AS value, min(event_id) AS f_at FROM events GROUP BY 1),
      s AS (SELECT f_at FROM (SELECT f_at, row_number() OVER (ORDER BY f_at) AS r FROM f) WHERE r = 101),
      h AS (SELECT event_id, user_id::VARCHAR AS value FROM events WHERE event_id <= coalesce((SELECT f_at FROM s), 9223372036854775807))
    SELECT * FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, min(event_id))::INT AS rank, value, count(*) AS n FROM h GROUP BY value) WHERE rank <= 5"""
)
def topk_overflow_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "events")
    return top_values_of_prefix(df, "user_id", "event_id", 100, 5)


KIND_SQL = """CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'null' WHEN lower(trim({c})) IN ('true', 'false') THEN 'bool'
  WHEN regexp_matches(trim({c}), '^-?[0-9]+$') THEN 'int'
  WHEN regexp_matches(trim({c}), '^-?[0-9]+\\.[0-9]+([eE][+-]?[0-9]+)?$|^-?[0-9]+([eE][+-]?[0-9]+)?$') THEN 'float'
  WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$') THEN 'datetime'
  ELSE 'string' END"""


@query(
    f"""WITH v AS (
      SELECT 'amount' AS "column", CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE (user_id * 2 + 1)::VARCHAR || '.5' END AS raw FROM events
      UNION ALL SELECT 'flag', CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'false' END FROM events
      UNION ALL SELECT 'when', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events
      UNION ALL SELECT 'any', CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 5 = 1 THEN ' ' ELSE user_id::VARCHAR END FROM events
    ), k AS (SELECT "column", raw, {KIND_SQL.format(c="raw")} AS kind FROM v),
    a AS (SELECT "column", list_sort(list_distinct(list(kind) FILTER (kind <> 'null'))) AS kinds, count(*) AS row_count,
      count(*) FILTER (kind = 'null') AS null_count, max(CASE WHEN kind IN ('int', 'float') THEN raw::DOUBLE END) AS max,
      min(CASE WHEN kind = 'datetime' THEN raw END) AS min_date FROM k GROUP BY 1)
    SELECT "column", CASE WHEN len(kinds) = 0 THEN 'null' WHEN len(kinds) = 1 THEN kinds[1] WHEN kinds = ['float', 'int'] THEN 'float' ELSE 'mixed' END AS dtype,
      row_count, null_count, max, min_date FROM a"""
)
def dtype_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    text = e.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.concat((F.col("user_id") * 2 + 1).cast("string"), F.lit(".5"))).alias("amount"),
        F.when(F.col("event_id") % 2 == 0, "True").otherwise("false").alias("flag"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).when(F.col("event_id") % 5 == 1, " ").otherwise(F.col("user_id").cast("string")).alias("any"),
    )
    return text_profile(to_cells(text, "event_id")).select("column", "dtype", "row_count", "null_count", "max", "min_date")


@query(
    """SELECT c AS "column", count(*)::BIGINT AS row_count, count(*) FILTER (v IS NULL)::BIGINT AS null_count,
      round(100.0 * count(*) FILTER (v IS NULL) / count(*), 4)::DOUBLE AS null_pct
    FROM (SELECT unnest(['quality', 'toxic']) AS c, unnest([l.quality, l.toxic]) AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1"""
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "labels")
    joined = docs.select("doc_id").join(labels, "doc_id", "left").select("quality", "toxic")
    return _rounded(typed_profile(joined).select("column", "row_count", "null_count", "null_pct"))


@query(
    """SELECT part, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS z FROM orders)
    CROSS JOIN (SELECT unnest(['head', 'tail']) AS part) WHERE part = 'head' AND a <= 5 OR part = 'tail' AND z <= 5"""
)
def sample_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "orders")
    return head_tail(df, "o_orderkey").select("part", "o_orderkey", "o_orderstatus")


@query(_numeric_sql("(SELECT * FROM orders WHERE o_orderkey <= 1000)", {"o_totalprice": "float"}))
def row_cap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "orders")
    return _rounded(typed_profile(rows_up_to(df, "o_orderkey", 1000).select("o_totalprice")).select(*PROFILE))


@query("SELECT 'l_orderkey' AS \"column\", 'int' AS dtype UNION ALL SELECT 'l_suppkey', 'int' UNION ALL SELECT 'l_quantity', 'float'")
def column_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    (df,) = read(spark, sf_dir, "lineitem")
    options = Options(columns=("l_quantity", "nothing", "l_suppkey", "l_orderkey", "l_tax"), max_columns=3)
    assert pick_columns(df.columns, options) == ["l_orderkey", "l_suppkey", "l_quantity"]
    return typed_profile(df, options).select("column", "dtype")


POINT = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 60"
JOIN = """SELECT n.n_name, r.r_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name"""
CTE = """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
  top AS (SELECT o_custkey, total FROM big WHERE total > 100000) SELECT count(*) AS customers, round(max(total), 2) AS most FROM top"""
RECURSIVE = """WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 40) SELECT n, total FROM t WHERE n % 10 = 0"""
SETS = """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier
  UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 3"""


def _guarded(name: str, sql: str, tables: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_select(spark, sql, dict(zip(tables, read(spark, sf_dir, *tables))))

    run.__name__ = name
    query(sql)(run)


_guarded("sql_point_query", POINT, ["orders"])
_guarded("sql_join_query", JOIN, ["customer", "nation", "region"])
_guarded("sql_cte_query", CTE, ["orders"])
_guarded("sql_recursive_cte", RECURSIVE, [])
_guarded("sql_set_operations", SETS, ["customer", "supplier", "nation"])


@query(
    f"""WITH q AS ({JOIN}), v AS (SELECT unnest(['customers', 'balance']) AS "column", unnest([customers::DOUBLE, balance]) AS x FROM q)
    SELECT "column", count(*)::BIGINT AS row_count, min(x) AS min, max(x) AS max FROM v GROUP BY 1"""
)
def sql_query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ["customer", "nation", "region"]
    result = run_select(spark, JOIN, dict(zip(tables, read(spark, sf_dir, *tables))))
    return typed_profile(result.select("customers", "balance")).select("column", "row_count", "min", "max")


@query(
    f"""SELECT kind, count(*) AS n, max(CASE WHEN kind IN ('int', 'float') THEN v::DOUBLE END) AS max, min(CASE WHEN kind = 'datetime' THEN v END) AS min_date
    FROM (SELECT v, {KIND_SQL.format(c="v")} AS kind FROM (SELECT unnest([event_type, user_id::VARCHAR, strftime(ts, '%Y-%m-%d'), round(value, 2)::VARCHAR, 'TRUE', '', NULL]) AS v FROM events)) GROUP BY 1"""
)
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    each = F.array("event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.format_string("%.1f", F.round("value", 2)), F.lit("TRUE"), F.lit(""), F.lit(None).cast("string"))
    rows = e.select(F.explode(each).alias("v"), F.round("value", 2).alias("_v")).withColumn("kind", kind(F.col("v")))
    rows = rows.withColumn("_max", number(F.when(F.col("v").contains("."), F.col("_v").cast("string")).otherwise(F.col("v")), F.col("kind")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("_max").alias("max"), F.min(date_text(F.col("v"), F.col("kind"))).alias("min_date"))
