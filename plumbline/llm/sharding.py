"""Sharding by jump consistent hashing (Lamping and Veach, 2014): stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_ranges, running_sum, tasks_for

# The published algorithm's multiplier and the width of its random draw.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_RANGE = float(1 << 31)


def jump_buckets(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard (0 to n_shards - 1) of each 64-bit key. A key moves only into shards that are appended."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.float64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live].astype(np.int64)
        state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        drawn = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        jump[live] = np.floor((shard[live] + 1) * (JUMP_RANGE / drawn))
        live = live[jump[live] < n_shards]
    return shard


def stable_key(df: DataFrame, key: str) -> Column:
    """key as a 64-bit number: whole numbers as they are, other types by XXH64; null is key 0's own class, -1."""
    kind = dict(df.dtypes)[key]
    number = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    return F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(number)


def assign_shards(df: DataFrame, key: str, n_shards: int, into: str = "shard") -> DataFrame:
    """Add the shard of each row's key as an int column. No shuffle; all rows and columns stay."""

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(), n_shards).astype(np.int32))

    return df.withColumn(into, shard_of(stable_key(df, key)))


def shard_layout(df: DataFrame, key: str, text: str, n_shards: int) -> DataFrame:
    """Place every row: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null: none), text_crc32 the unsigned CRC-32 of those bytes
    (null: as for an empty text), slot the row's place in its shard, gapless from 0 by ascending key
    (nulls first; rows that share a key by size and checksum), grown_shard the shard among
    n_shards + 1. Rows that repeat a key share its shard and get slots of their own. An empty table
    gives an empty result; other columns are not read. Only numbers are shuffled, never texts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(key),
        stable_key(df, key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(assign_shards(narrow, "_key", n_shards), "_key", n_shards + 1, "grown_shard").drop("_key")
    order = [key, "size", "text_crc32"]
    ranged = in_ranges(placed, order, "shards", tasks_for(df, 1 << 30))
    slots = running_sum(ranged, order, F.lit(1), "slot", ["shard"])
    return slots.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, n_shards: int, path: str) -> None:
    """Write df as Parquet, one folder shard=N for each shard."""
    assign_shards(df, key, n_shards).write.partitionBy("shard").parquet(path)


# DuckDB has no CRC-32: its table is made from the polynomial, then folded over each text's bytes.
_TABLE = (
    "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)
_CRC = (
    "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(t), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)), "
    "lambda c, v: xor(c >> 8, tab[1 + (xor(c, v) & 255)]))"
)
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
j(doc_id, n, state, shard, jump) AS (
  SELECT doc_id, n, (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT FROM d CROSS JOIN (VALUES (16), (17)) AS s(n)
  UNION ALL
  SELECT doc_id, n, state, jump, floor((jump + 1) * ({JUMP_RANGE}::DOUBLE / ((state // 8589934592)::DOUBLE + 1)))::BIGINT FROM (
    SELECT doc_id, n, (state * {JUMP_MULTIPLIER} + 1) % 18446744073709551616 AS state, jump FROM j WHERE jump < n)
), s AS (
  SELECT doc_id, max(shard) FILTER (n = 16) AS shard, max(shard) FILTER (n = 17) AS grown_shard FROM j GROUP BY 1
), c AS (
  SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, xor({_CRC}, 4294967295) AS text_crc32 FROM d CROSS JOIN (SELECT {_TABLE} AS tab)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM c JOIN s USING (doc_id)
"""
