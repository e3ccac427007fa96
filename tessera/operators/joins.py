"""Equi-joins whose key may be hot, with broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.session import materialise

#: Bytes of Parquet files up to which a relation is broadcast (packed vectors and numbers
#: take a few times as much in memory), and its rows at most: files of repeated values are small.
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 200_000
SALT_BUCKETS = 32


def size_checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The relation as a written table, with a broadcast hint only if its files have at most
    ``limit`` bytes and it has at most ``rows`` rows (equal values shrink files, not memory).

    Any other gets a merge hint: Spark too would go by the files' size and broadcast it on its own."""
    seen = Observation()
    df, size = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), "join-side")
    return (F.broadcast(df), True) if size <= limit and seen.get["n"] <= rows else (df.hint("merge"), False)


def blocked_join(left: DataFrame, right: DataFrame, on: list[str], left_vec: str,
                 limit: int = BROADCAST_BYTES, buckets: int = SALT_BUCKETS) -> DataFrame:
    """Equi-join where one key value may hold a large share of both sides.

    Small right side (bytes checked): broadcast, no shuffle of the hot key. Otherwise
    the left rows get a salt from their vector and the right side is replicated over all
    salts, so one hot key is spread over ``buckets`` tasks."""
    r, small = size_checked_broadcast(right, limit)
    return left.join(r, on) if small else salted_join(left, r, on, left_vec, buckets)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], left_vec: str, buckets: int = SALT_BUCKETS) -> DataFrame:
    """Equi-join with the left rows of a key dealt over ``buckets`` tasks by the hash of a column.

    The merge hint keeps Spark from broadcasting the right side: it takes the replicated rows for no
    more than the table's files."""
    ls = left.withColumn("__salt", F.pmod(F.xxhash64(F.col(left_vec)), F.lit(buckets)))
    rs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return ls.join(rs.hint("merge"), on + ["__salt"]).drop("__salt")
