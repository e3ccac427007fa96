"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a pseudo-random cost ``-ln(u) / weight`` with ``u`` from the XXH64 of
``key#shard``; a record goes to its cheapest shard. The choice depends on nothing but the key
and the shards, each shard gets rows in proportion to its weight, and one shard more takes rows only
into itself (one less gives away only its own).

Slots number the rows of each shard from 0 without gaps, in order of (doc_id, size, crc). They come
from one range shuffle of the slim rows (text is left behind in the scan) and a written table:
the position inside a sorted partition, plus the number of the shard's rows in earlier partitions,
which is a window over one small row per (partition, shard). The range key ends in a row number,
so that equal rows spread over partitions, and no shard is gathered in one task.

Defined cases: a null key counts as the empty text, null text as no bytes (size 1, crc 0); equal
keys share a shard; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stage

SHARDS = 16
SCALE = float(1 << 53)


def cost(key: Column, shard: int, weight: float = 1.0) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"#{shard}"))), 11)
    return -F.log((bits.cast("double") + 0.5) / SCALE) / weight


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a record key (text) among weighted shards; shards of weight 0 get nothing."""
    costs = [F.struct(cost(key, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in weights.items() if w > 0]
    return F.array_min(F.array(*costs))["shard"]


def assign(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row."""
    return docs.withColumn(shard, rendezvous(F.coalesce(F.col(key).cast("string"), F.lit("")), weights))


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Slim ``rows`` with a ``slot``, gapless from 0 within each ``shard``, in the given order."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, "tie").sortWithinPartitions("shard", *order, "tie")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(dealt.select(*rows.columns, F.spark_partition_id().alias("part"), local.alias("at")), "shard-rows")
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(counts.select("part", "shard", (before - F.col("first")).alias("offset")), "shard-offsets")
    return placed.join(offsets, ["part", "shard"]).select(*rows.columns, (F.col("at") + F.col("offset")).cast("long").alias("slot"))


def shard_manifest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, {s: 1.0 for s in range(shards)}).alias("shard"),
        rendezvous(key, {s: 1.0 for s in range(shards + 1)}).alias("grown_shard"),
    )
    out = slots(slim, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
