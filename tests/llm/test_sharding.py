"""Rendezvous shards against plain Python; slots; moved rows; weights."""

import math
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding as s

SCHEMA = "doc_id long, text string, shard string, slot string"


def brute(key, weights):
    u = lambda k: ((xxhash.xxh64_intdigest(f"{key}#{k}", 42) >> 11) + 0.5) / 2**53
    return min((-math.log(u(k)) / w, k) for k, w in weights.items() if w > 0)[1]


def test_manifest(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7), "a", "b") for i in range(500)]
    rows += [(7, "same", "a", "b")] * 400 + [(None, "x", "a", "b"), (None, None, "a", "b")]
    got = s.shard_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _, _ in rows:
        raw, key = (t or "").encode(), "" if i is None else str(i)
        want[i, len(raw) + 1, zlib.crc32(raw), "key", brute(key, dict.fromkeys(range(16), 1)), brute(key, dict.fromkeys(range(17), 1))] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32))
        assert r.grown_shard in (r.shard, 16)
    for shard in by.values():
        shard.sort()
        assert [x[0] for x in shard] == list(range(len(shard)))
        assert [x[1:] for x in shard] == sorted(x[1:] for x in shard)


def test_weights_and_moves(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    three = s.assign(df, {0: 1.0, 1: 2.0, 2: 0.0, 3: 1.0})
    n = {r.shard: r["count"] for r in three.groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[1] - 10_000) < 400 and abs(n[0] - 5_000) < 300
    fewer = s.assign(three, {0: 1.0, 3: 1.0}, shard="later")
    assert fewer.filter((F.col("shard") != 1) & (F.col("shard") != F.col("later"))).count() == 0


def test_empty(spark):
    assert s.shard_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
