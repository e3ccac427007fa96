"""Range search over packed 0/1 vectors against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import pack_flags
from tessera.operators import hamming as H

SCHEMA = "g string, u array<bigint>"


def pack(flags):
    return [sum(f << i for i, f in enumerate(flags[a : a + 62])) for a in range(0, len(flags), 62)]


def one_hot(rnd, dims):
    """Flags in groups of four with one set, as feature sets have."""
    out = [0] * dims
    for a in range(0, dims - 3, 4):
        out[a + min(3, int(rnd.expovariate(1)))] = 1
    return out


def coins(rnd, dims):
    return [rnd.randrange(2) for _ in range(dims)]


def tables(spark, make, dims, n, seed=1):
    rnd = random.Random(seed)
    left = [(g, make(rnd, dims)) for g in "ab" for _ in range(n)] + [("lonely", make(rnd, dims))]
    right = left[: n // 2] + [(g, make(rnd, dims)) for g in "abc" for _ in range(n)]
    frame = lambda rows: spark.createDataFrame([(g, pack(f)) for g, f in rows], SCHEMA)
    return left, right, frame(left), frame(right).withColumnRenamed("u", "w").withColumn("cnt", F.lit(2))


def dist(a, b):
    return sum(x != y for x, y in zip(a, b))


@pytest.mark.parametrize("make,dims,limit", [(one_hot, 46, H.BROADCAST_BYTES), (one_hot, 100, 0), (coins, 64, H.BROADCAST_BYTES), (coins, 20, 0)])
def test_against_all_pairs(spark, make, dims, limit):
    left, right, lf, rf = tables(spark, make, dims, 30)
    want = Counter((g, tuple(pack(u)), dist(u, w)) for g, u in {(g, tuple(u)) for g, u in left} for h, w in right if g == h)
    got = H.level_counts(lf, rf, dims, ["g"], broadcast_bytes=limit).collect()
    assert {(r.g, tuple(r.u), r.h): r.n for r in got} == {k: 2 * n for k, n in want.items()}
    radius = F.when(F.col("g") == "a", dims // 4).otherwise(dims // 3)
    limit_of = lambda g: dims // 4 if g == "a" else dims // 3
    pairs = sorted({(g, tuple(pack(u)), tuple(pack(w)), dist(u, w)) for g, u in left for h, w in right if g == h and dist(u, w) <= limit_of(g)})
    for find in (H.within, H.indexed_within):
        found = find(lf.withColumn("radius", radius), rf, dims, ["g"], broadcast_bytes=limit).collect()
        assert sorted((r.g, tuple(r.u), tuple(r.w), r.h) for r in found) == pairs


@pytest.mark.parametrize("make", [one_hot, coins])
def test_nearest_and_farthest(spark, make):
    dims = 64
    left, right, lf, rf = tables(spark, make, dims, 20, seed=2)
    by = {(g, tuple(u)): [(dist(u, w), pack(w)) for h, w in right if h == g] for g, u in left}
    near = {(r.g, tuple(r.u)): (r.h, r.w) for r in H.nearest(lf, rf, dims, ["g"], start=2).collect()}
    assert near == {(g, tuple(pack(u))): min(ws) for (g, u), ws in by.items() if ws}
    far = {(r.g, tuple(r.u)): (r.h, r.w) for r in H.farthest(lf, rf, dims, ["g"]).collect()}
    assert far == {(g, tuple(pack(u))): (max(h for h, _ in ws), min(w for h, w in ws if h == max(x for x, _ in ws))) for (g, u), ws in by.items() if ws}
    others = {(r.g, tuple(r.u)): r.h for r in H.nearest(lf, rf, dims, ["g"], others=False).collect()}
    assert others == {(g, tuple(pack(u))): min(h for h, _ in ws if h) for (g, u), ws in by.items() if any(h for h, _ in ws)}


def test_no_group_and_empty(spark):
    left, right, lf, rf = tables(spark, one_hot, 24, 15, seed=3)
    got = H.within(lf.withColumn("radius", F.lit(5)), rf, 24).collect()
    want = {(tuple(pack(u)), tuple(pack(w))) for _, u in left for _, w in right if dist(u, w) <= 5}
    assert {(tuple(r.u), tuple(r.w)) for r in got} == want
    assert {(tuple(r.u), tuple(r.w)) for r in H.indexed_within(lf.withColumn("radius", F.lit(5)), rf, 24, bits=6).collect()} == want
    assert H.level_counts(lf.limit(0), rf, 24, ["g"]).count() == 0
    assert H.nearest(lf, rf.limit(0), 24, ["g"]).count() == 0


def test_packing_flags(spark):
    flags = [[i % 3 == 0, None, i > 4] for i in range(9)]
    df = spark.createDataFrame([(f,) for f in flags], "f array<boolean>")
    got = [r.v for r in df.select(pack_flags([F.get("f", F.lit(j)) for j in range(3)]).alias("v")).collect()]
    assert got == [[sum((1 if x else 0) << j for j, x in enumerate(f))] for f in flags]


def test_state_stays_small(spark):
    """Product-like flags: the rows of a step follow the distinct vectors, not their square."""
    rnd = random.Random(5)
    rows = list({tuple(one_hot(rnd, 32)) for _ in range(3000)})
    df = spark.createDataFrame([("a", pack(r)) for r in rows], SCHEMA).withColumn("cnt", F.lit(1))
    got = H.level_counts(df, df.withColumnRenamed("u", "w"), 32, ["g"])
    assert got.agg(F.sum("n")).first()[0] == len(rows) ** 2 and got.count() < 20 * len(rows)


@pytest.mark.parametrize("by,block", [(["g"], 7), ([], 16_384), (["g"], 16_384)])
def test_wide_radius_compares_all_pairs_without_a_join(spark, monkeypatch, by, block):
    """Wide radii go block by block: no candidate pairs in a join, same pairs, counts and nearest vectors as the index."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "LIST_BLOCK", block)
    monkeypatch.setattr(H, "TILE", (4, 9))
    dims = 64
    assert H.index_share(dims, 20) > 0.3 and H.index_share(dims, 7) < H.SCAN_SHARE < H.index_share(dims, 8)
    _, _, lf, rf = tables(spark, coins, dims, 20, seed=5)
    lf = lf.withColumn("radius", F.lit(30)).unionByName(spark.createDataFrame([(None, [1, 2], 64), ("a", None, 64)], "g string, u array<bigint>, radius int"))
    rf = rf.unionByName(spark.createDataFrame([(None, [1, 2], 2), ("a", None, 2)], "g string, w array<bigint>, cnt int"))
    rows = lambda df, *cols: sorted(map(repr, df.select(*by, *cols).collect()))
    pairs = [H.indexed_within(lf, rf, dims, by, scan_share=s) for s in (0.0, 1e9)]
    assert rows(pairs[0], "u", "w", "h") == rows(pairs[1], "u", "w", "h") != []
    assert "MapInArrow" in (plan := pairs[0]._jdf.queryExecution().sparkPlan().toString()) or "CoGroupsInArrow" in plan
    counts = [H.indexed_within(lf, rf, dims, by, count="cnt", scan_share=s) for s in (0.0, 1e9)]
    assert rows(counts[0], "u", "n") == rows(counts[1], "u", "n") != []
    for others in (True, False):
        known = lf.filter("u IS NOT NULL")
        near = [H.nearest(known, rf, dims, by, others=others, scan_share=s) for s in (0.0, 1e9)]
        assert rows(near[0], "u", "h", "w") == rows(near[1], "u", "h", "w") != []
