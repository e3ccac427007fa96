"""Scalable k-means++ starts: draws, candidates, weights, costs, layout, subsets."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import kmeans as KM
from tessera.operators import seeding as SE


def blobs(seed, centres=12, n=60, d=6):
    rng = np.random.default_rng(seed)
    mid = rng.uniform(-50, 50, (centres, d))
    size = rng.integers(3, n, centres)  # very different sizes: uniform starts miss the small ones
    return np.vstack([m + rng.standard_normal((s, d)) for m, s in zip(mid, size)])


def frame(spark, x, weight=1):
    return spark.createDataFrame([(v.tolist(), weight) for v in x], "vec array<double>, wt long")


def cost(x, centroids):
    return ((x[:, None] - centroids[None]) ** 2).sum(2).min(1).sum()


def test_draws(spark):
    got = spark.range(200).select(SE.draw(F.col("id"), 3, 4).alias("u")).collect()
    want = [(int(hashlib.md5(f"{i}:3:4".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for i in range(200)]
    assert [r.u for r in got] == want and 0.4 < np.mean(want) < 0.6


def test_candidates_against_brute_force(spark):
    x = blobs(1, 5, 40)
    df = frame(spark, x)
    got = SE.candidates(df.repartition(7), {(): 5}, restarts=2, seed=9, rounds=2).collect()
    keys = {r.key: np.array(r.vec) for r in df.select(SE.vector_key(F.col("vec")).alias("key"), "vec").collect()}
    u = lambda k, *s: (int(hashlib.md5(":".join([k, *map(str, s)]).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    for r in range(2):
        chosen = [(0, min(keys, key=lambda k: (-np.log(u(k, r, 0, 9)), k)))]
        for n in (1, 2):
            d2 = {k: min(((v - keys[c]) ** 2).sum() for _, c in chosen) for k, v in keys.items()}
            total = sum(d2.values())
            chosen += [(n, k) for k in sorted(keys) if u(k, r, n, 9) < 10 * d2[k] / total]
        mine = sorted((c for c in got if c.r == r), key=lambda c: c.candidate)
        assert [(c["round"], c.key) for c in mine] == chosen
        near = [min(range(len(chosen)), key=lambda i: ((v - keys[chosen[i][1]]) ** 2).sum()) for v in keys.values()]
        assert [c.weight for c in mine] == [near.count(i) for i in range(len(chosen))]


def test_no_worse_than_forgy_on_ten_seeds(spark):
    x = blobs(3)
    df = frame(spark, x).persist()
    for seed in range(10):
        ours = SE.starts(df, {(): 12}, restarts=1, seed=seed)[(), 0]
        forgy = KM._seed_table(df, [], 1, 12, seed)[(), 0]
        assert ours.shape == forgy.shape and cost(x, ours) <= cost(x, forgy)


def test_layout_does_not_matter_and_orders_are_nested(spark):
    x = blobs(4)
    one = SE.starts(frame(spark, x).coalesce(1), {(): 9}, restarts=2)
    many = SE.starts(frame(spark, x[::-1]).repartition(13), {(): 9}, restarts=2)
    assert one.keys() == many.keys() and all((one[k] == many[k]).all() for k in one)
    assert not (one[(), 0] == one[(), 1]).all()


def test_weights_and_small_subsets(spark):
    rows = [("a", [0.0, 0.0], 1000), ("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 1), ("b", [5.0, 5.0], 2), ("c", [1.0, 1.0], 1), ("c", [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "s string, vec array<double>, wt long")
    got = SE.starts(df, {("a",): 3, ("b",): 1, ("c",): 2}, by=["s"], restarts=3)
    for r in range(3):
        assert sorted(map(tuple, got[("a",), r])) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
        assert got[("b",), r].tolist() == [[5.0, 5.0]]
        assert sorted(map(tuple, got[("c",), r])) == [(1.0, 1.0), (2.0, 2.0)]
    weight = SE.candidates(df, {("a",): 3}, by=["s"], restarts=1).groupBy("s").agg(F.sum("weight").alias("w")).collect()
    assert {r.s: r.w for r in weight} == {"a": 1002.0, "b": 2.0, "c": 2.0}
    assert SE.starts(df.limit(0), {}, by=["s"], restarts=1) == {}


def test_grid_uses_either_start(spark):
    x = blobs(6)
    df = frame(spark, x)
    a = KM.kmeans_grid(df, {(): [12]}, restarts=2)[(), 12][1]
    b = KM.kmeans_grid(df, {(): [12]}, restarts=2, init="forgy")[(), 12][1]
    assert a <= b
