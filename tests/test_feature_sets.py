"""Feature sets against dense vectors: preparation, dictionary, distance, cosine, k-means."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import feature_sets as FS
from tessera.operators import features as FE


def sets_frame(spark, rows):
    return spark.createDataFrame(rows, "key long, features array<string>")


def test_preparation_equals_the_flag_columns(spark):
    rnd = random.Random(1)
    cats = ["Card Game", "Dice", "Medical", "Horror", "Trivia", "Own Thing", None]
    langs = [*C.LANGUAGE_DEPENDENCY_MAPPING, "Unspecified", None]
    rows = [(i, f"g{i}", rnd.choice([3, 9, 13, 18, None]), rnd.choice([10, 45, 100, 500, None]), rnd.choice([0.5, 1.2, 2.5, 3.9, 4.8]),
             rnd.uniform(4, 10), rnd.randrange(0, 500), rnd.randrange(9), rnd.randrange(9), 1, 4,
             rnd.choice([None, [], rnd.sample(cats, 3)]), rnd.choice(langs), "a &amp; b") for i in range(300)]
    df = spark.createDataFrame(rows, "game_id long, game_name string, suggested_play_age int, playing_time int, avg_weight double, avg_rating double, "
                               "num_rates int, owned_by int, wished_by int, min_players int, max_players int, categories array<string>, "
                               "language_dependence_description string, description string")
    dense = FE.prepare_features(df)
    names = FE.feature_columns(dense)
    want = {r["game_id"]: sorted(n for n in names if r[n] == 1) for r in dense.collect()}
    got = FS.prepare_feature_sets(df)
    assert {r.game_id: list(r.features) for r in got.collect()} == want and want
    more = FS.prepare_feature_sets(df, lists={"game_name": "NAME"}).select("game_id", "features").collect()
    assert all(f"NAME_g{r.game_id}" in r.features for r in more)


def test_dictionary_and_encoding(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c", None, "é"]), (5, ["a"])]
    df = sets_frame(spark, rows).repartition(3)
    numbers = FS.dictionary(df)
    assert sorted((r.idx, r.feature, r.n) for r in numbers.collect()) == [(0, "a", 2), (1, "b", 1), (2, "c", 1), (3, "é", 1)]
    for limit in (0, 1 << 20):
        got = {r.key: r.idxs for r in FS.encode(df, numbers, "key", broadcast_bytes=limit).collect()}
        assert got == {1: [0, 1], 2: [], 3: [], 4: [2, 3], 5: [0]}
    assert FS.dictionary(df.limit(0)).count() == 0


def test_pairs_against_dense(spark):
    rnd = random.Random(2)
    rows = [(sorted(rnd.sample(range(30), rnd.randrange(0, 12))), sorted(rnd.sample(range(30), rnd.randrange(0, 12)))) for _ in range(100)] + [([], []), ([], [1])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for r in df.select("a", "b", FS.distance(F.col("a"), F.col("b")).alias("d"), FS.cosine(F.col("a"), F.col("b")).alias("c")).collect():
        x, y = np.zeros(30), np.zeros(30)
        x[r.a], y[r.b] = 1, 1
        assert r.d == math.sqrt(((x - y) ** 2).sum())
        assert abs(r.c - (x @ y / math.sqrt(x.sum() * y.sum()) if x.any() and y.any() else 0.0)) < 1e-12


def lloyd(x, cen, steps):
    for _ in range(steps):
        lab = np.round(((x[:, None] - cen[None]) ** 2).sum(2), 9).argmin(1)
        cen = np.array([x[lab == c].mean(0) if (lab == c).any() else cen[c] for c in range(len(cen))])
    d2 = np.round(((x[:, None] - cen[None]) ** 2).sum(2), 9)
    return d2.argmin(1), d2.min(1), cen


@pytest.mark.parametrize("cells,limit", [(10**6, 1 << 20), (0, 1 << 20), (0, 0)])
def test_kmeans_against_dense(spark, cells, limit):
    rnd = random.Random(3)
    pools = [list(range(0, 15)), list(range(10, 30)), list(range(25, 40))]
    sets = [sorted(rnd.sample(pools[i % 3], rnd.randrange(1, 8))) for i in range(90)] + [[], [], [39]] + [[0, 1, 2]] * 40
    x = np.zeros((len(sets), 40))
    for i, s in enumerate(sets):
        x[i, s] = 1
    df = spark.createDataFrame(list(enumerate(sets)), "key long, idxs array<bigint>").repartition(4)
    first = [0, 1, 2, 90]
    starts = spark.createDataFrame([(c, sets[i]) for c, i in enumerate(first)], "cid int, idxs array<bigint>")
    labels, centroids = FS.kmeans_sets(df, starts, 40, 4, tolerance=-1.0, cells=cells, broadcast_bytes=limit)
    lab, d2, cen = lloyd(x, x[first], 4)
    got = {r.key: (r.cid, r.d2) for r in labels.collect()}
    assert [got[i][0] for i in range(len(sets))] == lab.tolist()
    assert np.allclose([got[i][1] for i in range(len(sets))], d2)
    table = np.zeros((4, 40))
    for r in centroids.collect():
        table[r.cid, r.idx] = r.value
    assert np.allclose(table, cen)


def test_large_vocabulary(spark):
    """100 000 values through dictionary, encoding, distance and k-means; nothing caps them."""
    n = 100_000
    df = spark.range(20_000).select(F.col("id").alias("key"), F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda j: F.format_string("v%06d", F.pmod(F.col("id") * 5 + j * 10_007, F.lit(n)))).alias("features"))
    numbers = FS.dictionary(df)
    size = numbers.count()
    assert size == df.select(F.explode("features")).distinct().count() and size > 90_000
    encoded = FS.encode(df, numbers, "key")
    assert encoded.agg(F.sum(F.size("idxs"))).first()[0] == 200_000
    starts = encoded.orderBy("key").limit(3).select((F.col("key")).cast("int").alias("cid"), "idxs")
    labels, _ = FS.kmeans_sets(encoded, starts, size, 2, cells=0)
    assert labels.count() == 20_000


def test_a_relation_too_large_to_broadcast_is_not_broadcast_by_spark_either(spark):
    """Spark takes a table for as large as its files, and a replicated one for no more."""
    from tessera.operators.joins import blocked_join, size_checked_broadcast

    left = spark.range(50).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    met = blocked_join(left, right, ["k"], "v", limit=0)
    assert "Broadcast" not in met._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.k, r.v, r.w) for r in met.collect()) == sorted((v % 5, v, v % 5 * 2) for v in range(50))
    large, few = size_checked_broadcast(right, rows=4)
    assert not few and "Broadcast" not in left.join(large, "k")._jdf.queryExecution().sparkPlan().toString()


def test_matrix_is_fetched_in_parts_and_destroyed(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    sizes, ended = [], []
    monkeypatch.setattr(FS, "FETCH_CELLS", 6)
    frame = type(spark.range(1))
    fetch, destroy = frame.toArrow, Broadcast.destroy
    monkeypatch.setattr(frame, "toArrow", lambda df: (sizes.append((t := fetch(df)).num_rows), t)[1])
    monkeypatch.setattr(Broadcast, "destroy", lambda b, blocking=False: (ended.append(1), destroy(b, blocking))[1])
    sets = spark.createDataFrame([(i, [i % 6, (i * i + 1) % 6]) for i in range(24)], "key long, idxs array<bigint>")
    starts = sets.filter("key < 4").select(F.col("key").cast("int").alias("cid"), "idxs")
    labels, _ = FS.kmeans_sets(sets, starts, 6, 2, tolerance=-1.0)
    got = {r.key: (r.cid, r.d2) for r in labels.collect()}
    assert max(sizes) <= 6 and len(ended) == 2
    joined, _ = FS.kmeans_sets(sets, starts, 6, 2, tolerance=-1.0, cells=0)
    assert got == {r.key: (r.cid, r.d2) for r in joined.collect()}
