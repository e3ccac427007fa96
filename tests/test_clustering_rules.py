"""k range, size score, penalty, selection, binning and silhouette against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering as CL
from tessera.operators import kmeans as KM
from tessera.operators.binning import bin_items


def test_k_candidates_fixture(spark):
    counts = spark.createDataFrame([("s", 100)], "subset string, n long")
    rows = {r["k"]: r for r in CL.k_candidates(counts, n_columns=31).collect()}
    assert sorted(rows) == list(range(2, 20))
    assert rows[2]["min_k"] == 4 and rows[2]["max_k"] == 10
    sizes = {k: round(rows[k]["size_score"], 6) for k in rows}
    assert [sizes[k] for k in (2, 3, 4, 10, 11, 12, 13, 14, 15, 19)] == [0.6, 0.8, 1, 1, 0.8, 0.6, 0.4, 0.2, 0, 0]
    assert rows[2]["penalty"] == pytest.approx(0.001108, abs=1e-6)
    assert rows[10]["penalty"] == pytest.approx(0.027701, abs=1e-6)
    assert rows[19]["penalty"] == pytest.approx(0.1)


def test_select_k_first_argmax(spark):
    cands = spark.createDataFrame([("s", 2, 1.0, 0.0), ("s", 3, 1.0, 0.0), ("s", 4, 1.0, 0.0)],
                                  "subset string, k int, size_score double, penalty double")
    sil = spark.createDataFrame([("s", 2, 0.5), ("s", 3, 0.5), ("s", 4, 0.1)], "subset string, k int, silhouette double")
    sel = {r["k"]: r["selected"] for r in CL.select_k(cands, sil).collect()}
    assert sel == {2: True, 3: False, 4: False}


def test_binning_fixture():
    vecs = np.array([[1, 1, 0, 0], [1, 1, 1, 0], [0, 0, 0, 1], [1, 1, 1, 0], [0, 0, 0, 0]], dtype=float)
    bins = bin_items(list("ABCDZ"), vecs, 0.7).to_dict("records")
    assert [b["members"] for b in bins] == [["A", "B", "D"], ["C"], ["Z"]]
    assert [b["centroid"] for b in bins] == [[1, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]]


def _numpy_silhouette(x, lab):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def test_silhouette_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2, size=(60, 5)).astype(float)
    lab = rng.integers(0, 3, size=60)
    df = spark.createDataFrame([(int(l), [float(v) for v in row]) for row, l in zip(x, lab)], "label int, vec array<double>")
    dv = df.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("wt")).withColumn("all", F.lit(1))
    got = KM.silhouette(dv, "label", by=["all"]).first()["silhouette"]
    assert got == pytest.approx(_numpy_silhouette(x, lab), abs=1e-12)


def test_kmeans_grid_separates_blobs(spark):
    pts = [([0.0, 0.0], 5), ([0.1, 0.0], 5), ([5.0, 5.0], 5), ([5.1, 5.0], 5)]
    dv = spark.createDataFrame([(1, v, w) for v, w in pts], "all int, vec array<double>, wt long")
    best = KM.kmeans_grid(dv, {(1,): [2]}, by=["all"], restarts=3)
    cen, cost = best[((1,), 2)]
    assert cost == pytest.approx(2 * 5 * 0.05 ** 2 * 2, rel=1e-6)
    assert sorted(np.round(cen[:, 0], 2).tolist()) == [0.05, 5.05]


def test_kmeans_does_not_depend_on_layout_or_groups(spark):
    pts = [([0.0, 0.0], 5), ([0.1, 0.0], 5), ([5.0, 5.0], 5), ([5.1, 5.0], 5), ([9.0, 0.0], 2)]
    dv = spark.createDataFrame([(1, v, w) for v, w in pts], "all int, vec array<double>, wt long")
    for df, cells in [(dv, 1), (dv.repartition(3), 10_000), (dv.coalesce(1), 10_000)]:
        best = KM.kmeans_grid(df, {(1,): [2, 3]}, by=["all"], restarts=4, group_cells=cells)
        cen, cost = best[((1,), 3)]
        assert sorted(np.round(cen[:, 0], 2).tolist()) == [0.05, 5.05, 9.0]
        assert cost == pytest.approx(2 * 5 * 0.05 ** 2 * 2, rel=1e-6)


def test_fit_from_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    dv = spark.createDataFrame([([float(v) for v in r], 1 + i % 3) for i, r in enumerate(x)], "vec array<double>, wt long")
    w = np.array([1 + i % 3 for i in range(len(x))], float)
    cen = x[:5].copy()
    for _ in range(4):
        lab = ((x[:, None] - cen[None]) ** 2).sum(-1).argmin(1)
        cen = np.array([np.average(x[lab == c], axis=0, weights=w[lab == c]) for c in range(5)])
    cost = (w * ((x[:, None] - cen[None]) ** 2).sum(-1).min(1)).sum()
    got, got_cost = KM.fit_from(dv, x[:5], 4)
    assert np.allclose(got, cen) and got_cost == pytest.approx(cost)


@pytest.mark.parametrize("tile", [16, 1024])
def test_tiled_silhouette_of_several_models(spark, tile):
    rng = np.random.default_rng(11)
    x = np.unique(rng.integers(0, 3, size=(150, 5)).astype(float), axis=0)
    labs = np.stack([rng.integers(0, 3, len(x)), rng.integers(0, 5, len(x)), np.zeros(len(x), int)], axis=1)
    df = spark.createDataFrame([("s", [float(v) for v in r], 1, [int(v) for v in lab]) for r, lab in zip(x, labs)],
                               "sub string, vec array<double>, wt long, labels array<int>")
    got = {r["model"]: r["silhouette"] for r in KM.silhouette(df, "labels", by=["sub"], tile=tile).collect()}
    assert got[0] == pytest.approx(_numpy_silhouette(x, labs[:, 0]), abs=1e-12)
    assert got[1] == pytest.approx(_numpy_silhouette(x, labs[:, 1]), abs=1e-12) and got[2] == 0.0


def test_fit_or_load_reuses_saved_model(spark, tmp_path):
    from tessera.operators import constrained as CO

    rows = [(i, f"g{i}", i % 2, float(i % 3 == 0), float(i % 5 == 0)) for i in range(30)]
    items = spark.createDataFrame(rows, "game_id long, game_name string, GAME_CAT_GROUP_card_game int, "
                                        "f1 double, f2 double")
    path = str(tmp_path / "model")
    m1, i1 = CO.fit_or_load(items, ["f1", "f2"], path, mode="retrain", restarts=2)
    n1 = m1.count()
    empty = spark.createDataFrame([], items.schema)  # a refit on this would fail: reuse must load
    m2, i2 = CO.fit_or_load(empty, ["f1", "f2"], path, mode="reuse")
    assert m2.count() == n1 and i2.count() == i1.count()
    assert set(i2.columns) >= {"cluster_id", "constraint", "is_subcluster", "created_at"}


def test_squared_silhouette_option_runs(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.1, 0.0, 0), (5.0, 5.0, 1), (5.1, 5.0, 1)], "a double, b double, l int")
    assert 0.9 < KM.silhouette_squared(df, ["a", "b"], "l") <= 1.0


def test_large_basket_folds_fast():
    import time

    rng = np.random.default_rng(0)
    vecs = (rng.random((20_000, 24)) < 0.15).astype(float)
    t0 = time.time()
    bins = bin_items([str(i) for i in range(len(vecs))], vecs, 0.7)
    assert bins["size"].sum() == 20_000 and time.time() - t0 < 30
