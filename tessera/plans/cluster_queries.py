"""Registered clustering queries: profiles, descriptions, silhouette, k selection, k-means,
constrained clustering, projection, centroid assignment, cosine similarity, binning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.vectors import cosine
from tessera.operators import clustering as CL
from tessera.operators import kmeans as KM
from tessera.operators.binning import basket_bins as bin_baskets
from tessera.operators import constrained as CO
from tessera.operators import seeding
from tessera.operators.features import feature_columns
from tessera.operators.projection import pca_projection as project
from tessera.plans import sqlgen as S
from tessera.plans.rec_queries import CONSTRAINT, DIFFICULTY_ORDER, clustered
from tessera.session import cut_lineage, shared_path
from tessera.sources.tables import read_table

ROUND = 6
SUBSET = "subset"


def _items(spark, sf):
    items, members = clustered(spark, sf)
    return items, members, feature_columns(items)


def _fixed_info(items: DataFrame) -> DataFrame:
    """Cluster info of the deterministic clustering: card-game clusters are subclusters."""
    parent = CONSTRAINT.replace(C.CATEGORY_GROUP_PREFIX + "_", "")
    sub = F.col("cluster") % F.lit(len(DIFFICULTY_ORDER))
    is_sub = F.col("cluster") >= F.lit(len(DIFFICULTY_ORDER))
    return items.select("cluster").distinct().select(
        "cluster",
        F.when(is_sub, F.format_string(f"{parent}_subcluster_%d", sub))
        .otherwise(F.format_string("unconstrained_cluster_%d", sub)).alias("constraint"),
        F.when(is_sub, F.lit(parent)).alias("parent_constraint"),
        is_sub.alias("is_subcluster"),
        sub.cast("int").alias("subcluster_id"))


def cluster_profile(spark, sf):
    items, _, feats = _items(spark, sf)
    p = CL.cluster_profile(items.withColumnRenamed("cluster_id", "cluster"), feats)
    return p.select("cluster", "count", F.array_join("top_features", ", ").alias("top_features"),
                    F.array_join("sample", " | ").alias("sample"))


def cluster_description(spark, sf):
    items, _, feats = _items(spark, sf)
    it = items.withColumnRenamed("cluster_id", "cluster")
    d = CL.describe_clusters(CL.cluster_profile(it, feats), _fixed_info(it))
    return d.select("cluster", "description", "constraint", "is_subcluster", "parent_constraint", "count")


def silhouette(spark, sf):
    items, _, feats = _items(spark, sf)
    dv = KM.distinct_vectors(items, feats, ["cluster_id"]).withColumn("all", F.lit(1))
    s = KM.silhouette(dv, "cluster_id", by=["all"])
    return s.select(F.round("silhouette", ROUND).alias("silhouette"))


def _subsets(items: DataFrame) -> DataFrame:
    """rows of each constraint subset (taken from the full table), remainder otherwise."""
    return CO.split_by_constraints(items, C.CONSTRAINT_COLUMNS)


def k_candidates(spark, sf):
    items, _, feats = _items(spark, sf)
    counts = _subsets(items).groupBy(SUBSET).agg(F.count(F.lit(1)).alias("n"))
    kc = CL.k_candidates(counts, n_columns=len(feats) + 1)
    return kc.select(SUBSET, "n", "k", "min_k", "max_k", F.round("size_score", ROUND).alias("size_score"),
                     F.round("penalty", ROUND).alias("penalty"))


def _seed_labels(items: DataFrame, feats, kc: DataFrame):
    """Per subset and k: each distinct vector's nearest of the subset's first k distinct vectors
    (ordered by first occurrence) — a deterministic one-step clustering for every k."""
    dv = KM.distinct_vectors(_subsets(items), feats, [SUBSET])
    first = _subsets(items).groupBy(SUBSET, F.array(*[F.col(f"`{f}`").cast("double") for f in feats]).alias("vec")) \
        .agg(F.min("game_id").alias("first_id"))
    ks = {}
    for r in kc.groupBy(SUBSET).agg(F.collect_list("k").alias("ks")).collect():
        ks[(r[SUBSET],)] = sorted(r["ks"])
    k_max = max(max(v) for v in ks.values())
    seeds = (first.withColumn("pos", F.row_number().over(Window.partitionBy(SUBSET).orderBy("first_id")))
             .filter(F.col("pos") <= k_max).collect())
    per = {}
    for r in seeds:
        per.setdefault((r[SUBSET],), []).append((r["pos"], r["vec"]))
    cents, order = {}, {}
    for key, rows in per.items():
        arr = np.array([v for _, v in sorted(rows)], dtype=np.float64)
        kl = [k for k in ks.get(key, []) if k <= len(arr)]
        cents[key] = [arr[:k] for k in kl]
        order[key] = kl
    labelled = KM.assign(dv, cents, by=[SUBSET], out="labels")
    return labelled, order


def select_k(spark, sf):
    items, _, feats = _items(spark, sf)
    counts = _subsets(items).groupBy(SUBSET).agg(F.count(F.lit(1)).alias("n"))
    kc = cut_lineage(CL.k_candidates(counts, n_columns=len(feats) + 1))
    labelled, order = _seed_labels(items, feats, kc)
    sil = KM.silhouette(labelled, "labels", by=[SUBSET])
    kmap = spark.createDataFrame([(key[0], i, k) for key, kl in order.items() for i, k in enumerate(kl)],
                                 f"{SUBSET} string, model int, k int")
    sil = sil.join(kmap, [SUBSET, "model"]).select(SUBSET, "k", F.round("silhouette", 9).alias("silhouette"))
    sel = CL.select_k(kc, sil)
    return sel.select(SUBSET, "k", F.round("silhouette", ROUND).alias("silhouette"),
                      F.round("score", ROUND).alias("score"), "selected")


def kmeans_step(spark, sf):
    """One Lloyd step from given centroids (the deterministic clusters' means): assignment to
    the nearest (ties -> lowest id), then per cluster: size, squared error, centroid move."""
    items, _, feats = _items(spark, sf)
    vec = F.array(*[F.col(f"`{f}`").cast("double") for f in feats])
    x = items.select("game_id", "cluster_id", vec.alias("vec"))
    old = KM.mean_vectors(x, "cluster_id").withColumnRenamed("cluster_id", "cid")
    table = KM.centroid_table(old, "cid")
    nc = KM.nearest_centroid_expr(F.col("vec"), F.col("centroids"))
    a = x.crossJoin(F.broadcast(table)).withColumn("nc", nc).withColumn("cid", F.get("ids", F.col("nc.cid"))).drop("centroids", "ids")
    agg = a.groupBy("cid").agg(F.count(F.lit(1)).alias("n"),
                               F.sum(F.col("nc.distance") * F.col("nc.distance")).alias("sse"))
    new = KM.mean_vectors(a, "cid", out="m")
    from tessera.functions.vectors import euclidean
    return agg.join(new, "cid").join(old, "cid").select(
        "cid", "n", F.round("sse", ROUND).alias("sse"), F.round(euclidean(F.col("m"), F.col("c")), ROUND).alias("moved"))


def model_roundtrip(spark, sf):
    """Save the cluster model (a first version of half the members, then all of them) in the shared
    folder and load what is published: the members of the newest version, with their cluster's info."""
    _, members, _ = _items(spark, sf)
    members = members.select("cluster_id", F.col("game_name").alias("item_key"))
    info = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "constraint", F.format_string("cluster_%d", F.col("cluster_id")))
    path = shared_path(spark, "cluster-model")
    CO.save_model(members.filter(F.pmod(F.xxhash64("item_key"), F.lit(2)) == 0), info, path)
    CO.save_model(members, info, path)
    got, got_info = CO.load_model(spark, path)
    return got.join(got_info.drop("created_at"), "cluster_id").select("cluster_id", "item_key", "constraint", "count")


def _embeddings(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def model_reuse(spark, sf):
    """The reuse rule: a published model is loaded, not fitted again."""
    items, members, feats = _items(spark, sf)
    members = members.select("cluster_id", F.col("game_name").alias("item_key"))
    info = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "constraint", F.format_string("cluster_%d", F.col("cluster_id")))
    path = shared_path(spark, "reused-model")
    CO.save_model(members, info, path)
    got, got_info = CO.fit_or_load(items, feats, path, mode="reuse")
    return got.join(got_info.drop("created_at"), "cluster_id").select("cluster_id", "item_key", "constraint", "count")


def nearest_centroid(spark, sf):
    e = _embeddings(spark, sf)
    table = KM.centroid_table(KM.mean_vectors(e, "label"), "label")
    nc = KM.nearest_centroid_expr(F.col("vec"), F.col("centroids"))
    return e.crossJoin(F.broadcast(table)).select("vec_id", nc.alias("n"), "ids").select(
        "vec_id", F.get("ids", F.col("n.cid")).alias("nearest"), F.round(F.col("n.distance"), ROUND).alias("distance"))


def cosine_similarity(spark, sf):
    """Cosine similarity of each embedding to its label's mean vector (zero vector -> 0)."""
    e = _embeddings(spark, sf)
    cen = KM.mean_vectors(e, "label")
    return e.join(cen, "label").select("vec_id", F.round(cosine(F.col("vec"), F.col("c")), ROUND).alias("cosine"))


FIT_STEPS = 4
PCA_ROUND = 4


def kmeans_fit(spark, sf):
    """k-means on embeddings: ``FIT_STEPS`` Lloyd steps from the first vector of every label, then
    each vector's cluster and its squared distance."""
    e = _embeddings(spark, sf)
    firsts = e.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec")).orderBy("label").collect()  # k rows
    dv = e.groupBy("vec").agg(F.count(F.lit(1)).alias("wt"))
    cen, _ = KM.fit_from(dv, np.array([r["vec"] for r in firsts]), FIT_STEPS)
    table = spark.createDataFrame([(cen.tolist(),)], "centroids array<array<double>>")  # one row
    near = KM.nearest_centroid_expr(F.col("vec"), F.col("centroids"))
    return e.crossJoin(F.broadcast(table)).select("vec_id", near.alias("n")).select(
        "vec_id", F.col("n.cid").alias("cluster"), F.round(F.col("n.distance"), ROUND).alias("distance"))


SEED_K, SEED_RESTARTS, SEED_ROUNDS = 8, 2, 3


def kmeans_seeding(spark, sf):
    """Candidates of the scalable k-means++ start over the distinct embeddings, with the number of
    vectors nearest to each; draws go by the smallest id of a vector."""
    dv = _embeddings(spark, sf).groupBy("vec").agg(F.count(F.lit(1)).alias("wt"), F.min("vec_id").alias("id"))
    found = seeding.candidates(dv, {(): SEED_K}, restarts=SEED_RESTARTS, rounds=SEED_ROUNDS, key=F.col("id"))
    return found.select("r", "candidate", "round", F.col("key").cast("long").alias("vec_id"), F.col("weight").cast("long").alias("weight"))


def constrained_clusters(spark, sf):
    items, _, feats = _items(spark, sf)
    members, info = CO.constrained_clusters(items, feats, C.CONSTRAINT_COLUMNS, key="game_name", order="game_id")
    return members.join(info.select("cluster_id", "constraint"), "cluster_id")


def pca_projection(spark, sf):
    """Cluster centroids on two principal components, without the axes' arbitrary signs."""
    items, _, feats = _items(spark, sf)
    proj, ratio = project(items, feats, "cluster_id")
    return proj.groupBy("cluster_id").agg(
        F.round(F.abs(F.avg("pc1")), PCA_ROUND).alias("abs_pc1"), F.round(F.abs(F.avg("pc2")), PCA_ROUND).alias("abs_pc2"),
        F.count(F.lit(1)).alias("n")) \
        .withColumn("explained_1", F.round(F.lit(float(ratio[0])), PCA_ROUND)) \
        .withColumn("explained_2", F.round(F.lit(float(ratio[1])), PCA_ROUND))


def basket_bins(spark, sf):
    """Leader binning of each order's items (games joined through line items, table order)."""
    items, _, feats = _items(spark, sf)
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"),
                                                  F.col("l_partkey").alias("game_id"))
    basket = li.join(items.select("game_id", "game_name", *[F.col(f"`{f}`") for f in feats]), "game_id")
    return bin_baskets(basket, feats, basket_col="basket", order_col="game_id", name_col="game_name")


QUERIES = {
    "cluster_profile": cluster_profile,
    "cluster_description": cluster_description,
    "silhouette": silhouette,
    "k_candidates": k_candidates,
    "select_k": select_k,
    "kmeans_step": kmeans_step,
    "model_roundtrip": model_roundtrip,
    "model_reuse": model_reuse,
    "nearest_centroid": nearest_centroid,
    "cosine_similarity": cosine_similarity,
    "kmeans_fit": kmeans_fit,
    "kmeans_seeding": kmeans_seeding,
    "constrained_clusters": constrained_clusters,
    "pca_projection": pca_projection,
    "basket_bins": basket_bins,
}


# ------------------------------------------------------------------ oracle side
def _feat_list(cast="DOUBLE"):
    return "[" + ", ".join(S.ident(n) for n in S.feature_names_in_order()) + f"]::{cast}[]"


def _kmeans_fit_sql(emb: str) -> str:
    near = "arg_min(c.cid, struct_pack(d := list_distance(e.vec, c.c), i := c.cid))"
    ctes = [emb, "f0 AS (SELECT label, arg_min(vec, vec_id) AS c FROM e GROUP BY label)",
            "c0 AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cid, c FROM f0)"]
    for i in range(FIT_STEPS):
        ctes += [f"a{i} AS (SELECT e.vec_id, any_value(e.vec) AS vec, {near} AS cid FROM e, c{i} c GROUP BY e.vec_id)",
                 f"m{i} AS (SELECT cid, j, AVG(vec[j]) AS m FROM a{i}, range(1, len(vec) + 1) t(j) GROUP BY cid, j)",
                 f"n{i} AS (SELECT cid, list(m ORDER BY j) AS c FROM m{i} GROUP BY cid)",
                 f"c{i + 1} AS (SELECT c{i}.cid, COALESCE(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (cid))"]
    return (f"WITH {', '.join(ctes)} SELECT e.vec_id, CAST({near} AS INTEGER) AS cluster, "
            f"round(min(list_distance(e.vec, c.c)), {ROUND}) AS distance FROM e, c{FIT_STEPS} c GROUP BY e.vec_id")


def _kmeans_seeding_sql() -> str:
    """The rounds of drawing, unrolled: all distances to the candidates so far, then the draws."""
    def u(number):
        text = f"concat_ws(':', e.key, r, {number}, {C.KMEANS_SEED})"
        return f"(CAST('0x' || substr(md5({text}), 1, {seeding.DIGITS}) AS BIGINT) + 0.5) / {16 ** seeding.DIGITS}.0"

    rate = seeding.OVERSAMPLING * SEED_K
    ctes = ["e AS (SELECT CAST(MIN(vec_id) AS VARCHAR) AS key, vec, CAST(COUNT(*) AS DOUBLE) AS wt FROM "
            "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) GROUP BY vec)",
            f"rs AS (SELECT unnest(range(0, {SEED_RESTARTS})) AS r)",
            f"c0 AS (SELECT r, 0 AS round, arg_min(e.key, -ln({u(0)}) / wt) AS key, arg_min(vec, -ln({u(0)}) / wt) AS vec FROM e, rs GROUP BY r)"]
    for n in range(1, SEED_ROUNDS + 1):
        ctes += [f"d{n} AS (SELECT c.r, e.key, any_value(e.vec) AS vec, any_value(e.wt) AS wt, "
                 f"pow(min(list_distance(e.vec, c.vec)), 2) AS d2 FROM e, c{n - 1} c GROUP BY c.r, e.key)",
                 f"p{n} AS (SELECT r AS pr, SUM(wt * d2) AS cost FROM d{n} GROUP BY r)",
                 f"c{n} AS (SELECT * FROM c{n - 1} UNION ALL SELECT r, {n} AS round, key, vec FROM d{n} e JOIN p{n} ON pr = r "
                 f"WHERE {u(n)} < {rate} / cost * wt * d2)"]
    last = f"c{SEED_ROUNDS}"
    return (f"WITH {', '.join(ctes)}, nu AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY round, key) - 1 AS candidate FROM {last}), "
            "nr AS (SELECT nu.r, e.key, any_value(e.wt) AS wt, arg_min(nu.candidate, struct_pack(d := list_distance(e.vec, nu.vec), "
            "c := nu.candidate)) AS candidate FROM e, nu GROUP BY nu.r, e.key), "
            "sz AS (SELECT r, candidate, SUM(wt) AS weight FROM nr GROUP BY r, candidate) "
            "SELECT CAST(nu.r AS INTEGER) AS r, CAST(nu.candidate AS INTEGER) AS candidate, nu.round, CAST(nu.key AS BIGINT) AS vec_id, "
            "CAST(COALESCE(weight, 0) AS BIGINT) AS weight FROM nu LEFT JOIN sz ON sz.r = nu.r AND sz.candidate = nu.candidate")


def _constrained_sql(subsets: str, kc: str, silhouettes: str, vec: str, n_dims: int) -> str:
    """The whole run: candidates and starts of every restart, Lloyd steps of every model until it rests,
    the best restart, the silhouette of every k, the chosen k, and the clusters of the chosen models."""
    def u(key, *salt):
        text = f"concat_ws(':', {key}, {', '.join(map(str, salt))}, {C.KMEANS_SEED})"
        return f"((CAST('0x' || substr(md5({text}), 1, {seeding.DIGITS}) AS BIGINT) + 0.5) / {16 ** seeding.DIGITS}.0)"

    apart = lambda a, b: f"round(pow(list_distance({a}, {b}), 2))"  # noqa: E731  whole numbers: the vectors are 0/1
    to_centre = "round(greatest(list_dot_product(d.vec, d.vec) - 2 * list_dot_product(d.vec, a.c) + list_dot_product(a.c, a.c), 0.0), 9)"
    key = "md5(array_to_string(list_transform(vec, lambda v: CAST(v AS VARCHAR)), ','))"
    ctes = [
        f"dv AS (SELECT subset, vec, COUNT(*)::DOUBLE AS wt, {key} AS key FROM (SELECT subset, {vec} AS vec FROM sub) GROUP BY subset, vec)",
        "e AS (SELECT dv.*, km.k FROM dv JOIN (SELECT subset, MAX(k) AS k FROM kc GROUP BY subset) km USING (subset))",
        f"rs AS (SELECT unnest(range(0, {C.KMEANS_RESTARTS})) AS r)",
        f"g0 AS (SELECT subset, r, 0 AS round, arg_min(key, o) AS key, arg_min(vec, o) AS vec FROM (SELECT e.*, rs.r, "
        f"struct_pack(c := -ln({u('e.key', 'r', 0)}) / wt, k := e.key) AS o FROM e, rs) GROUP BY subset, r)"]
    for n in range(1, seeding.ROUNDS + 1):
        ctes += [
            f"d{n} AS (SELECT e.subset, c.r, e.key, any_value(e.vec) AS vec, any_value(e.wt) AS wt, any_value(e.k) AS k, "
            f"MIN({apart('e.vec', 'c.vec')}) AS d2 FROM e JOIN g{n - 1} c USING (subset) GROUP BY e.subset, c.r, e.key)",
            f"p{n} AS (SELECT subset, r, SUM(wt * d2) AS cost FROM d{n} GROUP BY subset, r HAVING SUM(wt * d2) > 0)",
            f"g{n} AS (SELECT * FROM g{n - 1} UNION ALL SELECT subset, r, {n} AS round, key, vec FROM d{n} JOIN p{n} USING (subset, r) "
            f"WHERE {u('key', 'r', n)} < {seeding.OVERSAMPLING} * k / cost * wt * d2)"]
    ctes += [
        f"nu AS (SELECT *, row_number() OVER (PARTITION BY subset, r ORDER BY round, key) - 1 AS cand FROM g{seeding.ROUNDS})",
        f"nw AS (SELECT subset, r, cand, SUM(wt) AS weight FROM (SELECT e.subset, c.r, e.key, any_value(e.wt) AS wt, arg_min(c.cand, "
        f"struct_pack(d := {apart('e.vec', 'c.vec')}, c := c.cand)) AS cand FROM e JOIN nu c USING (subset) GROUP BY e.subset, c.r, e.key) GROUP BY subset, r, cand)",
        "pp AS (SELECT nu.subset, nu.r, 0 AS step, cand, vec, COALESCE(weight, 0.0) AS weight, 1.0::DOUBLE AS d2, CAST(NULL AS BIGINT) AS picked, "
        "(SELECT MAX(k) FROM kc WHERE kc.subset = nu.subset) AS k FROM nu LEFT JOIN nw USING (subset, r, cand) "
        "UNION ALL SELECT s.subset, s.r, s.step + 1, s.cand, s.vec, s.weight, "
        f"CASE WHEN s.step = 0 THEN {apart('s.vec', 'pk.vec')} ELSE least(s.d2, {apart('s.vec', 'pk.vec')}) END, pk.cand, s.k "
        "FROM pp s JOIN (SELECT subset, r, MIN(cand) AS cand, arg_min(vec, cand) AS vec FROM (SELECT *, SUM(weight * d2) OVER (PARTITION BY subset, r "
        "ORDER BY cand ROWS UNBOUNDED PRECEDING) AS share, SUM(weight * d2) OVER (PARTITION BY subset, r) AS total FROM pp WHERE step < k) "
        f"WHERE total > 0 AND share > {u('subset', chr(39) + 'pick' + chr(39), 'r', 'step')} * total GROUP BY subset, r) pk USING (subset, r))",
        "st0 AS (SELECT DISTINCT subset, r, step AS pos, picked AS cand FROM pp WHERE picked IS NOT NULL)",
        "st1 AS (SELECT st0.subset, st0.r, pos, vec, COUNT(*) OVER (PARTITION BY st0.subset, st0.r) AS found FROM st0 JOIN nu USING (subset, r, cand))",
        "tl AS (SELECT subset, AVG(greatest(mu - mu * mu, 0.0)) * " + repr(C.KMEANS_TOL) + " AS tol FROM (SELECT subset, j, SUM(wt * vec[j]) / SUM(wt) AS mu "
        f"FROM dv, range(1, {n_dims + 1}) t(j) GROUP BY subset, j) GROUP BY subset)",
        "ll AS (SELECT 0 AS step, kc.subset, kc.k, s.r, s.pos - 1 AS cid, s.vec AS c, 1e300::DOUBLE AS shift, tl.tol FROM kc JOIN st1 s ON s.subset = kc.subset "
        "AND s.pos <= kc.k AND s.found >= kc.k JOIN tl ON tl.subset = kc.subset "
        "UNION ALL SELECT step + 1, subset, k, r, cid, c, SUM(moved) OVER (PARTITION BY subset, k, r), tol FROM ("
        "SELECT a.step, a.subset, a.k, a.r, a.cid, COALESCE(m.c, a.c) AS c, COALESCE(pow(list_distance(m.c, a.c), 2), 0.0) AS moved, a.tol "
        f"FROM (SELECT * FROM ll WHERE shift > tol AND step < {C.KMEANS_MAX_ITER}) a LEFT JOIN ("
        f"SELECT z.subset, z.k, z.r, z.cid, list_transform(range(1, {n_dims + 1}), lambda j: COALESCE(f.s[j], 0.0) / z.w) AS c FROM "
        "(SELECT subset, k, r, cid, SUM(wt) AS w FROM (SELECT a.subset, a.k, a.r, d.key, any_value(d.wt) AS wt, "
        f"arg_min(a.cid, struct_pack(d := {to_centre}, c := a.cid)) AS cid FROM dv d JOIN ll a ON a.subset = d.subset "
        f"WHERE a.shift > a.tol AND a.step < {C.KMEANS_MAX_ITER} GROUP BY a.subset, a.k, a.r, d.key) GROUP BY subset, k, r, cid) z LEFT JOIN "
        "(SELECT subset, k, r, cid, map_from_entries(list(struct_pack(k := j, v := s))) AS s FROM (SELECT subset, k, r, cid, j, SUM(wt) AS s FROM "
        "(SELECT a.subset, a.k, a.r, d.key, any_value(d.wt) AS wt, any_value(d.flags) AS flags, "
        f"arg_min(a.cid, struct_pack(d := {to_centre}, c := a.cid)) AS cid FROM (SELECT *, list_filter(range(1, {n_dims + 1}), lambda j: vec[j] = 1) AS flags FROM dv) d "
        f"JOIN ll a ON a.subset = d.subset WHERE a.shift > a.tol AND a.step < {C.KMEANS_MAX_ITER} GROUP BY a.subset, a.k, a.r, d.key), "
        "unnest(flags) t(j) GROUP BY subset, k, r, cid, j) GROUP BY subset, k, r, cid) f USING (subset, k, r, cid)) m USING (subset, k, r, cid)))",
        "fin AS (SELECT * FROM ll QUALIFY step = MAX(step) OVER (PARTITION BY subset, k, r))",
        f"near AS (SELECT a.subset, a.k, a.r, d.key, any_value(d.vec) AS vec, any_value(d.wt) AS wt, MIN({to_centre.replace('round(', '(', 1).removesuffix(', 9)')})) AS d2, "
        f"arg_min(a.cid, struct_pack(d := {to_centre}, c := a.cid)) AS lab FROM dv d JOIN fin a ON a.subset = d.subset GROUP BY a.subset, a.k, a.r, d.key)",
        f"bestr AS (SELECT subset, k, arg_min(r, struct_pack(c := cost, r := r)) AS r FROM (SELECT subset, k, r, round(SUM(wt * d2), {KM.COST_DIGITS}) AS cost "
        "FROM near GROUP BY subset, k, r) GROUP BY subset, k)",
        "asg AS (SELECT near.* EXCLUDE (d2, key) FROM near JOIN bestr USING (subset, k, r))"]
    order = "CASE " + " ".join(f"WHEN subset = {S.q(c)} THEN {i}" for i, c in enumerate(C.CONSTRAINT_COLUMNS)) + f" ELSE {len(C.CONSTRAINT_COLUMNS)} END"
    prefix = C.CATEGORY_GROUP_PREFIX + "_"
    return (f"{subsets.replace('WITH ', 'WITH RECURSIVE ', 1)}, {kc}, {', '.join(ctes)}, {silhouettes}, "
            "chosen AS (SELECT asg.subset, asg.vec, asg.lab FROM asg JOIN bestk ON bestk.subset = asg.subset AND bestk.best_k = asg.k "
            "UNION ALL SELECT subset, vec, 0 FROM dv WHERE subset NOT IN (SELECT subset FROM bestk)), "
            f"ids AS (SELECT subset, lab, CAST(row_number() OVER (ORDER BY {order}, lab) - 1 AS INTEGER) AS cluster_id FROM (SELECT DISTINCT subset, lab FROM chosen)) "
            "SELECT cluster_id, game_name, game_id, s.subset, CASE WHEN s.subset = 'remainder' THEN 'unconstrained_cluster_' || ids.lab "
            f"ELSE regexp_replace(s.subset, '^.*{prefix}', '') || '_subcluster_' || ids.lab END AS constraint "
            f"FROM (SELECT *, {vec} AS vec FROM sub) s JOIN chosen ON chosen.subset = s.subset AND chosen.vec = s.vec "
            "JOIN ids ON ids.subset = chosen.subset AND ids.lab = chosen.lab")


#: Squarings of the covariance matrix: its 2^14th power leaves nothing of an axis whose eigenvalue is
#: 0.3 % smaller.
SQUARINGS = 14


def _pca_sql(items: str, vec: str) -> str:
    """Leading axis by repeated squaring of the covariance matrix, twice (the second time deflated)."""
    def power(name: str, mat: str) -> str:
        square = "list_transform(p.m, lambda r: list_transform(p.m, lambda c: list_dot_product(r, c)))"
        trace = "list_sum(list_transform(w, lambda r, i: r[i]))"
        start = "list_transform(p.m, lambda r, i: 1.0 + (i % 7) / 10.0)"
        return (f"{name}p AS (SELECT 0 AS step, m FROM {mat} UNION ALL SELECT step + 1, list_transform(w, lambda r: list_transform("
                f"r, lambda c: c / t)) FROM (SELECT step, w, {trace} AS t FROM (SELECT p.step, {square} AS w FROM {name}p p "
                f"WHERE p.step < {SQUARINGS}))), "
                f"{name}v AS (SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM (SELECT list_transform("
                f"p.m, lambda r: list_dot_product(r, {start})) AS w FROM {name}p p WHERE p.step = {SQUARINGS})), "
                f"{name} AS (SELECT v, list_dot_product(v, list_transform({mat}.m, lambda r: list_dot_product(r, v))) AS lam "
                f"FROM {name}v, {mat})")
    return (
        f"{items.replace('WITH ', 'WITH RECURSIVE ', 1)}, x AS (SELECT game_id, cluster, {vec} AS vec FROM it), "
        "lg AS (SELECT game_id, i, vec[i] AS v FROM x, range(1, len(vec) + 1) t(i)), "
        "cv AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM lg a JOIN lg b USING (game_id) GROUP BY a.i, b.i), "
        "rw AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i), m1 AS (SELECT list(r ORDER BY i) AS m FROM rw), "
        f"{power('e1', 'm1')}, "
        "m2 AS (SELECT list_transform(m1.m, lambda r, i: list_transform(r, lambda c, j: c - e1.lam * e1.v[i] * e1.v[j])) AS m FROM m1, e1), "
        f"{power('e2', 'm2')}, "
        "tr AS (SELECT SUM(c) AS t FROM cv WHERE i = j), "
        "mu AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, AVG(v) AS a FROM lg GROUP BY i)), "
        "pj AS (SELECT cluster, list_dot_product(list_transform(list_zip(vec, mu.m), lambda z: z[1] - z[2]), e1.v) AS a, "
        "list_dot_product(list_transform(list_zip(vec, mu.m), lambda z: z[1] - z[2]), e2.v) AS b FROM x, mu, e1, e2) "
        f"SELECT cluster AS cluster_id, round(abs(AVG(a)), {PCA_ROUND}) AS abs_pc1, round(abs(AVG(b)), {PCA_ROUND}) AS abs_pc2, "
        f"COUNT(*) AS n, round(any_value(e1.lam / tr.t), {PCA_ROUND}) AS explained_1, "
        f"round(any_value(e2.lam / tr.t), {PCA_ROUND}) AS explained_2 FROM pj, e1, e2, tr GROUP BY cluster")


def _oracles() -> dict[str, str]:
    from tessera.plans.rec_queries import cluster_sql as csql

    feats = S.feature_names_in_order()
    items = f"WITH {S.prepared_ctes()}, it AS (SELECT *, {csql()} AS cluster FROM prepared)"
    stack = " UNION ALL ".join(
        f"SELECT cluster, {i} AS pos, {S.q(f)} AS feature, AVG({S.ident(f)}) AS mean FROM it GROUP BY cluster"
        for i, f in enumerate(feats))
    long = f"lg AS ({stack})"
    top = ("tp AS (SELECT cluster, string_agg(feature, ', ' ORDER BY r) AS top_features FROM "
           "(SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, pos) AS r FROM lg) "
           f"WHERE r <= {C.DESC_TOP_FEATURES} GROUP BY cluster)")
    labels_expr = "feature"
    for a, b in C.DESC_LABEL_REPLACEMENTS:
        labels_expr = f"replace({labels_expr}, {S.q(a)}, {S.q(b)})"
    tpl = ("tl AS (SELECT cluster, string_agg(" + labels_expr + ", ', ' ORDER BY r) AS labels FROM "
           "(SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, pos) AS r FROM lg) "
           f"WHERE r <= {C.DESC_TOP_FEATURES} GROUP BY cluster)")
    smp = ("sp AS (SELECT cluster, string_agg(game_name, ' | ' ORDER BY game_id) AS sample FROM "
           "(SELECT cluster, game_id, game_name, row_number() OVER (PARTITION BY cluster ORDER BY game_id) AS r "
           f"FROM it) WHERE r <= {C.DESC_SAMPLE} GROUP BY cluster)")
    cnt = "ct AS (SELECT cluster, COUNT(*) AS count FROM it GROUP BY cluster)"
    nd = len(DIFFICULTY_ORDER)
    parent = CONSTRAINT.replace(C.CATEGORY_GROUP_PREFIX + "_", "")
    parent_title = parent.replace("_", " ").title()
    vec = _feat_list()
    sil = (
        f"{items}, x AS (SELECT game_id, cluster, {vec} AS vec FROM it), "
        "nc AS (SELECT cluster, COUNT(*) AS n FROM x GROUP BY cluster), "
        "sd AS (SELECT a.game_id, a.cluster AS la, b.cluster AS lb, SUM(list_distance(a.vec, b.vec)) AS s "
        "FROM x a JOIN x b ON true GROUP BY a.game_id, a.cluster, b.cluster), "
        "ab AS (SELECT sd.game_id, sd.la, MAX(CASE WHEN lb = la THEN s / NULLIF(n - 1, 0) END) AS a, "
        "MIN(CASE WHEN lb <> la THEN s / n END) AS b, MAX(CASE WHEN lb = la THEN n END) AS own_n "
        "FROM sd JOIN nc ON nc.cluster = sd.lb GROUP BY sd.game_id, sd.la), "
        "si AS (SELECT CASE WHEN own_n <= 1 OR greatest(a, b) = 0 OR b IS NULL THEN 0.0 "
        "ELSE (b - a) / greatest(a, b) END AS s FROM ab) "
        f"SELECT round(AVG(s), {ROUND}) AS silhouette FROM si")
    subsets = (f"{items}, sub AS (SELECT *, CASE WHEN {S.ident(CONSTRAINT)} = 1 THEN {S.q(CONSTRAINT)} "
               "ELSE 'remainder' END AS subset FROM it)")
    ncols = len(feats) + 1
    kc = (
        "cn AS (SELECT subset, COUNT(*) AS n FROM sub GROUP BY subset), "
        "kb AS (SELECT subset, n, greatest(2.0, floor(ln(n))) AS min_k, "
        f"least(CAST({ncols} AS DOUBLE), n - 1.0, greatest(5.0, floor(sqrt(n)) / 2.0) * 2.0) AS max_k, "
        "floor(sqrt(n) / 2.0) AS reasonable FROM cn), "
        "kk AS (SELECT kb.*, CAST(floor(max_k * 2.0) AS INTEGER) AS k_end, unnest(range(2, CAST(floor(max_k * 2.0) "
        "AS INTEGER))) AS k FROM kb), "
        "kc AS (SELECT subset, n, CAST(k AS INTEGER) AS k, min_k, max_k, CASE WHEN k >= min_k AND k <= max_k THEN 1.0 ELSE "
        "greatest(0.0, 1.0 - least(abs(k - min_k), abs(k - max_k)) / greatest(1.0, reasonable)) END AS size_score, "
        f"{C.COMPLEXITY_PENALTY} * pow(CAST(k AS DOUBLE) / (k_end - 1), 2.0) AS penalty FROM kk)")
    selk = (
        f"{subsets}, {kc}, "
        f"dv AS (SELECT subset, {vec} AS vec, COUNT(*) AS wt, MIN(game_id) AS first_id FROM sub GROUP BY subset, vec), "
        "sd AS (SELECT subset, vec AS svec, row_number() OVER (PARTITION BY subset ORDER BY first_id) AS pos FROM dv), "
        "asg AS (SELECT kc.subset, kc.k, dv.vec, dv.wt, arg_min(sd.pos, struct_pack(d := list_distance(dv.vec, sd.svec), "
        "p := sd.pos)) - 1 AS lab FROM kc JOIN dv ON dv.subset = kc.subset JOIN sd ON sd.subset = kc.subset AND sd.pos <= kc.k "
        "GROUP BY kc.subset, kc.k, dv.vec, dv.wt), ")
    scored = (
        "sz AS (SELECT subset, k, lab, SUM(wt) AS n FROM asg GROUP BY subset, k, lab), "
        "sm AS (SELECT a.subset, a.k, a.vec, a.wt, a.lab AS la, b.lab AS lb, SUM(b.wt * list_distance(a.vec, b.vec)) AS s "
        "FROM asg a JOIN asg b ON a.subset = b.subset AND a.k = b.k GROUP BY a.subset, a.k, a.vec, a.wt, a.lab, b.lab), "
        "ab AS (SELECT sm.subset, sm.k, sm.vec, sm.wt, MAX(CASE WHEN lb = la THEN s / NULLIF(sz.n - 1, 0) END) AS a, "
        "MIN(CASE WHEN lb <> la THEN s / sz.n END) AS b, MAX(CASE WHEN lb = la THEN sz.n END) AS own_n "
        "FROM sm JOIN sz ON sz.subset = sm.subset AND sz.k = sm.k AND sz.lab = sm.lb GROUP BY sm.subset, sm.k, sm.vec, sm.wt), "
        "sl AS (SELECT subset, k, round(SUM(wt * CASE WHEN own_n <= 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 "
        "ELSE (b - a) / greatest(a, b) END) / SUM(wt), 9) AS silhouette FROM ab GROUP BY subset, k), "
        "j AS (SELECT kc.*, sl.silhouette FROM kc JOIN sl USING (subset, k)), "
        "st AS (SELECT subset, min(silhouette) AS smin, max(silhouette) AS smax FROM j GROUP BY subset), "
        f"sc AS (SELECT j.*, {C.SILHOUETTE_WEIGHT} * CASE WHEN smax <> smin THEN (silhouette - smin) / (smax - smin) "
        f"ELSE 1.0 END + {C.SIZE_WEIGHT} * size_score - penalty AS score FROM j JOIN st USING (subset)), "
        "bestk AS (SELECT subset, arg_min(k, struct_pack(s := -score, k := k)) AS best_k FROM sc GROUP BY subset)")
    selk += (
        f"{scored} SELECT subset, k, round(silhouette, {ROUND}) AS silhouette, round(score, {ROUND}) AS score, "
        "k = best_k AS selected FROM sc JOIN bestk USING (subset)")
    step = (
        f"{items}, x AS (SELECT game_id, cluster, {vec} AS vec FROM it), "
        "dims AS (SELECT cluster, i, AVG(vec[i]) AS m FROM x, range(1, len(vec) + 1) t(i) GROUP BY cluster, i), "
        "cen AS (SELECT cluster AS cid, list(m ORDER BY i) AS c FROM dims GROUP BY cluster), "
        "asg AS (SELECT x.game_id, x.vec, arg_min(cen.cid, struct_pack(d := list_distance(x.vec, cen.c), c := cen.cid)) AS cid, "
        "min(list_distance(x.vec, cen.c)) AS dist FROM x, cen GROUP BY x.game_id, x.vec), "
        "nd AS (SELECT cid, i, AVG(vec[i]) AS m FROM asg, range(1, len(vec) + 1) t(i) GROUP BY cid, i), "
        "nw AS (SELECT cid, list(m ORDER BY i) AS m FROM nd GROUP BY cid), "
        "agg AS (SELECT cid, COUNT(*) AS n, SUM(dist * dist) AS sse FROM asg GROUP BY cid) "
        f"SELECT agg.cid, agg.n, round(agg.sse, {ROUND}) AS sse, round(list_distance(nw.m, cen.c), {ROUND}) AS moved "
        "FROM agg JOIN nw USING (cid) JOIN cen USING (cid)")
    emb = ("e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), "
           "ed AS (SELECT label, i, AVG(vec[i]) AS m FROM e, range(1, len(vec) + 1) t(i) GROUP BY label, i), "
           "ec AS (SELECT label, list(m ORDER BY i) AS c FROM ed GROUP BY label)")
    roundtrip = (f"{items}, m AS (SELECT DISTINCT cluster, game_name FROM it) "
                 "SELECT cluster AS cluster_id, game_name AS item_key, 'cluster_' || cluster AS constraint, "
                 "COUNT(*) OVER (PARTITION BY cluster) AS count FROM m")
    cos = lambda a, b: (f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "  # noqa: E731
                        f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
                        f"sqrt(list_dot_product({b}, {b}))) END)")
    new_bin = "struct_pack(members := [o.game_name], s := o.vec, n := 1, c := o.vec)"
    grown = ("struct_pack(members := list_append(b.members, o.game_name), "
             "s := list_transform(list_zip(b.s, o.vec), lambda z: z[1] + z[2]), n := b.n + 1, "
             "c := list_transform(list_zip(b.s, o.vec), lambda z: round_even((z[1] + z[2]) / (b.n + 1), 0)))")
    bins = (
        f"WITH RECURSIVE {S.prepared_ctes()}, "
        f"it AS (SELECT game_id, game_name, {vec} AS vec FROM prepared), "
        "bi AS (SELECT DISTINCT l.l_orderkey AS basket, it.game_id, it.game_name, it.vec FROM lineitem l "
        "JOIN it ON it.game_id = l.l_partkey), "
        "ord AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY game_id) AS pos FROM bi), "
        f"fold AS (SELECT basket, pos, [{new_bin.replace('o.', '')}] AS bins FROM ord WHERE pos = 1 "
        "UNION ALL SELECT basket, pos, CASE WHEN best = 0 THEN list_append(bins, "
        f"{new_bin}) ELSE list_transform(bins, lambda b, i: CASE WHEN i = best THEN {grown} ELSE b END) END "
        "FROM (SELECT o.basket, o.pos, o.game_name, o.vec, f.bins, "
        f"CASE WHEN list_max(list_transform(f.bins, lambda b: {cos('o.vec', 'b.c')})) > {C.BIN_THRESHOLD} "
        f"THEN list_position(list_transform(f.bins, lambda b: {cos('o.vec', 'b.c')}), "
        f"list_max(list_transform(f.bins, lambda b: {cos('o.vec', 'b.c')}))) ELSE 0 END AS best "
        "FROM fold f JOIN ord o ON o.basket = f.basket AND o.pos = f.pos + 1) o), "
        "last AS (SELECT basket, bins FROM fold QUALIFY row_number() OVER (PARTITION BY basket ORDER BY pos DESC) = 1), "
        "ub AS (SELECT basket, unnest(bins) AS b, generate_subscripts(bins, 1) AS bin_id FROM last) "
        "SELECT basket, CAST(bin_id AS INTEGER) AS bin_id, CAST(b.n AS INTEGER) AS size, b.members AS members, "
        "CAST(b.c AS BIGINT[]) AS centroid FROM ub")
    return {
        "basket_bins": bins,
        "cluster_profile": f"{items}, {long}, {top}, {smp}, {cnt} SELECT cluster, count, top_features, sample "
                           "FROM ct JOIN tp USING (cluster) JOIN sp USING (cluster)",
        "cluster_description": (
            f"{items}, {long}, {tpl}, {cnt} SELECT cluster, CASE WHEN cluster >= {nd} THEN "
            f"'Cluster ' || cluster || ': {parent_title} (Subcluster ' || (cluster % {nd}) || ') games characterized by ' "
            "ELSE 'Cluster ' || cluster || ': Other games characterized by ' END || labels AS description, "
            f"CASE WHEN cluster >= {nd} THEN '{parent}_subcluster_' || (cluster % {nd}) "
            f"ELSE 'unconstrained_cluster_' || (cluster % {nd}) END AS constraint, cluster >= {nd} AS is_subcluster, "
            f"CASE WHEN cluster >= {nd} THEN '{parent}' ELSE '' END AS parent_constraint, count "
            "FROM ct JOIN tl USING (cluster)"),
        "silhouette": sil,
        "k_candidates": f"{subsets}, {kc} SELECT subset, n, k, min_k, max_k, round(size_score, {ROUND}) AS size_score, "
                        f"round(penalty, {ROUND}) AS penalty FROM kc",
        "select_k": selk,
        "kmeans_step": step,
        "model_reuse": roundtrip,
        "model_roundtrip": roundtrip,
        "nearest_centroid": (
            f"WITH {emb} SELECT e.vec_id, arg_min(ec.label, struct_pack(d := list_distance(e.vec, ec.c), l := ec.label)) "
            f"AS nearest, round(min(list_distance(e.vec, ec.c)), {ROUND}) AS distance FROM e, ec GROUP BY e.vec_id"),
        "kmeans_fit": _kmeans_fit_sql(emb),
        "kmeans_seeding": _kmeans_seeding_sql(),
        "constrained_clusters": _constrained_sql(subsets, kc, scored, vec, len(feats)),
        "pca_projection": _pca_sql(items, vec),
        "cosine_similarity": (
            f"WITH {emb} SELECT e.vec_id, round(COALESCE(list_dot_product(e.vec, ec.c) / NULLIF(sqrt(list_dot_product("
            f"e.vec, e.vec)) * sqrt(list_dot_product(ec.c, ec.c)), 0), 0.0), {ROUND}) AS cosine FROM e JOIN ec USING (label)"),
    }


ORACLES = _oracles()
