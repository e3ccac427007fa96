"""Constrained clustering with model selection.

Each constraint column defines a subset (rows flagged 1, taken from the full table, so
subsets may overlap); rows flagged by none form the remainder. Per subset: candidate k
values from its size, all (k x restarts) models fitted together, exact silhouette of each
k's best restart, the scored k selection, then the selected model's labels. Cluster ids
run over subsets in order (constraints first, remainder last), skipping empty clusters.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import clustering as CL
from tessera.operators import kmeans as KM
from tessera.session import cut_lineage, hadoop_fs, path_exists

SUBSET = "subset"
REMAINDER = "remainder"
#: Decimals to which silhouettes are compared.
SILHOUETTE_DIGITS = 9


def split_by_constraints(df: DataFrame, constraint_columns: Sequence[str]) -> DataFrame:
    tags = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in constraint_columns]), lambda t: t.isNotNull())
    return df.withColumn(SUBSET, F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(REMAINDER)))))


def constrained_clusters(items: DataFrame, features: Sequence[str], constraint_columns: Sequence[str] = C.CONSTRAINT_COLUMNS,
                         key: str = "game_name", order: str = "game_id", restarts: int = C.KMEANS_RESTARTS,
                         max_iter: int = C.KMEANS_MAX_ITER, tol: float = C.KMEANS_TOL, seed: int = C.KMEANS_SEED,
                         init: str = "parallel") -> tuple[DataFrame, DataFrame]:
    """Returns (members: cluster_id, key, order, subset; info: cluster_id, constraint,
    parent_constraint, is_subcluster, subcluster_id, count)."""
    spark = items.sparkSession
    rows = cut_lineage(split_by_constraints(items, constraint_columns)
                       .select(SUBSET, F.col(key).alias("key"), F.col(order).alias("ord"),
                               F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(0)).cast("double") for f in features])
                               .alias("vec")))
    counts = rows.groupBy(SUBSET).agg(F.count(F.lit(1)).alias("n"))
    kc = cut_lineage(CL.k_candidates(counts, n_columns=len(features) + 1))
    dv = cut_lineage(rows.groupBy(SUBSET, "vec").agg(F.count(F.lit(1)).alias("wt")))
    ks = {(r[SUBSET],): sorted(r["ks"]) for r in kc.groupBy(SUBSET).agg(F.collect_list("k").alias("ks")).collect()}
    best = KM.kmeans_grid(dv, ks, by=[SUBSET], restarts=restarts, max_iter=max_iter, tol=tol, seed=seed, init=init)
    cents, order_k = {}, {}
    for (sk, k), (cen, _) in sorted(best.items()):
        cents.setdefault(sk, []).append(cen)
        order_k.setdefault(sk, []).append(k)
    if cents:
        labelled = KM.assign(dv, cents, by=[SUBSET], out="labels")
        sil = KM.silhouette(labelled, "labels", by=[SUBSET])
        kmap = spark.createDataFrame([(sk[0], i, k) for sk, kl in order_k.items() for i, k in enumerate(kl)],
                                     f"{SUBSET} string, model int, k int")
        sil = sil.join(kmap, [SUBSET, "model"]).select(SUBSET, "k", F.round("silhouette", SILHOUETTE_DIGITS).alias("silhouette"))
        chosen = {r[SUBSET]: r["k"] for r in CL.select_k(kc, sil).filter("selected").collect()}
    else:
        chosen = {}
    final = {}
    for (sk, k), (cen, _) in best.items():
        if chosen.get(sk[0]) == k:
            final[sk] = cen
    # subsets too small for a k range (n < 3) form one cluster
    all_subsets = [r[SUBSET] for r in counts.collect()]
    labelled = KM.assign(dv, final, by=[SUBSET], out="label") if final else None
    lab = (labelled.select(SUBSET, "vec", "label") if labelled is not None
           else spark.createDataFrame([], f"{SUBSET} string, vec array<double>, label int"))
    one = [s for s in all_subsets if (s,) not in final]
    if one:
        lab = lab.unionByName(dv.filter(F.col(SUBSET).isin(one)).select(SUBSET, "vec", F.lit(0).alias("label")))
    lab = cut_lineage(lab)  # one label per distinct vector: computed once, read by both outputs
    labelled_rows = rows.join(lab, [SUBSET, "vec"])
    order_expr = F.when(F.col(SUBSET) == REMAINDER, F.lit(len(constraint_columns)))
    for i, c in enumerate(constraint_columns):
        order_expr = order_expr.when(F.col(SUBSET) == c, F.lit(i))
    used = labelled_rows.groupBy(SUBSET, "label").agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("sub_order", order_expr)
    # (subset, label) pairs are few (sum of selected k): a global window over them is bounded
    used = cut_lineage(used.withColumn(
        "cluster_id", (F.row_number().over(Window.orderBy("sub_order", "label")) - 1).cast("int")))
    prefix = C.CATEGORY_GROUP_PREFIX + "_"
    parent = F.when(F.col(SUBSET) != REMAINDER, F.regexp_replace(F.col(SUBSET), "^.*" + prefix, ""))
    info = used.select(
        "cluster_id",
        F.when(parent.isNotNull(), F.format_string("%s_subcluster_%d", parent, F.col("label")))
        .otherwise(F.format_string("unconstrained_cluster_%d", F.col("label"))).alias("constraint"),
        parent.alias("parent_constraint"), parent.isNotNull().alias("is_subcluster"),
        F.col("label").alias("subcluster_id"), "count")
    members = labelled_rows.join(used.select(SUBSET, "label", "cluster_id"), [SUBSET, "label"]) \
        .select("cluster_id", F.col("key").alias(key), F.col("ord").alias(order), SUBSET)
    return members, info


# ------------------------------------------------------------------ model persistence (S8, M12)
def _published(spark, path: str) -> list[str]:
    """Names of the published versions, oldest first; empty if the model was never saved."""
    marks = f"{path.rstrip('/')}/published"
    if not path_exists(spark, marks):
        return []
    fs, folder = hadoop_fs(spark, marks)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder))


def save_model(members: DataFrame, info: DataFrame, path: str) -> str:
    """Write members and cluster info as a new version, then publish it by a marker, last: a crash
    in between leaves the version before in force. Returns the version's name."""
    spark = members.sparkSession
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    root = path.rstrip("/")
    stamp = F.unix_timestamp(F.current_timestamp()).cast("double").alias("created_at")
    members.select("*", stamp).write.parquet(f"{root}/versions/{version}/members")
    info.select("*", stamp).write.parquet(f"{root}/versions/{version}/info")
    fs, mark = hadoop_fs(spark, f"{root}/published/{version}")
    fs.create(mark, False).close()
    return version


def load_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Members and info of the newest published version."""
    versions = _published(spark, path)
    if not versions:
        raise FileNotFoundError(f"no model has been published in {path}")
    root = f"{path.rstrip('/')}/versions/{versions[-1]}"
    return spark.read.parquet(f"{root}/members"), spark.read.parquet(f"{root}/info")


def model_exists(spark, path: str) -> bool:
    """Whether a version is published; storage errors rise instead of reading as "no model"."""
    return bool(_published(spark, path))


def fit_or_load(items: DataFrame, features: Sequence[str], path: str, mode: str = "reuse",
                **kw) -> tuple[DataFrame, DataFrame]:
    """``mode="reuse"`` loads the published model when there is one (fits otherwise);
    ``mode="retrain"`` always fits and publishes a new version."""
    spark = items.sparkSession
    if mode == "reuse" and model_exists(spark, path):
        return load_model(spark, path)
    members, info = constrained_clusters(items, features, **kw)
    save_model(members, info, path)
    return load_model(spark, path)
