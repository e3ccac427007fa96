"""Cluster profiles, descriptions, k-range rules and model selection (DataFrame operators).

Profiles are one wide aggregate per cluster (partial aggregation, so a hot cluster is
pre-combined on the map side) followed by small per-cluster top-n windows over the
*feature* axis (bounded by the feature count) and a first-n sample per cluster
(``row_number`` with a literal limit -> map-side partial limit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def feature_means_long(df: DataFrame, cluster_col: str, features: Sequence[str]) -> DataFrame:
    """(cluster, pos, feature, mean, count): one aggregate, then unpivot of the means."""
    aggs = [F.avg(_c(f)).alias(f"m{i}") for i, f in enumerate(features)]
    wide = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("count"), *aggs)
    pairs = ", ".join(f"{i}, '{f.replace(chr(39), chr(39) * 2)}', m{i}" for i, f in enumerate(features))
    return wide.selectExpr(f"`{cluster_col}`", "count", f"stack({len(features)}, {pairs}) AS (pos, feature, mean)")


def cluster_profile(df: DataFrame, features: Sequence[str], cluster_col: str = "cluster",
                    name_col: str = "game_name", order_col: str = "game_id",
                    top_n: int = C.DESC_TOP_FEATURES, sample_n: int = C.DESC_SAMPLE) -> DataFrame:
    """cluster, count, top_features (by mean desc, ties by feature order), sample (first names)."""
    long = feature_means_long(df, cluster_col, features)
    w = Window.partitionBy(cluster_col).orderBy(F.col("mean").desc(), F.col("pos").asc())
    top = (long.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_n)
           .groupBy(cluster_col, "count")
           .agg(F.array_sort(F.collect_list(F.struct("r", "feature"))).alias("t"))
           .select(cluster_col, "count", F.transform("t", lambda s: s["feature"]).alias("top_features")))
    ws = Window.partitionBy(cluster_col).orderBy(F.col(order_col).asc())
    sample = (df.select(cluster_col, order_col, name_col).withColumn("r", F.row_number().over(ws))
              .filter(F.col("r") <= sample_n).groupBy(cluster_col)
              .agg(F.array_sort(F.collect_list(F.struct("r", name_col))).alias("s"))
              .select(cluster_col, F.transform("s", lambda s: s[name_col]).alias("sample")))
    return top.join(sample, cluster_col)


def feature_label(col: Column, replacements=C.DESC_LABEL_REPLACEMENTS) -> Column:
    out = col
    for a, b in replacements:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def describe_clusters(profile: DataFrame, info: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Description text per cluster from its profile and ``info`` (cluster, constraint,
    parent_constraint, is_subcluster, subcluster_id)."""
    j = profile.join(info, cluster_col)
    labels = F.array_join(F.transform("top_features", lambda f: feature_label(f)), ", ")
    parent = F.initcap(F.replace(F.coalesce(F.col("parent_constraint"), F.lit("")), F.lit("_"), F.lit(" ")))
    head = F.when(
        F.col("is_subcluster"),
        F.format_string("Cluster %d: %s (Subcluster %d) games characterized by ", F.col(cluster_col), parent,
                        F.col("subcluster_id")),
    ).otherwise(F.format_string("Cluster %d: Other games characterized by ", F.col(cluster_col)))
    return j.select(cluster_col, F.concat(head, labels).alias("description"), "constraint", "is_subcluster",
                    F.coalesce(F.col("parent_constraint"), F.lit("")).alias("parent_constraint"),
                    "top_features", "count", "sample")


# ------------------------------------------------------------------ k selection rules
def k_candidates(counts: DataFrame, n_columns: int, subset_col: str = "subset", n_col: str = "n") -> DataFrame:
    """Per subset of ``n`` rows: the candidate k values with size score and complexity penalty.

    min_k = max(2, int(ln n)); amax = max(5, int(sqrt n) / 2); max_k = min(n_columns, n - 1,
    2 * amax); k in [2, int(2 * max_k)); size score 1 inside [min_k, max_k], else decays by
    distance / max(1, int(sqrt(n) / 2)); penalty 0.1 * (k / k_last)^2."""
    n = F.col(n_col).cast("double")
    min_k = F.greatest(F.lit(2.0), F.floor(F.log(n)).cast("double"))
    amax = F.greatest(F.lit(5.0), F.floor(F.sqrt(n)) / F.lit(2.0))
    max_k = F.least(F.lit(float(n_columns)), n - F.lit(1.0), amax * F.lit(2.0))
    k_end = F.floor(max_k * F.lit(2.0)).cast("int")  # exclusive
    base = counts.select(subset_col, n_col, min_k.alias("min_k"), max_k.alias("max_k"), k_end.alias("k_end"),
                         F.floor(F.sqrt(n) / F.lit(2.0)).cast("double").alias("reasonable"))
    ks = base.filter(F.col("k_end") > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.col("k_end") - 1)))
    k = F.col("k").cast("double")
    inside = (k >= F.col("min_k")) & (k <= F.col("max_k"))
    dist = F.least(F.abs(k - F.col("min_k")), F.abs(k - F.col("max_k")))
    size = F.when(inside, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - dist / F.greatest(F.lit(1.0), F.col("reasonable"))))
    k_last = (F.col("k_end") - 1).cast("double")
    penalty = F.lit(C.COMPLEXITY_PENALTY) * F.pow(k / k_last, F.lit(2.0))
    return ks.select(subset_col, n_col, "k", "min_k", "max_k", size.alias("size_score"), penalty.alias("penalty"))


def select_k(cands: DataFrame, silhouettes: DataFrame, subset_col: str = "subset") -> DataFrame:
    """Score = 0.65 * minmax(silhouette over the subset's k values) + 0.35 * size - penalty;
    the first k with the highest score wins (all-equal silhouettes normalise to 1)."""
    j = cands.join(silhouettes, [subset_col, "k"])
    st = j.groupBy(subset_col).agg(F.min("silhouette").alias("smin"), F.max("silhouette").alias("smax"))
    s = j.join(st, subset_col)
    norm = F.when(F.col("smax") != F.col("smin"),
                  (F.col("silhouette") - F.col("smin")) / (F.col("smax") - F.col("smin"))).otherwise(F.lit(1.0))
    scored = s.withColumn("score", F.lit(C.SILHOUETTE_WEIGHT) * norm + F.lit(C.SIZE_WEIGHT) * F.col("size_score")
                          - F.col("penalty"))
    best = scored.groupBy(subset_col).agg(F.min_by("k", F.struct(-F.col("score"), F.col("k"))).alias("best_k"))
    return scored.join(best, subset_col).select(subset_col, "k", "silhouette", "size_score", "penalty", "score",
                                                (F.col("k") == F.col("best_k")).alias("selected"))
