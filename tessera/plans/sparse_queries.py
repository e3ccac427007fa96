"""Registered queries over feature sets: preparation without vocabularies, dictionary, distance and
cosine similarity, k-means over baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import feature_sets as FS
from tessera.plans import sqlgen as S
from tessera.plans.games import games
from tessera.session import cut_lineage
from tessera.sources.tables import read_table

ROUND = 6
SET_K, SET_STEPS = 6, 3


def feature_sets(spark, sf):
    """Every prepared item with the names of its features."""
    out = FS.prepare_feature_sets(cut_lineage(games(spark, sf)))
    return out.select("game_id", "popularity_score", "features")


def _sets(spark, sf, key: str) -> DataFrame:
    """The parts of each order or supplier, as features."""
    li = read_table(spark, sf, "lineitem")
    named = F.format_string("part:%d", F.col("l_partkey"))
    return li.groupBy(F.col(key).alias("key")).agg(F.collect_set(named).alias("features"))


def _numbered(spark, sf, key: str) -> tuple[DataFrame, DataFrame]:
    sets = cut_lineage(_sets(spark, sf, key))
    numbers = cut_lineage(FS.dictionary(sets))
    return cut_lineage(FS.encode(sets, numbers, "key")), numbers


def set_dictionary(spark, sf):
    return FS.dictionary(_sets(spark, sf, "l_orderkey"))


def set_pairs(spark, sf):
    """Each supplier's parts against those of the supplier with the next key."""
    sets, _ = _numbered(spark, sf, "l_suppkey")
    keys = sets.select("key").withColumn("other", F.lead("key").over(Window.orderBy("key")))  # keys alone
    other = sets.select(F.col("key").alias("other"), F.col("idxs").alias("theirs"))
    both = sets.join(keys.filter("other IS NOT NULL"), "key").join(other, "other")
    return both.select("key", "other", FS.shared(F.col("idxs"), F.col("theirs")).alias("n_shared"),
                       F.round(FS.distance(F.col("idxs"), F.col("theirs")), ROUND).alias("distance"),
                       F.round(FS.cosine(F.col("idxs"), F.col("theirs")), ROUND).alias("cosine"))


def set_kmeans(spark, sf):
    """k-means over orders as sets of parts, from the orders with the smallest keys."""
    sets, numbers = _numbered(spark, sf, "l_orderkey")
    first = sets.orderBy("key").limit(SET_K)
    starts = first.withColumn("cid", (F.row_number().over(Window.orderBy("key")) - 1).cast("int"))  # k rows
    labels, _ = FS.kmeans_sets(sets, starts.select("cid", "idxs"), numbers.count(), SET_STEPS, tolerance=-1.0)
    return labels.select(F.col("key").alias("order_key"), F.col("cid").alias("cluster"), F.round("d2", ROUND).alias("d2"))


QUERIES = {"feature_sets": feature_sets, "set_dictionary": set_dictionary, "set_pairs": set_pairs, "set_kmeans": set_kmeans}


# ------------------------------------------------------------------ oracle side
def _kmeans_sql() -> str:
    near = ("(SELECT key, cid, round(greatest(n + n2 - 2 * COALESCE(dot, 0.0), 0.0), {d}) AS d2 FROM z CROSS JOIN m{i} "
            "LEFT JOIN (SELECT x.key, c.cid, SUM(c.v) AS dot FROM x JOIN c{i} c USING (feature) GROUP BY x.key, c.cid) USING (key, cid))")
    ctes = ["x AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS feature FROM lineitem)", "z AS (SELECT key, COUNT(*) AS n FROM x GROUP BY key)",
            f"s AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS cid FROM z ORDER BY key LIMIT {SET_K})",
            "c0 AS (SELECT cid, feature, 1.0::DOUBLE AS v FROM x JOIN s USING (key))"]
    for i in range(SET_STEPS + 1):
        ctes += [f"m{i} AS (SELECT cid, SUM(v * v) AS n2 FROM c{i} GROUP BY cid)",
                 f"a{i} AS (SELECT key, arg_min(cid, struct_pack(d := d2, c := cid)) AS cid, min(d2) AS d2 FROM {near.format(i=i, d=FS.TIE_DIGITS)} GROUP BY key)"]
        if i < SET_STEPS:
            ctes += [f"w{i} AS (SELECT cid, COUNT(*) AS n FROM a{i} GROUP BY cid)",
                     f"c{i + 1} AS (SELECT cid, feature, COUNT(*) / any_value(w.n)::DOUBLE AS v FROM a{i} JOIN x USING (key) JOIN w{i} w USING (cid) "
                     f"GROUP BY cid, feature UNION ALL SELECT cid, feature, v FROM c{i} WHERE cid NOT IN (SELECT cid FROM w{i}))"]
    return (f"WITH {', '.join(ctes)} SELECT key AS order_key, CAST(cid AS INTEGER) AS cluster, round(d2, {ROUND}) AS d2 FROM a{SET_STEPS}")


def _oracles() -> dict[str, str]:
    flags = ", ".join(f"CASE WHEN {S.ident(n)} = 1 THEN {S.q(n)} END" for n in S.feature_names_in_order())
    return {
        "feature_sets": f"WITH {S.prepared_ctes()} SELECT game_id, popularity_score, "
                        f"list_sort(list_filter([{flags}], lambda x: x IS NOT NULL)) AS features FROM prepared",
        "set_dictionary": "WITH d AS (SELECT 'part:' || l_partkey AS feature, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) "
                          "SELECT feature, n, row_number() OVER (ORDER BY feature) - 1 AS idx FROM d",
        "set_pairs": "WITH x AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS f FROM lineitem), z AS (SELECT key, COUNT(*) AS n, "
                     "LEAD(key) OVER (ORDER BY key) AS other FROM x GROUP BY key), "
                     "i AS (SELECT z.key, COUNT(*) AS s FROM z JOIN x a ON a.key = z.key JOIN x b ON b.key = z.other AND b.f = a.f GROUP BY z.key) "
                     "SELECT z.key, z.other, CAST(COALESCE(s, 0) AS INTEGER) AS n_shared, "
                     f"round(sqrt(CAST(z.n + o.n - 2 * COALESCE(s, 0) AS DOUBLE)), {ROUND}) AS distance, "
                     f"round(COALESCE(s, 0) / (sqrt(z.n::DOUBLE) * sqrt(o.n::DOUBLE)), {ROUND}) AS cosine "
                     "FROM z JOIN z o ON o.key = z.other LEFT JOIN i ON i.key = z.key",
        "set_kmeans": _kmeans_sql(),
    }


ORACLES = _oracles()
