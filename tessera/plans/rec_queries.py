"""Registered queries for recommendation scoring and its relational pieces.

The cluster assignment used here is deterministic (constraint flag x difficulty bucket),
so every query has an exact DuckDB twin; the k-means clusterings are registered in
:mod:`tessera.plans.cluster_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import scores as SC
from tessera.functions.vectors import pack_bits, pack_flags, packed_distance
from tessera.operators import recommend as R
from tessera.operators.constrained import split_by_constraints
from tessera.operators.features import feature_columns
from tessera.operators.hamming import farthest, indexed_within, nearest
from tessera.operators.joins import size_checked_broadcast
from tessera.plans import sqlgen as S
from tessera.plans.prep_queries import prepared
from tessera.session import cut_lineage
from tessera.sources.tables import read_table

DIFFICULTY_ORDER = [lbl for _, lbl in C.DIFFICULTY_BUCKETS]
CONSTRAINT = C.CONSTRAINT_COLUMNS[0]


def fixed_cluster_expr() -> F.Column:
    idx = None
    for i, lbl in enumerate(DIFFICULTY_ORDER):
        cond = F.col("game_difficulty_group") == lbl
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    return (F.col(CONSTRAINT) * F.lit(len(DIFFICULTY_ORDER)) + idx).cast("int")


def clustered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # the prepared table is a materialised stage (the pipeline's own snapshot), read back once
    items = cut_lineage(prepared(spark, sf).withColumn("cluster_id", fixed_cluster_expr()))
    members = items.select("cluster_id", "game_name").distinct()
    return items, members


def plan(spark, sf):
    items, members = clustered(spark, sf)
    return R.recommendation_plan(items, members)


def recommendations(spark, sf):
    p = plan(spark, sf)
    return p["recs"], p["status"]


# ------------------------------------------------------------------ scoring keys
def recommend_topk(spark, sf):
    return recommendations(spark, sf)[0]


def recommend_status(spark, sf):
    return recommendations(spark, sf)[1]


def rating_quality(spark, sf):
    items = prepared(spark, sf)
    return items.select("game_id", SC.rating_quality().alias("rating_quality_upper"),
                        SC.rating_quality(bound="lower").alias("rating_quality_lower"))


def normalize_direction(spark, sf):
    items = prepared(spark, sf)
    mm = items.agg(F.min("popularity_score").alias("lo"), F.max("popularity_score").alias("hi"))
    j = items.crossJoin(F.broadcast(mm))  # one row
    v, lo, hi = F.col("popularity_score"), F.col("lo"), F.col("hi")
    return j.select("game_id", SC.minmax_direction(v, lo, hi, True).alias("higher_better"),
                    SC.minmax_direction(v, lo, hi, False).alias("lower_better"))


def anchor_scores(spark, sf):
    """Every item scored against its cluster's anchor (the cluster's first item): cluster-level
    min-max of popularity, rating quality and distance-to-anchor, then the final score."""
    items, _ = clustered(spark, sf)
    feats = feature_columns(items)
    x = items.select("game_id", "game_name", "cluster_id", "popularity_score",
                     SC.rating_quality().alias("rq"), pack_bits(feats).alias("vec"))
    anchor = x.groupBy("cluster_id").agg(F.min_by("vec", "game_id").alias("avec"))
    y = x.join(anchor, "cluster_id").withColumn("d", packed_distance(F.col("vec"), F.col("avec")))
    st = y.groupBy("cluster_id").agg(
        F.min("popularity_score").alias("pmin"), F.max("popularity_score").alias("pmax"),
        F.min("rq").alias("rmin"), F.max("rq").alias("rmax"), F.min("d").alias("dmin"), F.max("d").alias("dmax"))
    z = y.join(st, "cluster_id")
    pn = SC.minmax(F.col("popularity_score"), F.col("pmin"), F.col("pmax"))
    rn = SC.minmax(F.col("rq"), F.col("rmin"), F.col("rmax"))
    dn = SC.minmax(F.col("d"), F.col("dmin"), F.col("dmax"))
    return z.select("game_id", "cluster_id", pn.alias("popularity"), dn.alias("distance"), rn.alias("rating_quality"),
                    SC.final_score(pn, dn, rn).alias("final_score"))


def final_score(spark, sf):
    return anchor_scores(spark, sf)


def explain(spark, sf):
    a = anchor_scores(spark, sf)
    return a.select("game_id", SC.explanation(F.col("distance"), F.col("popularity"), F.col("rating_quality"))
                    .alias("explanation"))


def input_level_counts(spark, sf):
    """Per input and distance level, the candidate rows left after exclusions."""
    return plan(spark, sf)["levels"]


def input_distances(spark, sf):
    return input_level_counts(spark, sf)


def similarity_cut(spark, sf):
    """Per input: candidates kept / removed by the normalised-distance cut — from the level
    counts, no candidate pairs."""
    lv = input_level_counts(spark, sf)
    st = lv.groupBy("input").agg(F.min("distance").alias("dmin"), F.max("distance").alias("dmax"))
    j = lv.join(st, "input").withColumn("dn", SC.minmax(F.col("distance"), F.col("dmin"), F.col("dmax")))
    keep = F.col("dn") <= F.lit(C.MAX_NORMALIZED_DISTANCE)
    return j.groupBy("input").agg(
        F.sum(F.when(keep, F.col("n_candidates")).otherwise(0)).alias("kept"),
        F.sum(F.when(~keep, F.col("n_candidates")).otherwise(0)).alias("cut"))


def minmax_normalize(spark, sf):
    """Per input: min / max of popularity, rating quality and distance over its candidates
    (the normalisation ranges) — cluster totals unless exclusions hold an extreme."""
    return plan(spark, sf)["ranges"]


# ------------------------------------------------------------------ relational keys
def cluster_semi_join(spark, sf):
    items, members = clustered(spark, sf)
    m = members.select(F.col("cluster_id").alias("member_of"), "game_name")
    return R.member_rows(items, members).select("game_id", "game_name").join(m, "game_name") \
        .select("member_of", "game_id", "game_name")


def candidate_antijoin(spark, sf):
    """Per input: candidate names (cluster names minus the input) and candidate rows."""
    items, members = clustered(spark, sf)
    M, P, _ = R.build_pool(items, members)
    XC = R.cluster_of_inputs(items.select(F.col("game_name").alias("input")).distinct(), M)
    names = M.groupBy("cl").agg(F.count(F.lit(1)).alias("n_names"))
    rows = P.groupBy("cl").agg(F.count(F.lit(1)).alias("n_rows"))
    own = P.join(XC.withColumnRenamed("input", "key"), ["cl", "key"]).groupBy(F.col("key").alias("input")) \
        .agg(F.count(F.lit(1)).alias("n_own"))
    return (XC.join(names, "cl").join(rows, "cl").join(own, "input", "left")
            .select("input", F.col("cl").alias("cluster_id"), (F.col("n_names") - 1).alias("candidate_names"),
                    (F.col("n_rows") - F.coalesce(F.col("n_own"), F.lit(0))).alias("candidate_rows")))


def find_cluster(spark, sf):
    items, members = clustered(spark, sf)
    X = items.select(F.col("game_name").alias("input")).distinct()
    M = members.select(F.col("cluster_id").alias("cl"), F.col("game_name").alias("key"))
    return R.cluster_of_inputs(X, M).withColumnRenamed("cl", "cluster_id")


def cluster_labels(spark, sf):
    items, members = clustered(spark, sf)
    return R.cluster_labels(items, members).select("game_id", "game_name", "cluster")


def pairwise_distance(spark, sf):
    """Per cluster: how many ordered row pairs lie at each distance — from the distinct vectors'
    counts per distance (`distance_levels`), never from row pairs."""
    items, members = clustered(spark, sf)
    _, P, _ = R.build_pool(items, members)
    G = P.groupBy("cl", "w").agg(F.count(F.lit(1)).alias("cnt"))
    G, few = size_checked_broadcast(G)
    mine = G.select("cl", F.col("w").alias("u"), F.col("cnt").alias("cu"))
    levels = R.distance_levels(mine.select("cl", "u"), G, few, len(feature_columns(items)))
    return levels.join(mine, ["cl", "u"]).groupBy("cl", "d").agg(F.sum(F.col("cu") * F.col("n")).alias("n_pairs")) \
        .select(F.col("cl").alias("cluster_id"), F.col("d").alias("distance"), "n_pairs")


SIGN_BITS, SIGN_RADIUS = 64, 20


def range_search(spark, sf):
    """Per embedding, among the sign vectors of its label: rows within ``SIGN_RADIUS`` bits (itself
    included), distance to the nearest other vector and to the farthest one."""
    e = cut_lineage(read_table(spark, sf, "embeddings").select(
        "vec_id", "label", pack_flags([F.get("embedding", F.lit(j)) > 0 for j in range(SIGN_BITS)]).alias("u")))
    table = e.groupBy("label", F.col("u").alias("w")).agg(F.count(F.lit(1)).alias("cnt"))
    queries = e.select("label", "u").distinct().withColumn("radius", F.lit(SIGN_RADIUS))
    inside = indexed_within(queries, table, SIGN_BITS, ["label"], count="cnt").withColumnRenamed("n", "n_within")
    near = nearest(queries, table, SIGN_BITS, ["label"], others=False).select("label", "u", F.col("h").alias("nearest"))
    far = farthest(queries, table, SIGN_BITS, ["label"]).select("label", "u", F.col("h").alias("farthest"))
    return (e.join(inside, ["label", "u"]).join(near, ["label", "u"], "left").join(far, ["label", "u"])
            .select("vec_id", "n_within", "nearest", "farthest"))


def constraint_split(spark, sf):
    """Every row goes to each constraint it satisfies; rows matching none go to the remainder."""
    return split_by_constraints(prepared(spark, sf), C.CONSTRAINT_COLUMNS).select("game_id", "subset")


def feature_lookup(spark, sf):
    """Feature vector of the first row of every name (point lookup served for all names at once)."""
    items = prepared(spark, sf)
    return R.feature_lookup(items, items.select("game_name"), feature_columns(items)).select(
        F.col("name").alias("game_name"), "features")


def variant_filter(spark, sf):
    """(input, variant row) pairs removed by the ':'-variant rule inside the input's cluster
    (enumerated by an equi-join on name prefixes, not by comparing names pairwise)."""
    items, members = clustered(spark, sf)
    M, P, _ = R.build_pool(items, members)
    ex = R.exclusion_pairs(P, R.cluster_of_inputs(items.select(F.col("game_name").alias("input")).distinct(), M))
    own = ex.filter(F.col("kind") == "own").select("input", "rid")
    return (ex.filter(F.col("kind") == "variant").join(own, ["input", "rid"], "left_anti")
            .select("input", F.col("rid").alias("variant_id"), F.col("key").alias("variant")).distinct())


QUERIES = {
    "rating_quality": rating_quality,
    "minmax_normalize": minmax_normalize,
    "normalize_direction": normalize_direction,
    "final_score": final_score,
    "similarity_cut": similarity_cut,
    "recommend_topk": recommend_topk,
    "recommend_status": recommend_status,
    "explain": explain,
    "cluster_semi_join": cluster_semi_join,
    "candidate_antijoin": candidate_antijoin,
    "find_cluster": find_cluster,
    "cluster_labels": cluster_labels,
    "pairwise_distance": pairwise_distance,
    "range_search": range_search,
    "input_distances": input_distances,
    "constraint_split": constraint_split,
    "feature_lookup": feature_lookup,
    "variant_filter": variant_filter,
}


# ------------------------------------------------------------------ oracle side
Z2 = repr(C.WILSON_Z ** 2)


def rq_sql(bound: str = "upper") -> str:
    p = "(avg_rating / 10.0)"
    n = "CAST(num_rates AS DOUBLE)"
    root = f"CAST({C.WILSON_Z} AS DOUBLE) * sqrt({p} * (1.0 - {p}) / {n} + CAST({Z2} AS DOUBLE) / (4.0 * ({n} * {n})))"
    centre = f"{p} + CAST({Z2} AS DOUBLE) / (2.0 * {n})"
    sign = "+" if bound == "upper" else "-"
    return f"(({centre} {sign} {root}) / (1.0 + CAST({Z2} AS DOUBLE) / {n}))"


def cluster_sql() -> str:
    arms = " ".join(f"WHEN game_difficulty_group = {S.q(l)} THEN {i}" for i, l in enumerate(DIFFICULTY_ORDER))
    return f"CAST({S.ident(CONSTRAINT)} * {len(DIFFICULTY_ORDER)} + (CASE {arms} END) AS INTEGER)"


def vec_sql() -> str:
    return "[" + ", ".join(S.ident(n) for n in S.feature_names_in_order()) + "]::DOUBLE[]"


def minmax_sql(v, lo, hi, const="1.0") -> str:
    return f"(CASE WHEN {hi} <> {lo} THEN ({v} - {lo}) / ({hi} - {lo}) ELSE CAST({const} AS DOUBLE) END)"


def final_sql(pn, dn, rn) -> str:
    return (f"({pn} * CAST({C.REC_POPULARITY_WEIGHT} AS DOUBLE) + (1.0 - {dn}) * CAST({C.REC_DISTANCE_WEIGHT} AS DOUBLE)"
            f" + {rn} * CAST({C.REC_RATING_QUALITY_WEIGHT} AS DOUBLE))")


def explain_sql(dn, pn, rn) -> str:
    hi, mid, lo = C.EXPLAIN_SIM_THRESHOLDS
    t = C.EXPLAIN_SECONDARY_THRESHOLD
    first = (f"(CASE WHEN 1.0 - {dn} > {hi} THEN {S.q(C.EXPLAIN_VERY_SIMILAR)} WHEN 1.0 - {dn} > {mid} "
             f"THEN {S.q(C.EXPLAIN_MANY_SHARED)} WHEN 1.0 - {dn} > {lo} THEN {S.q(C.EXPLAIN_SOME_SHARED)} END)")
    second = f"(CASE WHEN {first} IS NOT NULL AND {pn} > {t} THEN {S.q(C.EXPLAIN_POPULAR)} END)"
    third = f"(CASE WHEN {first} IS NOT NULL AND {rn} > {t} THEN {S.q(C.EXPLAIN_WELL_RATED)} END)"
    return f"(concat_ws({S.q(C.EXPLAIN_JOINER)}, {first}, {second}, {third}) || '.')"


def rec_ctes() -> str:
    return f"""{S.prepared_ctes()},
items AS (SELECT game_id AS rid, game_name AS key, {cluster_sql()} AS cl, popularity_score AS pop,
                 {rq_sql()} AS rq, {vec_sql()} AS vec FROM prepared),
members AS (SELECT DISTINCT cl, key FROM items),
pool AS (SELECT m.cl, i.key, i.rid, i.pop, i.rq, i.vec FROM members m JOIN items i ON i.key = m.key),
nv AS (SELECT cl, key, arg_min(vec, rid) AS w FROM pool GROUP BY cl, key),
pw AS (SELECT pool.*, nv.w FROM pool JOIN nv USING (cl, key)),
inputs AS (SELECT DISTINCT key AS input FROM items),
ic AS (SELECT i.input, MIN(m.cl) AS cl FROM inputs i JOIN members m ON m.key = i.input GROUP BY i.input),
iu AS (SELECT ic.*, nv.w AS u FROM ic JOIN nv ON nv.cl = ic.cl AND nv.key = ic.input),
cand AS (SELECT iu.input, iu.cl, pw.rid, pw.key, pw.pop, pw.rq, list_distance(iu.u, pw.w) AS d
         FROM iu JOIN pw ON pw.cl = iu.cl AND pw.key <> iu.input
         WHERE NOT starts_with(lower(pw.key), lower(trim(iu.input)) || ':')),
st AS (SELECT input, min(pop) AS pmin, max(pop) AS pmax, min(rq) AS rmin, max(rq) AS rmax,
              min(d) AS dmin, max(d) AS dmax FROM cand GROUP BY input),
nrm AS (SELECT c.input, c.cl, c.rid, c.key, {minmax_sql('pop', 'pmin', 'pmax')} AS popularity,
               {minmax_sql('rq', 'rmin', 'rmax')} AS rating_quality, {minmax_sql('d', 'dmin', 'dmax')} AS distance
        FROM cand c JOIN st USING (input)),
sc AS (SELECT *, {final_sql('popularity', 'distance', 'rating_quality')} AS final_score FROM nrm
       WHERE distance <= {C.MAX_NORMALIZED_DISTANCE}),
rk AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY final_score DESC, rid ASC) AS rank FROM sc),
topk AS (SELECT * FROM rk WHERE rank <= {C.TOP_K})"""


def anchor_ctes() -> str:
    return f"""{S.prepared_ctes()},
x AS (SELECT game_id, game_name, {cluster_sql()} AS cluster_id, popularity_score, {rq_sql()} AS rq,
             {vec_sql()} AS vec FROM prepared),
an AS (SELECT cluster_id, arg_min(vec, game_id) AS avec FROM x GROUP BY cluster_id),
y AS (SELECT x.*, list_distance(x.vec, an.avec) AS d FROM x JOIN an USING (cluster_id)),
st AS (SELECT cluster_id, min(popularity_score) AS pmin, max(popularity_score) AS pmax, min(rq) AS rmin,
              max(rq) AS rmax, min(d) AS dmin, max(d) AS dmax FROM y GROUP BY cluster_id),
z AS (SELECT y.game_id, y.cluster_id, {minmax_sql('popularity_score', 'pmin', 'pmax')} AS popularity,
             {minmax_sql('d', 'dmin', 'dmax')} AS distance, {minmax_sql('rq', 'rmin', 'rmax')} AS rating_quality
      FROM y JOIN st USING (cluster_id))"""


def _oracles() -> dict[str, str]:
    base = f"WITH {rec_ctes()}"
    levels = (f"{base}, lv AS (SELECT input, cl AS cluster_id, d AS distance, COUNT(*) AS n_candidates "
              "FROM cand GROUP BY input, cl, d)")
    st_status = (
        f"{base}, nn AS (SELECT cl, COUNT(*) AS n_names FROM members GROUP BY cl), "
        "cnt AS (SELECT input, COUNT(*) AS n FROM topk GROUP BY input) "
        "SELECT i.input, ic.cl AS cluster_id, CASE "
        f"WHEN ic.cl IS NULL THEN 'Game ''' || i.input || ''' not found in any cluster' "
        f"WHEN nn.n_names <= 1 THEN {S.q(C.STATUS_NO_OTHER)} "
        f"WHEN COALESCE(cnt.n, 0) = 0 THEN 'No games similar enough to ''' || i.input || ''' were found' "
        f"ELSE {S.q(C.STATUS_OK)} END AS status, COALESCE(cnt.n, 0) AS n_recommended "
        "FROM inputs i LEFT JOIN ic USING (input) LEFT JOIN nn ON nn.cl = ic.cl LEFT JOIN cnt USING (input)"
    )
    return {
        "recommend_topk": (
            f"{base} SELECT input, cl AS cluster_id, CAST(rank AS INTEGER) AS rank, key AS item, rid AS item_id, "
            f"final_score, popularity, distance, rating_quality, "
            f"{explain_sql('distance', 'popularity', 'rating_quality')} AS explanation FROM topk"),
        "recommend_status": st_status,
        "rating_quality": f"WITH {S.prepared_ctes()} SELECT game_id, {rq_sql()} AS rating_quality_upper, "
                          f"{rq_sql('lower')} AS rating_quality_lower FROM prepared",
        "normalize_direction": (
            f"WITH {S.prepared_ctes()}, mm AS (SELECT min(popularity_score) AS lo, max(popularity_score) AS hi "
            f"FROM prepared) SELECT game_id, {minmax_sql('popularity_score', 'lo', 'hi')} AS higher_better, "
            f"(CASE WHEN hi <> lo THEN 1.0 - (popularity_score - lo) / (hi - lo) ELSE CAST(0.0 AS DOUBLE) END) "
            f"AS lower_better FROM prepared CROSS JOIN mm"),
        "final_score": f"WITH {anchor_ctes()} SELECT *, {final_sql('popularity', 'distance', 'rating_quality')} "
                       "AS final_score FROM z",
        "explain": f"WITH {anchor_ctes()} SELECT game_id, "
                   f"{explain_sql('distance', 'popularity', 'rating_quality')} AS explanation FROM z",
        "input_distances": f"{levels} SELECT * FROM lv",
        "similarity_cut": (
            f"{levels}, s AS (SELECT input, min(distance) AS dmin, max(distance) AS dmax FROM lv GROUP BY input), "
            f"j AS (SELECT lv.*, {minmax_sql('distance', 'dmin', 'dmax')} AS dn FROM lv JOIN s USING (input)) "
            f"SELECT input, SUM(CASE WHEN dn <= {C.MAX_NORMALIZED_DISTANCE} THEN n_candidates ELSE 0 END) AS kept, "
            f"SUM(CASE WHEN dn <= {C.MAX_NORMALIZED_DISTANCE} THEN 0 ELSE n_candidates END) AS cut "
            "FROM j GROUP BY input"),
        "minmax_normalize": f"{base} SELECT input, pmin, pmax, rmin, rmax, dmin, dmax FROM st",
        "cluster_semi_join": f"{base} SELECT m.cl AS member_of, i.rid AS game_id, i.key AS game_name "
                             "FROM items i JOIN members m ON m.key = i.key",
        "candidate_antijoin": (
            f"{base}, nn AS (SELECT cl, COUNT(*) AS n_names FROM members GROUP BY cl), "
            "nr AS (SELECT cl, COUNT(*) AS n_rows FROM pool GROUP BY cl), "
            "own AS (SELECT ic.input, COUNT(*) AS n_own FROM ic JOIN pool p ON p.cl = ic.cl AND p.key = ic.input "
            "GROUP BY ic.input) SELECT ic.input, ic.cl AS cluster_id, nn.n_names - 1 AS candidate_names, "
            "nr.n_rows - COALESCE(own.n_own, 0) AS candidate_rows FROM ic JOIN nn USING (cl) JOIN nr USING (cl) "
            "LEFT JOIN own USING (input)"),
        "find_cluster": f"{base} SELECT input, cl AS cluster_id FROM ic",
        "cluster_labels": (
            f"{base}, top AS (SELECT key, MAX(cl) AS label FROM members GROUP BY key), "
            "last AS (SELECT key, MAX(rid) AS rid FROM items GROUP BY key) "
            "SELECT i.rid AS game_id, i.key AS game_name, COALESCE(CASE WHEN last.rid = i.rid THEN top.label END, -1) "
            "AS cluster FROM items i JOIN last USING (key) JOIN top USING (key)"),
        "pairwise_distance": (
            f"{base}, g AS (SELECT cl, w, COUNT(*) AS cnt FROM pw GROUP BY cl, w) "
            "SELECT a.cl AS cluster_id, list_distance(a.w, b.w) AS distance, SUM(a.cnt * b.cnt) AS n_pairs "
            "FROM g a JOIN g b ON a.cl = b.cl GROUP BY a.cl, list_distance(a.w, b.w)"),
        "range_search": (
            "WITH e AS (SELECT vec_id, label, "
            + ", ".join("+".join(f"(CASE WHEN embedding[{j + 1}] > 0 THEN {1 << j - a}::BIGINT ELSE 0 END)" for j in range(a, a + 32)) + f" AS s{a}"
                        for a in range(0, SIGN_BITS, 32))
            + " FROM embeddings), p AS (SELECT a.vec_id, bit_count(xor(a.s0, b.s0)) + bit_count(xor(a.s32, b.s32)) AS h FROM e a JOIN e b "
            f"ON a.label = b.label) SELECT vec_id, COUNT(*) FILTER (h <= {SIGN_RADIUS}) AS n_within, "
            "CAST(MIN(h) FILTER (h > 0) AS BIGINT) AS nearest, CAST(MAX(h) AS BIGINT) AS farthest FROM p GROUP BY vec_id"),
        "constraint_split": (
            f"WITH {S.prepared_ctes()} SELECT game_id, CASE WHEN {S.ident(CONSTRAINT)} = 1 THEN {S.q(CONSTRAINT)} "
            "ELSE 'remainder' END AS subset FROM prepared"),
        "feature_lookup": (
            f"WITH {S.prepared_ctes()} SELECT game_name, arg_min("
            + "[" + ", ".join(S.ident(n) for n in S.feature_names_in_order()) + "]::INTEGER[], game_id) AS features "
            "FROM prepared GROUP BY game_name"),
        "variant_filter": (
            f"{base} SELECT ic.input, p.rid AS variant_id, p.key AS variant FROM ic JOIN pool p ON p.cl = ic.cl "
            "AND p.key <> ic.input WHERE starts_with(lower(p.key), lower(trim(ic.input)) || ':')"),
    }


ORACLES = _oracles()
