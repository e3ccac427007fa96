"""Batch top-k recommendation for any number of input items in one job.

Semantics reproduced per input ``x`` (key = item name by default):

1. cluster ``c(x)`` = lowest cluster id whose member names contain ``x``;
2. candidates = every item row whose name is a member of ``c(x)``, except rows named ``x``
   and *variants* (``lower(name)`` starts with ``lower(strip(x)) + ':'``);
3. distance = Euclidean distance between the first row (by ``order``) of ``x``'s name and
   the first row of the candidate's name inside the cluster's pool;
4. popularity, rating quality and distance are min-max normalised over the candidates;
5. candidates with normalised distance > 0.4 are cut; the rest ranked by
   ``0.25*pop_n + 0.55*(1-dist_n) + 0.20*rq_n`` (ties: ``order`` ascending), top k kept.

How it avoids comparing every input with every member of its cluster (quadratic on a hot
cluster):

* distances are computed between *distinct vectors* of a cluster only (packed 0/1 flags,
  ``popcount(xor)``). If their table is small (bytes and rows checked) it is broadcast and all pairs
  are compared; beyond, the counts per distance and the pairs within the cut come from the
  prefix methods of :mod:`tessera.operators.hamming`, which never form all pairs;
* per input, min/max distance come from per-level counts (``sqrt(h)`` for h = 0..D)
  minus the levels of its own excluded rows — exclusions are enumerated by equi-joins
  (own name; ``:``-prefixes), so the work is linear;
* popularity / rating minima and maxima are the cluster's unless an input's exclusions
  remove every row holding an extreme; only those inputs (and inputs with more than
  ``exclusion_cap`` excluded rows) take the per-input path. Both paths give the same rows;
  the parameter only says which one an input takes;
* inputs sharing (cluster, vector, dmin, dmax) share one scoring function: their top
  ``k + excluded`` rows are taken once per class from per-vector-group lists, by the final
  score itself. The group lists are cut by a partial score whose rounding differs from the
  final score's, so they keep every row that is not certainly beaten (see ``group_lists``);
  ranks with a literal limit let Spark add a map-side partial limit, so a hot group never
  reaches one task whole. Then each input drops its own excluded rows.

Vector pairs are never stored or shuffled: one pass counts rows per (vector, distance), a
second one keeps the pairs below the distance cut. Relations are built when they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import scores as SC
from tessera.functions.text import strip_unicode
from tessera.functions.vectors import dense_vector, euclidean, pack_bits, packed_distance
from tessera.operators.features import feature_columns
from tessera.operators.hamming import level_counts, within
from tessera.operators.joins import BROADCAST_BYTES, blocked_join, salted_join, size_checked_broadcast
from tessera.session import cut_lineage

EXCLUSION_CAP = 32
#: Width of the buckets in which partial scores count as tied: far above rounding (1e-16),
#: far below what makes lists long.
TIE_WIDTH = 1e-9


# ------------------------------------------------------------------ small pieces
def base_name(col: Column) -> Column:
    return F.lower(strip_unicode(col))


def variant_prefixes(key: Column) -> Column:
    """Lower-cased prefixes of ``key`` ending just before each ``:`` — a row is a variant of
    input ``x`` iff ``base_name(x)`` is one of them."""
    parts = F.split(F.lower(key), ":", -1)
    n = F.size(parts)
    return F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda j: F.array_join(F.slice(parts, F.lit(1), j), ":"))
    ).otherwise(F.array().cast("array<string>"))


def is_variant(candidate: Column, input_name: Column) -> Column:
    return F.startswith(F.lower(candidate), F.concat(base_name(input_name), F.lit(":")))


# ------------------------------------------------------------------ cluster lookups
def member_rows(items: DataFrame, members: DataFrame, key: str = "game_name") -> DataFrame:
    """Item rows whose name is a member of any cluster (semi join: rows are not multiplied)."""
    return items.join(members.select(key), key, "left_semi")


def cluster_labels(items: DataFrame, members: DataFrame, key: str = "game_name", order: str = "game_id",
                   cluster_col: str = "cluster_id", out: str = "cluster") -> DataFrame:
    """Label each row with its cluster, -1 when none: of a duplicated name only the last row is
    labelled, with the highest cluster id containing it."""
    top = members.groupBy(key).agg(F.max(cluster_col).alias("__label"))
    last = items.groupBy(key).agg(F.max(order).alias(order)).join(top, key).select(order, "__label")
    return items.join(last, order, "left").withColumn(out, F.coalesce("__label", F.lit(-1))).drop("__label")


def feature_lookup(items: DataFrame, names: DataFrame, features: list[str], key: str = "game_name",
                   order: str = "game_id") -> DataFrame:
    """(name, features, status): the feature vector of the first row of each asked name. Names
    that no item has come back with null features and the missing-name message."""
    vector = F.array(*[F.col(f"`{c}`").cast("int") for c in features])
    firsts = items.groupBy(F.col(key).alias("name")).agg(F.min_by(vector, order).alias("features"))
    asked = names.select(F.col(names.columns[0]).alias("name")).distinct()
    found = asked.join(firsts, "name", "left")
    missing = F.format_string(C.STATUS_NOT_IN_CLUSTER.replace("{}", "%s"), F.col("name"))
    return found.withColumn("status", F.when(F.col("features").isNull(), missing).otherwise(F.lit(C.STATUS_OK)))


def group_lists(rows: DataFrame, depth: int, width: float = TIE_WIDTH) -> DataFrame:
    """Rows of each (cl, w) that can be among the group's first ``depth`` by final score.

    ``rows``: cl, w, rid, pop, rq and the partial score ``t``. Rows of equal (pop, rq) score alike
    whatever the distance, so only the first ``depth`` of them by ``rid`` matter. Of the rest, a
    row goes only if ``depth`` rows are higher by more than rounding: scores are put into buckets
    twice, half a bucket apart, and in at least one of the two a near-tie is no bucket edge; a row
    that ranks within ``depth`` in either survives. Near-ties therefore all survive."""
    twin = Window.partitionBy("cl", "w", "pop", "rq").orderBy(F.col("rid").asc())
    once = rows.withColumn("twin", F.row_number().over(twin)).filter(F.col("twin") <= depth).drop("twin")
    kept = None
    for shift in (0.0, 0.5):
        bucket = F.floor(F.col("t") / F.lit(width) + F.lit(shift))
        part = (once.withColumn("grank", F.rank().over(Window.partitionBy("cl", "w").orderBy(bucket.desc())))
                .filter(F.col("grank") <= depth).drop("grank"))
        kept = part if kept is None else kept.unionByName(part)
    return kept.dropDuplicates(["cl", "w", "rid"])


def cluster_of_inputs(inputs: DataFrame, members: DataFrame) -> DataFrame:
    """input -> lowest cluster id containing it (inputs in no cluster are absent)."""
    m = members.select(F.col("cl"), F.col("key").alias("input"))
    return inputs.join(m, "input").groupBy("input").agg(F.min("cl").alias("cl"))


# ------------------------------------------------------------------ the operator
def build_pool(items: DataFrame, members: DataFrame, *, key: str = "game_name", order: str = "game_id",
               cluster_col: str = "cluster_id", features: list[str] | None = None,
               binary: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members M(cl, key), pool P(cl, key, rid, w, pop, rq), name vectors NV(cl, key, w)).

    The pool holds every item row whose name is a member of a cluster; ``w`` is the vector of
    the name's first row (by ``order``). P is materialised once (reliable checkpoint)."""
    feats = list(features or feature_columns(items))
    vec = pack_bits(feats) if binary else dense_vector(feats)
    I = items.select(F.col(key).alias("key"), F.col(order).alias("rid"), vec.alias("vec"),
                     F.col("popularity_score").cast("double").alias("pop"),
                     SC.rating_quality("avg_rating", F.nullif(F.col("num_rates").cast("double"), F.lit(0.0)))
                     .alias("rq"))
    M = members.select(F.col(cluster_col).alias("cl"), F.col(key).alias("key")).distinct()
    P0 = M.join(I, "key")
    NV = P0.groupBy("cl", "key").agg(F.min_by("vec", "rid").alias("w"))
    P = cut_lineage(P0.join(NV, ["cl", "key"]).select("cl", "key", "rid", "w", "pop", "rq"))
    NV = P.groupBy("cl", "key").agg(F.first("w").alias("w"))
    return M, P, NV


def recommend(items: DataFrame, members: DataFrame, inputs: DataFrame | None = None,
              **kw) -> tuple[DataFrame, DataFrame]:
    """Returns ``(recommendations, status)``.

    recommendations: input, cluster_id, rank, item, item_id, final_score, popularity,
    distance, rating_quality, explanation. status: input, cluster_id, status, n_recommended.
    """
    plan = recommendation_plan(items, members, inputs, **kw)
    return plan["recs"], plan["status"]


def exclusion_pairs(P: DataFrame, XC: DataFrame) -> DataFrame:
    """(input, cl, rid, key, w, pop, rq, kind): own-name rows and ':'-variants of each input inside
    its cluster, by equi-joins; no distances involved."""
    own = P.join(XC.withColumnRenamed("input", "key"), ["cl", "key"]).withColumn("input", F.col("key"))
    pre = P.select("*", F.explode(variant_prefixes(F.col("key"))).alias("pre"))
    var = pre.join(XC.select("input", "cl", base_name(F.col("input")).alias("pre")), ["cl", "pre"])
    cols = ["input", "cl", "rid", "key", "w", "pop", "rq"]
    return own.select(*cols, F.lit("own").alias("kind")).unionByName(var.select(*cols, F.lit("variant").alias("kind")))


def distance_levels(U: DataFrame, G: DataFrame, few: bool, dims: int | None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(cl, u, d, n): rows of the vector groups ``G`` (cl, w, cnt) at each distance from each vector of
    ``U`` (cl, u). ``few``: G is small and comes with a broadcast hint, so all pairs are compared;
    otherwise 0/1 vectors of ``dims`` flags are counted without pairs (``dims`` None: numeric vectors)."""
    if dims is not None and not few:
        counts = level_counts(U, G, dims, ["cl"], broadcast_bytes=broadcast_bytes)
        return counts.select("cl", "u", F.sqrt(F.col("h").cast("double")).alias("d"), "n")
    dist = packed_distance if dims is not None else euclidean
    pairs = (U.join(G, "cl") if few else salted_join(U, G, ["cl"], "u")).withColumn("d", dist(F.col("u"), F.col("w")))
    return pairs.groupBy("cl", "u", "d").agg(F.sum("cnt").alias("n"))


def recommendation_plan(items: DataFrame, members: DataFrame, inputs: DataFrame | None = None, *,
                        key: str = "game_name", order: str = "game_id", cluster_col: str = "cluster_id",
                        features: list[str] | None = None, binary: bool = True, k: int = C.TOP_K,
                        max_distance: float = C.MAX_NORMALIZED_DISTANCE,
                        exclusion_cap: int = EXCLUSION_CAP, broadcast_bytes: int = BROADCAST_BYTES,
                        ) -> dict[str, DataFrame]:
    """All intermediate relations of the batch recommendation (lazy DataFrames):

    ``recs``, ``status``; ``levels`` (input, cluster_id, distance, n_candidates);
    ``ranges`` (input, pmin, pmax, rmin, rmax, dmin, dmax over the candidates);
    ``exclusions`` (input, cl, rid, key, kind); ``pool``; ``inputs_cluster``.
    """
    dist = packed_distance if binary else euclidean
    feats = list(features or feature_columns(items))
    M, P, NV = build_pool(items, members, key=key, order=order, cluster_col=cluster_col,
                          features=feats, binary=binary)
    X = (inputs if inputs is not None else items.select(F.col(key).alias("input"))).select("input").distinct()

    XC = cluster_of_inputs(X, M)
    XU = cut_lineage(XC.join(NV.withColumnRenamed("key", "input"), ["cl", "input"]).withColumnRenamed("w", "u"))

    # exclusions: own-name rows and ':'-variants inside the input's cluster
    EK = exclusion_pairs(P, XC)
    EK = cut_lineage(EK)
    E = EK.dropDuplicates(["input", "rid"])

    # distinct-vector groups and input-vector x group distances (the only pair work)
    G = P.groupBy("cl", "w").agg(F.count(F.lit(1)).alias("cnt"))
    U = XU.select("cl", "u").distinct()
    G, few = size_checked_broadcast(G, broadcast_bytes)
    LV = distance_levels(U, G, few, len(feats) if binary else None, broadcast_bytes)

    # exact per-input distance range over the remaining candidates
    EXL = (E.join(XU.select("input", "u"), "input").withColumn("d", dist(F.col("u"), F.col("w")))
           .groupBy("input", "d").agg(F.count(F.lit(1)).alias("e")))
    REM = (XU.join(LV, ["cl", "u"]).join(EXL, ["input", "d"], "left")
           .withColumn("rem", F.col("n") - F.coalesce(F.col("e"), F.lit(0))).filter(F.col("rem") > 0))
    DS = REM.groupBy("input").agg(F.min("d").alias("dmin"), F.max("d").alias("dmax"))

    # cluster-level score ranges and how many rows hold each extreme
    CS = P.groupBy("cl").agg(F.min("pop").alias("pmin"), F.max("pop").alias("pmax"),
                             F.min("rq").alias("rmin"), F.max("rq").alias("rmax"),
                             F.count(F.lit(1)).alias("n_rows"))
    CSb, _ = size_checked_broadcast(CS, broadcast_bytes)
    ext = lambda a, b: F.sum((F.col(a) == F.col(b)).cast("long"))
    CX = (P.join(CSb, "cl").groupBy("cl")
          .agg(ext("pop", "pmin").alias("c_pmin"), ext("pop", "pmax").alias("c_pmax"),
               ext("rq", "rmin").alias("c_rmin"), ext("rq", "rmax").alias("c_rmax")))
    CST = CS.join(CX, "cl").join(M.groupBy("cl").agg(F.count(F.lit(1)).alias("n_names")), "cl")
    CSTb, _ = size_checked_broadcast(CST, broadcast_bytes)
    EE = (E.join(CSTb, "cl").groupBy("input")
          .agg(ext("pop", "pmin").alias("e_pmin"), ext("pop", "pmax").alias("e_pmax"),
               ext("rq", "rmin").alias("e_rmin"), ext("rq", "rmax").alias("e_rmax"),
               F.count(F.lit(1)).alias("e_all")))
    own_n = EK.filter(F.col("kind") == "own").groupBy("input").agg(F.count(F.lit(1)).alias("e_own"))

    ST = (XU.join(CSTb, "cl").join(EE, "input", "left").join(own_n, "input", "left").join(DS, "input", "left")
          .fillna(0, ["e_pmin", "e_pmax", "e_rmin", "e_rmax", "e_all", "e_own"]))
    ok = (F.col("n_names") > 1) & (F.col("n_rows") - F.col("e_own") > 0) & F.col("dmin").isNotNull() \
        & (F.col("dmax") != F.col("dmin"))
    fallback = ((F.col("e_pmin") >= F.col("c_pmin")) | (F.col("e_pmax") >= F.col("c_pmax"))
                | (F.col("e_rmin") >= F.col("c_rmin")) | (F.col("e_rmax") >= F.col("c_rmax"))
                | (F.col("e_all") > exclusion_cap))
    has_cand = F.col("dmin").isNotNull()
    ST = cut_lineage(ST.withColumn("path", F.when(~ok, F.lit("none")).when(fallback, F.lit("exact"))
                                   .otherwise(F.lit("class")))
                     .withColumn("exact_ranges", has_cand & fallback))

    w_pop, w_dist, w_rq = C.REC_POPULARITY_WEIGHT, C.REC_DISTANCE_WEIGHT, C.REC_RATING_QUALITY_WEIGHT
    depth_lit = k + exclusion_cap

    # ---- class path: per-vector-group top lists by the cluster-level partial score
    pn_c = SC.minmax(F.col("pop"), F.col("pmin"), F.col("pmax"))
    rn_c = SC.minmax(F.col("rq"), F.col("rmin"), F.col("rmax"))
    GL = group_lists(P.join(CSb, "cl").withColumn("pn", pn_c).withColumn("rn", rn_c)
                     .withColumn("t", F.col("pn") * F.lit(w_pop) + F.col("rn") * F.lit(w_rq)), depth_lit)
    NM = ST.filter(F.col("path") == "class")
    TH = NM.groupBy("cl", "u", "dmin", "dmax").agg(F.max("e_all").alias("emax"))
    if binary and not few:
        far = F.col("dmin") + F.lit(max_distance) * (F.col("dmax") - F.col("dmin"))
        near = within(TH.withColumn("radius", F.floor(far * far + 1e-6)), G, len(feats), ["cl"], broadcast_bytes=broadcast_bytes)
        pairs = TH.join(near.select("cl", "u", "w"), ["cl", "u"])
    else:
        pairs = TH.join(G.select("cl", "w"), "cl") if few else salted_join(TH, G.select("cl", "w"), ["cl"], "u")
    TA = (pairs.withColumn("d", dist(F.col("u"), F.col("w")))
          .withColumn("dn", SC.minmax(F.col("d"), F.col("dmin"), F.col("dmax")))
          .filter(F.col("dn") <= F.lit(max_distance)))
    theta = ["cl", "u", "dmin", "dmax"]
    TC = (TA.join(GL.select("cl", "w", "rid", "key", "pop", "rq", "pn", "rn"), ["cl", "w"])
          .withColumn("s", SC.final_score(F.col("pn"), F.col("dn"), F.col("rn")))
          .withColumn("trank", F.row_number().over(
              Window.partitionBy(*theta).orderBy(F.col("s").desc(), F.col("rid").asc())))
          .filter(F.col("trank") <= depth_lit)
          .filter(F.col("trank") <= F.lit(k) + F.col("emax")))
    class_rows = (NM.select("input", *theta, "pmin", "pmax", "rmin", "rmax")
                  .join(TC.select(*theta, "rid", "key", "pop", "rq", "d"), theta)
                  .join(E.select("input", "rid"), ["input", "rid"], "left_anti"))

    # ---- exact path: brute force over the cluster pool for the few flagged inputs
    FB = ST.filter(F.col("exact_ranges")).select("input", "cl", "u", "dmin", "dmax", "path")
    fb = (blocked_join(P, FB, ["cl"], "rid", broadcast_bytes).join(E.select("input", "rid"), ["input", "rid"], "left_anti")
          .withColumn("d", dist(F.col("u"), F.col("w"))))
    fstats = fb.groupBy("input").agg(F.min("pop").alias("pmin"), F.max("pop").alias("pmax"),
                                     F.min("rq").alias("rmin"), F.max("rq").alias("rmax"))
    exact_rows = (fb.filter(F.col("path") == "exact").join(fstats, "input")
                  .select("input", *theta, "pmin", "pmax", "rmin", "rmax", "rid", "key", "pop", "rq", "d"))

    # ---- common scoring in the reproduced evaluation order
    rows = class_rows.unionByName(exact_rows)
    pop_n = SC.minmax(F.col("pop"), F.col("pmin"), F.col("pmax"))
    rq_n = SC.minmax(F.col("rq"), F.col("rmin"), F.col("rmax"))
    dist_n = SC.minmax(F.col("d"), F.col("dmin"), F.col("dmax"))
    scored = (rows.withColumn("popularity", pop_n).withColumn("rating_quality", rq_n)
              .withColumn("distance", dist_n)
              .filter(F.col("distance") <= F.lit(max_distance))
              .withColumn("final_score", SC.final_score(F.col("popularity"), F.col("distance"),
                                                        F.col("rating_quality"))))
    rank = F.row_number().over(Window.partitionBy("input").orderBy(F.col("final_score").desc(), F.col("rid").asc()))
    recs = (scored.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("input", F.col("cl").alias("cluster_id"), "rank", F.col("key").alias("item"),
                    F.col("rid").alias("item_id"), "final_score", "popularity", "distance", "rating_quality",
                    SC.explanation(F.col("distance"), F.col("popularity"), F.col("rating_quality"))
                    .alias("explanation")))

    counts = recs.groupBy("input").agg(F.count(F.lit(1)).alias("n_recommended"))
    status_txt = (
        F.when(F.col("cl").isNull(), F.format_string(C.STATUS_NOT_IN_CLUSTER.replace("{}", "%s"), F.col("input")))
        .when(F.col("n_names") <= 1, F.lit(C.STATUS_NO_OTHER))
        .when(F.col("n_rows") - F.coalesce(F.col("e_own"), F.lit(0)) <= 0, F.lit(C.STATUS_NONE_IN_FRAME))
        .when(F.coalesce(F.col("n_recommended"), F.lit(0)) == 0,
              F.format_string(C.STATUS_NONE_SIMILAR.replace("{}", "%s"), F.col("input")))
        .otherwise(F.lit(C.STATUS_OK))
    )
    status = (X.join(ST.select("input", "cl", "n_names", "n_rows", "e_own"), "input", "left")
              .join(counts, "input", "left")
              .select("input", F.col("cl").alias("cluster_id"), status_txt.alias("status"),
                      F.coalesce(F.col("n_recommended"), F.lit(0)).alias("n_recommended")))
    class_ranges = (ST.filter(F.col("dmin").isNotNull() & ~F.col("exact_ranges"))
                    .select("input", "pmin", "pmax", "rmin", "rmax", "dmin", "dmax"))
    exact_ranges = fstats.join(DS, "input").select("input", "pmin", "pmax", "rmin", "rmax", "dmin", "dmax")
    levels = REM.select("input", F.col("cl").alias("cluster_id"), F.col("d").alias("distance"),
                        F.col("rem").alias("n_candidates"))
    return {
        "recs": recs,
        "status": status,
        "levels": levels,
        "ranges": class_ranges.unionByName(exact_ranges),
        "exclusions": EK.select("input", "cl", "rid", "key", "kind"),
        "pool": P,
        "members": M,
        "inputs_cluster": XC,
        "groups": G,
    }
