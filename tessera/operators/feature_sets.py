"""Feature sets: sorted arrays of feature numbers instead of one 0/1 column per value.

A one-hot table needs its vocabulary in the plan, so it has to be bounded. A feature set needs none:
preparation names the features of each row (:func:`feature_names`), a distributed dictionary numbers
the names without gaps (:func:`dictionary`), and distance, cosine similarity and k-means work on the
sorted numbers. Categories, designers or baskets of any vocabulary go through, and nothing of it
is collected, except a centroid table whose cells are counted first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.text import clean_text
from tessera.operators import features as FE
from tessera.operators.joins import BROADCAST_BYTES, blocked_join
from tessera.session import materialise

#: Cells (features x clusters) of a centroid table that tasks may hold as one matrix.
MATRIX_CELLS = 8_000_000
#: Cells that reach the driver in one job when it fills that matrix.
FETCH_CELLS = 1_000_000
#: Decimals to which squared distances are compared, so that ties do not depend on the order of sums.
TIE_DIGITS = 9


# ------------------------------------------------------------------ preparation
def _prefixed(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lower(value.cast("string")))


def list_features(values: Column, prefix: str, groups: Mapping[str, Sequence[str]] | None = None,
                  group_prefix: str = C.CATEGORY_GROUP_PREFIX) -> Column:
    """Feature names of a list: each value's own, or those of the groups that it is a member of."""
    names = F.transform(F.array_compact(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))), lambda v: _prefixed(prefix, v))
    if not groups:
        return names
    member_of: dict[str, list[str]] = {}
    for group, members in groups.items():
        for m in members:
            member_of.setdefault(f"{prefix}_{m}", []).append(f"{group_prefix}_{group}")
    table = F.create_map(*[x for m, gs in member_of.items() for x in (F.lit(m), F.array(*map(F.lit, gs)))])
    return F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.array(n))))


def feature_names(df: DataFrame, lists: Mapping[str, str] | None = None, groups: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Sorted names of a prepared row's features: those of the one-hot columns that would be 1.

    ``lists`` (column -> prefix) adds free lists or scalars, of any vocabulary."""
    age, duration, difficulty = FE._bucket_exprs()
    scalars = [(C.AGE_PREFIX, age), (C.DURATION_PREFIX, duration), (C.DIFFICULTY_PREFIX, difficulty), (C.LANGUAGE_PREFIX, FE._encoded_language())]
    parts = [F.array(*[_prefixed(p, v) for p, v in scalars]), list_features(F.col("categories"), C.CATEGORY_PREFIX, groups or C.CATEGORY_GROUPS)]
    for column, prefix in (lists or {}).items():
        value = F.col(f"`{column}`")
        parts.append(list_features(value if FE._is_array(df, column) else F.array(value.cast("string")), prefix))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def prepare_feature_sets(df: DataFrame, lists: Mapping[str, str] | None = None, groups: Mapping[str, Sequence[str]] | None = None,
                         text_column: str | None = "description") -> DataFrame:
    """The preparation of :func:`tessera.operators.features.prepare_features` with ``features`` (sorted
    names) in place of the flag columns: one projection and filter, no vocabulary pass, no cap."""
    base = FE.quality_filter(df)
    if text_column and text_column in base.columns:
        base = base.withColumn(text_column, clean_text(text_column))
    base = FE.add_popularity_score(base)
    age, duration, difficulty = FE._bucket_exprs()
    unknown = F.lit(C.UNKNOWN_BUCKET)
    keep = (age != unknown) & (duration != unknown) & (difficulty != unknown) & F.col(FE.LANGUAGE_COLUMN).isNotNull()
    return base.filter(keep).withColumn("features", feature_names(base, lists, groups))


# ------------------------------------------------------------------ dictionary
def gapless(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """``df`` with row numbers from 0 in the given order (whose values are distinct): a range shuffle, the
    position in the sorted partition, and the rows of the partitions before it (one small row each)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed, _ = materialise(dealt.select("*", F.spark_partition_id().alias("__part"), local.alias("__at")), "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__before")).cast("long").alias(out))


def dictionary(sets: DataFrame, features: str = "features") -> DataFrame:
    """feature, n (rows that have it), idx (from 0 in the features' order)."""
    names = sets.select(F.explode(F.array_distinct(F.col(features))).alias("feature")).filter(F.col("feature").isNotNull())
    return gapless(names.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), ["feature"])


def encode(sets: DataFrame, numbers: DataFrame, key: str, features: str = "features", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key, idxs: each row's feature numbers, sorted. ``key`` is unique; names that the dictionary does
    not have are left out; rows without features have an empty set."""
    long = sets.select(F.col(key).alias("key"), F.explode(F.col(features)).alias("feature"))
    known = blocked_join(long, numbers.select("feature", "idx"), ["feature"], "key", broadcast_bytes)
    some = known.groupBy("key").agg(F.array_sort(F.collect_set("idx")).alias("idxs"))
    none = F.array().cast("array<bigint>")
    return sets.select(F.col(key).alias("key")).join(some, "key", "left").select(F.col("key").alias(key), F.coalesce("idxs", none).alias("idxs"))


# ------------------------------------------------------------------ pairs of sets
def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of the 0/1 vectors that two sets stand for."""
    return F.sqrt((F.size(a) + F.size(b) - 2 * shared(a, b)).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two sets; 0 if one is empty."""
    length = F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double"))
    return F.when(length > 0, shared(a, b) / length).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ k-means
def _norms(centroids: DataFrame, k: int) -> list[float]:
    out = [0.0] * k
    for r in centroids.groupBy("cid").agg(F.sum(F.col("value") * F.col("value")).alias("n2")).collect():  # one row per cluster
        out[r["cid"]] = r["n2"]
    return out


def assign_sets(sets: DataFrame, centroids: DataFrame, k: int, size: int, cells: int = MATRIX_CELLS,
                broadcast_bytes: int = BROADCAST_BYTES, sent: list | None = None) -> DataFrame:
    """``sets`` (id, idxs...) with ``cid`` and ``d2`` of the nearest centroid (ties: the lowest).

    ``centroids``: cid, idx, value (non-zero cells). A table of at most ``cells`` cells goes to the
    tasks as one matrix, noted in ``sent`` for the caller to destroy; a larger one is joined by feature."""
    norms = _norms(centroids, k)
    if size * k <= cells:
        return _assign_by_matrix(sets, centroids, norms, size, [] if sent is None else sent)
    long = sets.select("id", F.explode("idxs").alias("idx"))
    met = blocked_join(long, centroids.select("idx", "cid", "value"), ["idx"], "id", broadcast_bytes)
    dots = met.groupBy("id", "cid").agg(F.sum("value").alias("dot")).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("cid", "dot"))).alias("dots"))
    table = F.array(*[F.lit(n) for n in norms])
    d2 = F.transform(table, lambda n2, c: F.struct(F.round(F.greatest(
        F.size("idxs") + n2 - 2 * F.coalesce(F.try_element_at("dots", c), F.lit(0.0)), F.lit(0.0)), TIE_DIGITS).alias("d2"), c.alias("cid")))
    near = sets.join(dots, "id", "left").withColumn("near", F.array_min(d2))
    return near.select(*[F.col(c) for c in sets.columns], F.col("near.cid").alias("cid"), F.col("near.d2").alias("d2"))


def _assign_by_matrix(sets: DataFrame, centroids: DataFrame, norms: list[float], size: int, sent: list) -> DataFrame:
    matrix, step = np.zeros((size, len(norms))), max(1, FETCH_CELLS // max(1, size))
    for first in range(0, len(norms), step):  # at most size x step cells at once
        cells = centroids.filter((F.col("cid") >= first) & (F.col("cid") < first + step)).toArrow()
        matrix[cells["idx"].to_numpy(), cells["cid"].to_numpy()] = cells["value"].to_numpy()
    table = sets.sparkSession.sparkContext.broadcast((matrix, np.array(norms)))
    sent.append(table)
    at = sets.columns.index("idxs")

    def run(batches):
        matrix, n2 = table.value
        for batch in batches:
            lists = batch.column(at)
            n, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            dots = np.zeros((len(n), len(n2)))
            some = np.flatnonzero(n)
            if len(some):
                dots[some] = np.add.reduceat(matrix[flat], np.cumsum(n)[some] - n[some], axis=0)
            d2 = np.round(np.maximum(n[:, None] + n2[None, :] - 2.0 * dots, 0.0), TIE_DIGITS)
            cid = d2.argmin(1) if len(d2) else np.zeros(0, np.int64)
            cols = [*batch.columns, pa.array(cid, pa.int32()), pa.array(d2[np.arange(len(cid)), cid], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "cid", "d2"])

    return sets.mapInArrow(run, sets.select("*", F.lit(0).alias("cid"), F.lit(0.0).alias("d2")).schema)


def kmeans_sets(sets: DataFrame, starts: DataFrame, size: int, steps: int, tolerance: float = 0.0, cells: int = MATRIX_CELLS,
                broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Lloyd's k-means over feature sets.

    ``sets``: key, idxs; ``starts``: cid (from 0), idxs; ``size``: features in all. Equal sets are one
    weighted row. Centroids stay a table of non-zero cells; a cluster without rows keeps its
    centroid. Ends after ``steps`` or when the squared shift is at most ``tolerance``. Returns (key,
    cid, d2) and (cid, idx, value)."""
    rows, _ = materialise(sets.groupBy("idxs").agg(F.count(F.lit(1)).alias("wt")).withColumn("id", F.monotonically_increasing_id()), "sets")
    k = starts.count()
    centroids, _ = materialise(starts.select("cid", F.explode("idxs").alias("idx"), F.lit(1.0).alias("value")), "set-centroids")
    for _ in range(steps):
        sent: list = []
        near, _ = materialise(assign_sets(rows, centroids, k, size, cells, broadcast_bytes, sent), "set-labels")
        for table in sent:
            table.destroy()
        weights = {r["cid"]: r["n"] for r in near.groupBy("cid").agg(F.sum("wt").alias("n")).collect()}  # one row per cluster
        share = F.create_map(*[x for c, n in weights.items() for x in (F.lit(c), F.lit(float(n)))]) if weights else F.lit(None)
        moved = near.select("cid", "wt", F.explode("idxs").alias("idx")).groupBy("cid", "idx").agg(F.sum("wt").alias("n"))
        moved = moved.select("cid", "idx", (F.col("n") / F.element_at(share, F.col("cid"))).alias("value")) if weights else centroids.limit(0)
        kept = centroids.filter(~F.col("cid").isin(list(weights))) if len(weights) < k else centroids.limit(0)
        new, _ = materialise(moved.unionByName(kept), "set-centroids")
        signed = new.unionByName(centroids.withColumn("value", -F.col("value")))
        shift = signed.groupBy("cid", "idx").agg(F.sum("value").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
        centroids = new
        if shift <= tolerance:
            break
    near = assign_sets(rows, centroids, k, size, cells, broadcast_bytes).select("idxs", "cid", "d2")
    return sets.join(near, "idxs").select("key", "cid", "d2"), centroids
