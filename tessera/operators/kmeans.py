"""k-means, nearest-centroid assignment and exact silhouette over distinct feature vectors.

Rows are first collapsed to ``distinct (vector) + weight`` per subset: k-means and the
silhouette are weight-aware, so duplicates cost nothing. Every model of a k-grid (all k x
restarts x subsets) is fitted *together*: one Spark job per Lloyd iteration — tasks assign
their tile of vectors to the centroids of a group of models and emit partial sums, Spark
reduces them (``Summarizer.sum``). Vectors stay distributed at every size; only centroids
move. Their table is bounded by (#k values x restarts x k x dim), i.e. by the feature count,
and grids beyond ``GROUP_CELLS`` are fitted group by group.

The exact Euclidean silhouette needs every vector's summed distance to every cluster: the
distinct vectors are cut into tiles, the tiles dealt into blocks, and every unordered pair of blocks
is a task: it meets their tiles, one distance matrix a pair of tiles for both of them, and adds up
each tile's sums. A tile is sent once for every block, so about sqrt(2 x tasks) times. Nothing
is collected or refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import seeding
from tessera.session import materialise

#: Vectors of a tile, and tiles of a block that a silhouette task holds at most.
TILE, BLOCK_TILES = 512, 16
#: Decimals to which squared distances and the costs of restarts are compared.
TIE_DIGITS, COST_DIGITS = 9, 6
#: Centroid cells (models x k x dim) that are fitted and broadcast together.
GROUP_CELLS = 8_000_000


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def distinct_vectors(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., vec array<double>, wt (rows with this vector). Partial aggregation pre-combines
    duplicates on the map side, so a hot vector never reaches one task whole."""
    vec = F.array(*[F.coalesce(_c(f).cast("double"), F.lit(0.0)) for f in features])
    return df.groupBy(*[_c(b) for b in by], vec.alias("vec")).agg(F.count(F.lit(1)).alias("wt"))


def _key(row, by):
    return tuple(row[b] for b in by)


def _pairwise(xb: np.ndarray, y: np.ndarray, y2: np.ndarray) -> np.ndarray:
    x2 = (xb * xb).sum(1)[:, None]
    d2 = x2 - 2.0 * (xb @ y.T) + y2[None, :]
    np.maximum(d2, 0.0, out=d2)
    return np.sqrt(d2)


# ------------------------------------------------------------------ exact silhouette
def _tiles(src: DataFrame, by: list[str], n: int, tile: int) -> DataFrame:
    """One row per tile of a subset: parallel lists of vectors, weights and labels."""
    number = F.pmod(F.xxhash64("vec"), F.lit(max(1, -(-n // tile)))).cast("int")
    return src.groupBy(*[_c(b) for b in by], number.alias("tile")).agg(
        F.collect_list(F.struct("vec", "wt", "labels")).alias("rows")).select(
        *[_c(b) for b in by], "tile", F.col("rows.vec").alias("vecs"), F.col("rows.wt").alias("wts"),
        F.col("rows.labels").alias("labs"))


def silhouette(dv: DataFrame, label_col: str, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Mean exact (Euclidean) silhouette per subset (and per model when ``label_col`` is an
    ``array<int>`` holding one labelling per model). Input: distinct vectors with weights.

    Returns by..., model, silhouette (0 when fewer than two clusters)."""
    by = list(by)
    spark = dv.sparkSession
    is_multi = dv.schema[label_col].dataType.typeName() == "array"
    lab = F.col(label_col) if is_multi else F.array(F.col(label_col))
    src, _ = materialise(dv.select(*[_c(b) for b in by], "vec", "wt", lab.alias("labels")), "silhouette-vectors")
    # cluster sizes: one number per subset, model and cluster (bounded by the k-range rule)
    sizes: dict = {}
    for r in (src.select(*[_c(b) for b in by], "wt", F.posexplode("labels").alias("m", "l"))
              .groupBy(*[_c(b) for b in by], "m", "l").agg(F.sum("wt").alias("n")).collect()):
        sizes.setdefault(_key(r, by), {}).setdefault(r["m"], {})[r["l"]] = float(r["n"])
    by_types = ", ".join(f"`{b}` {dv.schema[b].dataType.simpleString()}" for b in by)
    schema = (by_types + ", " if by else "") + "model int, sw double, w double"
    if not sizes:
        return spark.createDataFrame([], (by_types + ", " if by else "") + "model int, silhouette double")
    bc = spark.sparkContext.broadcast({
        k: [np.array([ms[m].get(c, 0.0) for c in range(max(ms[m]) + 1)]) for m in sorted(ms)] for k, ms in sizes.items()})

    def finish(key, total, wa, la) -> list[list]:
        """Weighted silhouette sums of a tile, model by model, from its summed distances to every cluster."""
        out, at, start = [], np.arange(len(la)), 0
        for m, size in enumerate(bc.value[key]):
            far, own, start = total[:, start:start + len(size)].copy(), la[:, m], start + len(size)
            with np.errstate(divide="ignore", invalid="ignore"):
                inner = far[at, own] / (size[own] - 1.0)
                outer = far / size[None, :]
                outer[at, own] = np.inf
                outer[:, size == 0] = np.inf
                nearest = outer.min(1)
                value = (nearest - inner) / np.maximum(inner, nearest)
            value = np.nan_to_num(value, nan=0.0, posinf=0.0, neginf=0.0)
            value[(size[own] <= 1) | ((size > 0).sum() < 2)] = 0.0
            out.append([*key, m, float((wa * value).sum()), float(wa.sum())])
        return out

    def load(key, row) -> _Tile:
        return _Tile(row.tile, np.array(list(row.vecs), dtype=np.float64), np.array(row.wts, dtype=np.float64),
                     np.array(list(row.labs), dtype=np.int64), [len(size) for size in bc.value[key]])

    def meet(frames):
        """Rows come sorted by (subset, pair of blocks, block): each unordered pair of tiles is met once and
        both tiles get their share; what leaves is one sum a tile and task."""
        open_key, held = None, []

        def packed(key, tiles):
            rows = [[*key, t.number, t.sums.tobytes(), *t.rest(own=same)] for t in tiles]
            return pd.DataFrame(rows, columns=[*by, "tile", "sums", "wts", "labs"])

        for frame in frames:
            for row in frame.itertuples(index=False):
                key = (tuple(row[:len(by)]), row.i, row.j)
                if key != open_key:
                    if held:
                        yield packed(open_key[0], held)
                    open_key, held, same = key, [], row.i == row.j
                tile = load(key[0], row)
                if same:
                    tile.meet(tile)
                if same or row.block == row.i:
                    if same:
                        for other in held:
                            tile.meet(other)
                    held.append(tile)
                else:
                    for other in held:
                        tile.meet(other)
                    yield packed(key[0], [tile])
        if held:
            yield packed(open_key[0], held)

    def add(frames):
        """Rows come sorted by (subset, tile): the sums of a tile, then its silhouette."""
        open_key, total, wa, la = None, None, None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = tuple(row[:len(by) + 1])
                if key != open_key:
                    if open_key is not None:
                        out += finish(open_key[:-1], total, wa, la)
                    open_key, total = key, 0.0
                width = sum(len(size) for size in bc.value[key[:-1]])
                total = total + np.frombuffer(row.sums).reshape(-1, width)
                if row.wts is not None:
                    wa, la = np.frombuffer(row.wts), np.frombuffer(row.labs, dtype=np.int64).reshape(total.shape[0], -1)
            if out:
                yield pd.DataFrame(out, columns=[*by, "model", "sw", "w"])
        if open_key is not None:
            yield pd.DataFrame(finish(open_key[:-1], total, wa, la), columns=[*by, "model", "sw", "w"])

    n = src.count()
    tiles, _ = materialise(_tiles(src, by, n, tile), "silhouette-tiles")
    blocks = block_count(max(1, -(-n // tile)), spark.sparkContext.defaultParallelism)
    block = F.col("tile") % blocks
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = tiles.withColumn("block", block).withColumn("other", each).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    names = [_c(b) for b in by]
    dealt = dealt.repartition(*names, "i", "j").sortWithinPartitions(*names, "i", "j", "block", "tile")
    sums = dealt.select(*names, "tile", "vecs", "wts", "labs", "block", "i", "j").mapInPandas(
        meet, (by_types + ", " if by else "") + "tile int, sums binary, wts binary, labs binary")
    parts = sums.repartition(*names, "tile").sortWithinPartitions(*names, "tile").mapInPandas(add, schema)
    return parts.groupBy(*names, "model").agg((F.sum("sw") / F.sum("w")).alias("silhouette"))


def block_count(tiles: int, parallelism: int, most: int = BLOCK_TILES) -> int:
    """Blocks that the tiles of a subset are dealt into: enough pairs of blocks for all cores, and at
    most ``most`` tiles in a block. A tile is sent to as many tasks as there are blocks."""
    pairs = 2 * parallelism
    wanted = max(1, math.isqrt(2 * pairs))
    return min(tiles, max(wanted, -(-tiles // most)))


class _Tile:
    """A tile's vectors, weights and labels, and the summed distances to every cluster of every model."""

    def __init__(self, number: int, x: np.ndarray, weight: np.ndarray, labels: np.ndarray, widths: list[int]):
        self.number, self.x, self.weight, self.labels = number, x, weight, labels
        self.x2 = (x * x).sum(1)
        starts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
        self.member = np.zeros((len(x), sum(widths)))
        self.member[np.arange(len(x))[:, None], labels + starts[None, :]] = weight[:, None]
        self.sums = np.zeros((len(x), sum(widths)))

    def meet(self, other: _Tile) -> None:
        far = _pairwise(self.x, other.x, other.x2)
        self.sums += far @ other.member
        if other is not self:
            other.sums += far.T @ self.member

    def rest(self, own: bool) -> tuple:
        """Weights and labels, sent once: by the task that meets the tile with itself."""
        return (self.weight.tobytes(), self.labels.tobytes()) if own else (None, None)


# ------------------------------------------------------------------ batched Lloyd
def _seed_table(dv: DataFrame, by: list[str], restarts: int, k_max: int, seed: int) -> dict:
    """Per subset and restart, the first ``k_max`` distinct vectors in a seeded hash order
    (a random Forgy start per restart; model (k, r) starts from the first k of restart r)."""
    from pyspark.sql import Window

    rs = dv.select(*[_c(b) for b in by], "vec").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    h = F.xxhash64(F.col("vec"), F.col("r"), F.lit(seed))
    w = Window.partitionBy(*[_c(b) for b in by], "r").orderBy(h, F.col("vec").cast("string"))
    top = rs.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k_max)
    seeds: dict = {}
    for row in top.collect():
        seeds.setdefault((_key(row, by), row["r"]), []).append((row["pos"], row["vec"]))
    return {k: np.array([v for _, v in sorted(rows)], dtype=np.float64) for k, rows in seeds.items()}


def _groups_of_models(models: dict, cells: int) -> list[list]:
    """Model keys in groups whose centroid tables stay within ``cells`` (at least one each)."""
    groups, room = [[]], cells
    for key in sorted(models, key=repr):
        if groups[-1] and models[key].size > room:
            groups.append([])
            room = cells
        groups[-1].append(key)
        room -= models[key].size
    return groups


class _Sweep:
    """The vectors of all subsets, dealt into (tile, model share) parts, and one pass over them."""

    def __init__(self, dv: DataFrame, by: list[str]):
        spark = dv.sparkSession
        self.by, self.spark = by, spark
        src, _ = materialise(dv.select(*[_c(b) for b in by], "vec", "wt"), "kmeans-vectors")
        tiles = max(1, -(-src.count() // (8 * TILE)))
        # few tiles: several tasks share one, each with its own models
        self.shares = max(1, -(-spark.sparkContext.defaultParallelism // tiles))
        dealt = src.withColumn("tile", F.pmod(F.xxhash64("vec"), F.lit(tiles))).withColumn(
            "share", F.explode(F.sequence(F.lit(0), F.lit(self.shares - 1))))
        self.data = dealt.repartitionByRange(tiles * self.shares, "tile", "share").persist()
        self.tiles = tiles

    def run(self, centroids: dict, sums: bool = True) -> dict:
        """Per model: (cost of the centroids, weight of each cluster, sum of its vectors)."""
        keys = list(centroids)
        by, shares, wanted = self.by, self.shares, sums
        table: dict = {}
        for i, key in enumerate(keys):
            table.setdefault(key[0], []).append((i, centroids[key]))
        bc = self.spark.sparkContext.broadcast(table)

        def part(frames):
            """(model, packed cost, cluster weights and vector sums) of a tile."""
            for pdf in frames:
                rows = []
                for key, g in pdf.groupby([*by, "share"], sort=False, dropna=False):
                    mine = [x for x in bc.value.get(tuple(key[:-1]), []) if x[0] % shares == key[-1]]
                    if not mine:
                        continue
                    x = np.array(g["vec"].tolist(), dtype=np.float64)
                    wt = g["wt"].to_numpy(dtype=np.float64)
                    x2, at = (x * x).sum(1)[:, None], np.arange(len(x))
                    for i, cen in mine:
                        d2 = np.maximum(x2 - 2.0 * x @ cen.T + (cen * cen).sum(1)[None, :], 0.0)
                        lab = np.round(d2, TIE_DIGITS).argmin(1)
                        member = np.zeros((len(lab), len(cen)))
                        member[at, lab] = wt
                        packed = [[float((wt * d2[at, lab]).sum())], member.sum(0), (member.T @ x).ravel() if wanted else []]
                        rows.append((i, np.concatenate(packed).tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["i", "packed"])

        def add(frames):
            """Sums of equal models; a task holds one sum per model it is dealt."""
            total: dict = {}
            for pdf in frames:
                for i, packed in zip(pdf["i"], pdf["packed"]):
                    value = np.frombuffer(packed)
                    total[i] = total[i] + value if i in total else value
            yield pd.DataFrame([(i, v.tobytes()) for i, v in total.items()], columns=["i", "packed"])

        schema = "i int, packed binary"
        summed = self.data.mapInPandas(part, schema)
        if self.tiles > 1:
            summed = summed.repartition("i").mapInPandas(add, schema)
        out: dict = {}
        for r in summed.collect():  # the centroid table
            value, k = np.frombuffer(r["packed"]), len(centroids[keys[r["i"]]])
            cost, w, s = out.get(keys[r["i"]], (0.0, 0.0, 0.0))  # Arrow batches of one tile come apart
            out[keys[r["i"]]] = (cost + value[0], w + value[1:1 + k], s + value[1 + k:])
        bc.unpersist()
        return out


def lloyd(sweep: _Sweep, starts: dict, max_iter: int, tolerance: dict) -> dict:
    """Lloyd iterations of all models at once; model key -> (centroids, their cost).

    A model stops when its squared centroid shift is at most its subset's tolerance, or after
    ``max_iter`` steps. An empty cluster keeps its centroid. Costs belong to the final centroids."""
    models, active = dict(starts), set(starts)
    for _ in range(max_iter):
        if not active:
            break
        for key, (_, w, s) in sweep.run({k: models[k] for k in active}).items():
            old = models[key]
            filled = w > 0
            new = np.where(filled[:, None], s.reshape(old.shape) / np.where(filled, w, 1.0)[:, None], old)
            models[key] = new
            if float(((new - old) ** 2).sum()) <= tolerance.get(key[0], 0.0):
                active.discard(key)
    costs = sweep.run(models, sums=False)
    return {k: (c, costs[k][0]) for k, c in models.items() if k in costs}


def kmeans_grid(dv: DataFrame, ks: dict, by: Sequence[str] = (), restarts: int = C.KMEANS_RESTARTS,
                max_iter: int = C.KMEANS_MAX_ITER, tol: float = C.KMEANS_TOL, seed: int = C.KMEANS_SEED,
                group_cells: int = GROUP_CELLS, init: str = "parallel") -> dict:
    """Fit every (subset, k, restart) model; keep the lowest-cost restart (ties: the first) per (subset, k).

    ``ks``: subset key tuple -> list of k. Returns {(subset, k): (centroids, cost)}. Starts are
    scalable k-means++ (``init="parallel"``, see :mod:`tessera.operators.seeding`) or the first k
    vectors in a seeded hash order (``"forgy"``); either way a restart has one nested order for
    all its k. The relative tolerance is ``tol`` times the subset's mean feature variance."""
    by = list(by)
    k_max = max((max(v) for v in ks.values() if v), default=0)
    if k_max == 0:
        return {}
    if init not in ("parallel", "forgy"):
        raise ValueError(f"unknown init {init!r}")
    starts = {}
    table = (seeding.starts(dv, {sk: max(v) for sk, v in ks.items() if v}, by, restarts, seed) if init == "parallel"
             else _seed_table(dv, by, restarts, k_max, seed))
    for (sk, r), arr in table.items():
        for k in ks.get(sk, []):
            if k <= len(arr):
                starts[(sk, k, r)] = arr[:k].copy()
    weight = F.col("wt").cast("double")
    stats = dv.groupBy(*[_c(b) for b in by]).agg(
        vector_to_array(Summarizer.mean(array_to_vector("vec"), weight)).alias("mu"),
        vector_to_array(Summarizer.mean(array_to_vector(F.transform("vec", lambda x: x * x)), weight)).alias("m2"))
    tolerance = {_key(r, by): tol * float(np.mean(np.maximum(np.array(r["m2"]) - np.array(r["mu"]) ** 2, 0.0)))
                 for r in stats.collect()}  # one row per subset
    sweep = _Sweep(dv, by)
    best: dict = {}
    for group in _groups_of_models(starts, group_cells):
        for (sk, k, r), (cen, cost) in sorted(lloyd(sweep, {m: starts[m] for m in group}, max_iter, tolerance).items(), key=repr):
            mine = (round(cost, COST_DIGITS), r)  # restarts that end alike differ in rounding only
            if (sk, k) not in best or mine < best[(sk, k)][0]:
                best[(sk, k)] = (mine, cen, cost)
    sweep.data.unpersist()
    return {key: (cen, cost) for key, (_, cen, cost) in best.items()}


def fit_from(dv: DataFrame, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Exactly ``steps`` Lloyd steps of one model from given centroids; (centroids, their cost)."""
    sweep = _Sweep(dv, [])
    out = lloyd(sweep, {((), len(start), 0): np.asarray(start, dtype=np.float64)}, steps, {(): -1.0})
    sweep.data.unpersist()
    return out[((), len(start), 0)]


def assign(dv: DataFrame, centroids: dict, by: Sequence[str] = (), out: str = "label") -> DataFrame:
    """Nearest centroid (ties -> lowest id) for each distinct vector; ``centroids`` maps the
    subset key (tuple) to a (k x dim) array, or to a list of arrays -> ``out`` is array<int>."""
    by = list(by)
    spark = dv.sparkSession
    bc = spark.sparkContext.broadcast(centroids)
    multi = any(isinstance(v, list) for v in centroids.values())
    fields = [f for f in dv.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += f", `{out}` " + ("array<int>" if multi else "int")

    def run(it):
        table = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            keys = [tuple(t) for t in pdf[by].itertuples(index=False)] if by else [()] * len(pdf)
            x_all = np.array(pdf["vec"].tolist(), dtype=np.float64)
            res = [None] * len(pdf)
            idx_by_key: dict = {}
            for i, k in enumerate(keys):
                idx_by_key.setdefault(k, []).append(i)
            for k, idx in idx_by_key.items():
                cents = table.get(k)
                if cents is None:
                    continue
                x = x_all[idx]
                cl = cents if isinstance(cents, list) else [cents]
                labs = []
                x2 = (x * x).sum(1)[:, None]
                for cen in cl:  # n x k numbers at a time; ties by rounded distances, so that no rounding decides them
                    d2 = np.maximum(x2 - 2.0 * (x @ cen.T) + (cen * cen).sum(1)[None, :], 0.0)
                    labs.append(np.round(d2, TIE_DIGITS).argmin(1))
                for j, i in enumerate(idx):
                    res[i] = [int(lab[j]) for lab in labs] if multi else int(labs[0][j])
            pdf = pdf.copy()
            pdf[out] = res
            yield pdf

    return dv.mapInPandas(run, schema)


def centroid_table(centroids: DataFrame, id_col: str, vec: str = "c") -> DataFrame:
    """One row: ``ids`` and ``centroids`` (array<array<double>>), ordered by id. Its size is that of
    the k x dim table, and it never passes through the driver or the plan."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vec).alias("c"))))
    return centroids.agg(rows.alias("t")).select(F.col("t.id").alias("ids"), F.col("t.c").alias("centroids"))


def nearest_centroid_expr(vec: Column, centroids: Column) -> Column:
    """struct(distance, cid) of the nearest centroid, ties -> lowest id; JVM-side."""
    d2 = F.transform(centroids, lambda c, i: F.struct(
        F.aggregate(F.zip_with(vec, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x).alias("d2"),
        i.alias("cid")))
    best = F.array_min(d2)
    return F.struct(F.sqrt(best["d2"]).alias("distance"), best["cid"].alias("cid"))


def mean_vectors(df: DataFrame, group: str, vec: str = "vec", out: str = "c") -> DataFrame:
    """Per group, the element-wise mean vector (partial aggregation of whole vectors; the
    result has one row per group)."""
    return df.groupBy(group).agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias(out))


def silhouette_squared(df: DataFrame, features: Sequence[str], label_col: str) -> float:
    """Spark ML's silhouette (squared Euclidean, O(n x k) per pass). A *different* metric from
    the exact Euclidean one reproduced by :func:`silhouette` — offered for callers who
    choose it explicitly when the distinct-vector set exceeds the exact bound."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(features), outputCol="__features").transform(
        df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(label_col).cast("double")))
    ev = ClusteringEvaluator(featuresCol="__features", predictionCol=label_col, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(x))
