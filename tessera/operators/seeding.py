"""Scalable k-means++ starts (k-means||) for every subset and restart at once.

A first vector is drawn by weight. Then, for a few rounds, every vector is drawn on its own with
probability ``oversampling * weight * d2 / cost``, where ``d2`` is its squared distance to the nearest
candidate so far and ``cost`` the weighted sum of those: about ``oversampling`` new candidates a
round, wherever the data are badly covered. The candidates, weighted by the rows that are nearest
to them, are few (rounds x oversampling); weighted k-means++ over them, on the driver, gives
the start. Its order is nested, so the first k of it are a start for every smaller k.

Draws are hashes of (vector key, restart, round, seed), so the candidates do not depend on the
layout, on retries or on the order of rows. Vectors stay distributed: a round is one pass that
updates each vector's ``d2`` and nearest candidate against the new candidates only, and a filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.session import materialise

#: Rounds of drawing, and candidates drawn in each as a multiple of k.
ROUNDS = 5
OVERSAMPLING = 2.0
#: Hex digits of a draw's hash: 52 bits, exact in a double.
DIGITS = 13


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def vector_key(vec: Column) -> Column:
    """Text that stands for a vector in draws."""
    return F.md5(F.array_join(F.transform(vec, lambda x: x.cast("string")), ","))


def draw(key: Column, *salt: Column | int) -> Column:
    """Hash-drawn number in (0, 1) for a key: md5 of ``key:salt:salt...``."""
    text = F.concat_ws(":", key.cast("string"), *[s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def drawn(*parts) -> float:
    """The number that :func:`draw` gives for these texts, for draws on the driver."""
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:DIGITS], 16) + 0.5) / 16**DIGITS


def _nearest(state: DataFrame, by: list[str], found: dict, restarts: int) -> DataFrame:
    """``state`` with d2 and nearest brought up to date. ``found``: (subset, restart) -> (number of the
    first new candidate, new candidates as an array)."""
    sent = state.sparkSession.sparkContext.broadcast(found)

    def update(frames):
        for pdf in frames:
            if pdf.empty:
                continue
            d2, near = np.array(pdf["d2"].tolist()), np.array(pdf["near"].tolist())
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            groups = pdf.groupby(by, sort=False, dropna=False).indices.items() if by else [((), np.arange(len(pdf)))]
            for key, at in groups:
                key = key if isinstance(key, tuple) else (key,)
                part = x[at]
                size = (part * part).sum(1)[:, None]
                for r in range(restarts):
                    first, new = sent.value.get((key, r), (0, None))
                    if new is None or not len(new):
                        continue
                    far = np.maximum(size - 2.0 * part @ new.T + (new * new).sum(1)[None, :], 0.0)
                    best = far.argmin(1)
                    far = far[np.arange(len(at)), best]
                    closer = far < d2[at, r]
                    d2[at, r] = np.where(closer, far, d2[at, r])
                    near[at, r] = np.where(closer, first + best, near[at, r])
            yield pdf.assign(d2=list(d2), near=list(near))

    return state.mapInPandas(update, state.schema)


def candidates(dv: DataFrame, ks: dict, by: Sequence[str] = (), restarts: int = C.KMEANS_RESTARTS, seed: int = C.KMEANS_SEED,
               rounds: int = ROUNDS, oversampling: float = OVERSAMPLING, key: Column | None = None) -> DataFrame:
    """by..., r, candidate (number in order of drawing), round, key, vec, weight (rows nearest to it).

    ``dv``: distinct vectors ``vec`` with weights ``wt``; ``ks``: subset (tuple) -> k. ``key`` names a
    vector in draws (default: a hash of it)."""
    by, spark = list(by), dv.sparkSession
    names = [_c(b) for b in by]
    blank = lambda v, kind: F.array_repeat(F.lit(v).cast(kind), restarts)
    base = dv.select(*names, (key if key is not None else vector_key(F.col("vec"))).cast("string").alias("key"), "vec",
                     F.col("wt").cast("double").alias("wt"), blank(float("inf"), "double").alias("d2"), blank(-1, "int").alias("near"))
    state, _ = materialise(base, "seeding-vectors")
    each = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("r")
    cost = -F.log(draw(F.col("key"), F.col("r"), 0, seed)) / F.col("wt")
    firsts = state.select(*names, "key", "vec", "wt", each).groupBy(*names, "r").agg(
        F.min_by(F.struct("key", "vec"), F.struct(cost.alias("cost"), F.col("key").alias("key"))).alias("v"))
    found: dict = {}

    def note(rows, number: int) -> dict:
        """Number the drawn vectors in order of their keys; what is new of each (subset, restart)."""
        new: dict = {}
        for row in sorted(rows, key=lambda r: r["key"]):
            at = (tuple(row[b] for b in by), row["r"])
            new.setdefault(at, []).append((row["key"], row["vec"]))
        for at, drawn in new.items():
            found.setdefault(at, []).extend((number, k, v) for k, v in drawn)
        return {at: (len(found[at]) - len(drawn), np.array([v for _, v in drawn], dtype=np.float64)) for at, drawn in new.items()}

    new = note(firsts.select(*names, "r", "v.key", "v.vec").collect(), 0)
    for number in range(1, rounds + 1):
        state, _ = materialise(_nearest(state, by, new, restarts), "seeding-vectors")
        spread = state.select(*names, "wt", F.posexplode("d2").alias("r", "d2")).groupBy(*names, "r").agg(
            F.sum(F.col("wt") * F.col("d2")).alias("cost"))
        costs: dict = {}  # one number per subset and restart
        for row in spread.collect():
            sk = tuple(row[b] for b in by)
            costs.setdefault(sk, [0.0] * restarts)[row["r"]] = oversampling * ks.get(sk, 0) / row["cost"] if row["cost"] > 0 else 0.0
        kinds = ", ".join([f"`{b}` {dv.schema[b].dataType.simpleString()}" for b in by] + ["rate array<double>"])
        rates = F.broadcast(spark.createDataFrame([(*sk, rate) for sk, rate in costs.items()], kinds))
        joined = state.join(rates.select(*[_c(b).alias(f"{b}_") for b in by], "rate"), _same(by)) if by else state.crossJoin(rates)
        hit = F.filter(F.sequence(F.lit(0), F.lit(restarts - 1)),
                       lambda r: draw(F.col("key"), r, number, seed) < F.get("rate", r) * F.col("wt") * F.get("d2", r))
        drawn = joined.select(*names, "key", "vec", F.explode(hit).alias("r"))
        new = note(drawn.collect(), number)
    state = _nearest(state, by, new, restarts)
    sizes = state.select(*names, "wt", F.posexplode("near").alias("r", "candidate")).groupBy(*names, "r", "candidate").agg(
        F.sum("wt").alias("weight"))
    fields = ", ".join([f"`{b}` {dv.schema[b].dataType.simpleString()}" for b in by] + ["r int, candidate int, round int, key string, vec array<double>"])
    listed = spark.createDataFrame([(*sk, r, i, n, k, [float(x) for x in v]) for (sk, r), rows in found.items() for i, (n, k, v) in enumerate(rows)], fields)
    weighed = sizes.select(*[_c(b).alias(f"{b}_") for b in by], F.col("r").alias("r_"), F.col("candidate").alias("candidate_"), "weight")
    on = _same(by) & (F.col("r") == F.col("r_")) & (F.col("candidate") == F.col("candidate_")) if by else (
        (F.col("r") == F.col("r_")) & (F.col("candidate") == F.col("candidate_")))
    joined = listed.join(weighed, on, "left")
    return joined.select(*names, "r", "candidate", "round", "key", "vec", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for b in by:
        on = on & _c(b).eqNullSafe(_c(f"{b}_"))
    return on


def weighted_plusplus(x: np.ndarray, weight: np.ndarray, k: int, pick: Callable[[int], float]) -> np.ndarray:
    """Numbers of up to ``k`` rows in k-means++ order (fewer if no row is left at a distance).
    ``pick``: the draw of each step, in (0, 1)."""
    chosen: list[int] = []
    d2 = np.full(len(x), 1.0)
    while len(chosen) < min(k, len(x)):
        share = np.cumsum(weight * d2)
        if not share[-1] > 0:
            break
        i = min(int(np.searchsorted(share, pick(len(chosen)) * share[-1], side="right")), len(x) - 1)
        chosen.append(i)
        far = ((x - x[i]) ** 2).sum(1)
        d2 = far if len(chosen) == 1 else np.minimum(d2, far)
    return np.array(chosen, dtype=np.int64)


def starts(dv: DataFrame, ks: dict, by: Sequence[str] = (), restarts: int = C.KMEANS_RESTARTS, seed: int = C.KMEANS_SEED,
           rounds: int = ROUNDS, oversampling: float = OVERSAMPLING) -> dict:
    """(subset, restart) -> up to k start vectors, in an order whose first k' are a start for k'.

    Where fewer candidates than k were drawn (small subsets), the vectors of the smallest draws
    that are no candidates follow."""
    by = list(by)
    found: dict = {}
    for row in candidates(dv, ks, by, restarts, seed, rounds, oversampling).collect():
        found.setdefault((tuple(row[b] for b in by), row["r"]), []).append((row["candidate"], row["key"], row["vec"], row["weight"]))
    out, short = {}, {}
    for (sk, r), rows in found.items():
        rows.sort(key=lambda c: c[0])
        x, weight = np.array([c[2] for c in rows], dtype=np.float64), np.array([max(c[3], 0.0) for c in rows])
        order = weighted_plusplus(x, weight, ks.get(sk, 0), lambda step: drawn(*sk, "pick", r, step, seed))  # noqa: B023
        out[sk, r] = x[order]
        if len(order) < ks.get(sk, 0):
            short[sk, r] = {rows[i][1] for i in order}
    if short:
        most = max(ks[sk] for sk, _ in short)
        key = vector_key(F.col("vec"))
        each = dv.select(*[_c(b) for b in by], "vec", key.alias("key"), F.explode(F.array(*[F.lit(r) for r in sorted({r for _, r in short})])).alias("r"))
        rank = F.row_number().over(Window.partitionBy(*[_c(b) for b in by], "r").orderBy(draw(F.col("key"), F.col("r"), "more", seed), "key"))
        for row in each.withColumn("at", rank).filter(F.col("at") <= 2 * most).orderBy("at").collect():
            at = (tuple(row[b] for b in by), row["r"])
            if at in short and row["key"] not in short[at] and len(out[at]) < ks[at[0]]:
                out[at] = np.vstack([out[at], np.array(row["vec"], dtype=np.float64)])
    return out
