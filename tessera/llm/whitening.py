"""Embedding whitening by a Jacobi-Davidson eigensolver over distributed centred products.

The covariance matrix is never formed. Its products with a few vectors are: each task centres its rows
(exactly, in integers: n*x - S, then divided by n) and adds up Z'(ZQ); a few tasks add up those
sums, whose size is dimension x vectors, whatever the number of rows. The driver holds a subspace
of at most ``SUBSPACE`` vectors and does everything else:

* Rayleigh-Ritz on the subspace gives the leading pairs not yet locked;
* a pair whose residual is at double precision is locked, from the largest eigenvalue down, and the
  subspace stays orthogonal to it;
* for the others the correction equations (I - QQ')(A - theta I)(I - QQ')t = -r, with Q the locked and
  the current Ritz vectors, are solved by MINRES, all of them in step: one distributed product a step;
* the corrections extend the subspace, which restarts from its best Ritz vectors when it is full.

The pairs are accepted only after their residuals were recomputed from fresh products.

Defined cases: vectors that are null, empty, or hold a null, a NaN, an infinity or a number of 2^46 or
more in size are left out, and so are vectors of another length than the most frequent one (ties: the
longer); repeated vectors count once in the fit and all get their rows; null ids are kept;
components whose eigenvalue is zero to rounding have no whitened value and are not returned
(fewer distinct vectors than dimensions; a single one has none); an empty table gives no rows.
A deviation beyond the range of long is null. Of the input's columns, those named like a result
give way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, quote, stage

COMPONENTS = 16
#: Vectors that the driver's subspace holds at most (but for small dimensions).
SUBSPACE = 64
#: MINRES steps for one correction, and the residual it stops at.
INNER, INNER_TOL = 8, 1e-2
OUTER = 200
#: Tasks that add up the other tasks' sums.
ADDERS = 8
SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(np.float64).eps


@dataclass
class Whitening:
    """A fitted transformation; eigenvectors are columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    #: Largest residual norm over the largest eigenvalue, and distributed products that it took.
    residual: float
    products: int

    @property
    def dimension(self) -> int:
        return len(self.sums)


# ------------------------------------------------------------------ rows
def scaled(vector: Column) -> Column:
    """Entries as long floor(64 c) + 1000000; null if the vector can't be used."""
    v = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 46)))
    x = F.transform(v, lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), x)


def usable(df: DataFrame, vector: str, x: str) -> DataFrame:
    """Rows with a usable vector, and the scaled one as ``x``."""
    rows = df.withColumn(x, scaled(F.col(quote(vector)))).filter(F.col(quote(x)).isNotNull())
    size = rows.groupBy(F.size(quote(x)).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if size is None else rows.filter(F.size(quote(x)) == size["d"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], dtype=np.float64) -> np.ndarray:
    """Sum over all rows of ``part(rows of a batch)``, an array of fixed size: added up by each task,
    then by a few tasks, then here."""

    def add(batches: Iterator[pa.RecordBatch], read: Callable) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in read(batch):
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["packed"])

    def rows(batches):
        return add(batches, lambda b: [part(_matrix(b.column(0)))] if b.num_rows else [])

    def sums(batches):
        return add(batches, lambda b: [np.frombuffer(x, dtype) for x in b.column(0).to_pylist()])

    parts = fit.mapInArrow(rows, "packed binary").repartition(ADDERS).mapInArrow(sums, "packed binary").collect()
    return sum((np.frombuffer(r["packed"], dtype) for r in parts[1:]), np.frombuffer(parts[0]["packed"], dtype))


def centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once."""
    return (n * x - sums) / float(n)


# ------------------------------------------------------------------ eigensolver
def minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int = INNER, tol: float = INNER_TOL) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, in step with each other.
    ``product`` applies each column's operator."""
    norm = lambda y: np.sqrt((y * y).sum(0))
    x = np.zeros_like(rhs)
    first = beta = norm(rhs)
    live = first > 0
    r1, r2, y = rhs, rhs, rhs
    w = w2 = np.zeros_like(rhs)
    old = eps = dbar = sn = np.zeros_like(beta)
    cs, rest = -np.ones_like(beta), beta.copy()
    for step in range(steps):
        if not live.any():
            break
        v = y / np.where(beta > 0, beta, 1.0)
        y = product(v)
        if step:
            y = y - np.where(old > 0, beta / np.where(old > 0, old, 1.0), 0.0) * r1
        alpha = (v * y).sum(0)
        y = y - np.where(beta > 0, alpha / np.where(beta > 0, beta, 1.0), 0.0) * r2
        r1, r2, old, beta = r2, y, beta, norm(y)
        before, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), np.finfo(np.float64).tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, rest = cs * rest, sn * rest
        w1, w2 = w2, w
        w = (v - before * w1 - delta * w2) / gamma
        x = x + np.where(live, phi, 0.0) * w
        live = live & (np.abs(rest) > tol * first) & (beta > EPS * first)
    return x


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``t`` outside the bases' spans; columns that vanish are dropped."""
    size = np.maximum(np.sqrt((t * t).sum(0)), np.finfo(np.float64).tiny)
    t, out = t / size, np.zeros((len(t), 0))
    for j in range(t.shape[1]):
        c = t[:, j]
        for _ in range(3):
            for b in (*bases, out):
                c = c - b @ (b.T @ c)
            length = np.sqrt(c @ c)
            if length < 1e-10:
                break
            c = c / length
        else:
            out = np.column_stack([out, c])
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, subspace: int = SUBSPACE,
                    inner: int = INNER, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading eigenpairs of a symmetric positive semidefinite ``d`` x ``d`` operator that is
    known by its products with blocks of vectors only: (values, vectors, largest relative residual)."""
    rng = np.random.default_rng(seed)
    k = min(k, d)
    room = min(d, max(subspace, 2 * k + 4))
    locked = alocked = np.zeros((d, 0))
    v = _orthonormal(rng.standard_normal((d, min(d, k + 4))))
    av = product(v)
    top = 0.0
    for _ in range(OUTER):
        want = k - locked.shape[1]
        if want == 0:
            alocked = product(locked)  # fresh: what was carried through restarts is checked here
            theta, s = np.linalg.eigh((locked.T @ alocked + alocked.T @ locked) / 2)
            theta, s = theta[::-1], s[:, ::-1]
            u, au = locked @ s, alocked @ s
            worst = np.sqrt(((au - theta * u) ** 2).sum(0)).max(initial=0.0)
            if worst <= 2 * tolerance(d) * top:
                return theta, u, worst / top if top else 0.0
            v, av, locked = u, au, np.zeros((d, 0))
            want = k
        theta, s = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max(top, abs(theta[0])) if len(theta) else top
        if v.shape[1] + want > room:  # restart from the best Ritz vectors
            s = s[:, : max(want, room - 2 * want)]
            theta = theta[: s.shape[1]]
        v, av = v @ s, av @ s
        r = av[:, :want] - theta[:want] * v[:, :want]
        small = np.sqrt((r * r).sum(0)) <= tolerance(d) * top
        done = len(small) if small.all() else int(small.argmin())
        if done:
            locked, v, av = np.column_stack([locked, v[:, :done]]), v[:, done:], av[:, done:]
            theta, r, want = theta[done:], r[:, done:], want - done
            v = v - locked @ (locked.T @ v)
        if want == 0:
            continue
        u, theta = v[:, :want], theta[:want]
        q = np.column_stack([locked, u])
        off = lambda y: y - q @ (q.T @ y)
        open_ = ~small[done : done + r.shape[1]]
        t = minres(lambda y: off(product(off(y)) - theta[: r.shape[1]][open_] * off(y)), off(-r[:, open_]), inner) if open_.any() else r[:, :0]
        new = _orthonormal(t, locked, v)
        if not new.shape[1]:  # nothing left to correct within rounding: look elsewhere
            new = _orthonormal(rng.standard_normal((d, min(want, d - q.shape[1]) or 1)), locked, v)
        v, av = np.column_stack([v, new]), np.column_stack([av, product(new)]) if new.shape[1] else av
    raise ArithmeticError(f"{locked.shape[1]} of {k} eigenpairs reached double precision in {OUTER} steps")


def tolerance(d: int) -> float:
    """Residual norm over the largest eigenvalue at which a pair is exact to double precision."""
    return 4 * EPS * max(d, 16)


# ------------------------------------------------------------------ operator
def fit(vectors: DataFrame, components: int = COMPONENTS, subspace: int = SUBSPACE) -> Whitening | None:
    """The whitening of a table of distinct scaled vectors (one column, array<long>); None if it is empty."""
    spark = vectors.sparkSession
    head = vectors.first()
    if head is None:
        return None
    d = len(head[0])
    total = summed(vectors, lambda x: np.concatenate([[len(x)], x.sum(0)]).astype(np.int64), np.int64)
    n, sums = int(total[0]), total[1:].copy()
    trace = float(summed(vectors, lambda x: np.array([(centre(x, n, sums) ** 2).sum()]))[0]) / n
    count = 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1
        sent = spark.sparkContext.broadcast(q)

        def part(x: np.ndarray) -> np.ndarray:
            z = centre(x, n, sums)
            return (z.T @ (z @ sent.value)).ravel()

        out = summed(vectors, part).reshape(q.shape) / n
        sent.unpersist()
        return out

    values, u, residual = jacobi_davidson(product, d, components, subspace)
    keep = values > 16 * d * EPS * max(values.max(initial=0.0), 0.0)
    return Whitening(n, sums, trace, u[:, keep], values[keep], residual, count)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit vectors' covariance minus the identity."""
    n, sums, k = model.n, model.sums, len(model.values)
    if not k:
        return 0.0
    back = model.vectors / np.sqrt(model.values)
    mean = summed(vectors, lambda x: (centre(x, n, sums) @ back).sum(0)) / n

    def part(x: np.ndarray) -> np.ndarray:
        w = centre(x, n, sums) @ back - mean
        return (w.T @ w).ravel()

    return float(np.abs(summed(vectors, part).reshape(k, k) / n - np.eye(k)).max())


def _deviations(v: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond long."""
    if len(v) and float(np.abs(v).max()) ** 2 * v.shape[1] < 2.0**62:
        return (v * v).sum(1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in v]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, model: Whitening, x: str) -> DataFrame:
    """``rows`` without the scaled vector ``x``, with ``whitened`` (array<double>, one entry a component)
    and ``deviation`` (exact squared length of n*x - S)."""
    n, sums = model.n, model.sums
    back = rows.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values))
    kept = [f for f in rows.schema.fields if f.name != x and f.name.lower() not in ("whitened", "deviation")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(len(kept)))
            w = centre(m, n, sums) @ back.value
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            cols = [*batch.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(w.ravel())), pa.array(_deviations(n * m - sums), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in kept], "whitened", "deviation"])

    schema = T.StructType([*kept, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    return rows.select(*[F.col(quote(f.name)) for f in kept], F.col(quote(x))).mapInArrow(run, schema)


def fit_and_whiten(df: DataFrame, vector: str, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """(usable rows of ``df`` with whitened and deviation, the model, its identity error)."""
    x = free_name([*df.columns, "whitened", "deviation"], "x")
    rows = usable(df, vector, x)
    distinct = stage(rows.select(F.col(quote(x)).alias("x")).distinct(), "whitening-fit")
    model = fit(distinct, components)
    if model is None:
        empty = rows.drop(x).withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("long")})
        return empty, None, 0.0
    return whiten(rows, model, x), model, identity_error(distinct, model)


def whitened_embeddings(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector
    and component."""
    rows, model, error = fit_and_whiten(df.select(F.col(id), F.col(vector)), vector)
    shares = [] if model is None else [float(e / model.trace) for e in model.values]
    long = rows.select(id, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        id, (F.col("at") + 1).cast("int").alias("component"), F.lit(0 if model is None else model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
