"""Distances over sets of packed 0/1 vectors without comparing every vector with every other.

Vectors are ``array<bigint>`` words of ``BITS_PER_WORD`` flags (``functions/vectors.pack_bits``); their
flags are dealt into segments, each a mask over the words.

* :func:`level_counts`: for each left vector, how many right rows lie at each distance. One segment
  after the other, the right vectors' flags are replaced by those of the left vectors with the
  same earlier flags, and rows that have become equal are added up. Feature sets repeat their
  parts, so the state stays near (distinct vectors x distances) instead of all pairs.
* :func:`within`: the pairs within a radius of each left vector. Prefixes of left and right vectors are
  joined segment by segment and dropped as soon as their distance exceeds the radius, so the work
  follows the result, also for sparse flags, where most segments of most vectors agree.
* :func:`indexed_within`: the same by multi-index hashing. Of ``m`` segments at least one differs in
  no more than ``radius / m`` flags (pigeonhole); the values of a segment, at most 2^``bits``, are compared
  with each other, vectors meet by equal values, and each pair is verified. For flags that are
  about as often 0 as 1.
* :func:`nearest` and :func:`farthest`: :func:`indexed_within` with a growing radius for the vectors still
  open; the farthest vector is the nearest to the complement.

Where a radius is so wide that the index would bring together more than ``SCAN_SHARE`` of all pairs, comparing
all of them is cheaper: the vectors of a group are dealt into blocks, every pair of blocks is a group
of Spark's, and its task compares the words in tiles and returns only what was asked for (pairs, counts
or the nearest). The results are the same; a task holds two blocks, whatever the group's size.

All joins are equi-joins on (group, segment value or prefix); a side is broadcast only if its written
files are small, and the first step, where all vectors of a group share a key, is salted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import BITS_PER_WORD, hamming
from tessera.operators.joins import BROADCAST_BYTES, blocked_join
from tessera.session import materialise

#: Flags that one step of the prefix methods takes, and flags of a segment in the index.
STEP_BITS, INDEX_BITS = 8, 16
#: Share of all pairs from which on they are compared without an index.
SCAN_SHARE = 0.002
#: Vectors of a block that is compared with another, also where all its pairs may be listed; and rows and
#: columns of a tile.
BLOCK, LIST_BLOCK = 16_384, 2_048
TILE = (256, 2_048)
#: Tasks that compare blocks, at most.
SCAN_TASKS = 4_000
VECTOR = T.ArrayType(T.LongType())


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def segment_masks(dims: int, bits: int, spread: bool = False) -> list[list[int]]:
    """Masks (one number per word) of the segments, of at most ``bits`` flags each: runs of neighbouring
    flags, or every m-th flag (``spread``)."""
    m = max(1, -(-dims // bits))
    words = max(1, -(-dims // BITS_PER_WORD))
    out = [[0] * words for _ in range(m)]
    for j in range(dims):
        out[j % m if spread else j * m // dims][j // BITS_PER_WORD] |= 1 << j % BITS_PER_WORD
    return out


def _words(mask: Sequence[int]) -> Column:
    return F.array(*[F.lit(w).cast("long") for w in mask])


def masked(vec: Column, mask: Sequence[int]) -> Column:
    return F.zip_with(vec, _words(mask), lambda v, m: v.bitwiseAND(m))


def _merged(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def complement(vec: Column, dims: int) -> Column:
    whole = segment_masks(dims, dims)[0]
    return F.zip_with(vec, _words(whole), lambda v, m: v.bitwiseXOR(m))


def _union(masks: Sequence[Sequence[int]], words: int) -> list[int]:
    out = [0] * words
    for mask in masks:
        out = [o | w for o, w in zip(out, mask)]
    return out


def level_counts(left: DataFrame, right: DataFrame, dims: int, by: Sequence[str] = (), u: str = "u", w: str = "w", count: str = "cnt",
                 bits: int = STEP_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """by..., u, h, n: the number of right rows (``count``) at Hamming distance h from each left vector."""
    by = list(by)
    names = [_c(b) for b in by]
    masks = segment_masks(dims, bits)
    words = len(masks[0])
    left = materialise(left.select(*names, _c(u).alias("u")).distinct(), "hamming-left")[0]
    state = right.select(*names, _c(w).alias("x"), F.lit(0).cast("long").alias("h"), _c(count).cast("long").alias("n"))
    state = state.groupBy(*names, "x", "h").agg(F.sum("n").alias("n"))
    for s, mask in enumerate(masks):
        done = _union(masks[:s], words)
        rest = _union(masks[s + 1:], words)
        ahead = left.select(*names, masked(F.col("u"), done).alias("p"), masked(F.col("u"), mask).alias("a")).distinct()
        met = blocked_join(state.withColumn("p", masked(F.col("x"), done)), ahead, [*by, "p"], "x", broadcast_bytes)
        moved = met.select(*names, _merged(_merged(F.col("p"), F.col("a")), masked(F.col("x"), rest)).alias("x"),
                           (F.col("h") + hamming(masked(F.col("x"), mask), F.col("a"))).alias("h"), "n")
        state = moved.groupBy(*names, "x", "h").agg(F.sum("n").alias("n"))
    return state.select(*names, F.col("x").alias(u), "h", "n")


def within(left: DataFrame, right: DataFrame, dims: int, by: Sequence[str] = (), u: str = "u", w: str = "w", radius: str = "radius",
           bits: int = STEP_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """by..., u, w, h of the distinct pairs with Hamming distance h <= the left vector's largest ``radius``."""
    by = list(by)
    names = [_c(b) for b in by]
    masks = segment_masks(dims, bits)
    words = len(masks[0])
    left = materialise(left.groupBy(*names, _c(u).alias("u")).agg(F.max(_c(radius)).cast("long").alias("t")), "hamming-left")[0]
    right = materialise(right.select(*names, _c(w).alias("w")).distinct(), "hamming-right")[0]
    none = _words([0] * words)
    pairs = left.select(*names).distinct() if by else left.limit(1).select()  # one row per group
    pairs = pairs.select(*names, none.alias("pu"), none.alias("pw"), F.lit(0).cast("long").alias("h"))
    for s, mask in enumerate(masks):
        done = _union(masks[:s], words)
        u_next = left.groupBy(*names, masked(F.col("u"), done).alias("pu"), masked(F.col("u"), mask).alias("a")).agg(F.max("t").alias("t"))
        w_next = right.select(*names, masked(F.col("w"), done).alias("pw"), masked(F.col("w"), mask).alias("b")).distinct()
        met = blocked_join(pairs, u_next, [*by, "pu"], "pw", broadcast_bytes)
        met = blocked_join(met, w_next, [*by, "pw"], "a", broadcast_bytes).withColumn("h", F.col("h") + hamming(F.col("a"), F.col("b")))
        pairs = met.filter(F.col("h") <= F.col("t")).select(
            *names, _merged(F.col("pu"), F.col("a")).alias("pu"), _merged(F.col("pw"), F.col("b")).alias("pw"), "h")
    return pairs.select(*names, F.col("pu").alias(u), F.col("pw").alias(w), "h")


def index_share(dims: int, radius: int, bits: int = INDEX_BITS) -> float:
    """Share of all pairs of vectors with even flags that the index brings together."""
    sizes = [sum(m.bit_count() for m in mask) for mask in segment_masks(dims, bits, spread=True)]
    share = max(radius, 0) // len(sizes)
    return sum(sum(comb(n, k) for k in range(min(n, share) + 1)) / 2**n for n in sizes)


def _scan(left: DataFrame, right: DataFrame, by: list[str], block: int, compare: Callable, out: Sequence[str]) -> DataFrame:
    """``compare`` on every pair of blocks of the written tables ``left`` (by..., u, ...) and ``right`` (by..., w, ...).

    It gets both sides' Arrow tables and yields Arrow tables of the columns ``out`` (vectors u and w, else
    longs), before which the group's columns are put."""
    names = [_c(b) for b in by]
    blocks = lambda df, n: df.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    if by:
        sizes = blocks(left, "nl").join(blocks(right, "nr"), by)
    else:
        sizes = blocks(left, "nl").crossJoin(blocks(right, "nr")).filter("nl > 0 AND nr > 0")
    sizes = materialise(sizes, "hamming-blocks")[0]
    n = int(sizes.agg(F.sum(F.col("nl").cast("long") * F.col("nr"))).first()[0] or 0)
    tasks = max(1, min(2 * n, SCAN_TASKS))
    met = lambda df: df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes))  # noqa: E731 (one row without groups)
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = [*by, "lb", "rb"]
    mine = met(left).select(*[_c(c) for c in left.columns], F.pmod(F.xxhash64("u"), F.col("nl")).cast("int").alias("lb"), others("nr").alias("rb"))
    theirs = met(right).select(*[_c(c) for c in right.columns], F.pmod(F.xxhash64("w"), F.col("nr")).cast("int").alias("rb"), others("nl").alias("lb"))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        parts = list(compare(a, b)) if len(a) and len(b) else []
        rows = pa.concat_tables(parts) if parts else pa.table({c: pa.array([], t) for c, t in types})
        for at, (name, value) in enumerate(zip(by, key)):
            rows = rows.add_column(at, name, pa.repeat(value, len(rows)))
        return rows

    fields = T.StructType([*left.select(*names).schema, *[T.StructField(c, VECTOR if c in "uw" else T.LongType()) for c in out]])
    types = [(c, pa.list_(pa.int64()) if c in "uw" else pa.int64()) for c in out]
    dealt = [df.repartition(tasks, *[_c(k) for k in keys]).groupBy(*[_c(k) for k in keys]) for df in (mine, theirs)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, fields)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The packed vectors as one row of words each."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).view(np.uint64)


def _tiles(u: np.ndarray, w: np.ndarray):
    """(first row, first column, distances) of every tile."""
    kind = np.uint8 if u.shape[1] < 4 else np.uint16  # a word adds 64 at most
    for i in range(0, len(u), TILE[0]):
        for j in range(0, len(w), TILE[1]):
            h = np.zeros((len(u[i : i + TILE[0]]), len(w[j : j + TILE[1]])), kind)
            for k in range(u.shape[1]):
                h += np.bitwise_count(u[i : i + TILE[0], None, k] ^ w[None, j : j + TILE[1], k])
            yield i, j, h


def _list_pairs(a: pa.Table, b: pa.Table):
    t = a["t"].to_numpy()
    us, ws = a["u"].combine_chunks(), b["w"].combine_chunks()
    for i, j, h in _tiles(_matrix(a["u"]), _matrix(b["w"])):
        row, col = np.nonzero(h <= t[i : i + len(h), None])
        if len(row):
            yield pa.table({"u": us.take(pa.array(row + i)), "w": ws.take(pa.array(col + j)), "h": pa.array(h[row, col].astype(np.int64))})


def _count_pairs(a: pa.Table, b: pa.Table):
    t, cnt, total = a["t"].to_numpy(), b["cnt"].to_numpy(), np.zeros(len(a), np.int64)
    for i, j, h in _tiles(_matrix(a["u"]), _matrix(b["w"])):
        row, col = np.divmod(np.flatnonzero(h <= t[i : i + len(h), None]), h.shape[1])
        np.add.at(total, row + i, cnt[col + j])
    some = np.flatnonzero(total)
    yield pa.table({"u": a["u"].combine_chunks().take(pa.array(some)), "n": pa.array(total[some])})


def _nearest_of(others: bool) -> Callable:
    def compare(a: pa.Table, b: pa.Table):
        w = _matrix(b["w"])
        order = np.lexsort(w.view(np.int64).T[::-1])  # the least of equally near vectors comes first
        u, w = _matrix(a["u"]), w[order]
        best, at = np.full(len(u), 1 << 16, np.int64), np.zeros(len(u), np.int64)
        for i, j, h in _tiles(u, w):
            if not others:
                h -= 1  # equal vectors become the farthest
            col = h.argmin(1)
            d = h[np.arange(len(h)), col].astype(np.int64)
            if not others:
                d = np.where(d == np.iinfo(h.dtype).max, 1 << 16, d + 1)
            nearer = np.flatnonzero(d < best[i : i + len(h)])
            best[i + nearer], at[i + nearer] = d[nearer], col[nearer] + j
        some = np.flatnonzero(best < 1 << 16)
        yield pa.table({"u": a["u"].combine_chunks().take(pa.array(some)), "h": pa.array(best[some]),
                        "w": b["w"].combine_chunks().take(pa.array(order[at[some]]))})

    return compare


def indexed_within(left: DataFrame, right: DataFrame, dims: int, by: Sequence[str] = (), u: str = "u", w: str = "w",
                   radius: str = "radius", bits: int = INDEX_BITS, broadcast_bytes: int = BROADCAST_BYTES,
                   count: str | None = None, scan_share: float = SCAN_SHARE) -> DataFrame:
    """The result of :func:`within` by multi-index hashing. A pair is kept at the first of the segments
    that bring it together, so nothing has to be de-duplicated. With ``count``, by..., u, n: the number of right
    rows (``count``) within the radius of each left vector that has any.

    Radii for which the index brings together more than ``scan_share`` of all pairs go without it."""
    by = list(by)
    names = [_c(b) for b in by]
    masks = segment_masks(dims, bits, spread=True)
    left = materialise(left.groupBy(*names, _c(u).alias("u")).agg(F.max(_c(radius)).cast("long").alias("t")), "hamming-left")[0]
    widest = left.agg(F.max("t")).first()[0]
    if widest is not None and index_share(dims, widest, bits) > scan_share:
        mine = left.filter(F.col("t").isNotNull() & F.col("u").isNotNull())
        theirs = right.filter(_c(w).isNotNull()).groupBy(*names, _c(w).alias("w"))
        if count:
            theirs = materialise(theirs.agg(F.sum(_c(count)).cast("long").alias("cnt")), "hamming-right")[0]
            counts = _scan(mine, theirs, by, BLOCK, _count_pairs, ["u", "n"])
            return counts.groupBy(*names, "u").agg(F.sum("n").alias("n")).select(*names, F.col("u").alias(u), "n")
        theirs = materialise(theirs.agg(F.lit(1).alias("one")).drop("one"), "hamming-right")[0]
        pairs = _scan(mine, theirs, by, LIST_BLOCK, _list_pairs, ["u", "w", "h"])
        return pairs.select(*names, F.col("u").alias(u), F.col("w").alias(w), "h")
    left = left.withColumn("share", F.floor(F.col("t") / len(masks)))
    dealt = lambda df, vec, out: df.select("*", F.posexplode(F.array(*[masked(F.col(vec), m) for m in masks])).alias("s", out))
    mine = materialise(dealt(left, "u", "a"), "hamming-left")[0]
    theirs = materialise(dealt(right.select(*names, _c(w).alias("w")).distinct(), "w", "b"), "hamming-right")[0]
    # the values of a segment: at most 2^bits on either side, whatever the number of vectors
    values = blocked_join(mine.groupBy(*names, "s", "a").agg(F.max("share").alias("most")), theirs.select(*names, "s", "b").distinct(),
                          [*by, "s"], "a", broadcast_bytes)
    close = values.filter(hamming(F.col("a"), F.col("b")) <= F.col("most")).select(*names, "s", "a", "b")
    met = blocked_join(blocked_join(mine, close, [*by, "s", "a"], "u", broadcast_bytes), theirs, [*by, "s", "b"], "u", broadcast_bytes)
    apart = F.array(*[hamming(masked(F.col("u"), m), masked(F.col("w"), m)) for m in masks])
    met = met.withColumn("apart", apart).withColumn("h", F.aggregate("apart", F.lit(0).cast("long"), lambda n, x: n + x))
    earlier = F.exists(F.slice("apart", F.lit(1), F.col("s")), lambda x: x <= F.col("share"))
    found = met.filter((F.get("apart", F.col("s")) <= F.col("share")) & ~earlier & (F.col("h") <= F.col("t")))
    found = found.select(*names, "u", "w", "h")
    if count:
        rows = right.groupBy(*names, _c(w).alias("w")).agg(F.sum(_c(count)).cast("long").alias("cnt"))
        return found.join(rows, [*by, "w"]).groupBy(*names, "u").agg(F.sum("cnt").alias("n")).select(*names, F.col("u").alias(u), "n")
    return found.select(*names, F.col("u").alias(u), F.col("w").alias(w), "h")


def nearest(left: DataFrame, right: DataFrame, dims: int, by: Sequence[str] = (), u: str = "u", w: str = "w",
            start: int | None = None, others: bool = True, broadcast_bytes: int = BROADCAST_BYTES,
            scan_share: float = SCAN_SHARE) -> DataFrame:
    """by..., u, h, w: the smallest Hamming distance of each distinct left vector to a right vector and
    the least such vector; without ``others`` an equal vector does not count. Vectors whose group
    has no right vector are absent. The radius starts at ``start`` and doubles for those still open, until the
    index is no help: then they are compared with all vectors."""
    by = list(by)
    names = [_c(b) for b in by]
    rest = materialise(left.select(*names, _c(u).alias("u")).distinct(), "hamming-open")[0]
    right = materialise(right.select(*names, _c(w).alias("w")).distinct(), "hamming-right")[0]
    out, radius = None, max(1, dims // 8 if start is None else start)
    while True:
        scan = index_share(dims, radius) > scan_share
        if scan:
            known = [df.filter(F.col(c).isNotNull()) for df, c in ((rest, "u"), (right, "w"))]
            pairs = _scan(*known, by, BLOCK, _nearest_of(others), ["u", "h", "w"])
        else:
            pairs = indexed_within(rest.withColumn("radius", F.lit(radius)), right, dims, by, broadcast_bytes=broadcast_bytes)
        if not others and not scan:
            pairs = pairs.filter(F.col("h") > 0)
        best = materialise(pairs.groupBy(*names, "u").agg(F.min(F.struct("h", "w")).alias("v")), "hamming-nearest")[0]
        best = best.select(*names, "u", "v.h", "v.w")
        out = best if out is None else out.unionByName(best)
        if scan or radius >= dims:
            break
        rest = materialise(rest.join(best.select(*names, "u"), [*by, "u"], "left_anti"), "hamming-open")[0]
        if rest.isEmpty():
            break
        radius = min(dims, 2 * radius)
    return out.select(*names, F.col("u").alias(u), "h", F.col("w").alias(w))


def farthest(left: DataFrame, right: DataFrame, dims: int, by: Sequence[str] = (), u: str = "u", w: str = "w",
             start: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """by..., u, h, w: the largest Hamming distance of each distinct left vector to a right vector and the
    least such vector."""
    turned = left.withColumn(u, complement(_c(u), dims))
    near = nearest(turned, right, dims, by, u, w, start, broadcast_bytes=broadcast_bytes)
    return near.withColumn(u, complement(_c(u), dims)).withColumn("h", F.lit(dims).cast("long") - F.col("h"))
