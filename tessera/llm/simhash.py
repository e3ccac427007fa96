"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 64-bit fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word
shingles. Fingerprints at ``MAX_BITS`` (2) or fewer differing bits are linked; components of
links are the groups.

Candidate search. The fingerprint is cut into three segments of 22, 21 and 21 bits. Two
differing bits leave at least one segment untouched (pigeonhole). The segment after it may hold
up to two errors, and is read as a word of the perfect [23, 12] Golay code: its keys are the
indices of all codewords within four bits (one if the nearest is at most two bits away,
otherwise six). Any two words at most two bits apart share such an index (tested over all
syndromes), so the key (segment number, untouched segment, codeword index) loses no link. Rows
that share a key are joined and the bit distance is verified.

Hot groups. Equal fingerprints are one row from the start. A bucket of more than ``BUCKET``
fingerprints is not paired up: its members go to an exact path that links each fingerprint
to the smallest fingerprint with which it shares a word at most one bit from both. Such a word
has at most 65 neighbours, so the work is linear and no group grows.

Defined cases: null text is the empty text, whose fingerprint is zero and is linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows share a component;
rows with a null doc_id take the smallest non-null doc_id of their group, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import LOWER_ASCII, free_name, quote, stage

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BUCKET = 24
#: Bits of the three segments, from the low end, and where each begins.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words)))
        starts = [0, *ends]
        hashes = [digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[shingle - 1:])]
    votes = np.zeros(64, np.int64)
    arr = np.array(hashes, "<u8")
    for at in range(0, len(arr), CHUNK):
        part = arr[at:at + CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(arr), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return of(text)


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ GENERATOR << (bit - 11), v)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainders of the high 12 bits, error words per syndrome, how many of them).

    ``errors[s]`` holds every error word of weight 4 or less whose syndrome is ``s``: one, or six.
    """
    high = _remainder(np.arange(4096, dtype=np.int64) << 11)
    words = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    syndromes = _remainder(words)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=2048)
    errors = np.zeros((2048, counts.max()), np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for k in range(errors.shape[1]):
        has = counts > k
        errors[has, k] = words[order[starts[has] + k]]
    return high, errors, counts


def golay_indices(words: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``words``, index of a codeword within four bits), several per word."""
    high, errors, counts = tables
    syndrome = (words & 2047) ^ high[words >> 11]
    n = counts[syndrome]
    at = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, (words[at] ^ errors[syndrome[at], nth]) >> 11


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = fp.view(np.uint64)
        segs = [(bits >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        for i, seg in enumerate(segs):
            at, index = golay_indices(segs[(i + 1) % 3], tables)
            key = i << 34 | seg[at] << 12 | index
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], ["key", "fp"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fp), 4096):
            part = fp[at:at + 4096]
            mid = (part.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part, 65))], ["mid", "fp"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between different fingerprints: enough of them to connect every group.

    ``distinct``: a written table with one long column ``fp``, no repeats.
    """
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    large = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"), "simhash-large")
    marked = keys.join(large.withColumn("large", F.lit(True)), "key", "left")
    few = (
        marked.filter(F.col("large").isNull())
        .groupBy(F.xxhash64("key").alias("k"), "key")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )
    near = F.transform(
        F.col("fps"),
        lambda x: F.transform(
            F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS)),
            lambda y: F.struct(x.alias("a"), y.alias("b")),
        ),
    )
    paired = few.select(F.explode(F.flatten(near)).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b")
    dense = marked.filter("large").groupBy("fp").agg(F.count("*").alias("n")).select("fp")
    mids = dense.mapInArrow(_midpoints, "mid long, fp long")
    hubs = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = hubs.select("a", F.explode("fps").alias("b")).filter("a != b").groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b")
    return paired.unionByName(star)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) is connected to.

    Alternating large-star and small-star steps, each a min aggregate and an equi-join whose hot
    side AQE can split; every round is written out, and the loop ends when a round changes nothing.
    """
    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(neighbours: DataFrame) -> DataFrame:
        low = neighbours.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return neighbours.join(low, "a")

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "simhash-edges")
    seen = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        joined = star(large)
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        edges = stage(small.filter("a != b").distinct(), "simhash-edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _groups(slim: DataFrame) -> DataFrame:
    """fp -> first (smallest doc_id, then row id) of its component, for fingerprints that share one.

    ``slim``: written table (rid, doc_id, fp).
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid"))
    classes = stage(slim.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes))
    linked = classes.select("fp", "first").join(roots, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("first"))
    of_linked = roots.join(lowest, "root").select(F.col("node").alias("fp"), F.col("first").alias("best"))
    every = classes.join(of_linked, "fp", "left").filter((F.col("n") > 1) | F.col("best").isNotNull())
    return stage(every.select("fp", F.coalesce("best", "first").alias("first")), "simhash-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    slim = stage(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", fingerprints(F.col("text")).alias("fp")), "simhash-slim")
    out = slim.join(_groups(slim), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of documents, one of each component: that with the smallest doc_id."""
    fp, rid = free_name(docs.columns, "fp"), free_name(docs.columns, "rid")
    marked = stage(docs.select("*", F.monotonically_increasing_id().alias(rid), fingerprints(F.col("text")).alias(fp)), "simhash-docs")
    slim = marked.select(F.col(rid).alias("rid"), "doc_id", F.col(fp).alias("fp"))
    groups = _groups(slim).select(F.col("fp").alias("group_fp"), F.col("first.rid").alias("group_rid"))
    out = marked.join(groups, F.col(fp) == F.col("group_fp"), "left")
    return out.filter(F.col("group_rid").isNull() | (F.col("group_rid") == F.col(rid))).select(*[F.col(quote(c)) for c in docs.columns])
