"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the lower-cased UTF-8 byte n-grams (3 to 8) of a whole text, present or not, hashed
into ``BINS``. Training, as Spark jobs:

1. labels whose rows may be learned from are thinned by a hash of the id to about ``MAX_ROWS`` (the
   documented bound of the training sample; with fewer labels all are used) and joined to the texts;
2. per-bin document counts by label give the log-count ratios r = log((p1 + a)/|p1|) - log((p0 + a)/|p0|);
3. the ``FEATURES`` bins whose ratio is most significant are kept;
4. a logistic regression over presence times r is fitted by Spark ML, distributed over the rows.

The model is one weight per kept bin and an intercept, whatever the size of the corpus. Scoring is
a numpy lookup per text in Arrow batches.

Defined cases: null and empty texts have no features and score the intercept's probability; rows
without a label teach nothing; if several label rows of an id disagree, toxic wins; without both
labels every score is the share of toxic labels (0 without any); repeated documents count as often
as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import crc_mod, stage

ORDERS = (3, 4, 5, 6, 7, 8)
BIN_BITS = 20
BINS = 1 << BIN_BITS
FEATURES = 2048
MAX_ROWS = 20_000
SMOOTH = 1.0
REGULARISATION = 1e-3
THRESHOLD = 0.3
CHUNK = 1 << 16


class Bins:
    """Distinct feature bins of texts; one mask is reused."""

    def __init__(self):
        self.mask = np.zeros(BINS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass") if text else b"", np.uint8).astype(np.uint32)
        mask, longest = self.mask, max(ORDERS)
        for at in range(0, len(raw), CHUNK):
            part = raw[at:at + CHUNK + longest - 1]  # n-grams that begin in the chunk
            own = min(CHUNK, len(raw) - at)
            h = part.copy()
            for n in range(2, longest + 1):
                if len(part) < n:
                    break
                h = h[:len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1:]
                if n in ORDERS:
                    mixed = (h[:own] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                    mask[mixed >> np.uint32(32 - BIN_BITS)] = True
        found = np.flatnonzero(mask)
        mask[found] = False
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bins, counts = Bins(), np.zeros((2, BINS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic, bins(text)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], ["bin", "pos", "neg"])


class Model:
    def __init__(self, bins: np.ndarray, weights: np.ndarray, intercept: float):
        self.weights = np.zeros(BINS, np.float64)
        self.weights[bins] = weights
        self.intercept = intercept
        self.bins = Bins()

    def score(self, text: str | None) -> float:
        z = self.intercept + self.weights[self.bins(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of the labelled sample; written."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # about max_rows rows of two numbers: small by the sample's bound
    return stage(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-train")


def train(rows: DataFrame, features: int = FEATURES, regularisation: float = REGULARISATION) -> Model:
    """Fit on a written (text, toxic) table."""
    sums = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = sums.n, sums.pos or 0
    if pos == 0 or pos == n:
        share = min(max(pos / n if n else 0.0, 1e-12), 1 - 1e-12)
        return Model(np.zeros(0, int), np.zeros(0), float(np.log(share / (1 - share))))
    counts = stage(rows.mapInArrow(_count, "bin long, pos long, neg long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    sizes = counts.agg(F.count("*").alias("bins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    p, q = F.col("pos"), F.col("neg")
    all_pos, all_neg = (sizes[c] + SMOOTH * sizes.bins for c in ("pos", "neg"))
    ratio = F.log((p + SMOOTH) / all_pos) - F.log((q + SMOOTH) / all_neg)
    # significance: difference of the two labels' document rates over its standard error
    rate = (p + q + 1) / (n + 2)
    z = F.abs(p / pos - q / (n - pos)) / F.sqrt(rate * (1 - rate) * (1 / pos + 1 / (n - pos)))
    best = counts.select("bin", ratio.alias("ratio"), z.alias("z")).orderBy(F.desc("z"), "bin").limit(features).collect()
    kept = sorted((r.bin, r.ratio) for r in best)
    kept_bins, kept_ratio = np.array([b for b, _ in kept], np.int64), np.array([r for _, r in kept])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, place = Bins(), np.full(BINS, -1, np.int64)
        place[kept_bins] = np.arange(len(kept_bins))
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                at = place[bins(t)]
                found.append(at[at >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], ["at", "toxic"])

    size = len(kept_bins)
    vector = F.udf(lambda at: SparseVector(size, at, [float(kept_ratio[i]) for i in at]), VectorUDT())
    data = stage(rows.mapInArrow(present, "at array<long>, toxic int"), "toxic-features").select(vector("at").alias("features"), F.col("toxic").cast("double").alias("label"))
    fitted = LogisticRegression(regParam=regularisation, maxIter=60, standardization=False).fit(data)
    return Model(kept_bins, fitted.coefficients.toArray() * kept_ratio, float(fitted.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic label."""
    at = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.weights[at], model.intercept))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, of(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from three quarters of the ids."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    rows = training_rows(docs, labels.filter(crc_mod(F.col("doc_id"), 4) != 2))
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), train(rows))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
