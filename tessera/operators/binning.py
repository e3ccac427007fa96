"""Leader binning of baskets (order-dependent inside a basket, parallel across baskets).

Inside one basket, items are visited in table order; an item joins the bin whose centroid
has the highest cosine similarity strictly above the threshold (the first such bin wins
ties), the centroid becoming the half-to-even rounded mean of its members; otherwise it
opens a new bin (ids from 1). The fold is sequential by definition, so it runs per basket
over a sorted stream of rows; baskets are independent and spread over tasks by the group key.
A task holds the open bins of one basket, as running sums and one centroid matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import constants as C


#: Bins that leave a task in one Arrow batch.
BATCH = 4096
#: Bytes of item vectors that a task should sort.
TASK_BYTES = 64 << 20


class LeaderBins:
    """Open bins of one basket: member sums, rounded centroids (one matrix row each), names.

    One object serves all baskets of a task, one after the other (``close``)."""

    def __init__(self, width: int, threshold: float):
        self.threshold, self.used = threshold, 0
        self.sums = np.zeros((8, width))
        self.centroids = np.zeros((8, width))
        self.lengths = np.zeros(8)
        self.names: list[list[str]] = []

    def _place(self, vector: np.ndarray, length: float) -> int | None:
        """The most similar centroid above the threshold; one product for all bins."""
        scale = self.lengths[:self.used] * length
        similarity = np.divide(self.centroids[:self.used] @ vector, scale, out=np.zeros(self.used), where=scale > 0)
        top = int(similarity.argmax())
        return top if similarity[top] > self.threshold else None

    def add(self, name: str, vector: np.ndarray) -> None:
        length = math.sqrt(vector @ vector)
        at = self._place(vector, length) if self.used else None
        if at is None:
            at = self.used
            self.used += 1
            self.names.append([name])
            if at == len(self.sums):
                self.sums, self.centroids = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.centroids))
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.sums[at] = vector
            self.centroids[at] = np.trunc(vector)
        else:
            self.names[at].append(name)
            self.sums[at] += vector
            self.centroids[at] = np.rint(self.sums[at] / len(self.names[at]))
        row = self.centroids[at]
        self.lengths[at] = math.sqrt(row @ row)

    def close(self) -> tuple[list[list[str]], np.ndarray]:
        """(names, centroids) of the basket's bins; the next basket starts without bins."""
        out = self.names, self.centroids[:self.used].astype(np.int64)
        self.names, self.used = [], 0
        return out


def bin_items(names: Sequence[str], vectors: np.ndarray, threshold: float = C.BIN_THRESHOLD) -> pd.DataFrame:
    """Bins of one basket in the order in which they open."""
    vectors = np.asarray(vectors, dtype=np.float64)
    bins = LeaderBins(vectors.shape[1] if vectors.ndim == 2 else 0, threshold)
    for name, vector in zip(names, vectors):
        bins.add(name, vector)
    members, centroids = bins.close()
    return pd.DataFrame({"basket": [None] * len(members), "bin_id": range(1, len(members) + 1), "size": [len(m) for m in members],
                         "members": members, "centroid": centroids.tolist()})


def basket_bins(df: DataFrame, features: Sequence[str], basket_col: str = "basket", order_col: str = "game_id",
                name_col: str = "game_name", threshold: float = C.BIN_THRESHOLD,
                partitions: int | None = None) -> DataFrame:
    """basket, bin_id, size, members (array<string>), centroid (array<bigint>).

    Baskets are hash-partitioned, in as many partitions as keep the vectors of one near ``TASK_BYTES``,
    and inside each made distinct and sorted by (basket, order), so the vectors are moved once; one
    pass over Arrow batches feeds the rows to the open basket's bins and sets them aside when the
    next basket begins. Bins leave in batches, not basket by basket. One basket is one sequential
    fold by definition."""
    vec = F.array(*[F.coalesce(F.col(f"`{f}`"), F.lit(0)).cast("double") for f in features])
    src = df.select(F.col(basket_col).alias("basket"), F.col(order_col).alias("ord"),
                    F.col(name_col).alias("name"), vec.alias("vec"))
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-src.count() * (len(features) + 8) * 8 // TASK_BYTES))
    ordered = src.repartition(int(n), "basket").dropDuplicates(["basket", "ord"]).sortWithinPartitions("basket", "ord").select("basket", "name", "vec")
    btype = src.schema["basket"].dataType.simpleString()
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, begun, basket, kind = LeaderBins(width, threshold), False, None, None
        baskets, numbers, members, centroids = [], [], [], []

        def close() -> None:
            names, table = bins.close()
            baskets.extend([basket] * len(names))
            numbers.extend(range(1, len(names) + 1))
            members.extend(names)
            centroids.append(table)

        def flush() -> pa.RecordBatch:
            flat = pa.array(np.concatenate(centroids).ravel())
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(members) + 1, dtype=np.int32) * width), flat)
            cols = [pa.array(baskets, kind), pa.array(numbers, pa.int32()), pa.array([len(m) for m in members], pa.int32()),
                    pa.array(members, pa.list_(pa.string())), cells]
            for held in (baskets, numbers, members, centroids):
                held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["basket", "bin_id", "size", "members", "centroid"])

        for batch in batches:
            kind = batch.column(0).type
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for key, name, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), vectors):
                if begun and key != basket and not (key != key and basket != basket):  # NaN is one basket
                    close()
                    if len(members) >= BATCH:
                        yield flush()
                begun, basket = True, key
                bins.add(name, vector)
        if begun:
            close()
            yield flush()

    schema = f"basket {btype}, bin_id int, size int, members array<string>, centroid array<bigint>"
    return ordered.mapInArrow(run, schema)
