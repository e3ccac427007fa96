"""Feature-vector columns and distances.

0/1 feature sets are packed into ``array<bigint>`` words (62 flags per word), so the
Euclidean distance of two rows is ``sqrt(popcount(a XOR b))`` — exact, branch-free and
inside whole-stage codegen. General numeric features use ``array<double>`` with a
``zip_with``/``aggregate`` reduction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS_PER_WORD = 62


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def pack_bits(columns: Sequence[str]) -> Column:
    """0/1 columns -> array<bigint>; null flags count as 0."""
    words = []
    for start in range(0, len(columns), BITS_PER_WORD):
        word = F.lit(0).cast("long")
        for i, c in enumerate(columns[start:start + BITS_PER_WORD]):
            bit = F.shiftleft(F.coalesce(_c(c), F.lit(0)).cast("long"), i)
            word = word.bitwiseOR(bit)
        words.append(word)
    return F.array(*words)


def pack_flags(flags: Sequence[Column]) -> Column:
    """Boolean expressions -> array<bigint>; null counts as 0."""
    words = []
    for start in range(0, len(flags), BITS_PER_WORD):
        word = F.lit(0).cast("long")
        for i, f in enumerate(flags[start:start + BITS_PER_WORD]):
            word = word.bitwiseOR(F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        words.append(word)
    return F.array(*words)


def dense_vector(columns: Sequence[str]) -> Column:
    return F.array(*[_c(c).cast("double") for c in columns])


def hamming(a: Column, b: Column) -> Column:
    """Number of differing flags between two packed vectors of equal length."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )


def packed_distance(a: Column, b: Column) -> Column:
    return F.sqrt(hamming(a, b).cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
