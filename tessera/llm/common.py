"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import hadoop_fs, shared_path

#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+`` words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``bytes.translate`` table that lower-cases A-Z only.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Lists that note the tables written while they are open (see ``noted``).
_NOTED: list[list[str]] = []


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Note in ``paths`` where ``stage`` writes meanwhile, so that the caller can remove the tables."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.remove(paths)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables."""
    for path in paths:
        fs, at = hadoop_fs(spark, path)
        fs.delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts lineage at a point that survives lost executors, evaluates ``df`` once and gives the
    reread table exact file statistics, so that the planner broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array (null text: empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RE)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``... that no column has (case-insensitively)."""
    taken = {t.lower() for t in taken}
    out, n = name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def with_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns; columns of the input with the same names (in any case) give way."""
    new = {k.lower() for k in cols}
    return df.select(*[F.col(quote(c)) for c in df.columns if c.lower() not in new], *[v.alias(k) for k, v in cols.items()])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
