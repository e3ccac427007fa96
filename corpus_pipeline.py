"""Corpus pipeline: quality rules, near-dedup, decontamination, private data, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor kept. ``run``
writes each stage's rows as Parquet to the cluster's shared folder and rereads them as the next
stage's documents.

A stage's result is lazy and reads tables that the stage wrote. They are removed when the next stage
begins, unless its documents still read them: by then the result has to be written, as ``run`` does.

Defined cases, in every stage: nulls in any column, empty and very long texts and repeated rows pass
or go by the operator's rules (null text counts as empty; equal rows are near copies of each other,
of which the smallest doc_id stays, a null one last); an empty table stays empty; an empty
benchmark removes nothing; further columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, pieces, pii, quality, simhash
from tessera.llm.common import noted, quote, remove, stage
from tessera.sources.tables import read_table


#: Tables that the stages of a Spark application left, by its id.
_LEFT: dict[str, list[str]] = {}


def _frees(step: Callable) -> Callable:
    """A stage that first removes the tables earlier stages left, but for those that its documents read."""

    @wraps(step)
    def stage_function(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        files = docs.inputFiles() if left else []
        done = [path for path in left if not any(path.rsplit("/", 1)[-1] in f for f in files)]
        remove(spark, done)
        left[:] = [path for path in left if path not in done]
        with noted(left):
            return step(spark, docs, sf_dir)

    return stage_function


@_frees
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the robust outlier rule or the plain rule rejects go."""
    return quality.quality_filter(docs)


@_frees
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest doc_id."""
    return simhash.keep_one(docs)


@_frees
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@_frees
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; ``n_chars`` follows the new text."""
    out = pii.anonymise(docs)
    changed = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out if changed is None else out.select(*[changed.alias(c) if c == "n_chars" else F.col(quote(c)) for c in docs.columns])


@_frees
def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its pieces."""
    return pieces.with_tokens(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("private_data", private_data),
    ("sentencepiece_tokens", sentencepiece_tokens),
]

#: The stages use iterative estimates, bit fingerprints and keyed surrogates: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written: list[str] = []
            with noted(written):
                docs = stage(docs, name)
            remove(spark, before)
            before = written
    return docs
