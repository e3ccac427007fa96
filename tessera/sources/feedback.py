"""Feedback events: JSON records from the client, an append-only log (CSV or parquet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import constants as C

# required: timestamp, input_game, recommended_game, feedback; optional: reason, comment
FEEDBACK_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in C.FEEDBACK_COLUMNS])
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def parse_feedback(json_col: Column) -> Column:
    """JSON text -> struct of the six fields (missing optional fields are null)."""
    return F.from_json(json_col, FEEDBACK_SCHEMA)


def _parsed(df: DataFrame, json_col: str) -> DataFrame:
    p = df.select(F.col(json_col).alias("raw"), parse_feedback(F.col(json_col)).alias("f"))
    needed = [F.col(f"f.{c}").isNotNull() for c in ("timestamp", "input_game", "recommended_game", "feedback")]
    return p.withColumn("valid", F.coalesce(needed[0] & needed[1] & needed[2] & needed[3], F.lit(False)))


def event_time(timestamp: Column) -> Column:
    """ISO-8601 text, with or without a fraction, as a timestamp (null if it is none)."""
    iso = timestamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(iso, F.try_to_timestamp(timestamp))


def feedback_frame(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Parsed events with a typed event time. Records that are no JSON or lack a required field
    are in :func:`feedback_rejects` instead."""
    p = _parsed(df, json_col).filter("valid").select("f.*")
    return p.withColumn("event_time", event_time(F.col("timestamp")))


def feedback_rejects(df: DataFrame, json_col: str = "value") -> DataFrame:
    """(raw, missing): the records that :func:`feedback_frame` leaves out, and what they lack."""
    p = _parsed(df, json_col).filter("not valid")
    lacks = [F.when(F.col(f"f.{c}").isNull(), F.lit(c)) for c in ("timestamp", "input_game", "recommended_game", "feedback")]
    return p.select("raw", F.concat_ws(",", *lacks).alias("missing"))


def append_log(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Schema-evolving append: columns missing on either side become null; history kept."""
    return existing.unionByName(new, allowMissingColumns=True)


#: Both sides alike: quotes doubled, line feeds and outer blanks of a field kept.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(*C.FEEDBACK_COLUMNS).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv_log(spark, path: str) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(FEEDBACK_SCHEMA).csv(path)
