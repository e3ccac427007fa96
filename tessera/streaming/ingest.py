"""Structured Streaming jobs: resumable incremental ingest of landed files, and the
feedback event feed.

Both use a file source with an explicit schema, ``maxFilesPerTrigger`` batches, a
checkpoint in the shared folder (the position that survives restarts and executor loss)
and ``trigger(availableNow=True)``: run, drain what has landed, stop — rerun later and only
new files are read. Malformed records land in ``_corrupt_record`` instead of failing a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import feedback as FB

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def land_json(df: DataFrame, path: str, files: int) -> None:
    """Land records as JSON-lines files (the upstream drop zone)."""
    (df.repartition(files).write.mode("append").option("timestampFormat", TS_FORMAT)
     .option("timestampNTZFormat", TS_NTZ_FORMAT).json(path))


def with_corrupt_column(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != "_corrupt_record"]
                        + [T.StructField("_corrupt_record", T.StringType())])


def ingest_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                  max_files_per_trigger: int = 4, schema: T.StructType = EVENTS_SCHEMA) -> None:
    """Drain every landed file not yet recorded in the checkpoint into the parquet sink."""
    src = (spark.readStream.schema(with_corrupt_column(schema)).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_NTZ_FORMAT).json(landing))
    q = (src.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def feedback_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                    dedupe: bool = False, max_files_per_trigger: int = 4, rejects: str | None = None) -> None:
    """JSON feedback events (one per line) -> parsed, validated rows appended to the log, and the
    records that are no valid events to ``rejects``, if given (by a query of its own over the same
    files, with its own position).

    ``dedupe`` drops repeats of (timestamp, input, recommended item) within a 1-hour event-time
    watermark, so state stays bounded."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(landing)
    rows = FB.feedback_frame(raw)
    if dedupe:
        rows = (rows.withWatermark("event_time", "1 hour")
                .dropDuplicatesWithinWatermark(["timestamp", "input_game", "recommended_game"]))
    q = (rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if rejects:
        q = (FB.feedback_rejects(raw).writeStream.format("parquet").option("path", rejects)
             .option("checkpointLocation", f"{checkpoint.rstrip('/')}-rejects")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record") if "_corrupt_record" in df.columns else df
