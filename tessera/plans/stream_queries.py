"""Registered streaming queries (each run drains the landed files, then reads the sink)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as C
from tessera.plans.source_queries import _oracles as source_oracles
from tessera.plans.source_queries import feedback_json
from tessera.session import cut_lineage, shared_path
from tessera.sources.tables import read_table
from tessera.streaming import ingest as ST
from tessera.streaming import scan as SC

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def stream_ingest(spark, sf):
    """Events landed in two drops; the stream is run after each drop and resumes from its
    checkpoint, so the sink holds every event exactly once."""
    ev = read_table(spark, sf, "events").select(*EVENT_COLS)
    landing, sink, ckpt = (shared_path(spark, n) for n in ("events-landing", "events-sink", "events-ckpt"))
    first = F.dayofmonth("ts") <= 15
    ST.land_json(ev.filter(first), landing, files=4)
    ST.ingest_stream(spark, landing, sink, ckpt, schema=ev.schema)
    ST.land_json(ev.filter(~first), landing, files=4)
    ST.ingest_stream(spark, landing, sink, ckpt, schema=ev.schema)
    return ST.valid_rows(ST.read_sink(spark, sink)).select(*EVENT_COLS)


def stream_feedback(spark, sf):
    j = feedback_json(spark, sf)
    landing, sink, ckpt = (shared_path(spark, n) for n in ("feedback-landing", "feedback-sink", "feedback-ckpt"))
    j.select("value").repartition(4).write.mode("append").text(landing)
    ST.feedback_stream(spark, landing, sink, ckpt)
    return ST.read_sink(spark, sink).select(*C.FEEDBACK_COLUMNS, "event_time")


#: The registered scans end after fewer empty batches than a real one, and an id is an item if the
#: event's value is above this.
SCAN_EMPTY, SCAN_VALUE = 8, 95.0
SCAN_CHUNKS = C.SCAN_BATCH_SIZE // C.SCAN_CHUNK_SIZE


def scan_stop(spark, sf):
    """A scan of the event ids for each event type: batches of 20 ids in chunks of 10, every 17th chunk
    failed. Reports land in two drops, the later ids first, and the query resumes in between."""
    ev = read_table(spark, sf, "events")
    kinds = ev.select("event_type").filter("event_type IS NOT NULL").distinct().withColumnRenamed("event_type", "scan")
    chunk = F.floor(F.col("event_id") / C.SCAN_CHUNK_SIZE)
    hits = ev.filter(F.col("value") > SCAN_VALUE).groupBy(F.col("event_type").alias("scan"), chunk.alias("at")).agg(F.count(F.lit(1)).alias("items"))
    chunks = ev.select(chunk.alias("at")).distinct()
    failed = F.col("at") % 17 == 3
    reports = (kinds.crossJoin(chunks).join(hits, ["scan", "at"], "left").select(  # a handful of scans
        "scan", F.floor(F.col("at") / SCAN_CHUNKS).alias("batch"), (F.col("at") % SCAN_CHUNKS).cast("int").alias("chunk"),
        F.when(~failed, F.coalesce("items", F.lit(0))).cast("long").alias("items"), F.when(failed, F.lit("timeout")).alias("error")))
    reports = cut_lineage(reports)
    landing, sink, ckpt = (shared_path(spark, n) for n in ("scan-landing", "scan-sink", "scan-ckpt"))
    late = F.col("batch") % 4 >= 2
    for drop in (late, ~late):
        reports.filter(drop).repartition(4, "batch").write.mode("append").parquet(landing)
        SC.follow_scans(spark, landing, sink, ckpt, SCAN_CHUNKS, SCAN_EMPTY)
    return spark.read.schema(SC.OUTCOME_SCHEMA).parquet(sink)


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_feedback": stream_feedback,
    "scan_stop": scan_stop,
}

_SCAN_SQL = f"""
WITH k AS (SELECT DISTINCT event_type AS scan FROM events WHERE event_type IS NOT NULL),
h AS (SELECT event_type AS scan, event_id // {C.SCAN_CHUNK_SIZE} AS at, COUNT(*) AS items FROM events WHERE value > {SCAN_VALUE} GROUP BY 1, 2),
c AS (SELECT k.scan, a.at, a.at // {SCAN_CHUNKS} AS batch, CAST(a.at % {SCAN_CHUNKS} AS INTEGER) AS chunk, a.at % 17 = 3 AS failed, COALESCE(h.items, 0) AS items
      FROM k CROSS JOIN (SELECT DISTINCT event_id // {C.SCAN_CHUNK_SIZE} AS at FROM events) a LEFT JOIN h ON h.scan = k.scan AND h.at = a.at),
full_b AS (SELECT scan, batch, SUM(CASE WHEN failed THEN 0 ELSE items END) AS items FROM c GROUP BY scan, batch HAVING COUNT(*) = {SCAN_CHUNKS}),
seq AS (SELECT *, batch = row_number() OVER (PARTITION BY scan ORDER BY batch) - 1 AS gapless FROM full_b),
b AS (SELECT scan, batch, items FROM (SELECT *, MIN(CASE WHEN gapless THEN 1 ELSE 0 END) OVER (PARTITION BY scan ORDER BY batch) AS ok FROM seq) WHERE ok = 1),
isl AS (SELECT *, batch - row_number() OVER (PARTITION BY scan, items = 0 ORDER BY batch) AS island FROM b),
run AS (SELECT scan, batch, items, CASE WHEN items = 0 THEN row_number() OVER (PARTITION BY scan, items = 0, island ORDER BY batch) ELSE 0 END AS empty_run FROM isl),
stop AS (SELECT scan, MIN(batch) AS batch FROM run WHERE empty_run >= {SCAN_EMPTY} GROUP BY scan),
kept AS (SELECT run.* FROM run LEFT JOIN stop USING (scan) WHERE stop.batch IS NULL OR run.batch <= stop.batch)
SELECT scan, 'batch' AS kind, batch, CAST(NULL AS INTEGER) AS chunk, CAST(items AS BIGINT) AS items, empty_run, CAST(NULL AS VARCHAR) AS note FROM kept
UNION ALL SELECT c.scan, 'skipped', c.batch, c.chunk, NULL, NULL, 'timeout' FROM c JOIN kept USING (scan, batch) WHERE c.failed
UNION ALL SELECT scan, 'stopped', batch, NULL, NULL, {SCAN_EMPTY}, NULL FROM stop
"""

ORACLES = {
    "stream_ingest": f"SELECT {', '.join(EVENT_COLS)} FROM events",
    "stream_feedback": source_oracles()["feedback_events"],
    "scan_stop": _SCAN_SQL,
}
