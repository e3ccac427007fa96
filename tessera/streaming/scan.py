"""The stop rule of a resumable id scan, as a stateful streaming query.

A scan asks for consecutive batches of ids, each in a few chunks. What came back of each chunk is
landed as a report (scan, batch, chunk, items, error). The query follows every scan in batch order,
whatever the order in which reports arrive, and emits

* ``batch``: a batch whose chunks are all in, with its items and the run of empty batches it ends;
* ``skipped``: a chunk that failed (its items are missing; the batch goes on without them);
* ``stopped``: the batch after which a scan ended, once ``max_empty`` batches in a row were empty.

Reports beyond the end are dropped. State per scan: the next batch, the run, and the reports that
wait for an earlier one, so its size is that of the reordering. The checkpoint holds it across restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import constants as C

REPORT_SCHEMA = "scan string, batch long, chunk int, items long, error string"
OUTCOME_SCHEMA = "scan string, kind string, batch long, chunk int, items long, empty_run long, note string"
_STATE_SCHEMA = "next long, run long, stopped boolean, waiting string"


class ScanState:
    """Where a scan stands: plain values, so that the rule can be tested without a stream."""

    def __init__(self, chunks: int, max_empty: int, next: int = 0, run: int = 0, stopped: bool = False, waiting: dict | None = None):
        self.chunks, self.max_empty = chunks, max_empty
        self.next, self.run, self.stopped, self.waiting = next, run, stopped, waiting or {}

    def report(self, batch: int, chunk: int, items: int | None, error: str | None) -> None:
        """Note a chunk's report; a repeated one replaces the first, one of a finished batch is dropped."""
        if not self.stopped and batch >= self.next:
            self.waiting.setdefault(batch, {})[chunk] = (items or 0, error)

    def advance(self) -> Iterator[tuple]:
        """Outcomes (kind, batch, chunk, items, empty_run, note) of the batches that are complete and next."""
        while not self.stopped and len(self.waiting.get(self.next, ())) >= self.chunks:
            chunks = self.waiting.pop(self.next)
            failed = {c: e for c, (_, e) in sorted(chunks.items()) if e is not None}
            items = sum(n for c, (n, _) in chunks.items() if c not in failed)
            self.run = 0 if items else self.run + 1
            for chunk, error in failed.items():
                yield "skipped", self.next, chunk, None, None, error
            yield "batch", self.next, None, items, self.run, None
            if self.run >= self.max_empty:
                self.stopped, self.waiting = True, {}
                yield "stopped", self.next, None, None, self.run, None
            self.next += 1


def _follow(chunks: int, max_empty: int, first_batch: int):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan = ScanState(chunks, max_empty, first_batch)
        if state.exists:
            at, run, stopped, waiting = state.get
            held = {int(b): {int(c): tuple(v) for c, v in cs.items()} for b, cs in json.loads(waiting).items()}
            scan = ScanState(chunks, max_empty, at, run, stopped, held)
        for frame in frames:
            for r in frame.itertuples(index=False):
                if pd.isna(r.batch) or pd.isna(r.chunk):
                    continue
                scan.report(int(r.batch), int(r.chunk), None if pd.isna(r.items) else int(r.items), None if pd.isna(r.error) else r.error)
        rows = [(key[0], *outcome) for outcome in scan.advance()]
        state.update((scan.next, scan.run, scan.stopped, json.dumps(scan.waiting)))
        if rows:
            out = pd.DataFrame(rows, columns=["scan", "kind", "batch", "chunk", "items", "empty_run", "note"])
            yield out.astype({"chunk": "Int32", "items": "Int64", "empty_run": "Int64"})

    return run


def scan_outcomes(reports: DataFrame, chunks: int, max_empty: int = C.MAX_CONSECUTIVE_EMPTY, first_batch: int = 0) -> DataFrame:
    """Outcomes of a stream of chunk reports, keyed by scan."""
    return reports.groupBy("scan").applyInPandasWithState(
        _follow(chunks, max_empty, first_batch), OUTCOME_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def follow_scans(spark: SparkSession, landing: str, sink: str, checkpoint: str, chunks: int, max_empty: int = C.MAX_CONSECUTIVE_EMPTY,
                 first_batch: int = 0, max_files_per_trigger: int = 4) -> None:
    """Drain the landed reports that the checkpoint has not seen into the outcome sink."""
    reports = spark.readStream.schema(REPORT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(landing)
    q = (scan_outcomes(reports, chunks, max_empty, first_batch).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def read_items_up_to_stop(items: DataFrame, outcomes: DataFrame, batch: str = "batch") -> DataFrame:
    """The items of batches that their scan read (equi-join on scan and batch)."""
    read = outcomes.filter(F.col("kind") == "batch").select("scan", F.col("batch").alias(batch))
    return items.join(read, ["scan", batch], "left_semi")
