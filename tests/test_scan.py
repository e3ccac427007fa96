"""The stop rule of the id scan: as plain state against a loop, and as a resumed stream."""

import random

import pytest

from tessera.streaming import scan as SC


def loop(reports, chunks, max_empty):
    """Batch after batch: reports[batch] = list of item counts, None for a failed chunk."""
    out, run = [], 0
    for batch, parts in enumerate(reports):
        out += [("skipped", batch, c, None, None, "x") for c, n in enumerate(parts) if n is None]
        items = sum(n or 0 for n in parts)
        run = 0 if items else run + 1
        out.append(("batch", batch, None, items, run, None))
        if run >= max_empty:
            return [*out, ("stopped", batch, None, None, run, None)]
    return out


def scans(seed, n=60, chunks=3):
    rnd = random.Random(seed)
    return [[rnd.choice([0, 0, 0, 0, 0, 2, None]) for _ in range(chunks)] for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_any_order_of_reports(seed):
    reports, rnd = scans(seed), random.Random(seed)
    flat = [(b, c, n) for b, parts in enumerate(reports) for c, n in enumerate(parts)]
    rnd.shuffle(flat)
    state, got = SC.ScanState(3, 4), []
    for b, c, n in flat + flat[:20]:  # some twice
        state.report(b, c, n, None if n is not None else "x")
        got += state.advance()
    assert got == loop(reports, 3, 4)
    assert not state.waiting or not state.stopped


def test_stream_resumes(spark, tmp_path):
    rows, want = [], []
    for k, name in enumerate("pq"):
        reports = scans(k + 10)
        want += [(name, *o) for o in loop(reports, 3, 4)]
        rows += [(name, b, c, n, None if n is not None else "x") for b, parts in enumerate(reports) for c, n in enumerate(parts)]
    rows.append((None, None, None, None, None))
    random.Random(1).shuffle(rows)
    landing, sink, ckpt = (str(tmp_path / d) for d in ("landing", "sink", "ckpt"))
    for drop in (rows[::2], rows[1::2]):
        spark.createDataFrame(drop, SC.REPORT_SCHEMA).repartition(3).write.mode("append").parquet(landing)
        SC.follow_scans(spark, landing, sink, ckpt, 3, 4, max_files_per_trigger=1)
    got = spark.read.schema(SC.OUTCOME_SCHEMA).parquet(sink)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    items = spark.createDataFrame([("p", 0, 1), ("p", 59, 2), ("q", 1, 3)], "scan string, batch long, id int")
    last = {name: max(b for s, k, b, *_ in want if s == name and k == "batch") for name in "pq"}
    kept = {r.id for r in SC.read_items_up_to_stop(items, got).collect()}
    assert kept == {i for s, b, i in [("p", 0, 1), ("p", 59, 2), ("q", 1, 3)] if b <= last[s]}
