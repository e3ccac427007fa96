"""Property tests: bucket rules and min-max normalisation against plain-Python models."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.scores import minmax
from tessera.operators.features import bucket_column


def py_bucket(v, bounds, open_label):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return open_label if (open_label and isinstance(v, float) and math.isnan(v)) else C.UNKNOWN_BUCKET
    for b, lbl in bounds:
        if v <= b:
            return lbl
    return open_label or C.UNKNOWN_BUCKET


values = st.lists(st.one_of(st.none(), st.floats(min_value=-5, max_value=200, allow_nan=False),
                            st.just(float("nan"))), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values)
def test_buckets_match_python(spark, vals):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    for bounds, open_label in [(C.AGE_BUCKETS, C.AGE_OPEN_LABEL), (C.DIFFICULTY_BUCKETS, None)]:
        got = {r["i"]: r["b"] for r in df.select("i", bucket_column(F.col("v"), bounds, open_label).alias("b")).collect()}
        for i, v in enumerate(vals):
            assert got[i] == py_bucket(v, bounds, open_label), (v, got[i])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=30))
def test_minmax_in_unit_interval(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    mm = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = [r[0] for r in df.crossJoin(mm).select(minmax(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert all(0.0 <= x <= 1.0 for x in out)
    if len(set(vals)) == 1:
        assert all(x == 1.0 for x in out)


def test_baskets_are_dealt_by_their_bytes_and_moved_once(spark, monkeypatch):
    from tessera.operators import binning

    rows = spark.range(400).select((F.col("id") % 40).alias("basket"), (F.col("id") % 200).alias("game_id"), F.lit("n").alias("game_name"), *[(F.col("id") % m == 0).cast("int").alias(f"f{m}") for m in (2, 3, 5)])
    few = binning.basket_bins(rows, ["f2", "f3", "f5"])
    monkeypatch.setattr(binning, "TASK_BYTES", 1_000)
    many = binning.basket_bins(rows, ["f2", "f3", "f5"])
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(basket" in plan and ", 36)" in plan
    assert few.agg(F.sum("size")).first()[0] == 200  # equal (basket, item) rows count once
    key = lambda df: sorted((r.basket, r.bin_id, r.members, r.centroid) for r in df.collect())
    assert key(few) == key(many)
