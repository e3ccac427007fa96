"""Micro fixtures with hand-computed answers: text cleaning, buckets, flags, popularity."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import clean_text
from tessera.operators import features as FT

CLEAN_CASES = [
    ("This &amp; that &mdash; testing", "This  that — testing"),
    ("Another &quot;test&quot; string", "Another test string"),
    ("a - b", "a  b"),
    ("  x\n\ty&nbsp;z ", "x y z"),
    ("&amp;copy; 1", "copy; 1"),
    ("&copy 2024", "© 2024"),
    ("\x1cA　B ", "A B"),
    (None, None),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CLEAN_CASES)], "i int, s string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_text("s").alias("c")).collect()}
    for i, (_, want) in enumerate(CLEAN_CASES):
        assert got[i] == want, (CLEAN_CASES[i], got[i])


def _one(spark, schema, rows, fn, col):
    df = spark.createDataFrame(rows, schema)
    return {r[0]: r[col] for r in fn(df).collect()}


def test_age_buckets(spark):
    rows = [(a,) for a in [8, 9, 12, 13, 16, 17, None]]
    got = _one(spark, "suggested_play_age int", rows, FT.bucket_age, "age_group")
    assert got == {8: "Kids", 9: "Family", 12: "Family", 13: "Teen", 16: "Teen", 17: "Adult"}


def test_duration_buckets(spark):
    rows = [(a,) for a in [0, 30, 31, 60, 120, 121, 2000, None]]
    got = _one(spark, "playing_time int", rows, FT.bucket_duration, "playing_time_group")
    assert got == {0: "Short", 30: "Short", 31: "Medium", 60: "Medium", 120: "Long", 121: "Very_Long",
                   2000: "Very_Long"}


def test_difficulty_buckets(spark):
    rows = [(a,) for a in [0.0, 1.0, 1.01, 2.0, 3.0, 4.0, 5.0, 5.1, float("nan"), None]]
    got = _one(spark, "avg_weight double", rows, FT.bucket_difficulty, "game_difficulty_group")
    assert got == {0.0: "Very Easy", 1.0: "Very Easy", 1.01: "Easy", 2.0: "Easy", 3.0: "Medium", 4.0: "Hard",
                   5.0: "Very_Hard"}


def test_range_flags(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 6), (3, 5), (1, 8), (None, 4)], "min_players int, max_players int")
    got = [tuple(r[c] for c in ["GROUP_SIZE_solo", "GROUP_SIZE_couple", "GROUP_SIZE_small", "GROUP_SIZE_party"])
           for r in FT.range_flags(df).collect()]
    assert got[:5] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 1, 0), (1, 1, 0, 1)]
    assert got[5][0] is None and got[5][3] == 0


def test_popularity(spark):
    df = spark.createDataFrame([(1000, 200, 800, 8.5), (500, 100, 400, 7.5)],
                               "owned_by int, wished_by int, num_rates int, avg_rating double")
    got = [r["popularity_score"] for r in FT.add_popularity_score(df).collect()]
    assert got[0] == pytest.approx(0.97) and got[1] == pytest.approx(0.55)


def test_popularity_zero_max_is_zero_contribution(spark):
    df = spark.createDataFrame([(0, 0, 0, 5.0)], "owned_by int, wished_by int, num_rates int, avg_rating double")
    assert FT.add_popularity_score(df).first()["popularity_score"] == pytest.approx(0.1)


def test_one_hot_list_and_scalar(spark):
    df = spark.createDataFrame([(["A", "B"], "x"), ([], "y"), (None, None)], "c array<string>, s string")
    out = FT.one_hot_encode(df, ["c", "s"], "P")
    assert sorted(c for c in out.columns if c.startswith("P_")) == ["P_a", "P_b", "P_x", "P_y"]
    rows = out.select("P_a", "P_b", "P_x", "P_y").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)]


def test_group_indicators_keeps_unmapped(spark):
    df = spark.createDataFrame([(1, 0, 1)], "`GAME_CAT_card game` int, GAME_CAT_dice int, GAME_CAT_medical int")
    out = FT.group_indicators(df)
    r = out.first()
    assert r["GAME_CAT_GROUP_card_game"] == 1 and r["GAME_CAT_GROUP_physical_components"] == 0
    assert r["GAME_CAT_medical"] == 1 and "GAME_CAT_dice" not in out.columns


def test_encode_mapping(spark):
    df = spark.createDataFrame([("No necessary in-game text",), ("Other",), (None,)], "l string")
    got = [r["l_encoded"] for r in FT.encode_mapping(df, "l").collect()]
    assert got == ["none", "Other"]


def test_feature_columns_order():
    cols = ["x", "GAME_DURATION_short", "AGE_GROUP_kids", "GAME_CAT_GROUP_horror", "LANGUAGE_DEPENDENCY_low"]
    assert FT.feature_columns(cols) == ["AGE_GROUP_kids", "GAME_CAT_GROUP_horror", "LANGUAGE_DEPENDENCY_low",
                                        "GAME_DURATION_short"]
    assert not math.isnan(1.0)
