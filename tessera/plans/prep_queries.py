"""Registered queries for feature preparation (Spark side + DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import features as FT
from tessera.plans.games import games
from tessera.plans import sqlgen as S
from tessera.session import cut_lineage

ROUND = 6


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the item table feeds two passes (vocabularies, then the projection): materialise it once
    # instead of aggregating the line items twice
    return FT.prepare_features(cut_lineage(games(spark, sf_dir)))


def _q(name):
    return f"`{name}`"


# ------------------------------------------------------------------ spark side
def quality_filter(spark, sf):
    return FT.quality_filter(games(spark, sf)).select("game_id", "game_name", "num_rates", "avg_rating")


def popularity_score(spark, sf):
    df = FT.add_popularity_score(FT.quality_filter(games(spark, sf)))
    return df.select("game_id", "popularity_score")


def bucket_age(spark, sf):
    return FT.bucket_age(games(spark, sf)).select("game_id", "suggested_play_age", "age_group")


def bucket_duration(spark, sf):
    return FT.bucket_duration(games(spark, sf)).select("game_id", "playing_time", "playing_time_group")


def bucket_difficulty(spark, sf):
    return FT.bucket_difficulty(games(spark, sf)).select("game_id", "avg_weight", "game_difficulty_group")


def range_flags(spark, sf):
    df = FT.range_flags(games(spark, sf))
    return df.select("game_id", "min_players", "max_players", *[c for c in df.columns if c.startswith("GROUP_SIZE_")])


def one_hot_scalar(spark, sf):
    df = FT.one_hot_encode(FT.bucket_age(games(spark, sf)), ["age_group"], C.AGE_PREFIX)
    return df.select("game_id", *[_q(c) for c in df.columns if c.startswith(C.AGE_PREFIX + "_")])


def one_hot_long(spark, sf):
    """Categories in long form: no vocabulary, no cap."""
    return FT.one_hot_long(games(spark, sf), "game_id", ["categories"], C.CATEGORY_PREFIX)


def one_hot_list(spark, sf):
    df = FT.one_hot_encode(games(spark, sf), ["categories"], C.CATEGORY_PREFIX)
    return df.select("game_id", *[_q(c) for c in df.columns if c.startswith(C.CATEGORY_PREFIX + "_")])


MULTI_PREFIX = "LEVEL"


def one_hot_multi(spark, sf):
    df = FT.bucket_difficulty(FT.bucket_duration(games(spark, sf)))
    df = FT.one_hot_encode(df, ["playing_time_group", "game_difficulty_group"], MULTI_PREFIX)
    return df.select("game_id", *[_q(c) for c in df.columns if c.startswith(MULTI_PREFIX + "_")])


def distinct_vocab(spark, sf):
    return FT.distinct_values(games(spark, sf), ["categories", "language_dependence_description"])


def group_indicators(spark, sf):
    df = FT.group_indicators(FT.one_hot_encode(games(spark, sf), ["categories"], C.CATEGORY_PREFIX))
    return df.select("game_id", *[_q(c) for c in df.columns if c.startswith(C.CATEGORY_PREFIX + "_")])


def encode_mapping(spark, sf):
    df = FT.encode_mapping(games(spark, sf), "language_dependence_description")
    return df.select("game_id", "language_dependence_description_encoded")


def feature_columns(spark, sf):
    df = prepared(spark, sf)
    return df.select("game_id", *[_q(c) for c in FT.feature_columns(df)])


def prepare_features(spark, sf):
    df = prepared(spark, sf)
    return df.drop("categories")


QUERIES = {
    "quality_filter": quality_filter,
    "popularity_score": popularity_score,
    "bucket_age": bucket_age,
    "bucket_duration": bucket_duration,
    "bucket_difficulty": bucket_difficulty,
    "range_flags": range_flags,
    "one_hot_scalar": one_hot_scalar,
    "one_hot_list": one_hot_list,
    "one_hot_long": one_hot_long,
    "one_hot_multi": one_hot_multi,
    "distinct_vocab": distinct_vocab,
    "group_indicators": group_indicators,
    "encode_mapping": encode_mapping,
    "feature_columns": feature_columns,
    "prepare_features": prepare_features,
}


# ------------------------------------------------------------------ oracle side
def _oracles() -> dict[str, str]:
    g = f"WITH games AS ({S.games_sql()})"
    age = S.bucket_sql("suggested_play_age", C.AGE_BUCKETS, C.AGE_OPEN_LABEL)
    dur = S.bucket_sql("playing_time", C.DURATION_BUCKETS, C.DURATION_OPEN_LABEL)
    dif = S.bucket_sql("avg_weight", C.DIFFICULTY_BUCKETS, C.DIFFICULTY_OPEN_LABEL)
    cols = lambda pairs: ", ".join(f"{e} AS {S.ident(n)}" for n, e in pairs)
    multi_vals = sorted(set(S.DURATION_VALUES) | set(S.DIFFICULTY_VALUES))
    multi = []
    for v in multi_vals:
        e = (f"CAST(COALESCE(playing_time_group = {S.q(v)}, false) OR "
             f"COALESCE(game_difficulty_group = {S.q(v)}, false) AS INTEGER)")
        multi.append((f"{MULTI_PREFIX}_{v.lower()}", e))
    groups, unmapped = S.category_group_flags()
    feature_sel = ", ".join(S.ident(n) for n in S.feature_names_in_order())
    prepared_cols = (
        "game_id, game_name, min_players, max_players, suggested_play_age, playing_time, avg_weight, "
        "avg_rating, num_rates, owned_by, wished_by, language_dependence_description, popularity_score, "
        "age_group, playing_time_group, game_difficulty_group, language_dependence_description_encoded, "
        "GROUP_SIZE_solo, GROUP_SIZE_couple, GROUP_SIZE_small, GROUP_SIZE_party, "
        + ", ".join(S.ident(n) for n, _ in S.feature_flag_columns())
    )
    return {
        "quality_filter": f"{g} SELECT game_id, game_name, num_rates, avg_rating FROM games "
                          f"WHERE num_rates >= {C.MIN_NUM_RATES} AND avg_rating >= {C.MIN_AVG_RATING}",
        "popularity_score": f"WITH {S.prepared_ctes()} SELECT game_id, popularity_score FROM scored",
        "bucket_age": f"{g} SELECT * FROM (SELECT game_id, suggested_play_age, {age} AS age_group FROM games) "
                      "WHERE age_group <> 'Unknown'",
        "bucket_duration": f"{g} SELECT * FROM (SELECT game_id, playing_time, {dur} AS playing_time_group "
                           "FROM games) WHERE playing_time_group <> 'Unknown'",
        "bucket_difficulty": f"{g} SELECT * FROM (SELECT game_id, avg_weight, {dif} AS game_difficulty_group "
                             "FROM games) WHERE game_difficulty_group <> 'Unknown'",
        "range_flags": f"{g} SELECT game_id, min_players, max_players, "
                       "CAST(min_players <= 1 AS INTEGER) AS GROUP_SIZE_solo, "
                       "CAST(min_players <= 2 AND max_players >= 2 AS INTEGER) AS GROUP_SIZE_couple, "
                       "CAST(min_players >= 3 AND max_players <= 5 AS INTEGER) AS GROUP_SIZE_small, "
                       "CAST(max_players >= 6 AS INTEGER) AS GROUP_SIZE_party FROM games",
        "one_hot_scalar": f"{g}, a AS (SELECT game_id, {age} AS age_group FROM games) SELECT game_id, "
                          + cols(S.scalar_flags("age_group", C.AGE_PREFIX, S.AGE_VALUES))
                          + " FROM a WHERE age_group <> 'Unknown'",
        "one_hot_long": f"{g} SELECT DISTINCT game_id, '{C.CATEGORY_PREFIX}_' || lower(c) AS feature FROM "
                        "(SELECT game_id, unnest(categories) AS c FROM games) WHERE c IS NOT NULL",
        "one_hot_list": f"{g} SELECT game_id, "
                        + cols(S.list_flags("categories", C.CATEGORY_PREFIX, S.CATEGORY_VALUES)) + " FROM games",
        "one_hot_multi": f"{g}, a AS (SELECT game_id, {dur} AS playing_time_group, {dif} AS game_difficulty_group "
                         "FROM games) SELECT game_id, " + cols(multi)
                         + " FROM a WHERE playing_time_group <> 'Unknown' AND game_difficulty_group <> 'Unknown'",
        "distinct_vocab": f"{g} SELECT DISTINCT value FROM (SELECT unnest(categories) AS value FROM games "
                          "UNION ALL SELECT language_dependence_description FROM games) WHERE value IS NOT NULL",
        "group_indicators": f"{g} SELECT game_id, " + cols(unmapped + groups) + " FROM games",
        "encode_mapping": f"{g} SELECT game_id, {S.language_encoded_sql()} AS language_dependence_description_encoded "
                          "FROM games WHERE language_dependence_description IS NOT NULL",
        "feature_columns": f"WITH {S.prepared_ctes()} SELECT game_id, {feature_sel} FROM prepared",
        "prepare_features": f"WITH {S.prepared_ctes()} SELECT {prepared_cols} FROM prepared",
    }


ORACLES = _oracles()
