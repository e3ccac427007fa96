"""The derived ``games`` item table over the driver's star schema.

``part`` supplies one item per part key; ``lineitem`` aggregated per part supplies the
rating counts. Integer arithmetic first and at most one division by 10, so the Spark
plan and the DuckDB oracle agree bit for bit.

Plan at scale: lineitem is aggregated by ``l_partkey`` with a map-side partial aggregate
(the distinct-supplier count adds one expand + partial stage, no extra shuffle key), then
joined to ``part`` on the same key — the aggregate's output partitioning is reused, so
only ``part`` is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import LANGUAGE_DEPENDENCY_MAPPING
from tessera.sources.tables import read_table

# FIXED VALUES of the derivation (FIXTURES §3): part type -> category, size % 5 -> category
TYPE_CATEGORY = [
    ("ECONOMY", "Card Game"),
    ("STANDARD", "Dice"),
    ("MEDIUM", "Fantasy"),
    ("SMALL", "Economic"),
    ("PROMO", "Trivia"),
    ("LARGE", "Medical"),
]
SIZE_CATEGORY = ["Horror", "Bluffing", "Puzzle", "Animals", None]
UNMAPPED_LANGUAGE = "Unspecified"


def _case(col: Column, pairs) -> Column:
    out = None
    for key, value in pairs:
        cond = col == F.lit(key)
        val = F.lit(value) if value is not None else F.lit(None).cast("string")
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def games_from(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    stats = lineitem.groupBy(F.col("l_partkey")).agg(
        F.count(F.lit(1)).cast("int").alias("cnt"),
        F.sum("l_quantity").cast("int").alias("q"),
        F.countDistinct("l_suppkey").cast("int").alias("ns"),
    )
    p = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = p.join(stats, p.p_partkey == stats.l_partkey, "left")
    k = F.col("p_partkey")
    cnt = F.coalesce(F.col("cnt"), F.lit(0))
    q = F.coalesce(F.col("q"), F.lit(0))
    ns = F.coalesce(F.col("ns"), F.lit(0))
    size = F.col("p_size")

    name = (
        F.when(k % 50 == 1, F.col("p_name"))
        .when(k % 4 == 0, F.concat(F.col("p_name"), F.lit(": "), F.col("p_brand"), F.lit(" "), k.cast("string")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), k.cast("string")))
    )
    min_players = (F.lit(1) + k % 4).cast("int")
    type_cat = _case(F.col("p_type"), TYPE_CATEGORY)
    size_cat = _case(size % 5, list(enumerate(SIZE_CATEGORY)))
    categories = F.when(k % 37 == 0, F.array().cast("array<string>")).otherwise(
        F.filter(F.array(type_cat, size_cat), lambda x: x.isNotNull())
    )
    phrases = list(LANGUAGE_DEPENDENCY_MAPPING.keys())
    language = _case(size % 7, list(enumerate(phrases + [UNMAPPED_LANGUAGE, None])))

    return j.select(
        k.alias("game_id"),
        name.alias("game_name"),
        min_players.alias("min_players"),
        (min_players + size % 6).cast("int").alias("max_players"),
        F.when(k % 29 == 0, F.lit(None)).otherwise(F.lit(4) + size % 18).cast("int").alias("suggested_play_age"),
        F.when(k % 31 == 0, F.lit(None)).otherwise(F.lit(5) * (F.lit(1) + size)).cast("int").alias("playing_time"),
        (((cnt * 7 + k) % 53) / F.lit(10.0)).cast("double").alias("avg_weight"),
        (F.lit(5.0) + ((k * 37 + cnt) % 50) / F.lit(10.0)).cast("double").alias("avg_rating"),
        cnt.cast("int").alias("num_rates"),
        q.cast("int").alias("owned_by"),
        ns.cast("int").alias("wished_by"),
        categories.alias("categories"),
        language.alias("language_dependence_description"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games_from(read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem"))


def _sql_case(expr: str, pairs) -> str:
    arms = " ".join(
        f"WHEN {expr} = {k!r} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        if isinstance(k, str)
        else f"WHEN {expr} = {k} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for k, v in pairs
    )
    return f"(CASE {arms} END)"


def games_sql() -> str:
    """DuckDB text of the same view (used by the oracle queries as a CTE body)."""
    phrases = list(LANGUAGE_DEPENDENCY_MAPPING.keys())
    type_cat = _sql_case("p.p_type", TYPE_CATEGORY)
    size_cat = _sql_case("p.p_size % 5", list(enumerate(SIZE_CATEGORY)))
    lang = _sql_case("p.p_size % 7", list(enumerate(phrases + [UNMAPPED_LANGUAGE, None])))
    return f"""
SELECT
  p.p_partkey AS game_id,
  CASE WHEN p.p_partkey % 50 = 1 THEN p.p_name
       WHEN p.p_partkey % 4 = 0 THEN p.p_name || ': ' || p.p_brand || ' ' || CAST(p.p_partkey AS VARCHAR)
       ELSE p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR) END AS game_name,
  CAST(1 + p.p_partkey % 4 AS INTEGER) AS min_players,
  CAST(1 + p.p_partkey % 4 + p.p_size % 6 AS INTEGER) AS max_players,
  CAST(CASE WHEN p.p_partkey % 29 = 0 THEN NULL ELSE 4 + p.p_size % 18 END AS INTEGER) AS suggested_play_age,
  CAST(CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE 5 * (1 + p.p_size) END AS INTEGER) AS playing_time,
  CAST(((COALESCE(s.cnt, 0) * 7 + p.p_partkey) % 53) / 10.0 AS DOUBLE) AS avg_weight,
  CAST(5.0 + ((p.p_partkey * 37 + COALESCE(s.cnt, 0)) % 50) / 10.0 AS DOUBLE) AS avg_rating,
  CAST(COALESCE(s.cnt, 0) AS INTEGER) AS num_rates,
  CAST(COALESCE(s.q, 0) AS INTEGER) AS owned_by,
  CAST(COALESCE(s.ns, 0) AS INTEGER) AS wished_by,
  CASE WHEN p.p_partkey % 37 = 0 THEN CAST([] AS VARCHAR[])
       ELSE list_filter([{type_cat}, {size_cat}], lambda x: x IS NOT NULL) END AS categories,
  {lang} AS language_dependence_description
FROM part p
LEFT JOIN (
  SELECT l_partkey, COUNT(*) AS cnt, CAST(SUM(l_quantity) AS INTEGER) AS q,
         COUNT(DISTINCT l_suppkey) AS ns
  FROM lineitem GROUP BY l_partkey
) s ON p.p_partkey = s.l_partkey
"""
