"""Registered queries for snapshot sources/sinks and the feedback log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.plans.games import games, games_sql
from tessera.sources import feedback as FB
from tessera.sources import snapshots as SN
from tessera.sources.tables import read_table
from tessera.session import shared_path

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
UNDATED = "undated"


def land_order_snapshots(spark: SparkSession, sf: str) -> tuple[str, list[tuple[int, str]]]:
    """Orders split by year into dated snapshots (date = the year's last order date), plus one
    undated snapshot holding the first year again. Returns (root, [(year, yyyymmdd)])."""
    orders = read_table(spark, sf, "orders").select(*ORDER_COLS)
    years = (orders.groupBy(F.year("o_orderdate").alias("y"))
             .agg(F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("d")).orderBy("y").collect())
    root = shared_path(spark, "raw-snapshots")
    # half as datasets, half (the newest among them) as the plain files that other tools write
    for r in years:  # one write per year: the number of years is bounded by the calendar
        SN.write_snapshot(orders.filter(F.year("o_orderdate") == r["y"]), root, "orders", r["d"],
                          single_file=(years[-1]["y"] - r["y"]) % 2 == 0)
    SN.write_snapshot(orders.filter(F.year("o_orderdate") == years[0]["y"]), root, "orders", UNDATED)
    return root, [(r["y"], r["d"]) for r in years]


def latest_snapshot(spark, sf):
    root, _ = land_order_snapshots(spark, sf)
    return SN.read_latest(spark, root).select(*ORDER_COLS)


def snapshot_staleness(spark, sf):
    root, years = land_order_snapshots(spark, sf)
    latest = max(d for _, d in years)
    as_of = F.date_add(F.to_date(F.lit(latest), "yyyyMMdd"), C.STALE_AFTER_DAYS)
    return SN.staleness(spark, root, as_of)


def snapshot_presence(spark, sf):
    raw, _ = land_order_snapshots(spark, sf)
    prep = shared_path(spark, "prep-snapshots")
    g = games(spark, sf)
    SN.write_snapshot(g.select("game_id", "game_name"), prep, "game_data", "20240101")
    return SN.presence(spark, {"raw": raw, "prep": prep, "model": shared_path(spark, "model-missing")})


def snapshot_roundtrip(spark, sf):
    """Partitioned snapshots, the newest partition written twice: dynamic overwrite keeps one copy."""
    orders = read_table(spark, sf, "orders").select(*ORDER_COLS)
    # one row per calendar year: a bounded broadcast side
    ends = orders.groupBy(F.year("o_orderdate").alias("y")).agg(
        F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("snapshot_date"))
    snap = orders.join(F.broadcast(ends), F.year("o_orderdate") == F.col("y")).drop("y")
    root = shared_path(spark, "partitioned-snapshots")
    SN.write_partitioned(snap, root)
    newest = snap.agg(F.max("snapshot_date")).first()[0]
    SN.write_partitioned(snap.filter(F.col("snapshot_date") == newest), root)
    back = spark.read.option("basePath", root).parquet(root)
    return back.groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def union_snapshots(spark, sf):
    root, _ = land_order_snapshots(spark, sf)
    return SN.union_snapshots(spark, root).select(*ORDER_COLS)


def union_newest_wins(spark, sf):
    """Every order once: the first year also lies in the undated snapshot, whose copies lose."""
    root, _ = land_order_snapshots(spark, sf)
    u = SN.union_snapshots(spark, root, newest_wins=["o_orderkey"])
    return u.select(*ORDER_COLS)


def list_names(spark, sf):
    return games(spark, sf).select("game_name")


# ------------------------------------------------------------------ feedback
def feedback_json(spark: SparkSession, sf: str) -> DataFrame:
    """Client feedback events derived from the event stream: purchase -> like, error ->
    dislike (no reason chosen -> the client's default); empty comment omitted."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error"))
    like = F.col("event_type") == "purchase"
    rec = F.struct(
        # some clients leave the fraction out
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", FB.ISO_MILLIS)).alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("input_game"),
        F.concat(F.lit("item_"), F.get_json_object("props", "$.k")).alias("recommended_game"),
        F.when(like, F.lit("like")).otherwise(F.lit("dislike")).alias("feedback"),
        F.when(~like, F.lit("No reason provided")).alias("reason"),
        F.when(~like & (F.col("event_id") % 2 == 0),
               F.concat(F.lit("  user "), F.col("user_id").cast("string"), F.lit('\n"quoted", \\ end '))).alias("comment"),
    )
    return ev.select("event_type", F.to_json(rec).alias("value"))


def feedback_events(spark, sf):
    return FB.feedback_frame(feedback_json(spark, sf))


def feedback_rejects(spark, sf):
    """Records that are no valid event, kept with what they lack."""
    ev = read_table(spark, sf, "events").filter(~F.col("event_type").isin("purchase", "error"))
    bad = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{bad "), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit('{"timestamp":"t","input_game":"user_'), F.col("user_id").cast("string"), F.lit('","recommended_game":"r"}')))
    landed = feedback_json(spark, sf).select("value").unionByName(ev.select(bad.alias("value")))
    return FB.feedback_rejects(landed)


def feedback_append(spark, sf):
    j = feedback_json(spark, sf)
    old = FB.feedback_frame(j.filter(F.col("event_type") == "purchase")).select(
        "timestamp", "input_game", "recommended_game", "feedback")  # log written before the optional columns
    new = FB.feedback_frame(j.filter(F.col("event_type") == "error")).select(*C.FEEDBACK_COLUMNS)
    return FB.append_log(old, new).select(*C.FEEDBACK_COLUMNS)


def feedback_csv_roundtrip(spark, sf):
    j = feedback_json(spark, sf)
    path = shared_path(spark, "feedback-log")
    FB.write_csv_log(FB.feedback_frame(j.filter(F.col("event_type") == "purchase")), path, "overwrite")
    FB.write_csv_log(FB.feedback_frame(j.filter(F.col("event_type") == "error")), path, "append")
    return FB.read_csv_log(spark, path)


QUERIES = {
    "latest_snapshot": latest_snapshot,
    "snapshot_staleness": snapshot_staleness,
    "snapshot_presence": snapshot_presence,
    "snapshot_roundtrip": snapshot_roundtrip,
    "union_snapshots": union_snapshots,
    "list_names": list_names,
    "feedback_events": feedback_events,
    "feedback_append": feedback_append,
    "feedback_rejects": feedback_rejects,
    "union_newest_wins": union_newest_wins,
    "feedback_csv_roundtrip": feedback_csv_roundtrip,
}


def _oracles() -> dict[str, str]:
    cols = ", ".join(ORDER_COLS)
    yrs = ("yrs AS (SELECT year(o_orderdate) AS y, strftime(max(o_orderdate), '%Y%m%d') AS d FROM orders GROUP BY 1)")
    fb = ("fb AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE "
          "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS timestamp, "
          "'user_' || CAST(user_id AS VARCHAR) AS input_game, 'item_' || json_extract_string(props, '$.k') "
          "AS recommended_game, CASE WHEN event_type = 'purchase' THEN 'like' ELSE 'dislike' END AS feedback, "
          "CASE WHEN event_type <> 'purchase' THEN 'No reason provided' END AS reason, "
          "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '  user ' || CAST(user_id AS VARCHAR) || chr(10) || "
          "'\"quoted\", \\ end ' END AS comment, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE "
          "date_trunc('millisecond', ts) END AS event_time FROM events WHERE event_type IN ('purchase', 'error'))")
    six = ", ".join(C.FEEDBACK_COLUMNS)
    return {
        "latest_snapshot": f"SELECT {cols} FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)",
        "snapshot_staleness": (
            f"WITH {yrs}, mx AS (SELECT max(strptime(d, '%Y%m%d')) AS m FROM yrs) "
            "SELECT 'orders_' || d || '.parquet' AS name, CAST(strptime(d, '%Y%m%d') AS DATE) AS snapshot_date, "
            f"date_diff('day', CAST(strptime(d, '%Y%m%d') AS DATE), CAST(m AS DATE) + {C.STALE_AFTER_DAYS}) > "
            f"{C.STALE_AFTER_DAYS} AS stale FROM yrs, mx "
            f"UNION ALL SELECT 'orders_{UNDATED}.parquet', NULL, false"),
        "snapshot_presence": (
            f"WITH {yrs} SELECT 'raw' AS stage, COUNT(*) + 1 AS n_snapshots, false AS is_empty FROM yrs "
            "UNION ALL SELECT 'prep', 1, false UNION ALL SELECT 'model', 0, true"),
        "snapshot_roundtrip": (
            f"WITH {yrs} SELECT d AS snapshot_date, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total "
            "FROM orders JOIN yrs ON yrs.y = year(o_orderdate) GROUP BY d"),
        "union_snapshots": (
            f"SELECT {cols} FROM orders UNION ALL SELECT {cols} FROM orders "
            "WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)"),
        "union_newest_wins": f"SELECT {cols} FROM orders",
        "feedback_rejects": (
            "SELECT CASE WHEN event_id % 2 = 0 THEN '{bad ' || event_id ELSE '{\"timestamp\":\"t\",\"input_game\":\"user_' || user_id || "
            "'\",\"recommended_game\":\"r\"}' END AS raw, CASE WHEN event_id % 2 = 0 THEN "
            "'timestamp,input_game,recommended_game,feedback' ELSE 'feedback' END AS missing "
            "FROM events WHERE event_type NOT IN ('purchase', 'error')"),
        "list_names": f"WITH games AS ({games_sql()}) SELECT game_name FROM games",
        "feedback_events": f"WITH {fb} SELECT {six}, event_time FROM fb",
        "feedback_append": f"WITH {fb} SELECT {six} FROM fb",
        "feedback_csv_roundtrip": f"WITH {fb} SELECT {six} FROM fb",
    }


ORACLES = _oracles()
