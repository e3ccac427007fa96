"""Dated snapshots under one folder: plain ``<base>_<YYYYMMDD>.parquet`` files, or datasets
(folders) of that name.

Listing uses the ``binaryFile`` source with only the ``path`` column selected (no file
contents are read), so picking the latest snapshot touches metadata only; the chosen
snapshot is then scanned alone — the file-name equivalent of partition pruning. For
partitioned layouts (``snapshot_date=YYYYMMDD``) the same choice is a partition filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.session import hadoop_fs, path_exists

def snapshot_token(name: Column) -> Column:
    """Token after the last ``_`` and before the first ``.`` of a snapshot name."""
    return F.split_part(F.split_part(name, F.lit("_"), F.lit(-1)), F.lit("."), F.lit(1))


def snapshot_date(name: Column, fmt: str = C.SNAPSHOT_DATE_FORMAT) -> Column:
    """Parsed date of the name's token; unparsable names give null (never raise)."""
    tok = snapshot_token(name)
    ok = tok.rlike("^[0-9]{8}$")
    return F.when(ok, F.try_to_timestamp(tok, F.lit(fmt)).cast("date"))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row per snapshot dataset under ``root``: name, path, snapshot_date (null if undated)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(root).select("path"))
    folder = F.regexp_extract(F.col("path"), r"^(.*)/[^/]+$", 1)
    dataset = F.when(folder.rlike(r"\.parquet$"), folder).otherwise(F.col("path"))
    snaps = files.select(dataset.alias("path")).distinct()
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    return snaps.select(name.alias("name"), "path").withColumn("snapshot_date", snapshot_date(F.col("name")))


def latest_snapshot_name(spark: SparkSession, root: str) -> DataFrame:
    """1-row relation: the dated snapshot with the greatest (date, name)."""
    s = list_snapshots(spark, root).filter(F.col("snapshot_date").isNotNull())
    return s.agg(F.max(F.struct("snapshot_date", "name", "path")).alias("m")).select("m.*")


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    row = latest_snapshot_name(spark, root).first()
    if row is None or row["path"] is None:
        raise ValueError(f"No valid dated files found in {root}")
    return spark.read.parquet(row["path"])


def staleness(spark: SparkSession, root: str, as_of: Column, days: int = C.STALE_AFTER_DAYS) -> DataFrame:
    """Per snapshot: stale = (as_of - date) > days, strictly; undated names are not stale."""
    s = list_snapshots(spark, root)
    return s.select("name", "snapshot_date",
                    F.coalesce(F.datediff(as_of, F.col("snapshot_date")) > F.lit(days), F.lit(False)).alias("stale"))


def presence(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Per stage: number of entries (files or datasets) in its folder and whether it is empty or missing.

    Only a folder that does not exist counts as missing; an unreadable one raises."""
    listing = spark.createDataFrame([], "stage string, entry string")
    for stage, root in roots.items():
        if not path_exists(spark, root):
            continue
        fs, path = hadoop_fs(spark, root)
        top = fs.makeQualified(path).toString().rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        inside = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(top) + 2), F.length("path"))
        listing = listing.unionByName(files.select(F.lit(stage).alias("stage"), F.split_part(inside, F.lit("/"), F.lit(1)).alias("entry")).distinct())
    expected = spark.createDataFrame([(s,) for s in roots], "stage string")
    counts = listing.groupBy("stage").agg(F.count(F.lit(1)).alias("n_snapshots"))
    return expected.join(counts, "stage", "left").select(
        "stage", F.coalesce(F.col("n_snapshots"), F.lit(0)).alias("n_snapshots"),
        (F.coalesce(F.col("n_snapshots"), F.lit(0)) == 0).alias("is_empty"))


def write_snapshot(df: DataFrame, root: str, base: str, date_str: str, mode: str = "overwrite",
                   single_file: bool = False) -> str:
    """Write one dated snapshot; the same day is overwritten. ``single_file`` leaves a plain file
    (for snapshots small enough for one task) where other tools expect one."""
    path = f"{root.rstrip('/')}/{base}_{date_str}.parquet"
    if not single_file:
        df.write.mode(mode).parquet(path)
        return path
    spark = df.sparkSession
    staged = f"{root.rstrip('/')}/_staged_{base}_{date_str}"
    df.coalesce(1).write.mode("overwrite").parquet(staged)
    fs, target = hadoop_fs(spark, path)
    part = fs.globStatus(hadoop_fs(spark, f"{staged}/part-*")[1])[0].getPath()
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"cannot publish {path}")
    fs.delete(hadoop_fs(spark, staged)[1], True)
    return path


def union_snapshots(spark: SparkSession, root: str, newest_wins: list[str] | None = None) -> DataFrame:
    """All snapshots of a folder as one scan. ``newest_wins`` names key columns: of rows with equal
    keys only that of the latest snapshot stays (undated snapshots are the oldest)."""
    listed = list_snapshots(spark, root)
    paths = [r["path"] for r in listed.select("path").collect()]  # one per snapshot, bounded by the calendar
    rows = spark.read.parquet(*paths)
    if not newest_wins:
        return rows
    source = F.regexp_extract(F.input_file_name(), r"([^/]+\.parquet)(?:/[^/]+)?$", 1)
    columns = [F.col(c) for c in rows.columns]
    dated = rows.select(F.struct(*columns).alias("row"), F.struct(snapshot_date(source).alias("date"), source.alias("name")).alias("rank"))
    keys = [F.col(f"row.{k}").alias(k) for k in newest_wins]
    return dated.groupBy(*keys).agg(F.max_by("row", "rank").alias("row")).select("row.*")


def write_partitioned(df: DataFrame, root: str, date_col: str = "snapshot_date") -> None:
    """``snapshot_date=`` partitions; only the partitions present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(date_col).parquet(root))


def union_all(dfs: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out
