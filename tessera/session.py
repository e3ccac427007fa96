"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on its own: lineage is cut with
``DataFrame.checkpoint()`` under the cluster's ``spark.checkpoint.dir``. A session built
by :func:`get_spark` (tests, bench, local runs) sets that directory only when the
cluster configuration left it unset.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What results depend on, whatever the cluster.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
#: Sizes for tests, bench and laptops; set only for a ``local`` master that the caller names.
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def session_conf(master: str | None = None, **conf) -> dict[str, str]:
    """The settings :func:`get_spark` asks for. Without ``master`` neither a master nor any size is
    set, so those of ``spark-submit`` and the cluster hold."""
    out = dict(_DEFAULTS)
    if master is not None:
        out["spark.master"] = master
        if master.split("[")[0] == "local":
            out |= _LOCAL_DEFAULTS
    return out | conf


def get_spark(master: str | None = None, app: str = "tessera", **conf) -> SparkSession:
    """Build (or reuse) a session with the library's defaults; ``master`` only for local runs."""
    spark = SparkSession.builder.appName(app).config(map=session_conf(master, **conf)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a test-only one when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder every executor shares")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")  # local mode only (tests, laptops)
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path in any store that Spark reads."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """False only if the store says that there is no such path; other errors rise."""
    fs, jvm_path = hadoop_fs(spark, path)
    return bool(fs.exists(jvm_path))


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; the reread table and its size in bytes on disk."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    fs, jvm_path = hadoop_fs(spark, path)
    size = fs.getContentSummary(jvm_path).getLength()
    return spark.read.schema(df.schema).parquet(path), size
