"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SAVED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def save(spark: SparkSession, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as parquet into the shared folder and read it back: cuts lineage, survives a lost executor.

    release() leaves a table alone that was saved with keep.
    """
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/{app}-tables/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if not keep:
        _SAVED.setdefault(app, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def reclaim(spark: SparkSession, *done: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, and let the driver's collector find shuffle files of finished jobs."""
    for df in done:
        mine = _SAVED.get(spark.sparkContext.applicationId, [])
        if df.saved_at in mine:
            mine.remove(df.saved_at)
        _delete(spark, df.saved_at)
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the tables that save() wrote in this session. Results that still read them must be written before."""
    for path in _SAVED.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
