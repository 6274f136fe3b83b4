"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes = threading.Lock(), []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is set and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.getConf().get("spark.master") or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of the writes inside go when they end.  The last of several writes at the same time puts the setting back."""
    with _lock:
        _writes.append(_writes[0] if _writes else spark.conf.get(_CLEAN, None))
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            before = _writes.pop()
            if not _writes:
                spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and lets later joins see sizes."""
    spark = df.sparkSession
    path = path or fresh_path(spark)
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*frames: DataFrame | None) -> None:
    """Delete tables made by ``save`` that nothing reads any more."""
    for df in frames:
        if df is not None and getattr(df, "_saved_at", None):
            remove(df.sparkSession, df._saved_at)
