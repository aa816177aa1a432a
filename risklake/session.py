"""Session settings every job relies on, and the shared folder for materialised steps."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sessions merge inside each task before the shuffle, so a chatty device sends few rows
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

_written: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume (UTC, AQE with skew splitting)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written steps: ``spark.checkpoint.dir``, else a folder in the session's warehouse.

    A cluster whose only candidate is a plain local path is an error: its executors would each write to
    their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    check_shared(spark.sparkContext.master, path)
    return path


def check_shared(master: str, path: str) -> None:
    one_machine = master == "local" or master.startswith("local[")
    if not one_machine and (path.startswith(("/", "file:")) or ":" not in path):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {path} is local to each machine")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate to the shared folder and read it back.

    Cuts the lineage at a durable table, so a lost executor re-reads files instead of recomputing the
    upstream plan. The table goes with ``discard`` or at the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if not _written:
        atexit.register(_discard_all)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._step_path = path
    return back


def discard(*steps: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    for step in steps:
        path = step._step_path
        _delete(step.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]
    if steps:
        free_shuffles(steps[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that nothing refers to any more."""
    spark._jvm.System.gc()  # the context cleaner follows unreachable shuffles


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _discard_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; its files are then the cluster's to expire
            pass
