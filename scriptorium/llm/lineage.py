"""Cutting lineage with tables in the folder that all executors share, which outlive the executors that wrote them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process and not yet deleted, in order.
_tables: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set the checkpoint folder from ``spark.checkpoint.dir``; a private folder only in single-machine sessions.

    Raises ValueError on a cluster whose session names no shared folder: a machine-local folder would lose data
    with the machine. The private folder is deleted when the process ends.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="scriptorium-checkpoints-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that driver and executors share: the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder, and read from there afterwards."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A place in the list of written tables, for ``discard_since``."""
    return len(_tables)


def discard_since(spark: SparkSession, place: int, keep: int = 0) -> None:
    """Delete the tables written since ``place``, but for the last ``keep``; nothing may read them any more."""
    gone = _tables[place : len(_tables) - keep]
    del _tables[place : len(_tables) - keep]
    for path in gone:
        discard(spark, path)
