"""Session helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages. A local session that names none has one under its warehouse; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_BYTES unless the session asks for less.

    The default counts rows, ten thousand of them, so long texts would make batches of gigabytes.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"\d+", str(conf.get(name)))[0])
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def release() -> None:
    """Gives a Python worker's free memory back to the system; idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function of Arrow batches, or of a group's tables, that releases memory when it is done."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches(it):
            yield from run(it)
            release()

        return batches

    def one(table):
        out = run(table)
        release()
        return out

    def two(left, right):
        out = run(left, right)
        release()
        return out

    return two if len(inspect.signature(run).parameters) == 2 else one  # Spark reads the number of arguments


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for files that are an operator's output."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what an operator or a stage left under the shared folder, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
