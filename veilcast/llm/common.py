"""Shared helpers: the cluster-wide scratch folder, stage tables and small numeric tools."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

BATCH_BYTES = 4 << 20  # of rows that a Python worker gets at a time; a longer row comes alone
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = "67108864b"


def prepare(spark: SparkSession) -> None:
    """Gives workers this package and, unless the session names its own bound, bounds batches by BATCH_BYTES:
    the buffers of a batch lie outside of the heap, once in the executor and two or three times in a worker."""
    ship(spark)
    if spark.conf.get(_BATCH, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_BYTES)


_STATE: dict = {}


def worker_state(key, make):
    """What a worker keeps for later tasks of one stage. Another key's state goes first, so one is held at most."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder named in spark.checkpoint.dir, which every executor sees.

    Only where the setting is absent (tests on one machine) a temporary folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="veilcast-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """Writes df below the shared folder and returns the table reread, with its path: lineage ends
    in durable files, so a lost executor never forces an earlier stage to run again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a stage table that no later result reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def require(df: DataFrame, *names: str) -> None:
    """Fails early, with the names, where a needed column is absent or there twice."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"column {name!r} must be there exactly once, in {df.columns}")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
