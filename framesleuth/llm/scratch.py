"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import gc
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.session import shared_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/framesleuth/{label}-{uuid.uuid4().hex}"


_OPEN = threading.local()


@contextmanager
def temporary(spark: SparkSession):
    """Drop the tables that ``write`` makes inside this block at its end; ``keep`` spares one."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        drop(spark, *scopes.pop())


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table that outlives the innermost ``temporary`` block, and return it as read back."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    return write(df, label, scopes[-2] if len(scopes) > 1 else [])[0]


def write(df: DataFrame, label: str, scope: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` and return it as read back, with its path."""
    path = new_path(df.sparkSession, label)
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    if scope is not None:
        scope.append(path)
    elif scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Keys up to which ``few`` has a table broadcast.
FEW = 1_000_000


def few(keys: DataFrame, label: str) -> DataFrame:
    """Write a table of keys; up to ``FEW`` of them are broadcast when joined, more are shuffled."""
    keys, _ = write(keys, label)
    return F.broadcast(keys) if keys.count() <= FEW else keys


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no plan refers to any more.

    Python's objects go first, then those of the JVM that they held; the cleaner
    works beside, so it is given a moment.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)
