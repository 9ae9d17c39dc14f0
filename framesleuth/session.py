"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Settings the library relies on.  Only correctness settings are forced on a
# session that already exists (see ``prepare``); sizing stays with the cluster.
CORRECTNESS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Timers and map state of the live operators need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
SIZING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "framesleuth", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CORRECTNESS, **SIZING, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key, value in CORRECTNESS.items():
        spark.conf.set(key, value)
    return spark


def twin(spark: SparkSession, **changed: str) -> SparkSession:
    """Another session of the same context, with the settings of the first but for those ``changed``."""
    made = spark.newSession()
    for key, value in {**spark.conf.getAll, **CORRECTNESS, **changed}.items():
        if made.conf.isModifiable(key):
            made.conf.set(key, value)
    return made


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's checkpoint folder.

    A temporary folder is made only for a local master, where driver and tasks
    share one disk.  A cluster that names no folder is a configuration error.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_SETTING, made)
    return made


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    The written rows are fixed, so values that depend on physical placement
    survive lost executors, later reads prune columns, and lineage stays short.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/framesleuth/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_placed(df: DataFrame, label: str, parts: int, *columns: str) -> DataFrame:
    """Write once in ``parts`` buckets of the columns and read back; groups that hold these columns are not shuffled again."""
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/framesleuth/{name}"
    df.repartition(parts, *columns).write.bucketBy(parts, *columns).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
