"""Streaming jobs: sources, stateful operators and sinks put together.

Every stream brings its event time as ``ts`` and as ``at_us``, the same time in
microseconds.  Rows wait until the watermark has passed their slot; later ones
than the watermark are dropped, and ``Drained.late_rows`` counts them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.functions.checks import holds
from framesleuth.functions.labels import phase_category
from framesleuth.operators.telemetry import external_cpu
from framesleuth.session import prepare, shared_dir, twin
from framesleuth.streaming import processors as live

WATERMARK = "15 seconds"  # freshness limit of the telemetry policies
SLOT_US = 5 * live.SECOND
BUCKETS = 32  # of keys in the state of a policy: slots of a bucket should hold some thousand rows


def replay(rows: DataFrame, keys: tuple[str, ...], policy: live.Policy, delay: str = WATERMARK, slot_us: int = SLOT_US, buckets: int = BUCKETS) -> DataFrame:
    """Output of a policy over a stream with ``ts``, ``at_us`` and the ``keys``; the keys come first.

    Keys are handled in ``buckets``; those with nulls (numbers or texts) have one for each set of null keys.
    """
    kinds = dict(rows.dtypes)
    output = ", ".join([*(f"{k} {kinds[k]}" for k in keys), policy.output])
    nulls = reduce(add, (F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)))
    bucket = F.when(nulls > 0, -nulls).otherwise(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # Columns of numbers with nulls would reach the processor as doubles; the bucket tells which keys are null.
    filled = {k: F.coalesce(F.col(k), F.lit("0").cast(kinds[k])) for k in keys}
    marked = rows.withWatermark("ts", delay).withColumn("_bucket", bucket).withColumns(filled)
    return marked.groupBy("_bucket").transformWithStateInPandas(live.Replay(policy, keys, slot_us), output, "Append", "EventTime")


def state_session(spark: SparkSession, buckets: int = BUCKETS) -> SparkSession:
    """Session to open the streams of ``replay`` in: it deals state to ``buckets`` partitions at most, as no more hold rows.

    Every batch opens a store and a Python worker for each partition, also for those without rows.
    """
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    return twin(spark, **{"spark.sql.shuffle.partitions": str(parts)})


def gpu_yield(samples: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    """``track, ts, at_us, ordinal, usable, external`` stream to yield states."""
    rows = samples.select("track", "ts", "at_us", "ordinal", holds(F.col("usable")).alias("usable"), holds(F.col("external")).alias("external"))
    return replay(rows, ("track",), live.gpu_yield(), delay, slot_us)


def cpu_yield(samples: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    """``track, ts, at_us, ordinal, scoped, host_cpus, cpus, cpu_percent, container_cpu_percent``."""
    bounded = (F.col("cpu_percent").between(0, 100)) & (F.col("container_cpu_percent").between(0, 100))
    sane = holds(F.col("scoped") & (F.col("host_cpus") > 0) & (F.col("cpus") > 0) & (F.col("cpus") <= F.col("host_cpus")) & bounded)
    busy = holds(sane & (F.col("cpu_percent") >= 85) & (external_cpu() >= F.greatest(F.lit(1.0), F.col("host_cpus") * 0.25)))
    rows = samples.select("track", "ts", "at_us", "ordinal", sane.alias("sane"), busy.alias("busy"), holds(sane & ~busy & (F.col("cpu_percent") <= 65)).alias("quiet"))
    return replay(rows, ("track",), live.cpu_yield(), delay, slot_us)


def sustained_gate(samples: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US, **limits: int) -> DataFrame:
    rows = samples.select("track", "ts", "at_us", "ordinal", holds(F.col("healthy")).alias("healthy"))
    return replay(rows, ("track",), live.sustained_gate(**limits), delay, slot_us)


def stage_seconds(heartbeats: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    rows = heartbeats.select("track", "ts", "at_us", "ordinal", phase_category(F.col("phase")).alias("category"))
    return replay(rows, ("track",), live.stage_seconds(), delay, slot_us)


def throughput(samples: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    rows = samples.select("family", "ts", "at_us", "ordinal", *(F.col(n).cast("double").alias(n) for n in ("work", "elapsed", "overlap")))
    return replay(rows, ("family",), live.throughput(), delay, slot_us)


def activity(lines: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    return replay(lines.select("track", "counter", "ts", "at_us", "ordinal", "value"), ("track", "counter"), live.activity(), delay, slot_us)


def progress(chunks: DataFrame, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    return replay(chunks.select("job", "ts", "at_us", "ordinal", "chunk"), ("job",), live.progress(), delay, slot_us)


def confirmations(actions: DataFrame, ttl_us: int = 600 * live.SECOND, delay: str = WATERMARK, slot_us: int = SLOT_US) -> DataFrame:
    return replay(actions.select("token", "ts", "at_us", "ordinal", "action"), ("token",), live.confirmations(ttl_us), delay, slot_us)


def heartbeats(beats: DataFrame, limit_us: int = live.HEARTBEAT_US, delay: str = WATERMARK) -> DataFrame:
    """``job, ts, at_us, state``; ``stale`` rows appear as the watermark passes the limit."""
    rows = beats.withWatermark("ts", delay).select("job", "ts", "at_us", "state")
    return rows.groupBy("job").transformWithStateInPandas(live.Heartbeats(limit_us), live.Heartbeats.output, "Append", "EventTime")


def stage_rollup(increments: DataFrame, width: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    """Stage time and intervals per tumbling window and category, once the watermark has passed the window."""
    sums = F.sum("us").alias("us"), F.count(F.lit(1)).alias("intervals")
    rows = increments.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "category").agg(*sums)
    return rows.select(F.unix_micros("w.start").alias("from_us"), "category", "us", "intervals")


def sample_sessions(samples: DataFrame, gap: str = WATERMARK, delay: str = WATERMARK) -> DataFrame:
    """Sessions of a key's samples without a gap over the freshness limit, once the watermark has passed their end."""
    flag = lambda name: F.count_if(holds(F.col(name))).alias(name)
    rows = samples.withWatermark("ts", delay).groupBy("track", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("samples"), flag("usable"), flag("external")).select("track", F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("to_us"), "samples", "usable", "external")


class Drained(NamedTuple):
    rows: DataFrame
    late_rows: int


def run_once(rows: DataFrame, path: str, checkpoint: str) -> int:
    """Process everything available into parquet and return the number of rows dropped as late.

    The checkpoint makes it resumable; an input without rows ends at once.
    """
    prepare(rows.sparkSession)
    job = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in job.recentProgress for s in p["stateOperators"])


def drained(rows: DataFrame, label: str, spark: SparkSession | None = None) -> Drained:
    """Run a job over all available input; what it wrote, read in the given session or the job's own, and how many rows came late."""
    spark = spark or rows.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/framesleuth/{label}-{uuid.uuid4().hex}"
    late = run_once(rows, f"{base}/rows", f"{base}/checkpoint")
    return Drained(spark.read.schema(rows.schema).parquet(f"{base}/rows"), late)


class KeyedUpsert:
    """Newest row per key in a folder of key buckets; a ``foreachBatch`` target.

    A batch reads and rewrites only the buckets its keys fall into, under
    ``data/batch=<id>/bucket=<n>``.  Its manifest, written last and at once, says
    which batch holds each bucket's newest rows; readers take the newest manifest
    in the folder, so they see whole versions only, also after a restart without
    new data.  A repeated batch starts again from the manifest before its own and
    gives the same rows.  Files that neither of the last two manifests names are
    removed.  Among equal ``order`` the largest remaining columns win.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 32):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        make, files = self._files()
        folder = make(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = (s.getPath().getName() for s in files.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, number: int) -> dict[int, int]:
        """Batch that holds each bucket."""
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{number}").collect())  # one short line
        return {int(b): n for b, n in json.loads(text).items()}

    def _publish(self, number: int, held: dict[int, int]) -> None:
        make, files = self._files()
        draft, final = make(f"{self.path}/manifests/.{number}-{uuid.uuid4().hex}"), make(f"{self.path}/manifests/{number}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        files.delete(final, False)
        files.rename(draft, final)

    def _load(self, held: dict[int, int], schema) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(held.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _newest(self, rows: DataFrame) -> DataFrame:
        fields = [self.order, *(c for c in rows.columns if c not in (self.key, self.order))]
        best = rows.groupBy(self.key).agg(F.max(F.struct(*fields)).alias("r"))
        return best.select(*(F.col(self.key) if c == self.key else F.col(f"r.`{c}`").alias(c) for c in rows.columns))

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = [n for n in self._manifests() if n < number]
        held = self._manifest(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = self._newest(batch).persist()
        touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most one row a bucket
        known = self._load({b: held[b] for b in touched if b in held}, batch.schema)
        rows = self._newest(fresh.unionByName(known)) if known is not None else fresh
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        fresh.unpersist()
        held = held | {b: number for b in touched}
        self._publish(number, held)
        self._clean({number, *before[-1:]})

    def _clean(self, kept: set[int]) -> None:
        make, files = self._files()
        named = {(n, b) for k in kept for b, n in self._manifest(k).items()}
        for number in self._manifests():
            if number not in kept:
                files.delete(make(f"{self.path}/manifests/{number}"), False)
        for folder in files.listStatus(make(f"{self.path}/data")):
            number = int(folder.getPath().getName().partition("=")[2])
            if number > max(kept):  # an unfinished later batch
                continue
            buckets = [s.getPath() for s in files.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            gone = [p for p in buckets if (number, int(p.getName().partition("=")[2])) not in named]
            for place in gone:
                files.delete(place, True)
            if len(gone) == len(buckets) and number not in kept:
                files.delete(folder.getPath(), True)

    def run(self, rows: DataFrame, checkpoint: str) -> None:
        rows.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def read(self, schema) -> DataFrame:
        """Newest complete version."""
        found = self._manifests()
        rows = self._load(self._manifest(found[-1]), schema) if found else None
        return rows if rows is not None else self.spark.createDataFrame([], schema)
