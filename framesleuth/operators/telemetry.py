"""Host and GPU telemetry: headroom, sustained conditions, yielding, staleness.

These are the batch forms; ``framesleuth.streaming`` holds the live ones.  Each
policy is a small state machine, written as markers: a row that switches the
state on or off leaves a marker, and the state at a row is the last marker so
far.  Times are integers in microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesleuth.functions.checks import first_failure, holds
from framesleuth.operators import ordered
from framesleuth.session import materialise

SECOND = 1_000_000
FRESH_US = 15 * SECOND
HEARTBEAT_US = 90 * SECOND

# Admission ceilings of each resource profile.
PROFILES = {
    "automatic": {"max_jobs": 16, "cpu": 80, "memory_gib": 6, "gpu": 85, "io": 8}, "quiet": {"max_jobs": 1, "cpu": 55, "memory_gib": 8, "gpu": 60, "io": 5},
    "shared": {"max_jobs": 2, "cpu": 70, "memory_gib": 8, "gpu": 75, "io": 8}, "faster": {"max_jobs": 4, "cpu": 80, "memory_gib": 6, "gpu": 85, "io": 12},
}


def _known(*names: str) -> Column:
    result = F.lit(True)
    for name in names:
        result = result & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")) & (F.col(name) >= 0)
    return result


def cache_assisted(required: Column | float) -> Column:
    """Evictable cache may fund one serial start, within strict limits."""
    keys = ("host_available_gib", "host_free_gib", "zfs_reclaimable_gib", "zfs_need_free_gib", "memory_pressure", "io_pressure")
    budget = F.greatest(F.col("host_available_gib"), F.col("host_free_gib") + F.least(F.lit(8.0), F.col("zfs_reclaimable_gib") * 0.5))
    return holds(
        _known(*keys) & (F.col("host_available_gib") >= 6) & (F.col("zfs_reclaimable_gib") >= 8) & (F.col("zfs_need_free_gib") == 0)
        & (F.col("memory_pressure") < 0.1) & (F.col("io_pressure") < 5) & (budget >= required)
    )


def headroom() -> Column:
    """First reason a second GPU stage must not start; NULL when there is room."""
    engines = ("gpu_encode_percent", "gpu_decode_percent", "gpu_compute_percent")
    others = ("vram_free_gib", "gpu_temperature", "available_gib", "host_available_gib", "cpu_percent", "container_cpu_percent", "memory_pressure", "io_pressure")
    return first_failure([
        (_known(*engines, *others), "telemetry unavailable"), (F.greatest(*engines) < 75, "GPU engines busy"), (F.col("vram_free_gib") >= 4, "insufficient VRAM headroom"),
        (F.col("gpu_temperature") < 75, "GPU cooling headroom needed"),
        ((F.col("available_gib") >= 6) & ((F.col("host_available_gib") >= 12) | cache_assisted(8.0)), "insufficient RAM headroom"),
        (F.greatest("cpu_percent", "container_cpu_percent") <= 70, "CPU allocation busy"),
        ((F.col("memory_pressure") < 0.1) & (F.col("io_pressure") < 5), "memory or storage pressure"),
    ])


def pressure_ok() -> Column:
    return holds(_known("memory_pressure", "io_pressure") & (F.col("memory_pressure") < 0.1) & (F.col("io_pressure") < 5) & (F.coalesce("zfs_need_free_gib", F.lit(0)) == 0))


def memory_room(extra_gib: float = 2.0) -> Column:
    return holds(_known("available_gib", "host_available_gib") & (F.col("available_gib") >= extra_gib + 3) & (F.col("host_available_gib") >= extra_gib + 4))


def external_cpu() -> Column:
    """Cores used by other programs on the host."""
    return F.greatest(F.lit(0.0), F.col("host_cpus") * F.col("cpu_percent") / 100 - F.col("cpus") * F.col("container_cpu_percent") / 100)


def cpu_room() -> Column:
    """Cores left after other programs and a reserve of 15 % (1 core to a quarter); NULL if unknown."""
    sane = _known("cpus", "cpu_percent", "container_cpu_percent", "host_cpus") & (F.col("cpus") > 0) & (F.col("host_cpus") > 0) & (F.greatest("cpu_percent", "container_cpu_percent") <= 100)
    reserve = F.least(F.greatest(F.lit(1.0), F.col("host_cpus") * 0.15), F.col("host_cpus") * 0.25)
    return F.when(holds(sane), F.greatest(F.lit(0.0), F.least(F.col("cpus"), F.col("host_cpus") - external_cpu() - reserve)))


def admission(profile: str) -> Column:
    """First reason a new job waits under a resource profile; NULL when it may start."""
    limit = PROFILES[profile]
    host = F.coalesce("host_available_gib", "available_gib", F.lit(0.0))
    assisted = (host < limit["memory_gib"] + 2) & cache_assisted(float(limit["memory_gib"] + 2))
    reserve = 2 + F.least(F.lit(2.0), F.greatest(F.lit(1.0), F.coalesce("container_limit_gib", F.lit(0.0)) * 0.2))
    return first_failure([
        ((host >= limit["memory_gib"] + 2) | assisted, "waiting for memory"), (F.col("container_available_gib").isNull() | (F.col("container_available_gib") >= reserve), "waiting for container memory"),
        (F.coalesce("cpu_percent", F.lit(100.0)) <= limit["cpu"], "waiting for CPU"), (F.coalesce("container_cpu_percent", F.lit(0.0)) <= limit["cpu"], "waiting for container CPU"),
        (F.coalesce("io_pressure", F.lit(100.0)) <= limit["io"], "waiting for storage"), (F.coalesce("memory_pressure", F.lit(100.0)) <= 1, "waiting for memory pressure"),
        (F.coalesce("gpu_percent", F.lit(0.0)) <= limit["gpu"], "waiting for GPU"), (F.coalesce("vram_free_gib", F.lit(8.0)) >= 2, "waiting for GPU memory"),
        (F.coalesce("gpu_temperature", F.lit(0.0)) < 80, "waiting for GPU temperature"),
    ])


def gpu_rollup(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Busiest engine, least free memory and hottest device of each host sample."""
    engines = ("compute", "encode", "decode")
    return samples.groupBy(*keys).agg(
        F.max(F.greatest(*[F.col(f"{e}_percent") for e in engines])).alias("gpu_percent"), *[F.max(f"{e}_percent").alias(f"gpu_{e}_percent") for e in engines],
        F.min("vram_free_mib").alias("vram_free_mib"), F.max("temperature").alias("gpu_temperature"),
    )


def allocated_cpu(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of the CPU allocation used between neighbouring counter readings.
    ``at_us``, ``used_us`` and ``cpus`` per row."""
    rows = ordered.scan(samples, keys, before=ordered.lag(F.struct("at_us", "used_us")))
    spent, used = F.col("at_us") - F.col("before.at_us"), F.col("used_us") - F.col("before.used_us")
    percent = F.when((spent > 0) & (used >= 0) & (F.col("cpus") > 0), F.least(F.lit(100.0), 100.0 * used / (spent * F.col("cpus"))))
    return rows.withColumn("percent", percent).drop("before")


def latest_before(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """``points`` with ``mark``: the latest time of ``marks`` at or before ``at``; null before the first.

    Both are merged into one order and the last mark so far is carried, so a key
    of any size is spread over many tasks and no pairs are made.
    """
    keys = list(keys)
    held = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    both = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), held.alias("_row"))
    both = both.unionByName(marks.select(*keys, F.col(mark).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(dict(both.dtypes)["_row"]).alias("_row")).distinct())
    placed = ordered.arrange(both, keys, ["_at", "_kind", F.xxhash64("_row")])
    merged = ordered.scan(placed, keys, ordered.PLACE, block_rows, _mark=ordered.last_known(F.when(F.col("_kind") == 0, F.col("_at"))))
    return merged.where("_kind = 1").select("_row.*", F.col("_mark").alias(mark))


def gpu_evidence(samples: DataFrame, snapshots: DataFrame, processes: DataFrame, keys: Sequence[str], fresh_us: int = FRESH_US, busy_percent: float = 3.0, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """What a yielding policy may know at each sample: ``usable``, ``external``, ``names`` and ``reason``.

    ``samples``: keys, ``at_us``, ``wanted`` (ids of the GPUs in use).  ``snapshots``:
    keys, ``updated_us``, ``complete``, ``gpus`` (ids seen).  ``processes``: keys,
    ``updated_us``, ``gpu``, ``name``, ``owned`` and the percentages ``sm``, ``enc``,
    ``dec`` (null if not told).  A sample is judged by the latest snapshot.  It is
    unusable when that is missing, incomplete or older than ``fresh_us``, when no
    GPU is wanted or one was not seen, when the owner of a process on a wanted
    GPU is unknown, or when a foreign one there tells no usage.  A foreign
    process at ``busy_percent`` or more of any engine makes it external.
    """
    keys = list(keys)
    used = F.greatest("sm", "enc", "dec")  # ignores nulls
    sane = used.isNotNull() & (used <= 100) & (F.least("sm", "enc", "dec") >= 0)
    foreign = holds(~F.col("owned"))
    busy = foreign & holds(used >= busy_percent)
    # One row for each GPU of a snapshot, however many processes it runs.
    load = processes.groupBy(*keys, "updated_us", "gpu").agg(
        F.max(F.col("owned").isNull()).alias("unknown"), F.max(foreign & ~holds(sane)).alias("untold"), F.max(busy).alias("busy"), F.collect_set(F.when(busy, F.col("name"))).alias("names")
    )
    rows = latest_before(samples.withColumn("_sample", F.monotonically_increasing_id()), snapshots, keys, "at_us", "updated_us", block_rows)
    rows = materialise(rows.join(snapshots.select(*keys, "updated_us", "complete", "gpus"), [*keys, "updated_us"], "left"), "gpu-samples")
    per_gpu = rows.select(*keys, "updated_us", "_sample", F.explode("wanted").alias("gpu")).distinct().join(load, [*keys, "updated_us", "gpu"])
    flag = lambda c: F.max(c).alias(c)
    told = per_gpu.groupBy("_sample").agg(flag("unknown"), flag("untold"), flag("busy"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    age = F.col("at_us") - F.col("updated_us")
    reason = first_failure([
        (F.col("updated_us").isNotNull(), "no snapshot"), (F.col("complete"), "snapshot is incomplete"), ((age >= 0) & (age <= fresh_us), "snapshot is stale"),
        ((F.size("wanted") > 0) & (F.size(F.array_except("wanted", "gpus")) == 0), "a wanted GPU was not seen"),
        (~F.coalesce("unknown", F.lit(False)), "owner of a process is unknown"), (~F.coalesce("untold", F.lit(False)), "usage of a process is unknown"),
    ])
    out = rows.join(told, "_sample", "left").withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())
    external = F.col("usable") & F.coalesce("busy", F.lit(False))
    names = F.when(external, F.array_join(F.array_sort("names"), ", "))
    return out.select(*[c for c in samples.columns], "updated_us", "usable", external.alias("external"), names.alias("names"), "reason")


def gpu_yield(samples: DataFrame, keys: Sequence[str], sustained_us: int = 5 * SECOND, cooldown_us: int = 60 * SECOND, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """State of each sample: unavailable, busy, yielding, cooldown or available.

    ``ordinal, at_us, usable`` (complete and fresh evidence) and ``external``
    (another program uses the GPU).  Busy for ``sustained_us`` starts yielding;
    it ends ``cooldown_us`` after the last busy sample.  Unusable samples leave
    the state untouched.
    """
    keys = list(keys)
    usable, busy = holds(F.col("usable")), holds(F.col("usable") & F.col("external"))
    slim = samples.select(*keys, "ordinal", "at_us", usable.alias("_ok"), busy.alias("_busy"))
    step = ordered.scan(
        slim, keys, "ordinal", block_rows,
        was=ordered.last_known(F.when(F.col("_ok"), F.col("_busy")), inclusive=False), last_busy=ordered.last_known(F.when(F.col("_busy"), F.col("at_us"))),
    )
    step = materialise(step.withColumn("_start", F.when(F.col("_busy") & ~F.coalesce("was", F.lit(False)), F.col("at_us"))), "yield")
    step = ordered.scan(step, keys, "ordinal", block_rows, since=ordered.last_known(F.col("_start")))
    on = F.col("_busy") & (F.col("at_us") - F.col("since") >= sustained_us)
    off = F.col("_ok") & ~F.col("_busy") & holds(F.col("last_busy").isNull() | (F.col("at_us") - F.col("last_busy") >= cooldown_us))
    step = materialise(step.withColumn("_mark", F.when(on, True).when(off, False)), "yield")
    step = ordered.scan(step, keys, "ordinal", block_rows, yielding=ordered.last_known(F.col("_mark")))
    held = F.coalesce("yielding", F.lit(False))
    state = (
        F.when(~F.col("_ok"), "unavailable").when(F.col("_busy") & held, "yielding").when(F.col("_busy"), "busy").when(held, "cooldown").otherwise("available")
    )
    return step.select(*keys, "ordinal", "at_us", state.alias("state"), state.isin("yielding", "cooldown").alias("pause"), (state != "available").alias("block_admission"))


def cpu_yield(samples: DataFrame, keys: Sequence[str], block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """State of each sample: unavailable, busy, yielding or available.

    Busy is 85 % host load with at least a quarter of the host (one core) used by
    others; ten seconds of it pause, sixty seconds at 65 % or less resume.  A gap
    over 15 s or an unusable sample starts afresh.  Columns: ordinal, at_us,
    scoped, host_cpus, cpus, cpu_percent, container_cpu_percent.
    """
    keys = list(keys)
    sane = (
        F.col("scoped") & _known("host_cpus", "cpus", "cpu_percent", "container_cpu_percent") & (F.col("host_cpus") > 0) & (F.col("cpus") > 0)
        & (F.col("cpus") <= F.col("host_cpus")) & (F.col("cpu_percent") <= 100) & (F.col("container_cpu_percent") <= 100)
    )
    busy = (F.col("cpu_percent") >= 85) & (external_cpu() >= F.greatest(F.lit(1.0), F.col("host_cpus") * 0.25))
    slim = samples.select(*keys, "ordinal", "at_us", holds(sane).alias("_ok"), holds(sane & busy).alias("_busy"), holds(sane & ~busy & (F.col("cpu_percent") <= 65)).alias("_quiet"))
    step = ordered.scan(slim, keys, "ordinal", block_rows, before=ordered.lag(F.struct("at_us", "_ok", "_busy", "_quiet")))
    gap = F.col("at_us") - F.col("before.at_us")
    fresh = F.col("_ok") & ~holds(F.col("before._ok") & gap.between(0, FRESH_US))
    begins = lambda name: F.when(F.col(name) & (F.col("_fresh") | ~holds(F.col(f"before.{name}"))), F.col("at_us"))
    step = step.withColumn("_fresh", fresh)
    step = materialise(step.withColumns({"_busy_from": begins("_busy"), "_quiet_from": begins("_quiet")}).drop("before"), "yield")
    step = ordered.scan(step, keys, "ordinal", block_rows, busy_since=ordered.last_known(F.col("_busy_from")), quiet_since=ordered.last_known(F.col("_quiet_from")))
    on = F.col("_busy") & (F.col("at_us") - F.col("busy_since") >= 10 * SECOND)
    off = F.col("_quiet") & (F.col("at_us") - F.col("quiet_since") >= 60 * SECOND)
    step = materialise(step.withColumn("_mark", F.when(on, True).when(off | F.col("_fresh"), False)), "yield")
    step = ordered.scan(step, keys, "ordinal", block_rows, paused=ordered.last_known(F.col("_mark")))
    held = F.coalesce("paused", F.lit(False))
    state = F.when(~F.col("_ok"), "unavailable").when(held, "yielding").when(F.col("_busy"), "busy").otherwise("available")
    return step.select(*keys, "ordinal", "at_us", state.alias("state"), state.isin("yielding", "busy").alias("block_admission"))


def sustained_gate(samples: DataFrame, keys: Sequence[str], hold_us: int = 30 * SECOND, gap_us: int = 10 * SECOND, cooldown_us: int = 60 * SECOND, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Open once ``healthy`` has lasted ``hold_us`` without a sampling gap over
    ``gap_us`` and ``cooldown_us`` after the last unhealthy sample.

    A block and its successor are enough: the start of the current healthy run
    is the latest row that begins one.
    """
    keys = list(keys)
    slim = samples.select(*keys, "ordinal", "at_us", holds(F.col("healthy")).alias("_ok"))
    step = ordered.scan(slim, keys, "ordinal", block_rows, before=ordered.lag(F.struct("at_us", "_ok")))
    gap = F.col("at_us") - F.col("before.at_us")
    begins = F.col("_ok") & ~holds(F.col("before._ok") & gap.between(0, gap_us))
    step = materialise(step.select(*keys, "ordinal", "at_us", "_ok", F.when(begins, F.col("at_us")).alias("_from"), F.when(~F.col("_ok"), F.col("at_us")).alias("_bad")), "gate")
    step = ordered.scan(step, keys, "ordinal", block_rows, since=ordered.last_known(F.col("_from")), bad_at=ordered.last_known(F.col("_bad")))
    opened = F.col("_ok") & (F.col("at_us") - F.col("since") >= hold_us) & (F.col("bad_at").isNull() | (F.col("at_us") - F.col("bad_at") >= cooldown_us))
    return step.select(*keys, "ordinal", "at_us", F.col("_ok").alias("healthy"), F.when(F.col("_ok"), F.col("since")).alias("healthy_since"), holds(opened).alias("open"))


def heartbeat_states(heartbeats: DataFrame, keys: Sequence[str], now: Column, limit_us: int = HEARTBEAT_US) -> DataFrame:
    """Last state of each job; a running one not heard from is ``stale``, or
    ``interrupted`` when its process is known to be gone.

    ``updated_us, state, alive``; the ETA is dropped 30 s after its stage update.
    """
    last = heartbeats.groupBy(*keys).agg(F.max_by(F.struct("updated_us", "state", "alive", "phase", "eta", "stage_updated_us"), F.col("updated_us")).alias("h")).select(*keys, "h.*")
    fresh = now - F.col("updated_us") < limit_us
    state = (
        F.when(F.col("state") != "running", F.col("state")).when(holds(~F.col("alive")), "interrupted").when(holds(F.col("alive") & fresh), "running").otherwise("stale")
    )
    eta = F.when((state == "running") & ~holds(now - F.col("stage_updated_us") > 30 * SECOND), F.col("eta"))
    return last.select(*keys, "updated_us", state.alias("state"), "phase", eta.alias("eta"))


def advancing_activity(lines: DataFrame, keys: Sequence[str], block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Lines that prove work: a counter above its own running maximum.

    ``ordinal, name, value`` per line; names of one unit share a counter.
    """
    # Progress names and the counter each one feeds.
    counter = F.when(F.col("name") == "frame", "frames").when(F.col("name").isin("out_time_us", "out_time_ms"), "microseconds").when(F.col("name") == "activity", "units")
    valid = lines.withColumn("counter", counter).where(F.col("counter").isNotNull() & (F.col("value") >= 0) & (F.col("value") < 2**62))
    rows = ordered.scan(valid, [*keys, "counter"], "ordinal", block_rows, top=ordered.running_max(F.col("value"), inclusive=False))
    return rows.where(F.col("value") > F.coalesce("top", F.lit(0))).drop("top")


def progress_increments(lines: DataFrame, keys: Sequence[str], block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Forward movement of each progress line (tenths of a percent, at most 1000)."""
    rows = lines.withColumn("tenths", F.least(F.lit(1000), F.col("tenths")))
    rows = ordered.scan(rows, keys, "ordinal", block_rows, last=ordered.running_max(F.col("tenths"), inclusive=False))
    return rows.withColumn("increment", F.greatest(F.lit(0), F.col("tenths") - F.coalesce("last", F.lit(0)))).drop("last")


def evidence_percent(lines: DataFrame, keys: Sequence[str], duration_us: Column, start_us: Column) -> DataFrame:
    """Share of a file already examined, from the latest time seen; at most 99.9 %
    (in per mille) until the reader ends."""
    seen = F.greatest(F.lit(0), F.col("pts") - start_us)
    top = F.max(F.call_function("div", seen * 1000, duration_us))
    return lines.groupBy(*keys).agg(F.least(F.lit(999), top).alias("per_mille"))


def fresh_snapshot(tables: DataFrame, now: Column, limit_us: int = HEARTBEAT_US) -> DataFrame:
    """Newest row of every table with its age and whether it is still current."""
    newest = tables.groupBy("table").agg(F.max("updated_us").alias("updated_us"))
    age = now - F.col("updated_us")
    return newest.select("table", "updated_us", age.alias("age_us"), holds((age >= 0) & (age < limit_us)).alias("current"))


def unexpired(confirmations: DataFrame, now: Column, ttl_us: int = 600 * SECOND) -> DataFrame:
    """Confirmations that may still be used."""
    return confirmations.where((F.col("made_us") <= now) & (now < F.col("made_us") + ttl_us))
