"""Telemetry queries; an hour of the events table plays one second."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesleuth.operators import telemetry as op
from framesleuth.plans.registry import plain, query
from framesleuth.plans.tables import PACKET_SQL, packets

KEYS = ["track"]
ORIGIN = 1704067200000000


def ticks(spark, folder):
    return packets(spark, folder).withColumn("at_us", F.expr(f"(pts - {ORIGIN}) div 3600"))


_TICK = PACKET_SQL + f", tick AS (SELECT *, (pts - {ORIGIN}) // 3600 AS at_us FROM packet)"


@query(
    "yield_states",
    f"""WITH RECURSIVE {_TICK}, s AS (SELECT track, ordinal, at_us, event_id % 13 <> 0 AS ok, event_id % 13 <> 0 AND level % 3 < 2 AS busy FROM tick),
    w AS (SELECT track, ordinal, at_us, ok, busy, CASE WHEN busy THEN at_us END AS since, CASE WHEN busy THEN at_us END AS last_busy, false AS y FROM s WHERE ordinal = 1
      UNION ALL SELECT s.track, s.ordinal, s.at_us, s.ok, s.busy, CASE WHEN NOT s.ok THEN w.since WHEN s.busy THEN coalesce(w.since, s.at_us) END, CASE WHEN s.busy THEN s.at_us ELSE w.last_busy END,
        CASE WHEN NOT s.ok THEN w.y WHEN s.busy THEN w.y OR s.at_us - coalesce(w.since, s.at_us) >= 5000000 WHEN w.y AND s.at_us - w.last_busy < 60000000 THEN true ELSE false END
      FROM w JOIN s ON s.track = w.track AND s.ordinal = w.ordinal + 1),
    t AS (SELECT *, CASE WHEN NOT ok THEN 'unavailable' WHEN busy AND y THEN 'yielding' WHEN busy THEN 'busy' WHEN y THEN 'cooldown' ELSE 'available' END AS state FROM w)
    SELECT track, ordinal, at_us, state, state IN ('yielding', 'cooldown') AS pause, state <> 'available' AS block_admission FROM t""",
)
def yield_states(spark, folder):
    s = ticks(spark, folder).select("track", "ordinal", "at_us", (F.col("event_id") % 13 != 0).alias("usable"), (F.col("level") % 3 < 2).alias("external"))
    return plain(op.gpu_yield(s, KEYS))


_FAST = PACKET_SQL + f", tick AS (SELECT *, (pts - {ORIGIN}) // 36000 AS at_us FROM packet)"


@query(
    "cpu_yield",
    f"""WITH RECURSIVE {_FAST}, s AS (SELECT track, ordinal, at_us, event_id % 17 <> 0 AS ok, event_id % 17 <> 0 AND level % 100 >= 40 AS busy, event_id % 17 <> 0 AND level % 100 < 35 AS quiet FROM tick),
    w AS (SELECT track, ordinal, at_us, ok, busy, CASE WHEN busy THEN at_us END AS bs, CASE WHEN quiet THEN at_us END AS qs, CASE WHEN ok THEN at_us END AS last, false AS p FROM s WHERE ordinal = 1
      UNION ALL SELECT track, ordinal, at_us, ok, busy, bs, qs, CASE WHEN ok THEN at_us END, CASE WHEN NOT ok THEN false WHEN busy AND at_us - bs >= 10000000 THEN true WHEN quiet AND at_us - qs >= 60000000 THEN false ELSE p END FROM (
        SELECT s.track, s.ordinal, s.at_us, s.ok, s.busy, s.quiet, CASE WHEN s.busy THEN CASE WHEN r THEN s.at_us ELSE coalesce(w.bs, s.at_us) END END AS bs, CASE WHEN s.quiet THEN CASE WHEN r THEN s.at_us ELSE coalesce(w.qs, s.at_us) END END AS qs, NOT r AND w.p AS p
        FROM (SELECT w.*, s.at_us AS nx FROM w JOIN s ON s.track = w.track AND s.ordinal = w.ordinal + 1) w, LATERAL (SELECT coalesce(nx - w.last NOT BETWEEN 0 AND 15000000, true) AS r) rr
        JOIN s ON s.track = w.track AND s.ordinal = w.ordinal + 1)),
    t AS (SELECT *, CASE WHEN NOT ok THEN 'unavailable' WHEN p THEN 'yielding' WHEN busy THEN 'busy' ELSE 'available' END AS state FROM w)
    SELECT track, ordinal, at_us, state, state IN ('yielding', 'busy') AS block_admission FROM t""",
)
def cpu_yield(spark, folder):
    load = F.when(F.col("level") % 100 >= 40, 90.0).when(F.col("level") % 100 < 35, 50.0).otherwise(70.0)
    s = packets(spark, folder).withColumn("at_us", F.expr(f"(pts - {ORIGIN}) div 36000")).select(
        "track", "ordinal", "at_us", (F.col("event_id") % 17 != 0).alias("scoped"), F.lit(16).alias("host_cpus"), F.lit(8).alias("cpus"), load.alias("cpu_percent"), F.lit(50.0).alias("container_cpu_percent")
    )
    return plain(op.cpu_yield(s, KEYS))


@query(
    "sustained_gate",
    f"""WITH RECURSIVE {_FAST}, s AS (SELECT track, ordinal, at_us, level % 7 <> 0 AS ok FROM tick),
    w AS (SELECT track, ordinal, at_us, ok, CASE WHEN ok THEN at_us END AS since, CASE WHEN NOT ok THEN at_us END AS bad FROM s WHERE ordinal = 1
      UNION ALL SELECT s.track, s.ordinal, s.at_us, s.ok, CASE WHEN s.ok THEN CASE WHEN w.ok AND s.at_us - w.at_us BETWEEN 0 AND 40000000 THEN w.since ELSE s.at_us END END, CASE WHEN s.ok THEN w.bad ELSE s.at_us END FROM w JOIN s ON s.track = w.track AND s.ordinal = w.ordinal + 1)
    SELECT track, ordinal, at_us, ok AS healthy, coalesce(since, -1) AS healthy_since, coalesce(ok AND at_us - since >= 30000000 AND (bad IS NULL OR at_us - bad >= 60000000), false) AS open FROM w""",
)
def sustained_gate(spark, folder):
    s = packets(spark, folder).withColumn("at_us", F.expr(f"(pts - {ORIGIN}) div 36000")).select("track", "ordinal", "at_us", (F.col("level") % 7 != 0).alias("healthy"))
    return plain(op.sustained_gate(s, KEYS, gap_us=40_000_000))


@query(
    "stale_heartbeats",
    f"""WITH {_TICK}, l AS (SELECT track, max(at_us) AS updated_us, arg_max(kind, at_us) AS k, arg_max(event_id, at_us) AS e FROM tick GROUP BY track),
    j AS (SELECT *, CASE WHEN k = 'signup' THEN 'completed' WHEN e % 5 = 0 THEN 'interrupted' WHEN e % 5 < 4 AND 720000000 - updated_us < 90000000 THEN 'running' ELSE 'stale' END AS state FROM l)
    SELECT track, updated_us, state, k AS phase, CASE WHEN state = 'running' AND 720000000 - updated_us <= 30000000 THEN e % 100 ELSE -1 END AS eta FROM j""",
)
def stale_heartbeats(spark, folder):
    e = F.col("event_id")
    h = ticks(spark, folder).select(
        "track", F.col("at_us").alias("updated_us"), F.when(F.col("kind") == "signup", "completed").otherwise("running").alias("state"),
        F.when(e % 5 == 0, False).when(e % 5 < 4, True).alias("alive"), F.col("kind").alias("phase"), (e % 100).alias("eta"), F.col("at_us").alias("stage_updated_us"),
    )
    return plain(op.heartbeat_states(h, KEYS, F.lit(720_000_000)))


_HOST = """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE level % 90 END AS enc, 2 + level % 9 AS vram, 40 + level % 40 AS temp, 3 + level % 20 AS avail, 8 + level % 12 AS host, level % 95 AS cpu, level % 60 AS ccpu, level % 12 / 100.0 AS mem, level % 7 AS io FROM packet"""


def host_samples(spark, folder):
    level, e = F.col("level"), F.col("event_id")
    d = lambda c: c.cast("double")
    return packets(spark, folder).select(
        "event_id", d(F.when(e % 50 != 0, level % 90)).alias("gpu_encode_percent"), F.lit(10.0).alias("gpu_decode_percent"), F.lit(20.0).alias("gpu_compute_percent"), d(2 + level % 9).alias("vram_free_gib"),
        d(40 + level % 40).alias("gpu_temperature"), d(3 + level % 20).alias("available_gib"), d(8 + level % 12).alias("host_available_gib"), d(level % 95).alias("cpu_percent"), d(level % 60).alias("container_cpu_percent"),
        (level % 12 / 100.0).alias("memory_pressure"), d(level % 7).alias("io_pressure"), F.lit(None).cast("double").alias("host_free_gib"), F.lit(None).cast("double").alias("zfs_reclaimable_gib"),
        F.lit(None).cast("double").alias("zfs_need_free_gib"), F.lit(16.0).alias("host_cpus"), F.lit(8.0).alias("cpus"), d(level % 90).alias("gpu_percent"),
        F.lit(None).cast("double").alias("container_available_gib"), F.lit(None).cast("double").alias("container_limit_gib"),
    )


@query(
    "headroom",
    f"""WITH {PACKET_SQL}, h AS ({_HOST}) SELECT event_id, CASE WHEN enc IS NULL THEN 'telemetry unavailable' WHEN greatest(enc, 20) >= 75 THEN 'GPU engines busy' WHEN vram < 4 THEN 'insufficient VRAM headroom' WHEN temp >= 75 THEN 'GPU cooling headroom needed'
      WHEN avail < 6 OR host < 12 THEN 'insufficient RAM headroom' WHEN greatest(cpu, ccpu) > 70 THEN 'CPU allocation busy' WHEN mem >= 0.1 OR io >= 5 THEN 'memory or storage pressure' ELSE '' END AS reason,
      mem < 0.1 AND io < 5 AS pressure_ok, avail >= 5 AND host >= 6 AS memory_ok, CAST(floor(greatest(0.0, least(8.0, 16.0 - greatest(0.0, 16.0 * cpu / 100 - 8.0 * ccpu / 100) - 2.4)) * 1000 + 0.5) AS BIGINT) AS room_milli,
      CASE WHEN host < 10 THEN 'waiting for memory' WHEN cpu > 70 THEN 'waiting for CPU' WHEN ccpu > 70 THEN 'waiting for container CPU' WHEN io > 8 THEN 'waiting for storage' WHEN mem > 1 THEN 'waiting for memory pressure' WHEN coalesce(enc_raw, 0) > 75 THEN 'waiting for GPU'
        WHEN vram < 2 THEN 'waiting for GPU memory' WHEN temp >= 80 THEN 'waiting for GPU temperature' ELSE '' END AS waits FROM (SELECT h.*, level % 90 AS enc_raw FROM h JOIN packet USING (event_id))""",
)
def headroom(spark, folder):
    rows = host_samples(spark, folder).select(
        "event_id", op.headroom().alias("reason"), op.pressure_ok().alias("pressure_ok"), op.memory_room().alias("memory_ok"),
        F.floor(op.cpu_room() * 1000 + 0.5).cast("long").alias("room_milli"), op.admission("shared").alias("waits"),
    )
    return plain(rows)


@query(
    "gpu_rollup",
    f"""WITH {PACKET_SQL} SELECT track, max(greatest(level % 90, level % 50, level % 70)) AS gpu_percent, max(level % 90) AS gpu_compute_percent, max(level % 50) AS gpu_encode_percent, max(level % 70) AS gpu_decode_percent, min(size * 100) AS vram_free_mib, max(40 + level % 40) AS gpu_temperature
    FROM packet GROUP BY track""",
)
def gpu_rollup(spark, folder):
    level = F.col("level")
    s = packets(spark, folder).select(
        "track", (level % 90).alias("compute_percent"), (level % 50).alias("encode_percent"), (level % 70).alias("decode_percent"), (F.col("size") * 100).alias("vram_free_mib"), (40 + level % 40).alias("temperature")
    )
    return plain(op.gpu_rollup(s, KEYS))


@query(
    "allocated_cpu",
    f"""WITH {_TICK}, c AS (SELECT track, ordinal, at_us, sum(level * 1000) OVER (PARTITION BY track ORDER BY ordinal) AS used FROM tick),
    d AS (SELECT track, ordinal, at_us - lag(at_us) OVER t AS s, used - lag(used) OVER t AS u FROM c WINDOW t AS (PARTITION BY track ORDER BY ordinal))
    SELECT track, ordinal, CASE WHEN s > 0 THEN CAST(floor(least(100.0, 100.0::DOUBLE * u / (s * 2)) * 1000) AS BIGINT) ELSE -1 END AS milli FROM d""",
)
def allocated_cpu(spark, folder):
    from framesleuth.operators import ordered

    t = ordered.scan(ticks(spark, folder), KEYS, used_us=ordered.running_sum(F.col("level") * 1000)).select("track", "ordinal", "at_us", "used_us", F.lit(2).alias("cpus"))
    return plain(op.allocated_cpu(t, KEYS).select("track", "ordinal", F.floor(F.col("percent") * 1000).cast("long").alias("milli")))


@query(
    "advancing_activity",
    f"""WITH {PACKET_SQL}, n AS (SELECT track, ordinal, CASE event_id % 3 WHEN 0 THEN 'frames' WHEN 1 THEN 'microseconds' END AS counter, level AS value FROM packet),
    r AS (SELECT *, max(value) OVER (PARTITION BY track, counter ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM n WHERE counter IS NOT NULL)
    SELECT track, ordinal, counter, value FROM r WHERE value > coalesce(top, 0)""",
)
def advancing_activity(spark, folder):
    e = F.col("event_id")
    lines = packets(spark, folder).select("track", "ordinal", F.when(e % 3 == 0, "frame").when(e % 3 == 1, "out_time_us").otherwise("bitrate").alias("name"), F.col("level").alias("value"))
    return plain(op.advancing_activity(lines, KEYS), "track", "ordinal", "counter", "value")


@query(
    "progress_increments",
    f"""WITH {PACKET_SQL}, p AS (SELECT track, ordinal, least(1000, ordinal * 12 + level % 40) AS t FROM packet), r AS (SELECT *, max(t) OVER (PARTITION BY track ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p)
    SELECT track, ordinal, t AS tenths, greatest(0, t - coalesce(last, 0)) AS increment FROM r""",
)
def progress_increments(spark, folder):
    lines = packets(spark, folder).select("track", "ordinal", (F.col("ordinal") * 12 + F.col("level") % 40).alias("tenths"))
    return plain(op.progress_increments(lines, KEYS))


@query(
    "evidence_percent",
    f"WITH {PACKET_SQL} SELECT track, least(999, max(greatest(0, pts - {ORIGIN}) * 1000 // 2592000000000)) AS per_mille FROM packet GROUP BY track",
)
def evidence_percent(spark, folder):
    return plain(op.evidence_percent(packets(spark, folder), KEYS, F.lit(2592000000000), F.lit(ORIGIN)))


@query(
    "snapshot_freshness",
    f"""WITH {_TICK} SELECT kind AS "table", max(at_us) AS updated_us, 720000000 - max(at_us) AS age_us, 720000000 - max(at_us) BETWEEN 0 AND 89999999 AS current FROM tick GROUP BY kind""",
)
def snapshot_freshness(spark, folder):
    t = ticks(spark, folder).select(F.col("kind").alias("table"), F.col("at_us").alias("updated_us"))
    return plain(op.fresh_snapshot(t, F.lit(720_000_000)))


@query("unexpired_confirmations", f"WITH {_TICK} SELECT event_id FROM tick WHERE at_us <= 700000000 AND 700000000 < at_us + 120000000")
def unexpired_confirmations(spark, folder):
    rows = op.unexpired(ticks(spark, folder).withColumn("made_us", F.col("at_us")), F.lit(700_000_000), 120_000_000)
    return plain(rows, "event_id")
