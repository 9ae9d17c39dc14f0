"""From GPU process listings and process tables to yield states, as registered queries.

Each of 40 hosts lists its GPU processes twice a playback (an hour of events takes
a second) and its process table twice; samples ask for one or two GPUs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from framesleuth.operators import ledger, telemetry
from framesleuth.plans.evidence import _fresh
from framesleuth.plans.registry import plain, query
from framesleuth.plans.tables import FILE_SQL, file_packets
from framesleuth.plans.telemetries import ORIGIN
from framesleuth.sources import text

HALF = 360_000_000
GPUS, FRESH = 64, 120_000_000

_EVENTS = f"""{FILE_SQL}, ev AS (SELECT track AS host, event_id AS pid, ordinal, level, (pts - {ORIGIN}) // 3600 AS at_us FROM packet),
    listed AS (SELECT *, at_us // {HALF} * {HALF} AS updated_us FROM ev),
    snap AS (SELECT host, updated_us, host % 13 <> 5 AS complete FROM listed GROUP BY ALL),
    scans AS (SELECT host, pid, k * 200000000 AS taken_us, CASE WHEN pid % 7 = k THEN 0 WHEN pid % 97 = 96 THEN pid ELSE pid // 2 END AS parent, CASE WHEN pid % 53 = 0 THEN 0 ELSE pid END AS ticks FROM ev, (VALUES (0), (1)) v(k) WHERE pid % 101 <> 0 AND pid > 0)"""


@query(
    "gpu_evidence",
    f"""WITH RECURSIVE {_EVENTS},
    tree AS (SELECT DISTINCT taken_us, pid, parent FROM scans),
    w AS (SELECT taken_us, pid, pid AS node, 0 AS depth FROM tree UNION ALL SELECT w.taken_us, w.pid, t.parent, depth + 1 FROM w JOIN tree t ON t.pid = w.node AND t.taken_us = w.taken_us WHERE w.node <> 1 AND t.parent <> t.pid AND depth < 40),
    e AS (SELECT taken_us, pid, bool_or(node = 1) AS hit, bool_or(node <> 0 AND node <> 1 AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.pid = w.node AND t.taken_us = w.taken_us)) AS lost FROM w GROUP BY 1, 2),
    p AS (SELECT l.host, l.updated_us, l.pid, l.pid % {GPUS} AS gpu, CASE WHEN l.pid % 3 = 0 THEN NULL ELSE level % 8 END AS sm, CASE WHEN l.pid % 4 = 0 THEN NULL ELSE level % 3 END AS enc, 'app' || l.pid % 5 AS name,
        CASE WHEN l.pid % 19 = 0 THEN 'no' WHEN e.pid IS NULL OR l.pid % 53 = 0 THEN 'unknown' WHEN hit THEN 'yes' WHEN lost THEN 'unknown' ELSE 'no' END AS owned
      FROM listed l LEFT JOIN e ON e.pid = l.pid AND l.pid > 0 AND l.pid % 101 <> 0 AND e.taken_us = CASE WHEN updated_us >= 200000000 THEN 200000000 ELSE 0 END),
    s AS (SELECT host, ordinal, at_us, CASE WHEN pid % 17 = 0 THEN [] WHEN pid % 5 = 0 THEN [pid % {GPUS}, (pid + 1) % {GPUS}] WHEN pid % 29 = 0 THEN [999] ELSE [pid % {GPUS}] END AS wanted FROM ev),
    j AS (SELECT s.*, snap.updated_us, snap.complete FROM s ASOF LEFT JOIN snap ON s.host = snap.host AND s.at_us >= snap.updated_us),
    x AS (SELECT j.host, j.ordinal, bool_or(p.owned = 'unknown') AS unknown, bool_or(p.owned = 'no' AND greatest(sm, enc) IS NULL) AS untold, bool_or(p.owned = 'no' AND greatest(sm, enc) >= 3) AS busy,
        string_agg(DISTINCT CASE WHEN p.owned = 'no' AND greatest(sm, enc) >= 3 THEN name END, ', ' ORDER BY CASE WHEN p.owned = 'no' AND greatest(sm, enc) >= 3 THEN name END) AS names
      FROM j JOIN p ON p.host = j.host AND p.updated_us = j.updated_us AND list_contains(j.wanted, p.gpu) GROUP BY 1, 2),
    r AS (SELECT j.host, j.ordinal, j.at_us, names, busy, CASE WHEN updated_us IS NULL THEN 'no snapshot' WHEN NOT complete THEN 'snapshot is incomplete' WHEN at_us - updated_us > {FRESH} THEN 'snapshot is stale' WHEN len(wanted) = 0 OR list_contains(wanted, 999) THEN 'a wanted GPU was not seen'
        WHEN unknown THEN 'owner of a process is unknown' WHEN untold THEN 'usage of a process is unknown' ELSE '' END AS reason FROM j LEFT JOIN x USING (host, ordinal))
    SELECT host, ordinal, at_us, reason = '' AS usable, reason = '' AND coalesce(busy, false) AS external, CASE WHEN reason = '' AND busy THEN names ELSE '' END AS names, reason FROM r""",
)
def gpu_evidence(spark, folder):
    """Process listings as text, ids of GPUs, and two process tables a host, to what a policy may know at every sample."""
    p = file_packets(spark, folder).select(F.col("track").alias("host"), F.col("event_id").alias("pid"), "ordinal", "level", F.expr(f"(pts - {ORIGIN}) div 3600").alias("at_us"))
    p = p.withColumn("updated_us", F.expr(f"at_us div {HALF}") * HALF)
    pid, level = F.col("pid"), F.col("level")
    shown = lambda value, unknown: F.when(unknown, "-").otherwise(value.cast("string"))
    row = F.concat_ws("  ", (pid % GPUS).cast("string"), pid.cast("string"), F.lit("C"), shown(level % 8, pid % 3 == 0), shown(level % 3, pid % 4 == 0), F.lit("-"), F.concat(F.lit("app"), (pid % 5).cast("string")))
    listing = _fresh(spark, "listing")
    heads = p.select("host", "updated_us", F.lit(0).cast("long").alias("ordinal"), F.lit("# gpu pid type sm enc dec command").alias("value")).distinct()
    body = p.select("host", "updated_us", "ordinal", row.alias("value"))
    heads.unionByName(body).repartition(8, "host", "updated_us").sortWithinPartitions("host", "updated_us", "ordinal").select("host", "updated_us", "value").write.partitionBy("host", "updated_us").text(listing)
    ids = _fresh(spark, "ids")
    spark.range(GPUS).select(F.concat(F.col("id").cast("string"), F.lit(", GPU-"), F.col("id").cast("string")).alias("value")).coalesce(1).write.text(ids)  # one line a GPU

    named = lambda df: df.withColumns({"host": F.regexp_extract("file", r"host=(\d+)/", 1).cast("long"), "updated_us": F.regexp_extract("file", r"updated_us=(\d+)/", 1).cast("long")})
    lines = text.read_lines(spark, listing)
    known = text.gpu_ids(text.read_lines(spark, ids)).select("gpu", "gpu_id")
    rows = named(text.process_table(lines).join(known, "gpu", "left"))
    seen = F.array([F.lit(f"GPU-{k}") for k in range(GPUS)])
    snapshots = named(text.process_verdict(lines)).select("host", "updated_us", (F.col("reason").isNull() & (F.col("host") % 13 != 5)).alias("complete"), seen.alias("gpus"))

    # The owner's process tables, taken twice; a listing is judged by the latest one before it.
    scans = p.where((pid > 0) & (pid % 101 != 0)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    parent = F.when(pid % 7 == F.col("k"), 0).when(pid % 97 == 96, pid).otherwise(F.expr("pid div 2"))
    scans = scans.select((F.col("k") * 200_000_000).cast("long").alias("taken_us"), "pid", parent.alias("parent"), F.when(pid % 53 == 0, 0).otherwise(pid).alias("start_ticks")).distinct()
    taken = scans.select("taken_us").distinct().withColumn("all", F.lit(1))
    dated = telemetry.latest_before(rows.withColumn("all", F.lit(1)), taken, ["all"], "updated_us", "taken_us")
    dated = dated.withColumns({"namespace": F.when(F.col("pid") % 19 == 0, "ns2").otherwise("ns1"), "start_ticks": F.col("pid")})
    owned = ledger.owned_processes(dated, scans, 1, "ns1", ["taken_us"])
    processes = owned.select("host", "updated_us", F.col("gpu_id").alias("gpu"), "name", "owned", "sm", "enc", "dec")

    gpu = lambda k: F.concat(F.lit("GPU-"), ((pid + k) % GPUS).cast("string"))
    wanted = F.when(pid % 17 == 0, F.array().cast("array<string>")).when(pid % 5 == 0, F.array(gpu(0), gpu(1))).when(pid % 29 == 0, F.array(F.lit("GPU-999"))).otherwise(F.array(gpu(0)))
    samples = p.select("host", "ordinal", "at_us", wanted.alias("wanted"))
    found = telemetry.gpu_evidence(samples, snapshots, processes, ["host"], FRESH)
    return plain(found.select("host", "ordinal", "at_us", "usable", "external", "names", "reason"))
