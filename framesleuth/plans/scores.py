"""Real frame scores and JSON documents of any layout, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesleuth.operators import trials as op
from framesleuth.plans.evidence import ORIGIN, _fresh, _group, _write_lines
from framesleuth.plans.registry import plain, query
from framesleuth.plans.tables import FILE_SQL, PACKET_SQL, file_packets, packets
from framesleuth.sources import json_arrays, text

#: Six decimals between 85 and 99; some tracks hold a NaN or an infinity, or one frame too few.
_SCORE = "(85000000 + event_id * 7919 % 14000000) / 1000000.0::DOUBLE"
_POOL_SQL = """SELECT *, row_number() OVER (PARTITION BY track ORDER BY micro) AS r, count(*) OVER (PARTITION BY track) AS n FROM g"""


def _micro(shift: int = 0):
    return 85_000_000 + F.pmod(F.col("event_id") * 7919 + shift, F.lit(14_000_000))


@query(
    "score_pool_real",
    f"""WITH {PACKET_SQL}, g AS (SELECT track, ordinal, 85000000 + event_id * 7919 % 14000000 AS micro, ordinal = 2 AND track % 13 IN (0, 1) AS bad FROM packet), o AS ({_POOL_SQL}),
    t AS (SELECT track, count(*) AS frames, count(*) FILTER (bad) AS invalid, CAST(sum(micro) AS BIGINT) AS micro_sum, min(micro) FILTER (r >= greatest(1, (n + 19) // 20)) AS p5 FROM o GROUP BY track),
    c AS (SELECT *, invalid = 0 AND track % 19 <> 0 AS complete FROM t)
    SELECT track, frames, invalid, CASE WHEN complete THEN micro_sum ELSE -1 END AS micro_sum, CASE WHEN complete THEN micro_sum // frames ELSE -1 END AS mean_micro, CASE WHEN complete THEN p5 ELSE -1 END AS p5_micro,
      complete, complete AND micro_sum >= 92000000 * frames AND p5 >= 85700000 AS passed FROM c""",
)
def score_pool_real(spark, folder):
    p = packets(spark, folder)
    bad = F.when((F.col("ordinal") == 2) & (F.col("track") % 13 == 0), float("nan")).when((F.col("ordinal") == 2) & (F.col("track") % 13 == 1), float("inf"))
    scores = p.select("track", F.coalesce(bad, _micro() / F.lit(1_000_000.0)).alias("score"))
    expected = p.groupBy("track").agg(F.count(F.lit(1)).alias("n")).select("track", (F.col("n") + (F.col("track") % 19 == 0).cast("int")).alias("expected_frames"))
    pooled = op.pool_real_scores(scores, ["track"], "92", 85.7, expected)
    micro = (F.col("score_sum") * 1_000_000).cast("decimal(38,0)")
    return plain(pooled.select(
        "track", "frames", "invalid", micro.cast("long").alias("micro_sum"), F.call_function("div", micro, F.col("frames")).cast("long").alias("mean_micro"),
        F.round(F.col("p5") * 1_000_000).cast("long").alias("p5_micro"), "complete", "passed",
    ))


@query(
    "scorer_parity_real",
    f"""WITH {PACKET_SQL}, g AS (SELECT track, ordinal, 85000000 + event_id * 7919 % 14000000 AS a, 85000000 + event_id * 7919 % 14000000 + CASE WHEN track % 7 = 0 AND ordinal = 3 THEN 101 ELSE event_id % 100 END AS b, track % 13 = 0 AND ordinal = 2 AS bad FROM packet),
    r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY a) AS ra, row_number() OVER (PARTITION BY track ORDER BY b) AS rb, count(*) OVER (PARTITION BY track) AS n FROM g),
    t AS (SELECT track, count(*) AS frames, NOT bool_or(bad) AS whole, max(b - a) AS gap, sum(a) >= 92000000 * count(*) AND min(a) FILTER (ra >= greatest(1, (n + 19) // 20)) >= 85700000 AS lp, sum(b) >= 92000000 * count(*) AND min(b) FILTER (rb >= greatest(1, (n + 19) // 20)) >= 85700000 AS rp FROM r GROUP BY track)
    SELECT track, frames, CAST(0 AS BIGINT) AS unpaired, CASE WHEN whole THEN gap ELSE -1 END AS gap_micro, lp AS left_passed, whole AND rp AS right_passed, whole AND gap <= 100 AND lp = rp AS passed FROM t""",
)
def scorer_parity_real(spark, folder):
    p = packets(spark, folder)
    apart = F.when((F.col("track") % 7 == 0) & (F.col("ordinal") == 3), 101).otherwise(F.col("event_id") % 100)
    left = p.select("track", F.col("ordinal").alias("frame_no"), (_micro() / F.lit(1_000_000.0)).alias("score"))
    right = p.select("track", F.col("ordinal").alias("frame_no"), F.when((F.col("track") % 13 == 0) & (F.col("ordinal") == 2), float("nan")).otherwise((_micro() + apart) / F.lit(1_000_000.0)).alias("score"))
    rows = op.real_scorer_parity(left, right, ["track"], "92", 85.7, 0.0001000001)
    return plain(rows.select("track", "frames", "unpaired", F.round(F.col("max_difference") * 1_000_000).cast("long").alias("gap_micro"), "left_passed", "right_passed", "passed"))


def _documents(spark, folder, label, array, record, cut=None):
    """One document a track: pretty, on one line or compact by track; ``cut`` tracks are not closed."""
    p = file_packets(spark, folder)
    layout, last = F.col("track") % 3, F.col("dur").isNull()
    feed = F.when(layout == 1, F.lit("")).otherwise(F.lit("\n"))
    spaced = F.when(layout == 0, F.regexp_replace(F.regexp_replace(record, ",", ",\n    "), r"\{", "{\n    ")).otherwise(record)
    closed = F.lit(True) if cut is None else ~cut
    text_ = F.concat(
        F.when(F.col("ordinal") == 1, F.concat(F.lit(f'{{"made": {{"by": ["x", {{"v": "1]}}"}}]}},'), feed, F.lit(f'"{array}"'), F.when(layout == 0, " : [\n").otherwise(":["))).otherwise(F.lit("")),
        spaced, F.when(~last, F.concat(F.lit(","), feed)).when(closed, F.concat(feed, F.lit("]"), feed, F.lit("}"))).otherwise(F.lit("")),
    )
    path = _fresh(spark, label)
    # Lines of a file are joined by line feeds only where its layout has them.
    joined = p.select("track", "ordinal", text_.alias("value"))
    # A file is written by one task, which is given no other file once files are long.
    tasks = max(8, p.count() // 50_000)  # from the footers
    joined.repartitionByRange(tasks, "track").sortWithinPartitions("track", "ordinal").select("track", "value").write.partitionBy("track").option("lineSep", " ").text(path)
    return path



@query(
    "frame_json_layouts",
    f"""WITH {FILE_SQL} SELECT track, ordinal, '{{"note": "a}}\\"b[{{' || event_id % 9 || '", "pts": ' || (pts - {ORIGIN}) || ', "side": ' || CASE WHEN event_id % 2 = 0 THEN '[1, 2]' ELSE '1' END || '}}' AS record, CASE WHEN track % 11 = 0 THEN 'truncated' ELSE '' END AS reason FROM packet""",
)
def frame_json_layouts(spark, folder):
    e = F.col("event_id")
    record = F.concat(F.lit('{"pts":'), (F.col("pts") - ORIGIN).cast("string"), F.lit(',"side":1'), F.when(e % 2 == 0, ',"side":2').otherwise(""), F.lit(',"note":"a}\\"b[{'), (e % 9).cast("string"), F.lit('"}'))
    # The pretty layout breaks lines after braces, so its note is written without one there.
    record = F.when(F.col("track") % 3 == 0, F.concat(F.lit('{"pts":'), (F.col("pts") - ORIGIN).cast("string"), F.lit(',"side":1'), F.when(e % 2 == 0, ',"side":2').otherwise(""), F.lit(',"note":"a}\\"b[\\u007b'), (e % 9).cast("string"), F.lit('"}'))).otherwise(record)
    path = _documents(spark, folder, "layouts", "frames", record, F.col("track") % 11 == 0)
    records, status = text.frame_array(spark, path)
    return plain(records.join(status, "file").select(_group(), "ordinal", "record", "reason"))


@query(
    "score_files",
    f"""WITH {FILE_SQL}, g AS (SELECT track, ordinal, 85000000 + event_id * 7919 % 14000000 AS micro FROM packet), o AS ({_POOL_SQL}),
    t AS (SELECT track, count(*) AS n, CAST(sum(micro) AS BIGINT) AS micro_sum, min(micro) FILTER (r >= greatest(1, (n + 19) // 20)) AS p5, track % 11 <> 0 AND track % 13 <> 0 AS complete FROM o GROUP BY track)
    SELECT track, CASE WHEN track % 11 = 0 THEN 1 ELSE n END AS frames, CASE WHEN complete THEN micro_sum ELSE -1 END AS micro_sum, CASE WHEN complete THEN p5 ELSE -1 END AS p5_micro, complete AND micro_sum >= 92000000 * n AND p5 >= 85700000 AS passed FROM t""",
)
def score_files(spark, folder):
    score = F.when((F.col("track") % 13 == 0) & (F.col("ordinal") == 1), "NaN").otherwise(F.format_string("%d.%06d", F.expr("(85000000 + event_id * 7919 % 14000000) div 1000000"), F.expr("(85000000 + event_id * 7919 % 14000000) % 1000000")))
    record = F.concat(F.lit('{"frameNum":'), F.col("ordinal").cast("string"), F.lit(',"metrics":{"motion":1.5,"vmaf":'), score, F.lit("}}"))
    scores = text.score_files(spark, _documents(spark, folder, "scores", "frames", record, F.col("track") % 11 == 0))
    pooled = op.pool_real_scores(scores.withColumn("track", F.regexp_extract("file", r"track=(\d+)/", 1).cast("long")), ["track"], "92", 85.7)
    return plain(pooled.select("track", "frames", (F.col("score_sum") * 1_000_000).cast("decimal(38,0)").cast("long").alias("micro_sum"), F.round(F.col("p5") * 1_000_000).cast("long").alias("p5_micro"), "passed"))


@query(
    "scene_documents",
    f"""WITH {FILE_SQL} SELECT track, ordinal, ordinal - 1 + CASE WHEN event_id % 457 = 0 THEN 1 ELSE 0 END AS frame_index, '' AS reason FROM packet
    UNION ALL SELECT track, -1, -1, 'truncated' FROM packet WHERE track % 11 = 0 GROUP BY track""",
)
def scene_documents(spark, folder):
    index = F.col("ordinal") - 1 + F.when(F.col("event_id") % 457 == 0, 1).otherwise(0)
    record = F.concat(F.lit('{"Luma":{"Max":[1,2],"Names":"]}"},"SequenceFrameIndex":'), index.cast("string"), F.lit("}"))
    scenes = text.scene_records(spark, _documents(spark, folder, "scene-docs", "SceneInfo", record, F.col("track") % 11 == 0))
    return plain(scenes.select(_group(), "ordinal", "frame_index", "reason"))


@query(
    "status_array",
    f"""WITH {FILE_SQL}, g AS (SELECT track, max(event_id) AS last, count(*) AS n FROM packet GROUP BY track) SELECT row_number() OVER (ORDER BY track) AS ordinal, track, last, n FROM g""",
)
def status_array(spark, folder):
    """All status documents in one file, as one array; several tasks read it."""
    g = file_packets(spark, folder).groupBy("track").agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))
    path = _fresh(spark, "status-array")
    low, high = g.agg(F.min("track"), F.max("track")).first()
    line = F.concat(F.when(F.col("track") == low, "[").otherwise(""), F.to_json(F.struct("track", "last", "n")), F.when(F.col("track") == high, "]").otherwise(","))
    g.coalesce(1).sortWithinPartitions("track").select(line.alias("value")).write.text(path)  # a row for each of 40 tracks
    rows = json_arrays.array_records(spark, path)
    parsed = rows.select("ordinal", F.from_json("record", "track long, last long, n long").alias("d"))
    return plain(parsed.select("ordinal", "d.*"))
