"""Source-versus-copy queries over the packet tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesleuth.operators import compare
from framesleuth.plans.registry import near_sql, plain, query, reasons_sql, verdict_sql, zip_sql
from framesleuth.plans.tables import COPY_SQL, PACKET_SQL, damaged_packets, frames, packets

KEYS = ["track"]
VERDICT = ["track", "rows_checked", "failures", "first_bad_ordinal", "reason", "status"]


def _judged(cte: str, zipped: str, *checks: tuple[str, str]) -> str:
    return f"WITH {cte}, zipped AS ({zipped}), judged AS (SELECT *, {reasons_sql(*checks)} AS reason FROM zipped) "


_PACKET_CHECKS = [("a_here AND b_here AND a_hash = b_hash", "payload or count changed")] + [
    (near_sql(f), f"timing changed: {f}") for f in ("pts", "dts", "dur")
]


@query(
    "packet_copy_verdict",
    _judged(COPY_SQL, zip_sql("packet", "copied", "hash pts dts dur"), *_PACKET_CHECKS) + verdict_sql("judged"),
)
def packet_copy_verdict(spark, folder):
    result = compare.compare_packets(packets(spark, folder), damaged_packets(spark, folder), KEYS)
    return plain(result, *VERDICT)


_DROPPED = [_PACKET_CHECKS[0], _PACKET_CHECKS[1], _PACKET_CHECKS[2], (near_sql("dur") + " OR (b_dur IS NULL AND a_dur > 0)", "timing changed: dur")]


@query(
    "packet_copy_allowed_durations",
    _judged(COPY_SQL, zip_sql("packet", "copied", "hash pts dts dur"), *_DROPPED) + verdict_sql("judged"),
)
def packet_copy_allowed_durations(spark, folder):
    result = compare.compare_packets(packets(spark, folder), damaged_packets(spark, folder), KEYS, durations_dropped=True)
    return plain(result, *VERDICT)


_SAME = lambda f: f"a_{f} IS NOT DISTINCT FROM b_{f}"
_AAC = "track % 2 = 0"
_STRICT = [("a_here AND b_here", "packet count changed")]
_STRICT += [(_SAME(f), f"bytes, sequence or timestamps changed: {f}") for f in ("dts", "hash", "pts", "size")]
_STRICT += [
    (f"{_SAME('dur')} OR {_AAC}", "unexpected duration change"),
    (f"{_SAME('dur')} OR a_dur > 0", "invalid source duration"),
    (f"{_SAME('dur')} OR b_dur IS NULL OR (b_dur > 0 AND abs(a_dur - b_dur) <= 1000)", "duration change exceeds 1 ms"),
]


@query(
    "packet_copy_counts",
    _judged(COPY_SQL, zip_sql("packet", "copied", "hash size pts dts dur"), *_STRICT)
    + verdict_sql("judged", extra=f", count(*) FILTER (WHERE reason IS NULL AND NOT ({_SAME('dur')})) AS rounded"),
)
def packet_copy_counts(spark, folder):
    source = packets(spark, folder)
    streams = source.select("track").distinct().select(
        "track", F.lit("audio").alias("codec_type"), F.when(F.col("track") % 2 == 0, "aac").otherwise("ac3").alias("codec"),
        F.lit("1/1000").alias("time_base"),
    )
    return plain(compare.compare_tracks_strict(source, damaged_packets(spark, folder), KEYS, streams), *VERDICT, "rounded")


_INFER = "(a_dur IS NULL) <> (b_dur IS NULL) AND a_next_pts - a_pts > 0 AND abs(a_next_pts - a_pts - coalesce(a_dur, b_dur)) <= 2000"


@query(
    "packet_copy_inferred",
    _judged(
        COPY_SQL + """,
        l AS (SELECT *, kind AS side_key, lead(pts) OVER (PARTITION BY track ORDER BY ordinal) AS next_pts FROM packet),
        r AS (SELECT *, kind AS side_key, NULL AS next_pts FROM copied)""",
        zip_sql("l", "r", "hash size pts dts dur side_key next_pts"),
        ("a_here AND b_here", "packet count changed"),
        ("a_hash = b_hash", "payload changed"),
        (_SAME("side_key"), "side data changed"),
        (f"{_SAME('pts')} AND {_SAME('dts')} AND {_SAME('size')} AND ({_SAME('dur')} OR coalesce({_INFER}, false))", "timing changed"),
    )
    + verdict_sql("judged", extra=f", count(*) FILTER (WHERE reason IS NULL AND coalesce({_INFER}, false)) AS inferred"),
)
def packet_copy_inferred(spark, folder):
    left = packets(spark, folder).withColumn("side_key", F.col("kind"))
    right = damaged_packets(spark, folder).withColumn("side_key", F.col("kind"))
    return plain(compare.compare_tracks_inferred(left, right, KEYS), *VERDICT, "inferred")


@query(
    "track_pairing",
    """WITH b AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '5-LOW', o_orderkey) AS position,
         o_orderkey AS source_index, o_orderpriority AS source_codec FROM orders),
       a AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '5-LOW', o_orderkey) AS position,
         o_orderkey AS output_index, o_orderpriority AS output_codec FROM orders WHERE o_orderkey % 40 <> 0)
       SELECT coalesce(b.file, a.file) AS file, coalesce(b.position, a.position) AS position, coalesce(source_index, -1) AS source_index,
         coalesce(output_index, -1) AS output_index, coalesce(source_codec, '') AS source_codec, coalesce(output_codec, '') AS output_codec,
         CASE WHEN source_index IS NULL OR output_index IS NULL THEN 'track count changed' ELSE '' END AS reason
       FROM b FULL JOIN a ON b.file = a.file AND b.position = a.position""",
)
def track_pairing(spark, folder):
    from framesleuth.plans.tables import table

    streams = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("stream_index"), F.col("o_orderpriority").alias("codec"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_cover"),
    )
    return plain(compare.pair_streams(streams, streams.where(F.col("stream_index") % 40 != 0), ["file"]))


# Decoded frames.  The copy's frames differ in width, colour or scan in places.
_FRAME_SQL = COPY_SQL + """,
fa AS (SELECT track, ordinal, event_id, pts, pos AS pkt_pos, CASE WHEN kind = 'view' THEN 'unknown' ELSE 'tv' END AS color_range,
    pts > lag(pts, 1, -1) OVER (PARTITION BY track ORDER BY ordinal) AS rising FROM packet),
fb AS (SELECT track, ordinal, event_id, pts, pos AS pkt_pos, CASE WHEN event_id % 89 = 0 THEN 'pc' WHEN kind = 'view' THEN 'unknown' ELSE 'tv' END AS color_range,
    CASE WHEN event_id % 499 = 0 THEN 1280 ELSE 1920 END AS width, CASE WHEN event_id % 199 = 0 THEN 1 ELSE 0 END AS repeat_pict,
    pts > lag(pts, 1, -1) OVER (PARTITION BY track ORDER BY ordinal) AS rising FROM copied),
zf AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.ordinal, b.ordinal) AS ordinal, a.ordinal IS NOT NULL AND b.ordinal IS NOT NULL AS here,
    b.width = 1920 AS same_width, a.color_range AS a_range, b.color_range AS b_range, b.repeat_pict = 0 AS same_repeat,
    a.rising AS a_rising, b.rising AS b_rising, abs(a.pts - b.pts) <= 2000 AS near, abs(a.pts - b.pts) AS delta
  FROM fa a FULL JOIN fb b ON a.track = b.track AND a.ordinal = b.ordinal)"""


def _copied_frames(spark, folder):
    f = frames(damaged_packets(spark, folder))
    return f.withColumns({
        "width": F.when(F.col("event_id") % 499 == 0, 1280).otherwise(1920),
        "repeat_pict": F.when(F.col("event_id") % 199 == 0, 1).otherwise(0),
        "color_range": F.when(F.col("event_id") % 89 == 0, "pc").otherwise(F.col("color_range")),
        "sar": F.lit("1/1"),
        "side": F.array(F.create_map(F.lit("side_data_type"), F.lit("Mastering display metadata"), F.lit("red_x"), F.lit("177/250"))),
    })


def _frame_sql(*checks, extra=""):
    return f"WITH {_FRAME_SQL}, judged AS (SELECT *, {reasons_sql(*checks)} AS reason FROM zf) " + verdict_sql("judged", extra=extra)


@query(
    "frame_timeline_compare",
    _frame_sql(
        ("here", "frame count changed"), ("same_width", "geometry changed: width"),
        ("a_range = 'unknown' OR a_range = b_range", "color changed: color_range"), ("same_repeat", "scan changed: repeat_pict"),
        ("a_rising", "source timestamps do not increase"), ("b_rising", "output timestamps do not increase"), ("near", "frame timing changed"),
    ),
)
def frame_timeline_compare(spark, folder):
    return plain(compare.compare_frames_sdr(frames(packets(spark, folder)), _copied_frames(spark, folder), KEYS), *VERDICT)


@query(
    "frame_hdr_compare",
    _frame_sql(
        ("here", "frame count changed"), ("same_width", "missing or changed: width"),
        ("a_range <> 'unknown' AND a_range = b_range", "missing or changed: color_range"), ("same_repeat", "unconfirmed progressive frame"),
        ("near AND a_rising AND b_rising", "timestamp changed or not increasing"),
        extra=", coalesce(max(delta), -1) AS max_delta_us",
    ),
)
def frame_hdr_compare(spark, folder):
    pq = lambda df: df.withColumn("color_transfer", F.lit("smpte2084"))
    result = compare.compare_frames_hdr(pq(frames(packets(spark, folder))), pq(_copied_frames(spark, folder)), KEYS, "hdr10")
    return plain(result, *VERDICT, "max_delta_us")


@query(
    "frame_layered_compare",
    _frame_sql(
        ("here", "frame count changed"), ("near", "frame timing changed"), ("a_rising AND b_rising", "timeline not increasing"),
        ("same_width AND a_range = b_range", "geometry, aspect or color changed"),
        extra=", count(*) FILTER (WHERE reason IS NULL AND ordinal % 2 = 0) AS rounded_frames",
    ),
)
def frame_layered_compare(spark, folder):
    def side(df, red):
        entry = F.create_map(F.lit("side_data_type"), F.lit("Mastering display metadata"), F.lit("red_x"), red)
        return df.withColumn("side", F.array(entry))

    a = side(frames(packets(spark, folder)), F.lit("35400/50000"))
    b = side(_copied_frames(spark, folder), F.when(F.col("ordinal") % 2 == 0, "35401/50000").otherwise("35400/50000"))
    return plain(compare.compare_frames_layered(a, b, KEYS), *VERDICT, "rounded_frames")


@query(
    "decoded_audio_compare",
    _judged(
        COPY_SQL + """,
        l AS (SELECT *, pts > lag(pts, 1, -1) OVER (PARTITION BY track ORDER BY ordinal) AS rising FROM packet),
        r AS (SELECT *, pts > lag(pts, 1, -1) OVER (PARTITION BY track ORDER BY ordinal) AS rising FROM copied)""",
        zip_sql("l", "r", "dur size hash pts rising"),
        ("a_here AND b_here", "decoded frame count changed"),
        (f"{_SAME('dur')} AND {_SAME('size')} AND a_hash = b_hash", "decoded payload or sample count changed"),
        ("abs(a_pts - b_pts) <= 2000", "presentation timing changed"),
        ("a_rising AND b_rising", "timeline not increasing"),
    )
    + verdict_sql("judged", extra=", coalesce(max(abs(a_pts - b_pts)), -1) AS max_delta_us"),
)
def decoded_audio_compare(spark, folder):
    result = compare.compare_decoded_audio(packets(spark, folder), damaged_packets(spark, folder), KEYS)
    return plain(result, *VERDICT, "max_delta_us")


# A 90 kHz source clock against a 1 ms output clock.
@query(
    "clock_rescale_join",
    f"""WITH {PACKET_SQL},
    s AS (SELECT track, event_id, (pts - 1704067200000000) * 9 // 100 AS t, coalesce(dur, 40000) * 9 // 100 AS d FROM packet),
    a AS (SELECT track, (2 * t * 1000 + 90000) // 180000 AS tick, d * 1000 // 90000 AS span FROM s),
    b AS (SELECT track, (2 * t * 1000 + 90000) // 180000 + CASE WHEN event_id % 701 = 0 THEN 1 ELSE 0 END AS tick,
          d * 1000 // 90000 AS span FROM s WHERE event_id % 997 <> 0),
    ga AS (SELECT track, tick, count(*) AS n, min(span) AS span FROM a GROUP BY 1, 2),
    gb AS (SELECT track, tick, count(*) AS n, min(span) AS span FROM b GROUP BY 1, 2),
    judged AS (SELECT coalesce(ga.track, gb.track) AS track, coalesce(ga.tick, gb.tick) AS ordinal,
      CASE WHEN coalesce(ga.n, 0) > 1 OR coalesce(gb.n, 0) > 1 THEN 'presentation timestamps are not unique'
           WHEN ga.n IS NULL OR gb.n IS NULL THEN 'clocks do not project exactly'
           WHEN ga.span <= 0 OR gb.span <= 0 THEN 'duration is unresolved'
           WHEN ga.span <> gb.span THEN 'clocks do not project exactly' END AS reason
      FROM ga FULL JOIN gb ON ga.track = gb.track AND ga.tick = gb.tick)
    """ + verdict_sql("judged"),
)
def clock_rescale_join(spark, folder):
    fine = packets(spark, folder).select(
        "track", "event_id", F.expr("(pts - 1704067200000000) * 9 div 100").alias("pts_ticks"), F.expr("coalesce(dur, 40000) * 9 div 100").alias("dur_ticks"),
        F.lit(1).alias("base_num"), F.lit(90000).alias("base_den"),
    )
    coarse = fine.where(F.col("event_id") % 997 != 0).select(
        "track",
        (F.expr("(2 * pts_ticks * 1000 + 90000) div 180000") + F.when(F.col("event_id") % 701 == 0, 1).otherwise(0)).alias("pts_ticks"),
        F.expr("dur_ticks * 1000 div 90000").alias("dur_ticks"), F.lit(1).alias("base_num"), F.lit(1000).alias("base_den"),
    )
    return plain(compare.compare_clocks(fine, coarse, KEYS), *VERDICT)


@query(
    "materialised_durations",
    f"""WITH {PACKET_SQL},
    l AS (SELECT track, ordinal, hash, pts, dts, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE dur END AS dur FROM packet WHERE dur IS NOT NULL),
    r AS (SELECT track, ordinal, hash, pts, dts, CASE WHEN ordinal % 5 = 0 THEN dur // 1000 * 1000 + CASE WHEN event_id % 97 = 0 THEN 1000 ELSE 0 END ELSE dur END AS dur
          FROM packet WHERE dur IS NOT NULL),
    f AS (SELECT track, ordinal, pts, dur FROM packet WHERE dur IS NOT NULL AND event_id % 499 <> 0),
    z AS ({zip_sql("l", "r", "hash pts dts dur")}),
    j AS (SELECT z.*, f.pts AS f_pts, f.dur AS f_dur, f.ordinal IS NOT NULL AS f_here, a_dur IS NULL AND b_dur IS NOT NULL AS filled
          FROM z LEFT JOIN f ON z.track = f.track AND z.ordinal = f.ordinal),
    judged AS (SELECT *, {reasons_sql(
        ("a_here AND b_here AND f_here", "packet and frame association incomplete"),
        ("a_hash = b_hash", "payload changed"),
        ("abs(a_pts - b_pts) <= 2000 AND abs(a_dts - b_dts) <= 2000", "clock changed"),
        ("abs(a_pts - f_pts) <= 2000", "packet does not match decoded frame"),
        ("NOT filled OR (f_dur // 1000 * 1000 > 0 AND b_dur = f_dur // 1000 * 1000)", "duration is not the decoded projection"),
    )} AS reason FROM j),
    v AS ({verdict_sql("judged", extra=", count(*) FILTER (WHERE reason IS NULL AND filled) AS materialised")})
    SELECT track, rows_checked, failures, first_bad_ordinal, materialised,
      CASE WHEN status = 'pass' AND materialised = 0 THEN 'no materialised durations' ELSE reason END AS reason,
      CASE WHEN status = 'pass' AND materialised = 0 THEN 'fail' ELSE status END AS status FROM v""",
)
def materialised_durations(spark, folder):
    p = packets(spark, folder).where(F.col("dur").isNotNull())
    fifth = F.col("ordinal") % 5 == 0
    left = p.withColumn("dur", F.when(~fifth, F.col("dur")))
    wrong = F.when(F.col("event_id") % 97 == 0, 1000).otherwise(0)
    right = p.withColumn("dur", F.when(fifth, F.expr("dur div 1000 * 1000") + wrong).otherwise(F.col("dur")))
    decoded = p.where(F.col("event_id") % 499 != 0)
    result = compare.materialised_durations(left, right, decoded, KEYS, F.lit(1000))
    return plain(result, *VERDICT, "materialised")


@query(
    "rounding_normalised",
    f"""WITH {PACKET_SQL},
    f AS (SELECT track, ordinal, pts, level + 1 AS samples FROM packet),
    l AS (SELECT track, ordinal, pts, (level + 1) * 1000 // 48000 AS dur FROM packet),
    r AS (SELECT track, ordinal, pts, ((level + 1) * 1000 + 47999) // 48000 + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS dur FROM packet),
    z AS ({zip_sql("l", "r", "pts dur")}),
    j AS (SELECT z.*, samples, samples * 1000 // 48000 AS low, (samples * 1000 + 47999) // 48000 AS high, f.pts = a_pts AND f.pts = b_pts AS timed
          FROM z JOIN f ON z.track = f.track AND z.ordinal = f.ordinal),
    judged AS (SELECT *, {reasons_sql(
        ("timed", "decoded frame timing changed"), ("samples > 0", "invalid decoded sample count"),
        ("a_dur = b_dur OR (a_dur IN (low, high) AND b_dur IN (low, high))", "duration difference exceeds rounding"),
    )} AS reason FROM j) """
    + verdict_sql("judged", extra=", count(*) FILTER (WHERE reason IS NULL AND a_dur <> b_dur) AS rounded"),
)
def rounding_normalised(spark, folder):
    p = packets(spark, folder).withColumn("samples", F.col("level") + 1)
    left = p.withColumn("dur", F.expr("samples * 1000 div 48000"))
    wrong = F.when(F.col("event_id") % 211 == 0, 1).otherwise(0)
    right = p.withColumn("dur", F.expr("(samples * 1000 + 47999) div 48000") + wrong)
    decoded = p.select("track", "ordinal", "pts", "samples", F.lit(48000).alias("rate"), F.lit(1).alias("tick_num"), F.lit(1000).alias("tick_den"))
    return plain(compare.normalise_rounding(left, right, decoded, KEYS), *VERDICT, "rounded")


@query(
    "timeline_match",
    f"""WITH {COPY_SQL},
    l AS (SELECT track, pts, row_number() OVER (PARTITION BY track ORDER BY pts, ordinal) AS ordinal, min(pts) OVER (PARTITION BY track) AS first FROM packet
          WHERE pts >= 1704067200000000 AND pts < 1706054400000000),
    r AS (SELECT track, pts, row_number() OVER (PARTITION BY track ORDER BY pts, ordinal) AS ordinal, min(pts) OVER (PARTITION BY track) AS first FROM copied
          WHERE pts < 1706054400000000),
    z AS ({zip_sql("l", "r", "pts first")}),
    judged AS (SELECT *, {reasons_sql(
        ("a_here AND b_here", "count changed"), ("abs((a_pts - a_first) - (b_pts - b_first)) <= 2000", "timeline changed"),
    )} AS reason FROM z) """ + verdict_sql("judged"),
)
def timeline_match(spark, folder):
    end = 1706054400000000
    out = damaged_packets(spark, folder).where(F.col("pts") < end)
    return plain(compare.matching_timeline(packets(spark, folder), out, KEYS, F.lit(1704067200000000), F.lit(end)), *VERDICT)


@query(
    "timeline_mismatches",
    f"""WITH {COPY_SQL}, z AS ({zip_sql("packet", "copied", "pts")}),
    t AS (SELECT track, count(*) FILTER (WHERE a_here) AS source_count, count(*) FILTER (WHERE b_here) AS output_count,
          count(*) FILTER (WHERE a_here AND b_here AND abs(b_pts - a_pts) > 2000) AS mismatch_count FROM z GROUP BY track),
    f AS (SELECT track, string_agg(CAST(ordinal AS VARCHAR) || ':' || CAST(d AS VARCHAR), ',' ORDER BY ordinal) AS first_mismatches FROM
          (SELECT track, ordinal, b_pts - a_pts AS d, row_number() OVER (PARTITION BY track ORDER BY ordinal) AS n FROM z
           WHERE a_here AND b_here AND abs(b_pts - a_pts) > 2000) WHERE n <= 20 GROUP BY track)
    SELECT t.*, coalesce(first_mismatches, '') AS first_mismatches,
      source_count > 0 AND source_count = output_count AND mismatch_count = 0 AS passed FROM t LEFT JOIN f USING (track)""",
)
def timeline_mismatches(spark, folder):
    result = compare.timeline_mismatches(packets(spark, folder), damaged_packets(spark, folder), KEYS)
    listed = F.array_join(F.transform("first_mismatches", lambda m: F.concat_ws(":", m["ordinal"], m["delta_us"])), ",")
    return plain(result.withColumn("first_mismatches", listed))


@query(
    "exact_row_parity",
    _judged(
        COPY_SQL, zip_sql("packet", "copied", "hash pts dts dur size flags"), ("a_here AND b_here", "row count differs"),
        (" AND ".join(_SAME(f) for f in ("hash", "pts", "dts", "dur", "size", "flags")), "row fields differ"),
    )
    + verdict_sql("judged"),
)
def exact_row_parity(spark, folder):
    fields = ["hash", "pts", "dts", "dur", "size", "flags"]
    return plain(compare.exact_parity(packets(spark, folder), damaged_packets(spark, folder), KEYS, fields), *VERDICT)


# Frames whose clock steps back in places; the packet clock agrees only sometimes.
_STEP = "pts - CASE WHEN event_id % 53 = 0 THEN 864000000000 ELSE 0 END"


@query(
    "position_conflicts",
    f"""WITH {PACKET_SQL},
    f AS (SELECT track, ordinal, {_STEP} AS pts, pos FROM packet),
    p AS (SELECT track, pos, {_STEP} + CASE WHEN event_id % 106 = 0 THEN 1 ELSE 0 END AS pts FROM packet),
    n AS (SELECT *, lag(pts) OVER t AS previous_pts, lag(pos) OVER t AS previous_pos FROM f WINDOW t AS (PARTITION BY track ORDER BY ordinal)),
    c AS (SELECT n.* FROM n JOIN p a ON a.track = n.track AND a.pos = n.previous_pos AND a.pts = n.previous_pts
          JOIN p b ON b.track = n.track AND b.pos = n.pos AND b.pts = n.pts WHERE n.pts <= n.previous_pts AND n.pos <> n.previous_pos)
    SELECT track, count(*) AS conflicts, arg_min(previous_pts, ordinal) AS previous_pts, arg_min(pts, ordinal) AS pts,
      arg_min(previous_pos, ordinal) AS previous_packet, arg_min(pos, ordinal) AS packet FROM c GROUP BY track""",
)
def position_conflicts(spark, folder):
    stepped = F.col("pts") - F.when(F.col("event_id") % 53 == 0, 864000000000).otherwise(0)
    p = packets(spark, folder).withColumn("pts", stepped)
    shown = p.withColumn("pts", F.col("pts") + F.when(F.col("event_id") % 106 == 0, 1).otherwise(0))
    return plain(compare.position_conflicts(p.withColumn("pkt_pos", F.col("pos")), shown, KEYS))


@query(
    "packet_identity",
    f"""WITH {COPY_SQL},
    f AS (SELECT track, pos - CASE WHEN event_id % 401 = 0 THEN pos % 7 ELSE 0 END AS pos, count(*) AS frames, min(pts) AS frame_pts FROM packet GROUP BY 1, 2),
    p AS (SELECT track, pos, count(*) AS packets, min(pts) AS low, max(pts) AS high FROM copied GROUP BY 1, 2),
    judged AS (SELECT f.track, f.pos AS ordinal, CASE WHEN frames <> 1 THEN 'duplicate frame identity' WHEN coalesce(packets, 0) > 1 THEN 'duplicate packet identity'
      WHEN packets IS NULL THEN 'missing packet' WHEN low <> frame_pts OR high <> frame_pts THEN 'presentation timestamp mismatch' END AS reason
      FROM f LEFT JOIN p ON f.track = p.track AND f.pos = p.pos) """ + verdict_sql("judged"),
)
def packet_identity(spark, folder):
    wrong = F.when(F.col("event_id") % 401 == 0, F.col("pos") % 7).otherwise(0)
    named = packets(spark, folder).withColumn("pkt_pos", F.col("pos") - wrong)
    return plain(compare.packet_identity_join(named, damaged_packets(spark, folder), KEYS), *VERDICT)


@query(
    "keyframe_hints",
    f"""WITH {COPY_SQL}, z AS ({zip_sql("packet", "copied", "event_id flags pts")}),
    odd AS (SELECT DISTINCT track FROM z WHERE NOT (a_here AND b_here))
    SELECT track, ordinal, b_pts - 1704067200000000 AS hint_us FROM z WHERE a_event_id % 3 IN (0, 1) AND b_flags LIKE '%K%'
      AND b_flags NOT LIKE '%D%' AND b_pts - 1704067200000000 >= 0 AND track NOT IN (SELECT track FROM odd)""",
)
def keyframe_hints(spark, folder):
    pictures = packets(spark, folder).select("track", "ordinal", (F.col("event_id") % 3 + 19).cast("int").alias("kind"))
    return plain(compare.keyframe_hints(pictures, damaged_packets(spark, folder), KEYS, F.lit(1704067200000000)))


@query(
    "copy_revalidation",
    f"""WITH {COPY_SQL}, z AS ({zip_sql("packet", "copied", "hash pts dts dur size")}),
    parts AS (
      SELECT track, 0 AS rank, CASE WHEN count(*) FILTER (WHERE a_here) <> count(*) FILTER (WHERE b_here) THEN 'properties: packet total changed' END AS reason FROM z GROUP BY track
      UNION ALL SELECT track, 1, 'video: ' || arg_min(CASE WHEN NOT coalesce(a_here AND b_here, false) THEN 'count changed' ELSE 'timeline changed' END, ordinal)
          FILTER (WHERE NOT coalesce(abs(a_pts - b_pts) <= 2000, false)) FROM z GROUP BY track
      UNION ALL SELECT track, 2, 'tracks: ' || arg_min(CASE WHEN NOT coalesce(a_here AND b_here AND a_hash = b_hash, false) THEN 'payload or count changed'
            WHEN NOT {near_sql("pts")} THEN 'timing changed: pts' WHEN NOT {near_sql("dts")} THEN 'timing changed: dts' ELSE 'timing changed: dur' END, ordinal)
          FILTER (WHERE NOT coalesce(a_here AND b_here AND a_hash = b_hash AND {near_sql("pts")} AND {near_sql("dts")} AND {near_sql("dur")}, false)) FROM z GROUP BY track
      UNION ALL SELECT track, 3, CASE WHEN min(a_pts) <> min(b_pts) THEN 'chapters: chapter start moved' END FROM z GROUP BY track
      UNION ALL SELECT track, 4, CASE WHEN count(*) FILTER (WHERE a_size <> b_size) > 0 THEN 'attachments: attachment changed' END FROM z GROUP BY track)
    SELECT track, count(DISTINCT rank) AS parts_checked, count(reason) AS failures, coalesce(arg_min(reason, rank) FILTER (WHERE reason IS NOT NULL), '') AS reason,
      CASE WHEN count(reason) = 0 THEN 'pass' ELSE 'fail' END AS status FROM parts GROUP BY track""",
)
def copy_revalidation(spark, folder):
    a, b = packets(spark, folder), damaged_packets(spark, folder)
    rows = compare.zip_rows(a, b, KEYS, ["pts", "size"])
    totals = rows.groupBy("track").agg(
        F.count("a_here").alias("na"), F.count("b_here").alias("nb"), F.min("a_pts").alias("a0"), F.min("b_pts").alias("b0"),
        F.count_if(F.col("a_size") != F.col("b_size")).alias("resized"),
    )
    part = lambda bad, why: totals.select("track", F.when(bad, why).alias("reason"))
    near = F.abs(F.col("a_pts") - F.col("b_pts")) <= 2000
    both = F.coalesce(F.col("a_here") & F.col("b_here"), F.lit(False))
    why = F.when(~both, "count changed").when(~F.coalesce(near, F.lit(False)), "timeline changed")
    from framesleuth.functions.checks import verdicts

    result = compare.revalidate_copy(
        part(F.col("na") != F.col("nb"), "packet total changed"),
        verdicts(rows.withColumn("reason", why), KEYS),
        compare.compare_packets(a, b, KEYS),
        part(F.col("a0") != F.col("b0"), "chapter start moved"),
        part(F.col("resized") > 0, "attachment changed"),
        KEYS,
    )
    return plain(result)
