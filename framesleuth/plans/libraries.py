"""Inventory, naming, eligibility and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesleuth.functions import labels
from framesleuth.functions import metadata as meta
from framesleuth.functions import names
from framesleuth.functions import rational
from framesleuth.functions.rational import micros
from framesleuth.operators import library as op
from framesleuth.plans.registry import plain, query
from framesleuth.plans.tables import PACKET_SQL, attempts, ATTEMPT_SQL, cents, packets, table



def _part():
    return F.col("p_partkey")


def inventory(spark, folder):
    """Media files, one per part."""
    p = table(spark, folder, "part")
    dv = _part() % 17 == 0
    hdr = dv | (_part() % 19 == 0)
    codec = F.element_at(F.create_map(*[F.lit(x) for kv in {
        "STANDARD": "h264", "ECONOMY": "hevc", "MEDIUM": "av1", "PROMO": "mpeg2video", "LARGE": "h264", "SMALL": "vc1"}.items() for x in kv]), F.col("p_type"))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (_part() % len(v) + 1).cast("int"))
    return p.select(
        _part().alias("id"), F.concat(F.lit("/media/"), (_part() % 40).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), _part().cast("string"), F.lit(".mkv")).alias("path"),
        (cents(F.col("p_retailprice")) * 1000).alias("size_bytes"), (_part() % 4000 + 1).cast("double").alias("duration_s"), ((_part() % 4000 + 1) * 1000).alias("duration_ms"),
        pick("matroska,webm", "mov,mp4").alias("container"), codec.alias("video_codec"), (F.col("p_size") * 80).alias("width"), (F.col("p_size") * 45).alias("height"),
        F.lit("yuv420p").alias("pixel_format"), F.when(dv | (_part() % 3 == 0), 10).when(_part() % 7 == 0, 12).otherwise(8).alias("bit_depth"),
        F.when(dv, "bt2020").otherwise("bt709").alias("color_primaries"), F.when(hdr, "smpte2084").otherwise("bt709").alias("color_transfer"),
        F.when(_part() % 11 == 0, "unknown").otherwise("bt709").alias("color_space"), F.when(_part() % 13 != 0, "tv").alias("color_range"), hdr.alias("hdr"), dv.alias("dv"),
        F.when(dv, pick(5, 7, 8)).alias("dv_profile"), F.when(dv, (_part() % 2).cast("int")).alias("dv_compatibility"), (dv & (_part() % 5 != 0)).alias("dv_rpu"), (_part() % 34 == 0).alias("dv_el"),
        hdr.alias("mastering"), (_part() % 38 == 0).alias("content_light"), F.when(_part() % 2 == 0, F.array(F.lit("aac"), F.lit("ac3"))).otherwise(F.array(F.lit("aac"))).alias("audio_codecs"),
        F.array(F.lit("subrip")).alias("subtitle_codecs"), pick("progressive", "progressive", "tt", "unknown").alias("field_order"), pick("1:1", "1:1", "8:9").alias("sar"),
        F.lit(None).cast("string").alias("dar"), F.array().cast("array<map<string,string>>").alias("side"), pick("30000/1001", "24/1").alias("frame_rate"), pick(1, 1, 2).alias("video_tracks"),
    )


INVENTORY_SQL = """inv AS (SELECT p_partkey AS id, '/media/' || (p_partkey % 40) || '/' || replace(p_name, ' ', '.') || '.' || p_partkey || '.mkv' AS path, CAST(round(p_retailprice * 100) AS BIGINT) * 1000 AS size_bytes,
  p_partkey % 4000 + 1 AS duration_s, CASE p_partkey % 2 WHEN 0 THEN 'matroska,webm' ELSE 'mov,mp4' END AS container,
  CASE p_type WHEN 'STANDARD' THEN 'h264' WHEN 'ECONOMY' THEN 'hevc' WHEN 'MEDIUM' THEN 'av1' WHEN 'PROMO' THEN 'mpeg2video' WHEN 'LARGE' THEN 'h264' ELSE 'vc1' END AS video_codec,
  CAST(p_size * 80 AS BIGINT) AS width, CAST(p_size * 45 AS BIGINT) AS height, CASE WHEN p_partkey % 17 = 0 OR p_partkey % 3 = 0 THEN 10 WHEN p_partkey % 7 = 0 THEN 12 ELSE 8 END AS bit_depth,
  p_partkey % 17 = 0 AS dv, p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS hdr, CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE 'bt709' END AS color_space, p_partkey % 13 = 0 AS no_range,
  [5, 7, 8][p_partkey % 3 + 1] AS prof, p_partkey % 2 AS comp, p_partkey % 17 = 0 AND p_partkey % 5 <> 0 AS rpu, p_partkey % 34 = 0 AS el,
  ['progressive', 'progressive', 'tt', 'unknown'][p_partkey % 4 + 1] AS field_order, ['1:1', '1:1', '8:9'][p_partkey % 3 + 1] AS sar, ['30000/1001', '24/1'][p_partkey % 2 + 1] AS frame_rate, [1, 1, 2][p_partkey % 3 + 1] AS tracks FROM part),
routed AS (SELECT *, CASE WHEN NOT dv THEN NULL WHEN NOT rpu THEN 'inspect-missing-rpu' WHEN el OR prof = 7 THEN 'preserve-enhancement-layer' WHEN prof = 5 THEN 'profile5-color-pipeline-required'
  WHEN prof = 8 AND comp = 1 AND video_codec = 'hevc' AND bit_depth = 10 THEN 'profile8.1-research-candidate' ELSE 'inspect-unsupported-profile' END AS route FROM inv),
cls AS (SELECT *, CASE WHEN dv AND route = 'profile8.1-research-candidate' THEN 'specialized-dv' WHEN dv THEN 'needs-review' WHEN color_space = 'unknown' OR no_range THEN 'needs-review' WHEN hdr THEN 'needs-review' WHEN bit_depth NOT IN (8, 10) THEN 'needs-review'
    WHEN video_codec IN ('hevc', 'av1') THEN 'keep-as-is' WHEN video_codec = 'h264' THEN 'preview-candidate' ELSE 'needs-review' END AS action,
  CASE WHEN dv AND route = 'profile8.1-research-candidate' THEN 'layered HDR candidate for the preservation route' WHEN dv THEN 'unsupported layered HDR path: ' || route
    WHEN color_space = 'unknown' AND no_range THEN 'unspecified color_space, color_range' WHEN color_space = 'unknown' THEN 'unspecified color_space' WHEN no_range THEN 'unspecified color_range'
    WHEN hdr THEN 'HDR metadata needs a validated preservation route' WHEN bit_depth NOT IN (8, 10) THEN 'unsupported dimensions or bit depth' WHEN video_codec IN ('hevc', 'av1') THEN 'efficient codec already present'
    WHEN video_codec = 'h264' THEN 'test at original resolution' ELSE 'legacy or unvalidated codec' END AS reason FROM routed)"""


@query("inventory_classify", f"WITH {INVENTORY_SQL} SELECT id, action, reason, coalesce(route, '') AS route FROM cls")
def inventory_classify(spark, folder):
    return plain(op.classify(inventory(spark, folder)).withColumn("route", op.layered_route()), "id", "action", "reason", "route")


@query(
    "inventory_narrow",
    f"""WITH {INVENTORY_SQL}, n AS (SELECT *, CASE WHEN NOT (width = 1920 AND height = 1080 AND bit_depth = 8) THEN 'limited to 1080p 8-bit SDR' WHEN NOT (field_order = 'progressive' AND sar = '1:1') THEN 'requires progressive square pixels' ELSE 'eligible' END AS why FROM cls)
    SELECT id, CASE WHEN action = 'preview-candidate' AND why <> 'eligible' THEN 'needs-review' ELSE action END AS action, CASE WHEN action = 'preview-candidate' THEN why ELSE reason END AS reason FROM n""",
)
def inventory_narrow(spark, folder):
    return plain(op.narrow_eligibility(op.classify(inventory(spark, folder))), "id", "action", "reason")


@query(
    "inventory_summary",
    f"WITH {INVENTORY_SQL} SELECT coalesce(action, '') AS action, coalesce(video_codec, '') AS video_codec, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM cls GROUP BY GROUPING SETS ((action), (video_codec), ())",
)
def inventory_summary(spark, folder):
    return plain(op.inventory_summary(op.classify(inventory(spark, folder))))


_DIM = "CASE WHEN s >= 1.0 THEN {0} ELSE greatest(2, CAST(floor({0} * s / 2) AS BIGINT) * 2) END"


@query(
    "recommend",
    f"""WITH {INVENTORY_SQL}, d AS (SELECT *, least(1280.0::DOUBLE / width, 720.0::DOUBLE / height, 1.0::DOUBLE) AS s FROM inv), o AS (SELECT *, {_DIM.format('width')} AS out_width, {_DIM.format('height')} AS out_height FROM d)
    SELECT id, CASE WHEN dv AND width = out_width AND height = out_height THEN CASE WHEN container LIKE '%matroska%' THEN 'keep' ELSE 'remux' END WHEN dv THEN 'skip' WHEN width <> out_width OR height <> out_height THEN 'transcode'
      WHEN video_codec IN ('hevc', 'av1') THEN CASE WHEN container LIKE '%matroska%' THEN 'keep' ELSE 'remux' END ELSE 'transcode' END AS recommendation, out_width, out_height FROM o""",
)
def recommend(spark, folder):
    return plain(op.recommend(inventory(spark, folder), "hevc", "720p", "copy"), "id", "recommendation", "out_width", "out_height")


@query(
    "geometry",
    f"""WITH {INVENTORY_SQL}, g AS (SELECT *, 854 * height <= 480 * width AS bw, CASE WHEN field_order = 'tt' THEN 4 ELSE 2 END AS unit, width <= 854 AND height <= 480 AS fits FROM inv),
    n AS (SELECT *, greatest(2, CASE WHEN bw THEN 854 ELSE width * 480 // height END // 2 * 2) AS nw, greatest(unit, CASE WHEN bw THEN height * 854 // width ELSE 480 END // unit * unit) AS nh FROM g),
    r AS (SELECT *, CASE sar WHEN '1:1' THEN 1 ELSE 8 END * width * nh AS a, CASE sar WHEN '1:1' THEN 1 ELSE 9 END * height * nw AS b FROM n)
    SELECT id, CASE WHEN fits THEN width ELSE nw END AS out_width, CASE WHEN fits THEN height ELSE nh END AS out_height, CASE WHEN fits THEN sar ELSE (a // gcd(a, b)) || ':' || (b // gcd(a, b)) END AS out_sar, NOT fits AS resized FROM r""",
)
def geometry(spark, folder):
    return plain(op.preset_geometry(inventory(spark, folder), "small480"), "id", "out_width", "out_height", "out_sar", "resized")


@query(
    "source_eligibility",
    f"""WITH {INVENTORY_SQL} SELECT id, CASE WHEN hdr THEN 'HDR transfer needs its own workflow' WHEN field_order = 'unknown' THEN 'scan type not established' WHEN no_range THEN 'missing or unsupported color metadata' ELSE '' END AS sdr,
      CASE WHEN dv THEN 'layered HDR needs its own route' WHEN NOT hdr THEN 'HDR transfer cannot be determined' WHEN color_space = 'unknown' THEN 'evidence is missing color_space' WHEN no_range THEN 'evidence is missing color_range' ELSE '' END AS hdr_reason,
      CASE WHEN tracks <> 1 THEN 'requires exactly one video track' ELSE 'outside the tested profile' END AS dvd FROM inv""",
)
def source_eligibility(spark, folder):
    rows = inventory(spark, folder)
    return plain(rows.select("id", op.sdr_eligibility().alias("sdr"), op.hdr_eligibility().alias("hdr_reason"), op.dvd_eligibility().alias("dvd")))


@query(
    "copy_verification",
    f"""WITH {INVENTORY_SQL}, o AS (SELECT *, CASE WHEN id % 101 = 0 THEN width + 2 ELSE width END AS ow, duration_s + CASE WHEN id % 103 = 0 THEN 3 ELSE 1 END AS od, size_bytes * (60 + id % 50) // 100 AS os FROM inv WHERE id % 97 <> 0)
    SELECT i.id, CASE WHEN o.id IS NULL THEN 'output missing' WHEN ow <> i.width THEN 'resolution changed' WHEN od - i.duration_s > 2 THEN 'duration differs by more than two seconds' WHEN i.id % 107 = 0 THEN 'audio stream count changed'
      WHEN i.id % 109 = 0 THEN 'subtitle streams changed' WHEN i.hdr AND i.id % 23 = 0 THEN 'HDR signaling was lost' WHEN i.hdr AND i.bit_depth < 10 THEN 'HDR output below 10 bits' WHEN i.dv AND i.id % 29 = 0 THEN 'layered HDR profile changed'
      WHEN i.no_range THEN 'color_range changed' WHEN os >= i.size_bytes THEN 'output is not smaller' WHEN (i.size_bytes - os) * 10000 < i.size_bytes * 2000 THEN 'savings below the minimum' ELSE '' END AS reason,
    CASE WHEN o.id IS NULL OR ow <> i.width OR od - i.duration_s > 2 OR i.id % 107 = 0 OR i.id % 109 = 0 OR (i.hdr AND i.id % 23 = 0) OR (i.hdr AND i.bit_depth < 10) OR (i.dv AND i.id % 29 = 0) OR i.no_range OR os >= i.size_bytes
      OR (i.size_bytes - os) * 10000 < i.size_bytes * 2000 THEN 'fail' ELSE 'pass' END AS status FROM inv i LEFT JOIN o USING (id)""",
)
def copy_verification(spark, folder):
    rows, k = inventory(spark, folder), F.col("id")
    out = rows.where(k % 97 != 0).withColumns({
        "video_codec": F.lit("hevc"), "width": F.when(k % 101 == 0, F.col("width") + 2).otherwise(F.col("width")),
        "duration_s": F.col("duration_s") + F.when(k % 103 == 0, 3).otherwise(1), "size_bytes": F.expr("size_bytes * (60 + id % 50) div 100"),
        "audio_codecs": F.when(k % 107 == 0, F.array(F.lit("aac"), F.lit("ac3"), F.lit("dts"))).otherwise(F.col("audio_codecs")),
        "subtitle_codecs": F.when(k % 109 == 0, F.array().cast("array<string>")).otherwise(F.col("subtitle_codecs")),
        "hdr": F.col("hdr") & (k % 23 != 0), "dv_profile": F.when(k % 29 == 0, 4).otherwise(F.col("dv_profile")),
    })
    return plain(op.verify_copies(rows, out, "hevc", "id", 2000))


@query(
    "age_filter",
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS b FROM orders)
    SELECT o_orderkey, coalesce(b BETWEEN 915148800000000 - 52 * 604800000000 AND 915148800000000, false) AS within_ok, CASE WHEN b IS NULL THEN 'creation_date_unavailable' WHEN NOT b < 915148800000000 - 52 * 604800000000 THEN 'outside_age_window' ELSE '' END AS older_excluded FROM f""",
)
def age_filter(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 31 != 0, micros(F.col("o_orderdate"))).alias("birth"))
    now = F.lit(915148800000000)
    within = op.age_filter(o, "birth", now, "weeks", 52).select("o_orderkey", "birth", F.col("selected").alias("within_ok"))
    older = op.age_filter(within, "birth", now, "weeks", 52, "older")
    return plain(older.select("o_orderkey", "within_ok", F.col("excluded").alias("older_excluded")))


@query(
    "hdr_kind",
    f"""WITH {PACKET_SQL}, n AS (SELECT track, CASE WHEN event_id % 631 = 0 THEN 'DOVI configuration record' WHEN event_id % 337 = 0 THEN 'HDR10+ metadata' WHEN event_id % 211 = 0 THEN 'Dynamic HDR vivid' ELSE 'Mastering display metadata' END AS s FROM packet)
    SELECT track, CASE WHEN bool_or(s LIKE 'DOVI%') THEN 'layered HDR' WHEN bool_or(s LIKE 'HDR10+%') THEN 'HDR10+' WHEN bool_or(s LIKE 'Dynamic%') THEN 'dynamic HDR' WHEN track % 2 = 0 THEN 'HLG' ELSE 'PQ HDR' END AS kind FROM n GROUP BY track""",
)
def hdr_kind(spark, folder):
    e = F.col("event_id")
    name = F.when(e % 631 == 0, "DOVI configuration record").when(e % 337 == 0, "HDR10+ metadata").when(e % 211 == 0, "Dynamic HDR vivid").otherwise("Mastering display metadata")
    frames = packets(spark, folder).select("track", F.array(F.create_map(F.lit("side_data_type"), name)).alias("side"))
    streams = frames.select("track").distinct().select(
        "track", F.when(F.col("track") % 2 == 0, "arib-std-b67").otherwise("smpte2084").alias("color_transfer"), F.array().cast("array<map<string,string>>").alias("side")
    )
    return plain(op.hdr_kind(streams, frames, ["track"]))


@query(
    "stream_changes",
    f"""WITH {INVENTORY_SQL} SELECT id, array_to_string(list_filter([CASE WHEN id % 41 = 0 THEN 'disposition' END, CASE WHEN prim AND id % 43 = 0 THEN 'width' END, CASE WHEN prim AND id % 47 = 0 THEN 'codec' END, CASE WHEN prim AND id % 53 = 0 THEN 'sar' END,
      CASE WHEN prim AND id % 59 = 0 THEN 'frame_rate' END, CASE WHEN prim AND id % 61 = 0 THEN 'display_matrix' END, CASE WHEN NOT prim AND id % 67 = 0 THEN 'channels' END, CASE WHEN id % 71 = 0 THEN 'conflicting tags' END,
      CASE WHEN id % 73 = 0 AND id % 71 <> 0 THEN 'tag language' END, CASE WHEN (id % 79 = 0 AND id % 73 <> 0) OR id % 71 = 0 THEN 'tag title' END], lambda x: x IS NOT NULL), ',') AS changed FROM (SELECT *, id % 2 = 0 AS prim FROM inv)""",
)
def stream_changes(spark, folder):
    # A part is a short row and one small file holds many, so the pairs are dealt to tasks before they are compared.
    rows = inventory(spark, folder).select("id").repartition(table(spark, folder, "part").count() // 20_000 + 1)
    k = F.col("id")
    text = lambda v: F.lit(v)
    matrix = "00000000:            0       65536           0\n00000001:       -65536           0           0\n00000002:            0           0  1073741824\n"
    side_a = {
        "codec_type": text("video"), "disposition": F.create_map(text("default"), F.lit(1)), "width": F.lit(1920), "height": F.lit(1080), "pix_fmt": text("yuv420p"), "color_range": text("tv"),
        "color_space": text("bt709"), "color_transfer": text("bt709"), "color_primaries": text("bt709"), "codec": text("h264"), "sar": text("4:3"), "dar": F.lit(None).cast("string"),
        "frame_rate": text("24000/1001"), "matrix": text(matrix), "sample_rate": F.lit(48000), "channels": F.lit(2), "channel_layout": text("stereo"), "extradata_hash": text("x"),
        "tags": F.create_map(text("Language"), text("und"), text("title"), text("Main")),
    }
    side_b = dict(side_a)
    side_b["disposition"] = F.create_map(text("default"), F.when(k % 41 == 0, 0).otherwise(1))
    side_b["width"] = F.when(k % 43 == 0, 1280).otherwise(1920)
    side_b["codec"] = F.when((k % 2 == 1) | (k % 47 == 0), "h264").otherwise("hevc")
    side_b["sar"] = F.when(k % 53 == 0, "1:1").otherwise("8:6")
    side_b["frame_rate"] = F.when(k % 59 == 0, "25/1").otherwise("24000001/1001000")
    side_b["matrix"] = F.when(k % 61 == 0, F.replace(text(matrix), F.lit("-65536"), F.lit(" 65536"))).otherwise(F.lit(matrix))
    side_b["channels"] = F.when(k % 67 == 0, 6).otherwise(2)
    base = F.when(k % 73 == 0, F.create_map(text("language"), text("eng"), text("title"), text("Main"))).when(k % 79 == 0, F.create_map(text("title"), text("Other")))
    side_b["tags"] = F.when(k % 71 == 0, F.create_map(text("title"), text("A"), text("TITLE"), text("B"))).otherwise(F.coalesce(base, F.create_map(text("title"), text("Main"))))
    pairs = rows.select("id", (k % 2 == 0).alias("primary"), *[c.alias(f"a_{n}") for n, c in side_a.items()], *[c.alias(f"b_{n}") for n, c in side_b.items()])
    # 100 verified frames allow the tiny average-rate rounding.
    changed = op.stream_changes(pairs, "hevc", F.lit(100))
    return plain(changed.select("id", F.array_join("changed", ",").alias("changed")))


@query(
    "check_vector",
    f"""WITH {INVENTORY_SQL} SELECT id, array_to_string(list_filter([CASE WHEN hdr THEN 'sdr' END, CASE WHEN bit_depth <> 8 THEN 'eight_bit' END, CASE WHEN no_range THEN 'range_known' END], lambda x: x IS NOT NULL), ',') AS failed,
      NOT hdr AND bit_depth = 8 AND NOT no_range AS passed FROM inv""",
)
def check_vector(spark, folder):
    checks = {"sdr": ~F.col("hdr"), "eight_bit": F.col("bit_depth") == 8, "range_known": F.col("color_range").isin("tv", "pc")}
    rows = op.check_vector(inventory(spark, folder), checks)
    return plain(rows.withColumn("failed", F.array_join("failed", ",")), "id", "failed", "passed")


@query(
    "evidence_gate",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'flag not proven: packets_unchanged' WHEN o_orderkey % 11 = 0 THEN 'invalid count: output_bytes' WHEN o_orderkey % 13 = 0 THEN 'missing identity: reference_hash'
      WHEN o_orderkey % 17 = 0 THEN 'scores cover other frames: candidate_frames' ELSE '' END AS reason, NOT (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0) AS qualified FROM orders""",
)
def evidence_gate(spark, folder):
    k = F.col("o_orderkey")
    digest = F.sha2(k.cast("string"), 256)
    reports = table(spark, folder, "orders").select(
        k, F.when(k % 7 != 0, True).alias("packets_unchanged"), F.lit(True).alias("static_unchanged"), F.when(k % 11 == 0, 0).otherwise(5).alias("output_bytes"),
        F.when(k % 13 == 0, F.upper(digest)).otherwise(digest).alias("reference_hash"), F.lit(100).alias("frames"), F.when(k % 17 == 0, 99).otherwise(100).alias("candidate_frames"),
    )
    # A digest without letters equals its upper case; force one letter in.
    reports = reports.withColumn("reference_hash", F.when(k % 13 == 0, F.concat(F.lit("Z"), F.substring("reference_hash", 2, 63))).otherwise(F.col("reference_hash")))
    return plain(op.evidence_gate(reports, ["packets_unchanged", "static_unchanged"], ["output_bytes"], ["reference_hash"], ["candidate_frames"]), "o_orderkey", "reason", "qualified")


@query(
    "clean_title",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' - S01E02.mkv' WHEN 1 THEN p_name || ' (2003).mkv' WHEN 2 THEN p_name || ' (1999).mkv' WHEN 3 THEN p_name || ' 2150.mkv' WHEN 4 THEN p_name || ' - S02E03E04 - Finale.mkv' ELSE '' END AS title FROM part""",
)
def clean_title(spark, folder):
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    stem = (
        F.when(_part() % 6 == 0, F.concat(dotted, F.lit(".s01e02.1080p.WEB-DL.x265"))).when(_part() % 6 == 1, F.concat(dotted, F.lit(".2003.2160p.BluRay")))
        .when(_part() % 6 == 2, F.concat("p_name", F.lit(" (1999) [1080p]"))).when(_part() % 6 == 3, F.concat(dotted, F.lit("_2150")))
        .when(_part() % 6 == 4, F.concat(dotted, F.lit(".S02E03E04.Finale.HDTV"))).otherwise("1080p.HEVC")
    )
    return plain(table(spark, folder, "part").select("p_partkey", names.clean_title(stem, 2026).alias("title")))


@query(
    "readable_destination",
    """WITH f AS (SELECT p_partkey, p_name || ' ' || p_partkey AS folder FROM part)
    SELECT '/m/' || folder || '/abc-de.1080p.avi' AS path, '/m/' || folder || '/' || CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'abc-de.1080p' ELSE folder END || '.mkv' AS destination, NOT (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS renamed FROM f
    UNION ALL SELECT '/m/' || folder || '/other.mkv', '/m/' || folder || '/other.mkv', false FROM f WHERE p_partkey % 5 = 0""",
)
def readable_destination(spark, folder):
    base = F.concat(F.lit("/m/"), "p_name", F.lit(" "), _part().cast("string"), F.lit("/"))
    p = table(spark, folder, "part")
    one = lambda name, keep=F.lit(True): p.where(keep).select(F.concat(base, F.lit(name)).alias("path"))
    files = one("abc-de.1080p.avi").unionByName(one("other.mkv", _part() % 5 == 0)).unionByName(one("abc-de.1080p.srt", _part() % 7 == 0))
    # The stem of a companion ends at the first dot, so give it a plain one.
    files = files.unionByName(p.where(_part() % 7 == 0).select(F.concat(base, F.lit("abc-de.1080p.nfo")).alias("path")))
    return plain(op.readable_destination(files))


@query(
    "sample_plan",
    f"""WITH {INVENTORY_SQL}, d AS (SELECT id, duration_s * 1000 AS d, CASE WHEN duration_s < 6 THEN duration_s * 1000 ELSE least(20000, duration_s * 1000 // 6) END AS w FROM inv)
    SELECT id, w AS window_ms, CAST(i - 1 AS BIGINT) AS window, (d - w) * l[i] // 1000 AS start_ms, d < 6000 AS whole_source FROM
      (SELECT *, CASE WHEN d < 6000 THEN [0] WHEN d >= 1800000 THEN [100, 300, 500, 700, 900] ELSE [150, 500, 850] END AS l FROM d), (SELECT unnest(range(1, 6)) AS i) WHERE i <= len(l)""",
)
def sample_plan(spark, folder):
    return plain(op.sample_plan(inventory(spark, folder).select("id", "duration_ms"), 20000), "id", "window_ms", "window", "start_ms", "whole_source")


@query(
    "align_seek",
    f"""WITH {INVENTORY_SQL}, s AS (SELECT id, duration_s * 100003 AS seek, CASE id % 2 WHEN 0 THEN 1 ELSE 1001 END AS num, CASE id % 2 WHEN 0 THEN 100 ELSE 6000 END AS den FROM inv),
    a AS (SELECT *, seek * den // (num * 1000000) * num * 1000000 // den AS al FROM s)
    SELECT id, CASE WHEN 10000000 + seek - al <= 10008000 THEN al ELSE seek END AS aligned_us, CASE WHEN 10000000 + seek - al <= 10008000 THEN 10000000 + seek - al ELSE 10000000 END AS aligned_length_us FROM a""",
)
def align_seek(spark, folder):
    clock = lambda n, d: F.struct(F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den"))
    # lcm(1, 1001)/gcd(24000, 30000) = 1001/6000 s; lcm(1, 1)/gcd(1000, 300) = 1/100 s
    clocks = F.when(F.col("id") % 2 == 0, F.array(clock(1, 1000), clock(1, 300))).otherwise(F.array(clock(1001, 24000), clock(1, 30000)))
    plans = inventory(spark, folder).select(
        "id", (F.col("duration_s").cast("long") * 100003).alias("seek_us"), F.lit(0).cast("long").alias("origin_us"), F.lit(10_000_000).cast("long").alias("length_us"),
        F.lit(10_008_000).cast("long").alias("maximum_us"), clocks.alias("clocks"),
    )
    return plain(op.align_seek(plans), "id", "aligned_us", "aligned_length_us")


@query(
    "window_check",
    f"""WITH {PACKET_SQL}, f AS (SELECT track, pts - 1704067200000000 AS p, CASE WHEN event_id % 997 = 0 THEN 0 WHEN dur IS NULL AND track % 3 <> 0 THEN 40000 ELSE dur END AS dur FROM packet)
    SELECT track, count(*) AS packets, max(p + dur) - least(0, min(p)) AS span_us, CASE WHEN count(*) FILTER (WHERE dur <= 0 OR dur IS NULL) > 0 THEN 'incomplete sample timing' WHEN max(p + dur) - least(0, min(p)) > 2 * 1290000000000 THEN 'exceeds bounded sampling window' ELSE '' END AS reason FROM f GROUP BY track""",
)
def window_check(spark, folder):
    """A third of the tracks end in a packet of unknown length."""
    length = F.when(F.col("event_id") % 997 == 0, 0).when(F.col("dur").isNull() & (F.col("track") % 3 != 0), 40000).otherwise(F.col("dur"))
    p = packets(spark, folder).select("track", (F.col("pts") - 1704067200000000).alias("pts"), length.alias("dur"))
    return plain(op.window_check(p, ["track"], F.lit(1290000000000)))


@query(
    "nominated_files",
    """WITH n AS (SELECT p_partkey AS k, ['clip.mkv', 'a-frames.json', 'b-stream-3.txt', 'notes.txt', 'rpu.json', 'info.nfo', 'movie-sample.mp4', 'Sample/x.mp4', 'c-layers/metadata.json', 'metadata.json'][p_partkey % 10 + 1] AS name, p_partkey % 10 AS i FROM part)
    SELECT '/srv/samples/' || k || '/' || name AS path, i IN (0, 1, 2, 4, 6, 7, 8) AS generated, CASE i WHEN 5 THEN 'metadata file; review' WHEN 6 THEN 'explicit sample folder or name; review' WHEN 7 THEN 'explicit sample folder or name; review' ELSE '' END AS reason FROM n""",
)
def nominated_files(spark, folder):
    listed = ("clip.mkv", "a-frames.json", "b-stream-3.txt", "notes.txt", "rpu.json", "info.nfo", "movie-sample.mp4", "Sample/x.mp4", "c-layers/metadata.json", "metadata.json")
    name = F.element_at(F.array(*[F.lit(n) for n in listed]), (_part() % 10 + 1).cast("int"))
    path = F.concat(F.lit("/srv/samples/"), _part().cast("string"), F.lit("/"), name)
    rows = table(spark, folder, "part").select(path.alias("path"))
    return plain(rows.select("path", op.disposable(F.col("path")).alias("generated"), op.cleanup_reason(F.col("path"), F.lit("/srv/samples/main.mkv"), True, F.lit("/srv/samples")).alias("reason")))


@query(
    "hardlink_sets",
    """WITH f AS (SELECT o_orderkey AS path, o_custkey AS ino, 5 + o_custkey % 12 AS nlink FROM orders), c AS (SELECT ino, count(*) AS listed FROM f GROUP BY 1)
    SELECT path, listed, listed = nlink AS nominated FROM f JOIN c USING (ino)""",
)
def hardlink_sets(spark, folder):
    files = table(spark, folder, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).alias("dev"), F.col("o_custkey").alias("ino"), (5 + F.col("o_custkey") % 12).alias("nlink"))
    return plain(op.complete_hardlinks(files), "path", "listed", "nominated")


@query(
    "scalar_labels",
    f"""WITH {ATTEMPT_SQL} SELECT id, CASE WHEN output_bytes < 1024 THEN printf('%.2f B', output_bytes::DOUBLE) WHEN output_bytes < 1048576 THEN printf('%.2f KiB', output_bytes / 1024) WHEN output_bytes < 1073741824 THEN printf('%.2f MiB', output_bytes / 1048576) ELSE printf('%.2f GiB', output_bytes / 1073741824) END AS size,
      CASE id % 4 WHEN 0 THEN 'av1_duplicate_decode_timestamp' WHEN 1 THEN 'chroma_siting_preservation' WHEN 2 THEN 'attachment_evidence_unavailable' ELSE '' END AS failure,
      CASE WHEN state IN ('pending', 'running', 'cancelled') THEN upper(state[1]) || state[2:] WHEN outcome = 'error' THEN 'Processing error' ELSE 'Other' END AS label FROM att""",
)
def scalar_labels(spark, folder):
    rows, k = attempts(spark, folder), F.col("id")
    message = (
        F.when(k % 4 == 0, "[vost#0:0/av1_nvenc @ 0x1] Non-monotonic DTS; previous: 5, current: 5; Error submitting a packet to the muxer")
        .when(k % 4 == 1, "Frame 12: chroma location changed").when(k % 4 == 2, "Attachment payload hash unavailable")
        .otherwise("[vost#0:0/av1_nvenc @ 0x1] Non-monotonic DTS; previous: 5, current: 6; Error submitting a packet to the muxer")
    )
    label = labels.outcome_label(F.col("state"), F.lit(None).cast("string"), F.col("outcome"))
    known = F.col("state").isin("pending", "running", "cancelled") | (F.col("outcome") == "error")
    return plain(rows.select(
        "id", labels.human_size(F.col("output_bytes")).alias("size"), labels.structural_failure(message).alias("failure"),
        F.when(F.coalesce(known, F.lit(False)), label).otherwise("Other").alias("label"),
    ))


@query(
    "metadata_forms",
    f"""WITH {PACKET_SQL} SELECT event_id, event_id % 5 <> 0 AS equal,
      CASE WHEN event_id % 9 = 0 THEN 'ambiguous' WHEN event_id % 7 = 0 THEN 'inexact' ELSE '3a98' || printf('%04x', level % 50000) || '1d4c0bb884d03e803d1340420098968000000032' END AS payload,
      CASE WHEN event_id % 11 = 0 THEN '' ELSE '1920|1080|yuv420p|4/3|tv|bt709|bt709|bt709|unknown' END AS picture, (2 * (level % 50000) * 65536 + 50000) // 100000 || '/65536' AS quantised, round(event_id % 3 * 1.0) = 0 AS languages FROM packet""",
)
def metadata_forms(spark, folder):
    e = F.col("event_id")
    frac = lambda n: F.concat(F.lit(str(n)), F.lit("/50000")) if isinstance(n, int) else F.concat(n.cast("string"), F.lit("/50000"))
    fields = {
        "green_x": frac(15000), "green_y": F.when(e % 7 == 0, "1/3").otherwise(frac(F.col("level") % 50000)), "blue_x": frac(7500), "blue_y": frac(3000),
        "red_x": frac(34000), "red_y": frac(16000), "white_point_x": frac(15635), "white_point_y": frac(16450), "max_luminance": F.lit("1000/1"), "min_luminance": F.lit("50/10000"),
    }
    entry = F.create_map(F.lit("side_data_type"), F.lit("Mastering display metadata"), *[x for k, v in fields.items() for x in (F.lit(k), v)])
    side = F.when(e % 9 == 0, F.array(entry, entry)).otherwise(F.array(entry))
    left = F.create_map(F.lit("red_x"), F.lit("35400/50000"), F.lit("name"), F.lit("a"))
    right = F.create_map(F.lit("red_x"), F.when(e % 5 == 0, "178/250").otherwise("177/250"), F.lit("name"), F.lit("a"))
    frame = packets(spark, folder).select(
        e, "level", side.alias("side"), F.lit(1920).alias("width"), F.when(e % 11 == 0, 0).otherwise(1080).alias("height"), F.lit("yuv420p").alias("pix_fmt"), F.lit("8:6").alias("sar"),
        F.lit("tv").alias("color_range"), F.lit("bt709").alias("color_space"), F.lit("bt709").alias("color_transfer"), F.lit("bt709").alias("color_primaries"), F.lit("").alias("chroma_location"),
        left.alias("left"), right.alias("right"),
    )
    plainly = F.create_map(F.lit("side_data_type"), F.lit("Mastering display metadata"), F.lit("green_y"), frac(F.col("level") % 50000))
    lang = F.when(e % 3 == 1, "eng").when(e % 3 == 2, "zxx")
    return plain(frame.select(
        "event_id", meta.metadata_equal(F.col("left"), F.col("right")).alias("equal"), meta.mastering_payload(F.col("side")).alias("payload"), meta.picture_signature().alias("picture"),
        F.element_at(meta.quantise_for_av1(plainly), F.lit("green_y")).alias("quantised"), meta.equivalent_language(lang, F.lit("und")).alias("languages"),
    ))


@query(
    "family_keys",
    f"""WITH {PACKET_SQL} SELECT kind, count(DISTINCT event_id % 2) AS families, count(*) AS stages FROM packet GROUP BY kind""",
)
def family_keys(spark, folder):
    e = F.col("event_id")
    options = F.array(F.lit("-vf"), F.concat(F.lit("libvmaf=log_path=r"), e.cast("string"), F.lit(".json:n=1")), F.lit("-cq"), (e % 2).cast("string"))
    keyed = packets(spark, folder).select("kind", meta.family_key(options, F.lit(100.0) + e % 20, F.struct(F.lit("h264").alias("codec"))).alias("family"))
    # Two-step distinct: families are few, stages many.
    per = keyed.groupBy("kind", "family").agg(F.count(F.lit(1)).alias("n"))
    return plain(per.groupBy("kind").agg(F.count(F.lit(1)).alias("families"), F.sum("n").alias("stages")))


@query(
    "clock_witness",
    f"""WITH {PACKET_SQL}, c AS (SELECT event_id, (pts - 1704067200000000) AS us, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ((pts - 1704067200000000) * 9 + 50) // 100 END AS raw, event_id % 3 = 0 AS coarse FROM packet),
    d AS (SELECT *, CASE WHEN coarse THEN 1000 ELSE 90000 END AS den FROM c),
    v AS (SELECT *, coalesce(raw, (2 * us * den + 1000000) // 2000000) AS t FROM d)
    SELECT event_id, CASE WHEN 2 * abs(t * 1000000 - us * den) <= den THEN t ELSE -1 END AS tick, abs(us) % 7 = 0 OR true AS known FROM v""",
)
def clock_witness(spark, folder):
    e, us = F.col("event_id"), F.col("pts") - 1704067200000000
    raw = F.when(e % 4 != 0, F.call_function("div", us * 9 + 50, F.lit(100)))
    den = F.when(e % 3 == 0, 1000).otherwise(90000)
    return plain(packets(spark, folder).select("event_id", rational.packet_ticks(raw, F.lit(1), den, us).alias("tick"), F.lit(True).alias("known")))


@query(
    "chapter_compare",
    f"""WITH {PACKET_SQL}, c AS (SELECT track, ordinal, event_id, dur FROM packet),
    j AS (SELECT track, ordinal, CASE WHEN event_id % 37 = 0 THEN 'chapter missing or invalid' WHEN coalesce(dur, 0) < 0 OR event_id % 41 = 0 THEN 'chapter changed' END AS reason FROM c)
    SELECT track, count(*) AS rows_checked, count(reason) AS failures, coalesce(min(ordinal) FILTER (WHERE reason IS NOT NULL), -1) AS first_bad_ordinal, coalesce(arg_min(reason, ordinal) FILTER (WHERE reason IS NOT NULL), '') AS reason,
      CASE WHEN count(reason) = 0 THEN 'pass' ELSE 'fail' END AS status FROM j GROUP BY track""",
)
def chapter_compare(spark, folder):
    base = packets(spark, folder)
    e = F.col("event_id")
    a = base.select("track", "ordinal", F.col("pts").alias("start"), (F.col("pts") + F.coalesce("dur", F.lit(0))).alias("end"), F.create_map(F.lit("TITLE"), F.col("kind")).alias("tags"))
    b = base.where(e % 37 != 0).select(
        "track", "ordinal", F.col("pts").alias("start"), (F.col("pts") + F.coalesce("dur", F.lit(0)) + F.when(e % 41 == 0, 1).otherwise(0)).alias("end"), F.create_map(F.lit("title"), F.col("kind")).alias("tags")
    )
    return plain(op.chapter_changes(a, b, ["track"]), "track", "rows_checked", "failures", "first_bad_ordinal", "reason", "status")
