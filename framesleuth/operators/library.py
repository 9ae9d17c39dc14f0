"""Library inventory: classification, eligibility, verification and naming.

``inventory`` columns: path, size_bytes, duration_s, container, video_codec,
width, height, pixel_format, bit_depth, color_primaries, color_transfer,
color_space, color_range, hdr, dv, dv_profile, dv_compatibility, dv_rpu, dv_el,
mastering, content_light, audio_codecs, subtitle_codecs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesleuth.functions import metadata as meta
from framesleuth.functions.checks import failed_names, first_failure, holds
from framesleuth.functions.names import COMPANION_EXTENSIONS, MEDIA_EXTENSIONS, extension, file_name, folder_of, stem_of
from framesleuth.functions.rational import compatible_measured_rate, effective_pixel_aspect, ratios_equal

# Spellings of unknown colour, age units in seconds, size limits.
UNKNOWN_COLOR = ("", "unknown", "unspecified", "reserved")
COLORS = ("color_primaries", "color_transfer", "color_space", "color_range")
AGE_SECONDS = {"minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
RESOLUTION_LIMITS = {"2160p": (3840, 2160), "1080p": (1920, 1080), "720p": (1280, 720), "480p": (854, 480)}
PRESETS = {"original": None, "tv1080": (1920, 1080), "mobile720": (1280, 720), "small480": (854, 480)}
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
FIELD_ORDERS = ("tt", "bb", "tb", "bt")


def _unknown(name: str) -> Column:
    return F.col(name).isNull() | F.col(name).isin(*UNKNOWN_COLOR)


def age_filter(files: DataFrame, birth: str, now: Column, unit: str = "all", value: int = 0, comparison: str = "within") -> DataFrame:
    """Keep files by age, with the reason others are excluded.

    ``within`` includes both ends; ``older`` is strict; an unknown birth time
    never matches.  Times in microseconds.
    """
    if unit == "all":
        return files.withColumns({"selected": F.lit(True), "excluded": F.lit(None).cast("string")})
    edge = now - AGE_SECONDS[unit] * value * 1_000_000
    b = F.col(birth)
    chosen = (b < edge) if comparison == "older" else b.between(edge, now)
    reason = F.when(b.isNull(), "creation_date_unavailable").when(~chosen, "outside_age_window")
    return files.withColumns({"selected": holds(chosen), "excluded": reason})


def layered_route(prefix: str = "") -> Column:
    """Preservation route of a layered-HDR source; NULL for other sources."""
    c = lambda n: F.col(prefix + n)
    candidate = (
        (c("dv_profile") == 8) & (c("dv_compatibility") == 1) & (c("video_codec") == "hevc") & (c("bit_depth") == 10)
        & (c("color_transfer") == "smpte2084") & (c("color_primaries") == "bt2020")
    )
    return (
        F.when(~holds(c("dv")), None).when(~holds(c("dv_rpu")), "inspect-missing-rpu")
        .when(holds(c("dv_el")) | holds(c("dv_profile") == 7), "preserve-enhancement-layer")
        .when(holds(c("dv_profile") == 5), "profile5-color-pipeline-required").when(holds(candidate), "profile8.1-research-candidate")
        .otherwise("inspect-unsupported-profile")
    )


def classify(inventory: DataFrame) -> DataFrame:
    """Action and reason of each file by the first rule that applies."""
    route = layered_route()
    missing = F.array_compact(F.array(*[F.when(_unknown(c), c) for c in COLORS]))
    rules = [
        (holds(F.col("dv")) & (route == "profile8.1-research-candidate"), "specialized-dv", F.lit("layered HDR candidate for the preservation route")),
        (holds(F.col("dv")), "needs-review", F.concat(F.lit("unsupported layered HDR path: "), route)),
        (F.size(missing) > 0, "needs-review", F.concat(F.lit("unspecified "), F.array_join(missing, ", "))),
        (holds(F.col("hdr")), "needs-review", F.lit("HDR metadata needs a validated preservation route")),
        (~holds((F.col("width") > 0) & (F.col("height") > 0) & F.col("bit_depth").isin(8, 10)), "needs-review", F.lit("unsupported dimensions or bit depth")),
        (holds(F.col("video_codec").isin("hevc", "av1")), "keep-as-is", F.lit("efficient codec already present")),
        (holds(F.col("video_codec") == "h264"), "preview-candidate", F.lit("test at original resolution")),
    ]
    action, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, name, why in rules[1:]:
        action, reason = action.when(condition, name), reason.when(condition, why)
    return inventory.withColumns({"action": action.otherwise("needs-review"), "reason": reason.otherwise("legacy or unvalidated codec")})


def narrow_eligibility(classified: DataFrame) -> DataFrame:
    """Stricter overlay for the 1080p 8-bit progressive square-pixel route."""
    candidate = F.col("action") == "preview-candidate"
    sized = (F.col("width") == 1920) & (F.col("height") == 1080) & (F.col("bit_depth") == 8)
    square = (F.col("field_order") == "progressive") & (F.col("sar") == "1:1") & (F.coalesce(F.size("side"), F.lit(0)) <= 0)
    why = F.when(~holds(sized), "limited to 1080p 8-bit SDR").when(~holds(square), "requires progressive square pixels").otherwise("eligible")
    return classified.withColumns({
        "action": F.when(candidate & (why != "eligible"), "needs-review").otherwise(F.col("action")),
        "reason": F.when(candidate, why).otherwise(F.col("reason")),
    })


def output_dimensions(width: Column, height: Column, resolution: str) -> tuple[Column, Column]:
    """Even aspect-preserving size inside the limit, never larger than the source."""
    if resolution == "keep":
        return width, height
    max_width, max_height = RESOLUTION_LIMITS[resolution]
    scale = F.least(F.lit(float(max_width)) / width, F.lit(float(max_height)) / height, F.lit(1.0))
    even = lambda v: F.greatest(F.lit(2), (F.floor(v * scale / 2) * 2).cast("int"))
    unchanged = (scale >= 1.0) | (width == 0) | (height == 0)
    return F.when(unchanged, width).otherwise(even(width)), F.when(unchanged, height).otherwise(even(height))


def recommend(inventory: DataFrame, target: str, resolution: str = "keep", policy: str = "skip", reencode: bool = False) -> DataFrame:
    """keep, remux, transcode, skip or preview for a target codec."""
    out_width, out_height = output_dimensions(F.col("width"), F.col("height"), resolution)
    resizing = (out_width != F.col("width")) | (out_height != F.col("height"))
    dv, codec = holds(F.col("dv")), F.col("video_codec")
    contained = F.when(F.col("container").contains("matroska"), "keep").otherwise("remux")
    action = (
        F.when(dv & F.lit(policy == "sdr-preview") & ~resizing, "preview").when(dv & F.lit(policy == "copy") & ~resizing, contained).when(dv, "skip")
        .when(resizing, "transcode").when(F.lit(reencode) & codec.isin("hevc", "av1"), "transcode").when(codec == target, contained)
        .when(codec.isin("av1", "hevc") & F.lit(target == "hevc"), contained).otherwise("transcode")
    )
    return inventory.withColumns({"recommendation": action, "out_width": out_width, "out_height": out_height})


def _named(names: Column, pattern: str) -> Column:
    return F.exists(names, lambda n: n.rlike(pattern))


def hdr_kind(streams: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """HDR family from side-data names seen on the stream or any sampled frame.

    Names are tested where they are read and only flags are aggregated.
    """
    tests = {"layered": "(?i)dovi|dolby", "plus": r"(?i)2094-40|hdr10\+", "dynamic": r"(?i)dynamic.*hdr|hdr.*dynamic"}

    def flags(df: DataFrame) -> DataFrame:
        names = meta.side_names(F.col("side"))
        return df.select(*keys, *[_named(names, p).cast("int").alias(k) for k, p in tests.items()])

    seen = flags(streams).unionByName(flags(frames)).groupBy(*keys).agg(*[F.max(k).alias(k) for k in tests])
    rows = streams.select(*keys, "color_transfer").join(seen, list(keys))
    kind = (
        F.when(F.col("layered") == 1, "layered HDR").when(F.col("plus") == 1, "HDR10+").when(F.col("dynamic") == 1, "dynamic HDR")
        .when(F.col("color_transfer") == "arib-std-b67", "HLG").otherwise("PQ HDR")
    )
    return rows.select(*keys, kind.alias("kind"))


def valid_pixel_format(column: Column) -> Column:
    return ~column.isin("unknown", "none") & column.rlike(r"^[a-z][a-z0-9_]{0,31}$")


def sdr_eligibility() -> Column:
    """First reason an SDR source cannot be converted; NULL when it can."""
    declared = lambda c: _unknown(c) | F.col(c).rlike(r"^[a-z][a-z0-9_-]{0,31}$")
    side = meta.side_names(F.col("side"))
    return first_failure([
        (~holds(F.col("color_transfer").isin(*HDR_TRANSFERS)), "HDR transfer needs its own workflow"),
        (valid_pixel_format(F.col("pixel_format")), "missing or invalid pixel format"),
        (F.col("field_order").isin("progressive", *FIELD_ORDERS), "scan type not established"),
        (F.col("color_range").isin("tv", "pc") & declared("color_primaries") & declared("color_transfer") & declared("color_space"), "missing or unsupported color metadata"),
        (~F.exists(side, lambda n: n.rlike(r"(?i)dovi|dolby|2094|hdr10\+")), "dynamic HDR needs its own workflow"),
        ((F.col("width") > 0) & (F.col("height") > 0), "invalid dimensions"),
    ])


def hdr_eligibility() -> Column:
    """First reason an HDR source cannot be admitted; NULL when it can."""
    checks = [
        (~holds(F.col("dv")), "layered HDR needs its own route"),
        (F.col("color_transfer").isin(*HDR_TRANSFERS), "HDR transfer cannot be determined"),
        (valid_pixel_format(F.col("pixel_format")), "missing or invalid pixel format"),
    ]
    for c in ("color_primaries", "color_space", "color_range"):
        checks.append((~F.col(c).isin("unknown", "unspecified", "N/A", "0:1"), f"evidence is missing {c}"))
    checks.append(((F.col("width") > 0) & (F.col("height") > 0), "invalid dimensions"))
    return first_failure(checks)


# The one tested interlaced DVD profile.
DVD_PROFILE = {"video_codec": "mpeg2video", "width": 720, "height": 480, "pixel_format": "yuv420p", "sar": "8:9", "field_order": "tt"}


def dvd_eligibility() -> Column:
    profile = F.lit(True)
    for name, value in DVD_PROFILE.items():
        profile = profile & (F.col(name) == value)
    return first_failure([
        (F.col("video_tracks") == 1, "requires exactly one video track"), (profile, "outside the tested profile"),
        (F.col("frame_rate") == "30000/1001", "requires 29.97 interlaced input"),
        (~F.exists(meta.side_names(F.col("side")), lambda n: n != "CPB properties"), "unexpected side data"), (F.col("duration_s") > 0, "invalid duration"),
    ])


def verify_copies(source: DataFrame, output: DataFrame, expected_codec: str, key: str = "id", minimum_bp: int | None = None) -> DataFrame:
    """Inventory row of each copy against its source; first failed property wins.

    ``minimum_bp`` (basis points) also demands a saving.
    """
    names = [c for c in source.columns if c != key]
    a = source.select(key, *[F.col(c).alias(f"a_{c}") for c in names])
    b = output.select(key, F.lit(True).alias("_copied"), *[F.col(c).alias(f"b_{c}") for c in names])
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    kept = lambda c: ~holds(x(c)) | y(c)
    known = lambda c: x(c).isNull() | y(c).eqNullSafe(x(c))
    dv = lambda rule: ~holds(x("dv")) | rule
    checks = [
        (F.col("_copied"), "output missing"), (y("video_codec") == expected_codec, "unexpected video codec"),
        ((y("width") == x("width")) & (y("height") == x("height")), "resolution changed"),
        ((F.coalesce(x("duration_s"), F.lit(0)) == 0) | (F.abs(y("duration_s") - x("duration_s")) <= 2.0), "duration differs by more than two seconds"),
        (F.size(y("audio_codecs")) == F.size(x("audio_codecs")), "audio stream count changed"), (y("audio_codecs") == x("audio_codecs"), "audio codecs changed"),
        (y("subtitle_codecs") == x("subtitle_codecs"), "subtitle streams changed"), (kept("hdr"), "HDR signaling was lost"),
        (~holds(x("hdr")) | (y("bit_depth") >= 10), "HDR output below 10 bits"), (dv(y("dv")), "layered HDR signaling was lost"),
        (dv(known("dv_profile")), "layered HDR profile changed"), (dv(known("dv_compatibility")), "base-layer compatibility changed"),
        (dv(kept("dv_rpu")), "layered HDR metadata was lost"), (dv(kept("dv_el")), "enhancement layer was lost"),
        (kept("mastering"), "mastering metadata was lost"), (kept("content_light"), "content-light metadata was lost"),
    ]
    checks += [((x(c) == "unknown") | (x(c) == y(c)), f"{c} changed") for c in COLORS]
    if minimum_bp is not None:
        checks.append((y("size_bytes") < x("size_bytes"), "output is not smaller"))
        checks.append(((x("size_bytes") - y("size_bytes")).cast("decimal(20,0)") * 10_000 >= x("size_bytes").cast("decimal(20,0)") * minimum_bp, "savings below the minimum"))
    reason = first_failure(checks)
    return a.join(b, key, "left").select(key, reason.alias("reason"), F.when(reason.isNull(), "pass").otherwise("fail").alias("status"))


VIDEO_KEYS = ("width", "height", "pix_fmt", "color_range", "color_space", "color_transfer", "color_primaries")
COPIED_KEYS = ("codec", "sample_rate", "channels", "channel_layout", "extradata_hash")
TAGS = ("language", "title", "filename", "mimetype")


def stream_changes(pairs: DataFrame, codec: str, frames: Column | None = None, variable_timing: bool = False) -> DataFrame:
    """Names of every property that changed between two paired streams.

    ``pairs`` has ``a_*`` and ``b_*`` stream columns and ``primary`` (the moving
    video track).  Ratios compare exactly, unknown languages are equal, average
    rates may differ by rounding once ``frames`` were verified.
    """
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    same = lambda c: a(c).eqNullSafe(b(c))
    primary = F.col("primary")
    flags = lambda p: F.array_sort(F.map_entries(F.col(f"{p}_disposition")))
    checks = [(same("codec_type"), "codec_type"), (flags("a").eqNullSafe(flags("b")), "disposition")]
    checks += [(~primary | same(c), c) for c in VIDEO_KEYS]
    checks.append((~primary | (b("codec") == codec), "codec"))
    aspect = lambda p: effective_pixel_aspect(F.col(f"{p}_sar"), F.col(f"{p}_dar"), F.col(f"{p}_width"), F.col(f"{p}_height"))
    checks.append((~primary | ratios_equal(F.col("_a_aspect"), F.col("_b_aspect")), "sar"))
    if variable_timing:
        rate = a("frame_rate").rlike(r"^[1-9]\d*(/[1-9]\d*)?$") & b("frame_rate").rlike(r"^[1-9]\d*(/[1-9]\d*)?$")
    else:
        rate = compatible_measured_rate(a("frame_rate"), b("frame_rate"), frames if frames is not None else F.lit(0))
    checks.append((~primary | rate, "frame_rate"))
    matrix = lambda p: meta.display_matrix(F.col(f"{p}_matrix"))
    undeclared = F.col("a_matrix").isNull() & F.col("b_matrix").isNull()
    checks.append((~primary | undeclared | (matrix("a") == matrix("b")), "display_matrix"))
    checks += [(primary | same(c), c) for c in COPIED_KEYS]
    before, after = F.col("_a_tags"), F.col("_b_tags")
    checks.append((before.isNotNull() & after.isNotNull(), "conflicting tags"))
    for tag in TAGS:
        left, right = F.element_at(before, F.lit(tag)), F.element_at(after, F.lit(tag))
        checks.append((meta.equivalent_language(left, right) if tag == "language" else left.eqNullSafe(right), f"tag {tag}"))
    # Columns of their own are worked out once a row, however many checks use them.
    shared = {f"_{p}_aspect": F.when(F.coalesce(primary, F.lit(True)), aspect(p)) for p in ("a", "b")} | {f"_{p}_tags": meta.canonical_tags(F.col(f"{p}_tags")) for p in ("a", "b")}
    rows = pairs.withColumns(shared).withColumn("changed", failed_names(checks)).drop(*shared)
    return rows.withColumn("status", F.when(F.size("changed") == 0, "pass").otherwise("fail"))


def chapter_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chapters equal in exact start, end and tags; generated ids are ignored."""

    def canonical(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, "ordinal", meta.canonical_chapter(F.col("start"), F.col("end"), F.col("tags")).alias(side))

    rows = canonical(before.withColumn("_h", F.lit(1)), "a").join(canonical(after, "b"), [*keys, "ordinal"], "full_outer")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") == F.col("b"))
    reason = F.when(F.col("a").isNull() & F.col("b").isNull(), "invalid chapter").when(F.col("a").isNull() | F.col("b").isNull(), "chapter missing or invalid").when(~ok, "chapter changed")
    from framesleuth.functions.checks import verdicts

    return verdicts(rows.withColumn("reason", reason), keys)


def check_vector(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All named checks must hold; lists those that do not, in order."""
    names = failed_names([(ok, name) for name, ok in checks.items()])
    return rows.withColumn("failed", names).withColumn("passed", F.size("failed") == 0)


HEX64 = r"^[0-9a-f]{64}$"


def evidence_gate(reports: DataFrame, flags: Sequence[str], counts: Sequence[str], hashes: Sequence[str], frame_counts: Sequence[str] = ()) -> DataFrame:
    """First missing piece of evidence: flags true, hashes 64 hex digits, counts
    positive, and every score covering exactly ``frames`` frames."""
    checks = [(F.col(c), f"flag not proven: {c}") for c in flags]
    checks += [(F.col(c) > 0, f"invalid count: {c}") for c in counts]
    checks += [(F.col(c).rlike(HEX64), f"missing identity: {c}") for c in hashes]
    checks += [(F.col(c) == F.col("frames"), f"scores cover other frames: {c}") for c in frame_counts]
    reason = first_failure(checks)
    return reports.withColumn("reason", reason).withColumn("qualified", reason.isNull())


# Name endings of generated evidence that may be cleaned up.
GENERATED_MEDIA = (
    ".mkv", ".mp4", ".mov", ".avi", ".hevc", ".h265", ".h264", ".av1", ".obu", ".ivf", ".yuv", ".y4m", ".rgb", ".raw", ".pcm", ".wav", ".bin", ".ac3",
    ".aac", ".m4v", ".rpu", ".mka", ".thd", ".truehd", ".eac3", ".dts", ".flac",
)
# Whole names and endings of other generated files, and numbered stream lists.
GENERATED_FILES = ("rpu.json", "timestamps.txt", "source-rpu-packets.xml", "render-0-progress.txt", "render-1-progress.txt")
GENERATED_ENDINGS = (
    ".framehash", "-frames.jsonl", "-frames.json", "-all-packets.txt", "-preset-packets.txt", "-vmaf.json", "-dts-source-packets.json", "-dts-output-packets.json",
    "-dts-source-frame-sizes.json", "-rpu.json", ".hdr-index.sqlite",
)
NUMBERED_LIST = r"-stream-\d+\.txt$"


def disposable(path: Column) -> Column:
    """Name marks a generated file (report only; nothing is deleted)."""
    name = file_name(path)
    layered = (name == "metadata.json") & folder_of(path).endswith("-layers")
    ended = F.lit(False)
    for ending in GENERATED_ENDINGS:
        ended = ended | name.endswith(ending)
    return extension(path).isin(*GENERATED_MEDIA) | name.isin(*GENERATED_FILES) | ended | name.rlike(NUMBERED_LIST) | layered


def cleanup_reason(path: Column, primary: Column, samples: bool = False, root: Column | None = None) -> Column:
    """Why a file beside the main video is nominated for review; NULL otherwise.

    Only folders below ``root`` can mark a sample, not the library's own place.
    """
    suffix = extension(path)
    below = path if root is None else F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))
    in_folder = F.coalesce(F.lower(below), F.lit("")).rlike("(^|/)samples?/")
    named = stem_of(path).rlike(r"(?i)(^|[._ -])sample$")
    sampled = F.lit(samples) & suffix.isin(*MEDIA_EXTENSIONS) & (in_folder | named)
    return F.when(path == primary, None).when(suffix == ".nfo", "metadata file; review").when(sampled, "explicit sample folder or name; review")


def complete_hardlinks(files: DataFrame) -> DataFrame:
    """Generated files nominated only when every link of their inode is listed.

    ``files``: path, dev, ino, nlink.
    """
    links = files.groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("listed"))
    return files.join(links, ["dev", "ino"]).withColumn("nominated", F.col("listed") == F.col("nlink"))


def readable_destination(files: DataFrame, suffix: str = ".mkv") -> DataFrame:
    """Folder title as file name for a cryptic release name that is the only media
    file of its folder; otherwise the name with the new extension.

    Siblings are counted per folder; files with companions keep their names.
    """
    media = (*MEDIA_EXTENSIONS, ".vob")
    keyed = files.withColumns({"_folder": folder_of(F.col("path")), "_suffix": extension(F.col("path")), "_stem": stem_of(F.col("path"))})
    siblings = keyed.groupBy("_folder").agg(F.count_if(F.col("_suffix").isin(*media)).alias("_media"))
    # A companion belongs to every name it extends by a dotted part.
    parts = F.split(F.lower(file_name(F.col("path"))), r"\.")
    owners = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    companions = keyed.where(F.col("_suffix").isin(*COMPANION_EXTENSIONS)).select("_folder", F.explode(owners).alias("_stem_key")).distinct().withColumn("_companion", F.lit(True))
    rows = keyed.where(F.col("_suffix").isin(*media)).join(siblings, "_folder").withColumn("_stem_key", F.lower("_stem")).join(companions, ["_folder", "_stem_key"], "left")
    title = F.regexp_replace(F.regexp_extract("_folder", r"([^/]*)$", 1), r'[<>:"/\\|?*\x00-\x1f]', " ")
    title = F.btrim(F.regexp_replace(title, r"\s+", " "), F.lit(" ."))
    cryptic = F.col("_stem").rlike(r"(?i)^[a-z0-9]{2,12}-[a-z0-9]{2,12}[._-](?:480|576|720|1080|2160)p$") & ~F.col("_stem").rlike(r"(?i)s\d+e\d+|\d+x\d+")
    usable = (F.octet_length(title) <= 180) & (F.size(F.split(title, " ")) >= 2) & ~title.rlike(r"(?i)\b(?:season|extras|samples|test|output)\b")
    renamed = cryptic & usable & (F.col("_media") == 1) & F.col("_companion").isNull()
    name = F.when(renamed, title).otherwise(F.col("_stem"))
    return rows.select("path", F.concat("_folder", F.lit("/"), name, F.lit(suffix)).alias("destination"), renamed.alias("renamed"))


def preset_geometry(rows: DataFrame, preset: str) -> DataFrame:
    """Even size inside the preset keeping display aspect through the pixel aspect.

    Integer arithmetic throughout; the new aspect is in lowest terms.
    """
    limit = PRESETS[preset]
    if limit is None:
        return rows.withColumns({"out_width": F.col("width"), "out_height": F.col("height"), "out_sar": F.col("sar"), "resized": F.lit(False)})
    pw, ph = limit
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    by_width = F.lit(pw) * h <= F.lit(ph) * w
    div = lambda a, b: F.call_function("div", a, b)
    unit = F.when(F.col("field_order").isin(*FIELD_ORDERS), 4).otherwise(2)
    raw_w = F.when(by_width, F.lit(pw)).otherwise(div(w * ph, h))
    raw_h = F.when(by_width, div(h * pw, w)).otherwise(F.lit(ph))
    new_w, new_h = F.greatest(F.lit(2), div(raw_w, F.lit(2)) * 2), F.greatest(unit, div(raw_h, unit) * unit)
    fits = (w <= pw) & (h <= ph)
    aspect = effective_pixel_aspect(F.col("sar"), F.col("dar"), w, h)
    text = F.concat((aspect["num"].cast("long") * w * new_h).cast("string"), F.lit("/"), (aspect["den"].cast("long") * h * new_w).cast("string"))
    lowest = F.replace(meta.lowest_terms(text), F.lit("/"), F.lit(":"))
    return rows.withColumns({
        "out_width": F.when(fits, w).otherwise(new_w), "out_height": F.when(fits, h).otherwise(new_h),
        "out_sar": F.when(fits, F.col("sar")).otherwise(lowest), "resized": ~fits,
    })


# Where samples are taken, in per mille of the free length.
SHORT_FRACTIONS, LONG_FRACTIONS = (150, 500, 850), (100, 300, 500, 700, 900)


def sample_plan(files: DataFrame, requested_ms: int) -> DataFrame:
    """Sample windows of each file: five for 30 minutes and more, three below, and
    the whole source under six seconds.  Times in milliseconds."""
    d = F.col("duration_ms")
    seconds = F.when(d < 6000, d).otherwise(F.least(F.lit(requested_ms), F.call_function("div", d, F.lit(6))))
    parts = lambda fs: F.array(*[F.lit(f) for f in fs])
    fractions = F.when(d < 6000, parts((0,))).when(d >= 1_800_000, parts(LONG_FRACTIONS)).otherwise(parts(SHORT_FRACTIONS))
    rows = files.where(d > 0).withColumn("window_ms", seconds).select("*", F.posexplode(fractions).alias("window", "_f"))
    return rows.withColumn("start_ms", F.call_function("div", (d - F.col("window_ms")) * F.col("_f"), F.lit(1000))).withColumn("whole_source", d < 6000).drop("_f")


def align_seek(plans: DataFrame) -> DataFrame:
    """Seek moved down to a point every copied track's clock can represent.

    ``clocks``: array of struct<num, den> time bases; times in microseconds.  The
    common quantum is lcm(num) / gcd(den); the change is refused when it would
    precede the origin or exceed ``maximum_us``.
    """

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    num = F.aggregate("clocks", one, lambda acc, c: F.call_function("div", acc * c["num"], meta.gcd(acc, c["num"], 90)))
    den = F.aggregate("clocks", zero, lambda acc, c: meta.gcd(acc, c["den"], 90))
    rows = plans.withColumns({"_num": num, "_den": den})
    relative = F.col("seek_us") - F.col("origin_us")
    # floor(relative / quantum), quantum = num/den seconds
    steps = F.floor((relative.cast("decimal(20,0)") * F.col("_den")) / (F.col("_num").cast("decimal(10,0)") * 1_000_000)).cast("long")
    aligned = F.col("origin_us") + F.call_function("div", steps * F.col("_num") * 1_000_000, F.col("_den"))
    longer = F.col("length_us") + F.col("seek_us") - aligned
    ok = (aligned >= F.col("origin_us")) & (longer <= F.col("maximum_us"))
    return rows.withColumns({"aligned_us": F.when(ok, aligned).otherwise(F.col("seek_us")), "aligned_length_us": F.when(ok, longer).otherwise(F.col("length_us"))}).drop("_num", "_den")


def window_check(packets: DataFrame, keys: Sequence[str], seconds_us: Column) -> DataFrame:
    """Span of a sample's video packets must not exceed twice the request."""
    facts = packets.groupBy(*keys).agg(
        F.min("pts").alias("_start"), F.max(F.col("pts") + F.col("dur")).alias("_end"), F.count(F.lit(1)).alias("packets"),
        F.count_if(~holds(F.col("pts").isNotNull() & (F.col("dur") > 0))).alias("_bad"),
    )
    span = F.col("_end") - F.least(F.lit(0), F.col("_start"))
    reason = F.when(F.col("_bad") > 0, "incomplete sample timing").when(span > 2 * seconds_us, "exceeds bounded sampling window")
    return facts.select(*keys, "packets", span.alias("span_us"), reason.alias("reason"))


def inventory_summary(rows: DataFrame) -> DataFrame:
    """Files and bytes by action, by codec and overall, from one pass."""
    return rows.groupingSets([[F.col("action")], [F.col("video_codec")], []], "action", "video_codec").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )
