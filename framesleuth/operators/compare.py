"""Ordered source-versus-copy comparison.

Both sides carry a dense ``ordinal`` per group, so the ordered zip is an equi
full-outer join on ``(group, ordinal)``: unique keys, evenly spread however
large one track is.  Each joined row gets the reason of its first failed check;
the verdict of a group is the reason at its smallest failing ordinal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesleuth.functions.checks import first_failure, holds, verdicts
from framesleuth.functions.metadata import picture_signature, same_side_data, side_names
from framesleuth.functions.rational import TOLERANCE_US, differs, equivalent_ratio, floor_div, ticks
from framesleuth.operators import ordered

# Colour fields of a frame, and spellings of "unknown colour".
COLOR_FIELDS = ("color_primaries", "color_transfer", "color_space", "color_range")
UNKNOWN_COLOR = ("unknown", "unspecified", "reserved", "")
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
SDR_FORBIDDEN_SIDE = r"(?i)dovi|dolby|mastering|content light|hdr|display matrix"
HDR_PIXELS = tuple(f"yuv{c}p{d}" for c in ("420", "422", "444") for d in ("", "10le", "12le"))
CHROMATICITY = ("red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y", "white_point_x", "white_point_y")


def zip_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Zip-longest of two ordered tables; columns become ``a_*`` and ``b_*``."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            *keys, ordinal, F.lit(True).alias(f"{prefix}_here"), *[F.col(f).alias(f"{prefix}_{f}") for f in fields]
        )

    return side(left, "a").join(side(right, "b"), [*keys, ordinal], "full_outer")


def _both() -> Column:
    return F.col("a_here") & F.col("b_here")


def _close(field: str, tolerance: int = TOLERANCE_US) -> Column:
    return ~differs(F.col(f"a_{field}"), F.col(f"b_{field}"), tolerance)


def _same(field: str) -> Column:
    return F.col(f"a_{field}").eqNullSafe(F.col(f"b_{field}"))


def compare_packets(
    reference: DataFrame,
    output: DataFrame,
    keys: Sequence[str],
    *,
    cover: bool = False,
    first_pts: bool = False,
    first_duration_absent: bool = False,
    timestamps_filled: bool = False,
    durations_filled: bool = False,
    durations_dropped: bool = False,
    terminal_duration: bool = False,
) -> DataFrame:
    """Payload hash equal and pts/dts/duration within 2 ms, packet by packet.

    The flags are allowances another proof has already earned; each exempts one
    field in one situation and nothing else.  A cover image has no timeline: it
    must be exactly one unchanged packet.
    """
    rows = zip_rows(reference, output, keys, ["hash", "pts", "dts", "dur"])
    first = F.col("ordinal") == 1

    def exempt(field: str) -> Column:
        a, b = F.col(f"a_{field}"), F.col(f"b_{field}")
        allowed = F.lit(False)
        if field == "pts" and first_pts:
            allowed = allowed | first
        if field in ("pts", "dts") and timestamps_filled:
            allowed = allowed | (a.isNull() & b.isNotNull())
        if field == "dur":
            if durations_filled:
                allowed = allowed | (a.isNull() & (b > 0))
            if durations_dropped:
                allowed = allowed | (b.isNull() & (a > 0))
            if first_duration_absent:
                allowed = allowed | (first & b.isNull())
        return holds(allowed)

    checks = [(_both() & (F.col("a_hash") == F.col("b_hash")), "payload or count changed")]
    if not cover:
        checks += [(_close(f) | exempt(f), f"timing changed: {f}") for f in ("pts", "dts", "dur")]
    rows = rows.withColumn("reason", first_failure(checks))
    extra = {}
    if terminal_duration:
        extra = {"_last": F.max("ordinal")}
    result = verdicts(rows, keys, **extra)
    if cover:
        return result.withColumn(
            "reason", F.when(F.col("rows_checked") != 1, "expected exactly one cover packet").otherwise(F.col("reason"))
        ).withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("fail"))
    if terminal_duration:
        only_last = (
            (F.col("failures") == 1) & (F.col("first_bad_ordinal") == F.col("_last")) & (F.col("reason") == "timing changed: dur")
        )
        result = (
            result.withColumn("status", F.when(holds(only_last), "pass").otherwise(F.col("status")))
            .withColumn("reason", F.when(~holds(only_last), F.col("reason")))
            .drop("_last")
        )
    return result


def pair_streams(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair streams by position, ordinary tracks first and covers after them."""

    def ranked(df: DataFrame, side: str) -> DataFrame:
        slim = df.select(*keys, F.col("is_cover").cast("int").alias("_cover"), "stream_index", "codec")
        return ordered.number_rows(slim, keys, ["_cover", "stream_index"], "position").select(
            *keys, "position", F.col("stream_index").alias(f"{side}_index"), F.col("codec").alias(f"{side}_codec")
        )

    pairs = ranked(before, "source").join(ranked(after, "output"), [*keys, "position"], "full_outer")
    whole = F.col("source_index").isNotNull() & F.col("output_index").isNotNull()
    return pairs.withColumn("reason", F.when(~whole, "track count changed"))


def _timeline(df: DataFrame, keys: Sequence[str], clock: Column) -> DataFrame:
    return ordered.scan(df.withColumn("_clock", clock), keys, previous=ordered.lag(F.col("_clock"))).withColumn(
        "rising", F.col("previous").isNull() | (F.col("_clock") > F.col("previous"))
    )


def compare_frames_sdr(reference: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decoded frames of an SDR copy: geometry, colour, scan, side data and time."""
    clock = F.coalesce("pts", "best_pts")
    fields = ["width", "height", "pix_fmt", "sar", *COLOR_FIELDS, "interlaced", "repeat_pict", "top_field_first", "side", "best_pts", "rising"]
    rows = zip_rows(_timeline(reference, keys, clock), _timeline(output, keys, clock), keys, fields)
    checks = [(_both(), "frame count changed")]
    checks += [(_same(f), f"geometry changed: {f}") for f in ("width", "height", "pix_fmt")]
    checks.append((equivalent_ratio(F.col("a_sar"), F.col("b_sar")), "geometry changed: sar"))
    for f in COLOR_FIELDS:
        unknown = F.col(f"a_{f}").isNull() | F.col(f"a_{f}").isin(*UNKNOWN_COLOR)
        checks.append((unknown | _same(f), f"color changed: {f}"))
    checks += [(F.col(f"a_{f}") == F.col(f"b_{f}"), f"scan changed: {f}") for f in ("interlaced", "repeat_pict")]
    field_order = F.col("a_top_field_first").isin(0, 1) & _same("top_field_first")
    checks.append(((F.col("a_interlaced") != 1) | field_order, "field order changed"))
    for side in ("a", "b"):
        checks.append((~holds(F.col(f"{side}_color_transfer").isin(*HDR_TRANSFERS)), "unexpected HDR transfer"))
        names = F.filter(side_names(F.col(f"{side}_side")), lambda n: ~n.isin("Mastering display metadata", "Content light level metadata"))
        checks.append((~F.exists(names, lambda n: n.rlike(SDR_FORBIDDEN_SIDE)), "unexpected side data"))
    checks.append((same_side_data(F.col("a_side"), F.col("b_side")), "static metadata changed"))
    checks.append((F.col("a_rising"), "source timestamps do not increase"))
    checks.append((F.col("b_rising"), "output timestamps do not increase"))
    checks.append((F.abs(F.col("a_best_pts") - F.col("b_best_pts")) <= TOLERANCE_US, "frame timing changed"))
    return verdicts(rows.withColumn("reason", first_failure(checks)), keys)


def compare_frames_hdr(source: DataFrame, output: DataFrame, keys: Sequence[str], mode: str = "hdr10") -> DataFrame:
    """Decoded frames of an HDR copy: every field exact, time within 2 ms."""
    exact = ["width", "height", "pix_fmt", "color_range", "color_space", "color_transfer", "color_primaries"]
    clock = F.col("best_pts")
    fields = [*exact, "sar", "interlaced", "repeat_pict", "chroma_location", "side", "best_pts", "rising"]
    rows = zip_rows(_timeline(source, keys, clock), _timeline(output, keys, clock), keys, fields)
    transfer = "arib-std-b67" if mode == "hlg" else "smpte2084"
    checks = [
        (_both(), "frame count changed"),
        (F.col("a_pix_fmt").isin(*HDR_PIXELS) & (F.col("a_color_transfer") == transfer), "unsupported transfer or pixel format"),
    ]
    for f in [*exact, "sar"]:
        known = F.col(f"a_{f}").isNotNull() & ~F.col(f"a_{f}").cast("string").isin("unknown", "unspecified")
        equal = equivalent_ratio(F.col("a_sar"), F.col("b_sar")) if f == "sar" else _same(f)
        checks.append((known & equal, f"missing or changed: {f}"))
    for side in ("a", "b"):
        still = (F.col(f"{side}_interlaced") == 0) & (F.col(f"{side}_repeat_pict") == 0)
        checks.append((still, "unconfirmed progressive frame"))
        checks.append((~F.exists(side_names(F.col(f"{side}_side")), lambda n: n.rlike("(?i)display matrix")), "display rotation"))
    near = F.abs(F.col("a_best_pts") - F.col("b_best_pts")) <= TOLERANCE_US
    checks.append((near & F.col("a_rising") & F.col("b_rising"), "timestamp changed or not increasing"))
    checks.append((_same("chroma_location"), "chroma location changed"))
    for side in ("a", "b"):
        names = side_names(F.col(f"{side}_side"))
        checks.append((~F.exists(names, lambda n: n.rlike("(?i)dovi|dolby")), "layered HDR needs its own workflow"))
        if mode == "hdr10":
            checks.append((~F.exists(names, lambda n: n.rlike(r"(?i)dynamic|2094|hdr10\+")), "dynamic HDR in static HDR"))
    checks.append((same_side_data(F.col("a_side"), F.col("b_side")), "HDR metadata changed"))
    rows = rows.withColumn("reason", first_failure(checks))
    names = side_names(F.col("a_side"))
    dynamic = holds(F.exists(names, lambda n: n.rlike(r"2094-40|HDR10\+")))
    static = holds(F.array_contains(names, "Mastering display metadata"))
    result = verdicts(
        rows, keys,
        dynamic_frames=F.count_if(dynamic), static_frames=F.count_if(static),
        max_delta_us=F.max(F.abs(F.col("a_best_pts") - F.col("b_best_pts"))),
    )
    needed = {"hdr10plus": "dynamic_frames", "hdr10": "static_frames"}.get(mode)
    if needed:
        empty = (F.col("status") == "pass") & (F.col(needed) == 0)
        result = result.withColumn("reason", F.when(empty, f"no {mode} frame evidence").otherwise(F.col("reason")))
        result = result.withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("fail"))
    return result


def _static_difference(a: Column, b: Column) -> Column:
    """'same', 'rounded' (one 1/50000 chromaticity step) or 'changed' for two side lists."""

    def one(left: Column, right: Column) -> Column:
        keys_equal = F.array_sort(F.map_keys(left)) == F.array_sort(F.map_keys(right))

        def verdict(key: Column) -> Column:
            x, y = F.element_at(left, key), F.element_at(right, key)
            # Both values are n/50000 texts: compare the integer numerators.
            xn, yn = (F.regexp_extract(v, r"^(\d{1,9})/50000$", 1) for v in (x, y))
            step = F.abs(F.nullif(xn, F.lit("")).cast("long") - F.nullif(yn, F.lit("")).cast("long")) <= 1
            return F.when(x == y, 0).when(key.isin(*CHROMATICITY) & F.coalesce(step, F.lit(False)), 1).otherwise(2)

        worst = F.coalesce(F.array_max(F.transform(F.map_keys(left), verdict)), F.lit(0))
        return F.when(keys_equal, worst).otherwise(2)

    def pair(z: Column) -> Column:
        return F.when(z["l"].isNull() | z["r"].isNull(), 2).otherwise(one(z["l"], z["r"]))

    zipped = F.arrays_zip(F.coalesce(a, F.array()).alias("l"), F.coalesce(b, F.array()).alias("r"))
    return F.coalesce(F.array_max(F.transform(zipped, pair)), F.lit(0))


def compare_frames_layered(source: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decoded frames of a layered-HDR copy; static metadata may move by one
    chromaticity unit, which is counted rather than failed."""
    clock = F.col("best_pts")

    def prepared(df: DataFrame) -> DataFrame:
        static = F.filter(F.coalesce(F.col("side"), F.array()), lambda m: F.element_at(m, F.lit("side_data_type")).rlike("(?i)mastering|content light"))
        return _timeline(df, keys, clock).withColumn("picture", picture_signature()).withColumn("static_side", static)

    rows = zip_rows(prepared(source), prepared(output), keys, ["best_pts", "rising", "picture", "static_side"])
    rows = rows.withColumn("_static", _static_difference(F.col("a_static_side"), F.col("b_static_side")))
    checks = [
        (_both(), "frame count changed"),
        (F.abs(F.col("a_best_pts") - F.col("b_best_pts")) <= TOLERANCE_US, "frame timing changed"),
        (F.col("a_rising") & F.col("b_rising"), "timeline not increasing"),
        (F.col("a_picture").isNotNull() & _same("picture"), "geometry, aspect or color changed"),
        (F.col("_static") < 2, "static HDR metadata changed"),
    ]
    rows = rows.withColumn("reason", first_failure(checks))
    return verdicts(rows, keys, rounded_frames=F.count_if(F.col("reason").isNull() & (F.col("_static") == 1)))


def compare_tracks_strict(before: DataFrame, after: DataFrame, keys: Sequence[str], streams: DataFrame) -> DataFrame:
    """Bytes, order and timestamps exact; AAC on a 1 ms clock may lose or round a
    duration by one tick, counted per track."""
    fields = ["hash", "size", "pts", "dts", "dur"]
    rows = zip_rows(before, after, keys, fields).join(
        streams.select(*keys, "codec_type", "codec", "time_base"), list(keys), "left"
    )
    exact = [(_same(f), f"bytes, sequence or timestamps changed: {f}") for f in ("dts", "hash", "pts", "size")]
    aac = (F.col("codec_type") == "audio") & (F.col("codec") == "aac") & (F.col("time_base") == "1/1000")
    dropped = F.col("b_dur").isNull()
    checks = [
        (_both(), "packet count changed"), *exact,
        (_same("dur") | aac, "unexpected duration change"),
        (_same("dur") | (F.col("a_dur") > 0), "invalid source duration"),
        (_same("dur") | dropped | ((F.col("b_dur") > 0) & (F.abs(F.col("a_dur") - F.col("b_dur")) <= 1000)), "duration change exceeds 1 ms"),
    ]
    rows = rows.withColumn("reason", first_failure(checks))
    return verdicts(rows, keys, rounded=F.count_if(F.col("reason").isNull() & ~_same("dur")))


def compare_tracks_inferred(left: DataFrame, right: DataFrame, keys: Sequence[str], infer: bool = True) -> DataFrame:
    """Hash, side data and timing exact; a duration present on one side only is
    accepted when it matches the gap to the next source packet within 2 ms."""
    following = ordered.scan(left, keys, next_pts=ordered.lead(F.col("pts")))
    rows = zip_rows(
        following, right.withColumn("next_pts", F.lit(None).cast("long")), keys,
        ["hash", "size", "pts", "dts", "dur", "side_key", "next_pts"],
    )
    supplied = F.coalesce("a_dur", "b_dur")
    gap = F.col("a_next_pts") - F.col("a_pts")
    one_sided = F.col("a_dur").isNull() != F.col("b_dur").isNull()
    inferred = holds(F.lit(infer) & one_sided & (gap > 0) & (F.abs(gap - supplied) <= TOLERANCE_US))
    checks = [
        (_both(), "packet count changed"),
        (F.col("a_hash") == F.col("b_hash"), "payload changed"),
        (_same("side_key"), "side data changed"),
        (_same("pts") & _same("dts") & _same("size") & (_same("dur") | inferred), "timing changed"),
    ]
    rows = rows.withColumn("reason", first_failure(checks))
    return verdicts(rows, keys, inferred=F.count_if(F.col("reason").isNull() & inferred))


def compare_decoded_audio(
    reference: DataFrame, output: DataFrame, keys: Sequence[str], first_source_us: int | None = None, first_output_us: int | None = None
) -> DataFrame:
    """Decoded audio hashes: payload and length exact, clock within 2 ms and rising."""
    if (first_source_us is None) != (first_output_us is None):
        raise ValueError("both initial audio anchors are required together")
    clock = F.col("pts")
    rows = zip_rows(
        _timeline(reference, keys, clock), _timeline(output, keys, clock), keys, ["dur", "size", "hash", "pts", "rising"]
    )
    delta = F.abs(F.col("a_pts") - F.col("b_pts"))
    checks = [
        (_both(), "decoded frame count changed"),
        (_same("dur") & _same("size") & (F.col("a_hash") == F.col("b_hash")), "decoded payload or sample count changed"),
        (delta <= TOLERANCE_US, "presentation timing changed"),
    ]
    if first_source_us is not None:
        anchored = (F.abs(F.col("a_pts") - first_source_us) <= TOLERANCE_US) & (F.abs(F.col("b_pts") - first_output_us) <= TOLERANCE_US)
        checks.append(((F.col("ordinal") > 1) | anchored, "initial packet not proven non-output"))
    checks.append((F.col("a_rising") & F.col("b_rising"), "timeline not increasing"))
    rows = rows.withColumn("reason", first_failure(checks))
    return verdicts(rows, keys, max_delta_us=F.max(delta))


def compare_clocks(source: DataFrame, output: DataFrame, keys: Sequence[str], decoded: DataFrame | None = None) -> DataFrame:
    """Every video clock equal after exact rescaling to the output's tick.

    Inputs carry ``pts_ticks``, ``dur_ticks`` and their clock ``base_num`` /
    ``base_den``; the source clock has to be finer, the output's at most 2 ms.
    Rows meet on the rescaled presentation tick, which must be unique.
    """
    bases = output.groupBy(*keys).agg(F.first("base_num").alias("to_num"), F.first("base_den").alias("to_den"))
    moved = source.join(bases, list(keys)).select(
        *keys,
        ticks(F.col("pts_ticks"), F.col("base_num"), F.col("base_den"), F.col("to_num"), F.col("to_den")).alias("tick"),
        ticks(F.col("dur_ticks"), F.col("base_num"), F.col("base_den"), F.col("to_num"), F.col("to_den"), "floor").alias("span"),
    )
    kept = output.select(*keys, F.col("pts_ticks").alias("tick"), F.col("dur_ticks").alias("span"))

    def per_tick(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys, "tick").agg(F.count(F.lit(1)).alias(f"{side}_n"), F.min("span").alias(f"{side}_span"))

    rows = per_tick(moved, "a").join(per_tick(kept, "b"), [*keys, "tick"], "full_outer")
    checks = [
        ((F.coalesce("a_n", F.lit(0)) <= 1) & (F.coalesce("b_n", F.lit(0)) <= 1), "presentation timestamps are not unique"),
        (F.col("a_n").isNotNull() & F.col("b_n").isNotNull(), "clocks do not project exactly"),
        ((F.col("a_span") > 0) & (F.col("b_span") > 0), "duration is unresolved"),
        (F.col("a_span") == F.col("b_span"), "clocks do not project exactly"),
    ]
    rows = rows.withColumn("reason", first_failure(checks)).withColumnRenamed("tick", "ordinal")
    result = verdicts(rows, keys)
    if decoded is not None:
        result = result.join(decoded, list(keys), "left")
        short = ~holds(F.col("rows_checked") == F.col("decoded_frames"))
        result = result.withColumn(
            "reason", F.when((F.col("status") == "pass") & short, "packets and decoded frames differ").otherwise(F.col("reason"))
        ).withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("fail"))
    return result


def materialised_durations(reference: DataFrame, output: DataFrame, decoded: DataFrame, keys: Sequence[str], tick_us: Column) -> DataFrame:
    """Durations newly given by the output must be the decoded frame's length cut
    to whole output ticks (three-way zip; ``tick_us`` divides exactly)."""
    frames = decoded.select(*keys, "ordinal", F.lit(True).alias("f_here"), F.col("pts").alias("f_pts"), F.col("dur").alias("f_dur"))
    rows = zip_rows(reference, output, keys, ["hash", "pts", "dts", "dur"]).join(frames, [*keys, "ordinal"], "full_outer")
    filled = F.col("a_dur").isNull() & F.col("b_dur").isNotNull()
    expected = floor_div(F.col("f_dur"), tick_us) * tick_us
    checks = [
        (F.col("a_here") & F.col("b_here") & F.col("f_here"), "packet and frame association incomplete"),
        (F.col("a_hash") == F.col("b_hash"), "payload changed"),
        (_close("pts") & _close("dts") & F.col("a_pts").isNotNull(), "clock changed"),
        (F.abs(F.col("a_pts") - F.col("f_pts")) <= TOLERANCE_US, "packet does not match decoded frame"),
        (~filled | ((expected > 0) & (F.col("b_dur") == expected)), "duration is not the decoded projection"),
    ]
    rows = rows.withColumn("reason", first_failure(checks))
    result = verdicts(rows, keys, materialised=F.count_if(F.col("reason").isNull() & filled))
    none = (F.col("status") == "pass") & (F.col("materialised") == 0)
    return result.withColumn("reason", F.when(none, "no materialised durations").otherwise(F.col("reason"))).withColumn(
        "status", F.when(F.col("reason").isNull(), "pass").otherwise("fail")
    )


def normalise_rounding(left: DataFrame, right: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differing durations are accepted when both are the sample-backed length
    rounded down or up to a whole tick.

    ``frames`` carries ``samples``, ``rate``, ``tick_num`` and ``tick_den``;
    durations are in ticks of that clock.
    """
    f = frames.select(*keys, "ordinal", F.lit(True).alias("f_here"), F.col("pts").alias("f_pts"), "samples", "rate", "tick_num", "tick_den")
    rows = zip_rows(left, right, keys, ["pts", "dur"]).join(f, [*keys, "ordinal"], "full_outer")
    num, den = F.col("samples") * F.col("tick_den"), F.col("rate") * F.col("tick_num")
    low = floor_div(num, den)
    high = -floor_div(-num, den)
    allowed = F.col("a_dur").isin(low, high) & F.col("b_dur").isin(low, high)
    changed = F.col("a_dur") != F.col("b_dur")
    fine_clock = (F.col("rate") > 0) & (F.col("tick_num") > 0) & (F.col("tick_num") * 1000 <= F.col("tick_den"))
    checks = [
        (F.col("a_here") & F.col("b_here") & F.col("f_here"), "no one-to-one packet and frame correspondence"),
        (fine_clock, "unsupported clock precision"),
        (F.col("f_pts").eqNullSafe(F.col("a_pts")) & F.col("f_pts").eqNullSafe(F.col("b_pts")), "decoded frame timing changed"),
        (F.col("samples") > 0, "invalid decoded sample count"),
        (~F.coalesce(changed, F.lit(False)) | allowed, "duration difference exceeds rounding"),
    ]
    rows = rows.withColumn("reason", first_failure(checks))
    return verdicts(rows, keys, rounded=F.count_if(F.col("reason").isNull() & F.coalesce(changed, F.lit(False))))


def matching_timeline(source: DataFrame, output: DataFrame, keys: Sequence[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Presentation times relative to the first agree within 2 ms in sorted order.

    ``start``/``end`` bound the source side (half open).
    """
    chosen = source.where(F.col("pts").isNotNull())
    if start is not None:
        chosen = chosen.where((F.col("pts") >= start) & (F.col("pts") < end))
    other = output.where(F.col("pts").isNotNull())
    tie = [c for c in ("pts", "ordinal") if c in source.columns]

    def sorted_times(df: DataFrame) -> DataFrame:
        return ordered.number_rows(df.select(*keys, *tie), keys, tie, "rank").select(*keys, F.col("rank").alias("ordinal"), "pts")

    a, b = sorted_times(chosen), sorted_times(other)
    first = (
        a.groupBy(*keys).agg(F.min("pts").alias("a_first")).join(b.groupBy(*keys).agg(F.min("pts").alias("b_first")), list(keys), "full_outer")
    )
    repeated = ordered.scan(a, keys, previous=ordered.lag(F.col("pts"))).withColumn("repeat", F.col("pts") == F.col("previous"))
    rows = zip_rows(repeated, b.withColumn("repeat", F.lit(False)), keys, ["pts", "repeat"]).join(first, list(keys))
    offset = (F.col("a_pts") - F.col("a_first")) - (F.col("b_pts") - F.col("b_first"))
    checks = [
        (_both(), "count changed"),
        (~F.coalesce("a_repeat", F.lit(False)), "repeated timestamp"),
        (F.abs(offset) <= TOLERANCE_US, "timeline changed"),
    ]
    return verdicts(rows.withColumn("reason", first_failure(checks)), keys)


def timeline_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], shown: int = 20) -> DataFrame:
    """Counts on both sides, mismatches over 2 ms, and the first few of them.

    Showing only the first mismatches is the report's feature; the count covers
    all of them.
    """
    from pyspark.sql import Window

    rows = zip_rows(left, right, keys, ["pts"]).withColumn("delta_us", F.col("b_pts") - F.col("a_pts"))
    bad = _both() & (F.abs("delta_us") > TOLERANCE_US)
    totals = rows.groupBy(*keys).agg(
        F.count("a_here").alias("source_count"), F.count("b_here").alias("output_count"), F.count_if(holds(bad)).alias("mismatch_count")
    )
    position = Window.partitionBy(*keys).orderBy("ordinal")
    first = (
        rows.where(bad).select(*keys, "ordinal", "delta_us").withColumn("n", F.row_number().over(position)).where(F.col("n") <= shown)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", "delta_us"))).alias("first_mismatches"))
    )
    passed = (F.col("source_count") > 0) & (F.col("source_count") == F.col("output_count")) & (F.col("mismatch_count") == 0)
    return totals.join(first, list(keys), "left").withColumn("passed", passed)


def exact_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Two readers of the same file must agree on every field of every row."""
    rows = zip_rows(left, right, keys, fields)
    same = F.struct(*[f"a_{f}" for f in fields]).eqNullSafe(F.struct(*[f"b_{f}" for f in fields]))
    checks = [(_both(), "row count differs"), (same, "row fields differ")]
    return verdicts(rows.withColumn("reason", first_failure(checks)), keys)


def position_conflicts(frames: DataFrame, packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First pair of neighbouring frames whose clock does not rise, confirmed by
    the packets at both byte positions.

    Frames carry ``pts`` and ``pkt_pos``; a later packet at the same position
    replaces an earlier one.
    """
    timed = frames.where(F.col("pts").isNotNull())
    pairs = ordered.scan(timed, keys, before=ordered.lag(F.struct("pts", "pkt_pos"))).where(F.col("pts") <= F.col("before.pts"))
    at = packets.where(F.col("pos").isNotNull()).groupBy(*keys, "pos").agg(F.max_by("pts", "ordinal").alias("packet_pts"))
    pairs = pairs.select(
        *keys, "ordinal", F.col("pts"), F.col("pkt_pos").alias("pos"),
        F.col("before.pts").alias("previous_pts"), F.col("before.pkt_pos").alias("previous_pos"),
    )
    confirmed = pairs.join(at.where(F.col("packet_pts").isNotNull()), [*keys, "pos"]).where(F.col("packet_pts") == F.col("pts")).drop("packet_pts")
    earlier = at.select(*keys, F.col("pos").alias("previous_pos"), F.col("packet_pts").alias("previous_packet_pts"))
    confirmed = confirmed.join(earlier, [*keys, "previous_pos"]).where(
        (F.col("previous_packet_pts") == F.col("previous_pts")) & (F.col("pos") != F.col("previous_pos"))
    )
    found = F.min_by(F.struct("previous_pts", "pts", "previous_pos", "pos"), F.col("ordinal"))
    return confirmed.groupBy(*keys).agg(F.count(F.lit(1)).alias("conflicts"), found.alias("_f")).select(
        *keys, "conflicts", F.col("_f.previous_pts").alias("previous_pts"), F.col("_f.pts").alias("pts"),
        F.col("_f.previous_pos").alias("previous_packet"), F.col("_f.pos").alias("packet"),
    )


def packet_identity_join(frames: DataFrame, packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every frame owns exactly one packet at its byte position with its own time.

    Packets at positions no frame names are other pictures and are ignored.
    """
    f = frames.groupBy(*keys, F.col("pkt_pos").alias("pos")).agg(F.count(F.lit(1)).alias("frames"), F.min("pts").alias("frame_pts"))
    p = packets.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).alias("packets"), F.min("pts").alias("low_pts"), F.max("pts").alias("high_pts")
    )
    rows = f.join(p, [*keys, "pos"], "left")
    checks = [
        (F.col("frames") == 1, "duplicate frame identity"),
        (F.coalesce("packets", F.lit(0)) <= 1, "duplicate packet identity"),
        (F.col("packets").isNotNull(), "missing packet"),
        ((F.col("low_pts") == F.col("frame_pts")) & (F.col("high_pts") == F.col("frame_pts")), "presentation timestamp mismatch"),
    ]
    rows = rows.withColumn("reason", first_failure(checks)).withColumnRenamed("pos", "ordinal")
    return verdicts(rows, keys)


def keyframe_hints(pictures: DataFrame, packets: DataFrame, keys: Sequence[str], shift_us: Column) -> DataFrame:
    """Times of instantaneous-refresh pictures (unit kinds 19 and 20) whose packet
    is a kept keyframe; empty for a group whose counts differ."""
    rows = zip_rows(
        pictures.select(*keys, "ordinal", "kind", F.lit(None).cast("string").alias("flags"), F.lit(None).cast("long").alias("pts")),
        packets.select(*keys, "ordinal", F.lit(None).cast("int").alias("kind"), "flags", "pts"), keys, ["kind", "flags", "pts"],
    )
    odd = rows.where(~F.coalesce(_both(), F.lit(False))).select(*keys).distinct()
    point = F.col("b_pts") - shift_us
    wanted = F.col("a_kind").isin(19, 20) & F.col("b_flags").contains("K") & ~F.col("b_flags").contains("D") & (point >= 0)
    return rows.where(wanted).join(odd, list(keys), "left_anti").select(*keys, "ordinal", point.alias("hint_us"))


def revalidate_copy(properties: DataFrame, video: DataFrame, tracks: DataFrame, chapters: DataFrame, attachments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One verdict per file from the parts already compared.

    Each part has ``keys`` and a nullable ``reason``; the first failing part in
    the order properties, video times, tracks, chapters, attachments wins.
    """
    parts = [("properties", properties), ("video", video), ("tracks", tracks), ("chapters", chapters), ("attachments", attachments)]
    rows = None
    for rank, (name, part) in enumerate(parts):
        tagged = part.select(*keys, F.lit(rank).alias("rank"), F.when(F.col("reason").isNotNull(), F.concat(F.lit(name + ": "), "reason")).alias("reason"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    at = F.when(F.col("reason").isNotNull(), F.struct("rank", "reason"))
    return rows.groupBy(*keys).agg(
        F.count_distinct("rank").alias("parts_checked"), F.count("reason").alias("failures"), F.min(at)["reason"].alias("reason")
    ).withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("parts_checked") < len(parts)), "part not checked").otherwise(F.col("reason"))
    ).withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("fail"))
