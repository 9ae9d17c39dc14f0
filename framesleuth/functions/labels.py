"""Classification of phases, outcomes and messages into fixed labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stage time categories by phase, first match wins.
PHASE_PREFIXES = (
    ("validation_wait", ("waiting for validation resources",)),
    ("frame_validation", ("checking original hdr metadata", "checking hdr frames:")),
    ("quality_measurement", ("measuring shared hdr quality",)),
    ("checksums", ("verifying file checksum:",)),
    ("frame_validation", ("checking frame timing:", "checking hdr frame timing:", "comparing frame geometry")),
    ("track_validation", (
        "checking copied track:", "checking all copied tracks:", "organizing copied-track", "comparing copied track",
        "reusing verified sample", "reusing verified source",
    )),
    ("metadata", ("reading media metadata:", "inspecting legacy color")),
)
# Beginnings of encoder stages, and what fixed words of a reason mean.
ENCODER_PREFIXES = (
    "hevc_nvenc-", "av1_nvenc-", "hevc_amf-", "av1_amf-", "hevc_qsv-", "av1_qsv-", "libx265-", "libsvtav1-", "libaom-av1-",
)
VALIDATION_CATEGORIES = ("metadata", "checksums", "full_decode", "track_validation", "frame_validation")

ATTENTION_REASON = r"(?i)unsupported|not supported|unavailable|needs attention|recovery|conflict"
NO_BENEFIT_REASON = (
    r"(?i)no worthwhile savings|full output did not (?:save enough space|meet savings)|no eligible.*(?:size|smaller)"
    r"|quality.*(?:not met|below|threshold)|quality_pass"
)
NO_BENEFIT_CODES = ("already_efficient_for_settings", "full_output_insufficient_savings")

# Messages of structural checks and their plain wording.
STRUCTURAL_MESSAGES = {
    "Requires exactly one moving video track (cover pictures are separate)": "source_video_layout",
    "HDR finalizer requires one moving video track": "source_video_layout",
    "Cover picture precedes the movie track; stream ordering needs specialized handling": "source_video_layout",
    "Interleaved cover artwork needs stream-order-preserving remux support": "source_video_layout",
    "Cover artwork needs a supported image codec, filename and MIME type": "source_artwork_layout",
    "Attachment payload hash unavailable": "attachment_evidence_unavailable",
}
REPEATED_CLOCK = (
    r"\[vost#[^\]\r\n]*/av1_nvenc[^\]\r\n]*\] Non-monotonic DTS; previous: (-?\d+), current: (-?\d+); "
    r"Error submitting a packet to the muxer"
)


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    found = text.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        found = found | text.startswith(prefix)
    return found


def phase_category(phase: Column) -> Column:
    label = F.lower(phase)
    result = F.when(F.lit(False), "")
    for name, prefixes in PHASE_PREFIXES:
        result = result.when(_starts(label, prefixes), name)
    return (
        result.when(label.endswith("-quality"), "quality_measurement").when(label.endswith("-decode"), "full_decode")
        .when(label.startswith("reference-"), "sample_extraction")
        .when((label == "full-encode") | _starts(label, ENCODER_PREFIXES), "encoding").otherwise("other")
    )


def report_bucket(category: Column) -> Column:
    return (
        F.when(category == "encoding", "encoding").when(category == "quality_measurement", "quality").when(category.endswith("_wait"), "waiting")
        .when(category == "gpu_pause", "paused").when(category.isin(*VALIDATION_CATEGORIES), "validation").otherwise("other")
    )


def outcome_category(state: Column, reason: Column, code: Column, outcome: Column) -> Column:
    text = F.coalesce(reason, F.lit(""))
    no_benefit = F.coalesce(code.isin(*NO_BENEFIT_CODES), F.lit(False)) | text.rlike(NO_BENEFIT_REASON)
    return (
        F.when(state.isin("pending", "running"), "active").when(state == "cancelled", "cancelled").when(state == "replaced", "replaced")
        .when(state.isin("verified", "awaiting-playback", "playback-approved"), "copies")
        .when(state.isin("failed", "interrupted") | F.coalesce(outcome == "error", F.lit(False)), "errors")
        .when((state == "skipped") & text.rlike(ATTENTION_REASON), "attention").when((state == "skipped") & no_benefit, "benefit").when(state == "skipped", "other")
        .when(state.isin("kept-original", "analyzed", "tested", "completed"), "other").otherwise("attention")
    )


def report_group(category: Column) -> Column:
    return (
        F.when(category.isin("replaced", "copies"), "converted").when(category.isin("errors", "attention"), "problems")
        .when(category == "active", "active").otherwise("kept")
    )


def outcome_label(state: Column, code: Column, outcome: Column) -> Column:
    # Labels shown for measured outcomes.
    return (
        F.when(state.isin("pending", "running", "cancelled"), F.initcap(state))
        .when((state == "skipped") & (code == "source_timing_conflict"), "Source timing issue — original kept")
        .when(outcome == "quality", "Quality checks not met").when(outcome == "savings", "Insufficient space savings")
        .when(outcome == "size_quality", "No setting met both size and quality").when(outcome == "error", "Processing error").otherwise(F.initcap(state))
    )


def structural_failure(message: Column) -> Column:
    """Code of a failure that other settings of the same encoder would repeat."""
    first, second = F.regexp_extract(message, REPEATED_CLOCK, 1), F.regexp_extract(message, REPEATED_CLOCK, 2)
    table = F.create_map(*[F.lit(x) for pair in STRUCTURAL_MESSAGES.items() for x in pair])
    return (
        F.when((first != "") & (first == second), "av1_duplicate_decode_timestamp")
        .when(message.rlike(r"\AFrame \d+: chroma location changed\z"), "chroma_siting_preservation").otherwise(F.element_at(table, message))
    )


def human_size(size: Column) -> Column:
    """Binary unit text with two decimals, ties to even."""
    value, result = size.cast("double"), None
    for power, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB")):
        scaled = F.format_string(f"%.2f {unit}", F.bround(value / 1024.0**power, 2))
        below = value < 1024.0 ** (power + 1)
        result = F.when(below, scaled) if result is None else (result.when(below, scaled) if unit != "TiB" else result.otherwise(scaled))
    return result


def option_name(codec: Column, encoder: Column, settings: Column) -> Column:
    """Display name such as ``AV1 · P6 · CQ 21``."""
    name = F.when(codec == "av1", "AV1").when(codec == "hevc", "HEVC").when(codec == "h264", "H.264").otherwise("Encoding option")
    quality = F.element_at(settings, F.lit("quality"))
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), quality)
    preset = F.coalesce(F.element_at(settings, F.lit("nvenc_preset")), pick({"transparent": "p7", "balanced": "p6", "compact": "p5"}))
    cq = F.coalesce(F.element_at(settings, F.lit("nvenc_cq")), pick({"transparent": "18", "balanced": "21", "compact": "25"})).try_cast("int")
    hardware = F.coalesce(encoder.endswith("_nvenc"), F.lit(False))
    return F.concat(
        name, F.when(hardware & preset.isin("p4", "p5", "p6", "p7"), F.concat(F.lit(" · "), F.upper(preset))).otherwise(""),
        F.when(hardware & cq.between(0, 63), F.concat(F.lit(" · CQ "), cq.cast("string"))).otherwise(""),
    )


def natural_key(text: Column) -> Column:
    """Sort key that orders digit runs of any length by value, case folded.

    A run is written as its length without leading zeros, in four digits, and
    then those digits.  Longer runs write the length in ten digits after a colon,
    which sorts after every digit.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        count = F.length(digits).cast("string")
        length = F.when(F.length(digits) < 10_000, F.lpad(count, 4, "0")).otherwise(F.concat(F.lit(":"), F.lpad(count, 10, "0")))
        return F.when(run.rlike(r"^\d"), F.concat(length, digits)).otherwise(run)

    return F.array_join(F.transform(runs, key), "", None)


def csv_cell(value: Column) -> Column:
    """Quoted cell that a spreadsheet will not run as a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^\s*[=+@-]") | text.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
