"""Trials, samples and scores: pooling, eligibility, choice and forecast.

Scores are integers in hundredths (or finer) of a point and sizes are bytes, so
every threshold test is exact.  Reasons come from a fixed vocabulary, which
keeps each group's state to a few flags however many samples it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesleuth.functions.checks import holds
from framesleuth.session import materialise

# Acceptance profiles (points) and selection limits.
PROFILES = {"strict": (95, 90), "balanced": (94, 90), "space-saver": (90, 90)}
MAX_EXTRA_PERCENT = 5
MAX_EXTRA_BYTES = 512 * 1024**2
CODECS = ("hevc", "av1", "h264")
MIN_SCENE_MS, MIN_TOTAL_MS = 500, 3000


def profiles(spark: SparkSession, scale: int = 100) -> DataFrame:
    rows = [(name, mean * scale, p5 * scale) for name, (mean, p5) in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, mean_floor long, p5_floor long")


def pool_scores(scores: DataFrame, keys: Sequence[str], mean_floor: Column, p5_floor: Column, expected: DataFrame | None = None, bin_width: int = 100) -> DataFrame:
    """Mean and exact nearest-rank 5th percentile of integer frame scores.

    Scores are first counted per distinct value.  A coarse histogram finds the
    bin that holds the rank, and only that bin's values are ordered, so no group
    is ever collected or sorted whole.  Scores with a ``weight``, the number of
    equal frames, are counted already: a group has few rows, and they are ranked
    where they are (see ``_pool_counted``).  ``expected`` (keys,
    ``expected_frames``) makes short evidence fail.
    """
    keys = list(keys)
    pooled = _pool_counted(scores, keys) if "weight" in scores.columns else _pool_frames(scores, keys, bin_width)
    if expected is not None:
        pooled = expected.join(pooled, keys, "left")
        complete = (F.col("frames") == F.col("expected_frames")) & (F.col("invalid") == 0)
    else:
        complete = F.col("invalid") == 0
    passed = complete & (F.col("score_sum") >= mean_floor * F.col("frames")) & (F.col("p5") >= p5_floor)
    return pooled.select(
        *keys, F.coalesce("frames", F.lit(0)).alias("frames"), "score_sum", F.call_function("div", F.col("score_sum"), F.col("frames")).alias("mean"),
        "p5", holds(complete).alias("complete"), holds(passed).alias("passed"),
    )


def _pool_frames(scores: DataFrame, keys: list[str], bin_width: int) -> DataFrame:
    """``p5, frames, score_sum, invalid`` of each group, from any number of rows."""
    counts = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    binned = counts.withColumn("_bin", F.floor(F.col("score") / bin_width))
    bins = binned.groupBy(*keys, "_bin").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("score")).alias("_sum"), F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0)).alias("_bad")
    )
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.withColumns({
        "frames": F.sum("_n").over(whole), "score_sum": F.sum("_sum").over(whole), "invalid": F.sum("_bad").over(whole),
        "_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)),
    }).withColumn("_rank", F.greatest(F.lit(1), F.call_function("div", F.col("frames") + 19, F.lit(20))))
    target = ranked.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))).drop("_n", "_sum", "_bad")
    # NULL scores form a NULL bin, which sorts first and may be the target bin.
    inside = binned.select(*keys, F.col("_bin").alias("_b"), "score", "n").join(target, keys).where(F.col("_b").eqNullSafe(F.col("_bin")))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("_cum", F.col("_before") + running).where(F.col("_cum") >= F.col("_rank"))
    return reached.groupBy(*keys).agg(
        F.min("score").alias("p5"), F.max("frames").alias("frames"), F.max("score_sum").alias("score_sum"), F.max("invalid").alias("invalid")
    )


def _pool_counted(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The same from counted scores: one order of a group's values, and no row is joined back.

    Rows that are placed by some of the keys already are not moved.
    """
    order = Window.partitionBy(*keys).orderBy("score")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = scores.withColumns({"_cum": F.sum("weight").over(upto), "frames": F.sum("weight").over(whole)})
    reached = F.col("_cum") >= F.greatest(F.lit(1), F.call_function("div", F.col("frames") + 19, F.lit(20)))
    # NULL scores come first and may hold the rank.
    first = F.min(F.when(reached, F.struct("_cum", "score")))
    pooled = ranked.groupBy(*keys).agg(
        first.alias("_first"), F.max("frames").alias("frames"), F.sum(F.col("weight") * F.col("score")).alias("score_sum"), F.sum(F.when(F.col("score").isNull(), F.col("weight")).otherwise(0)).alias("invalid")
    )
    return pooled.where("_first IS NOT NULL").select(*keys, F.col("_first.score").alias("p5"), "frames", "score_sum", "invalid")


#: Widths of the bins that narrow real scores down, coarse to fine.
SCORE_BINS = (1e-2, 1e-6, 1e-10)
_EXACT = "decimal(28,10)"


def pool_real_scores(scores: DataFrame, keys: Sequence[str], mean_floor: str, p5_floor: float, expected: DataFrame | None = None) -> DataFrame:
    """Mean and exact nearest-rank 5th percentile of floating-point frame scores.

    ``frames, invalid, score_sum, mean, p5, complete, passed`` per group.  A null,
    NaN or infinite score, a listing of another length than ``expected`` (keys,
    ``expected_frames``) and an empty one are incomplete: they have no mean or
    percentile and never pass.  Sums are taken in decimals of ten places, so they
    do not depend on the order of rows.  The rank is found in bins that keep the
    order of scores, each a ten-thousandth of the one before; only rows of the
    bin that holds the rank go on, so no group is sorted whole.
    """
    keys = list(keys)
    exact = F.col("score").cast("double").try_cast(_EXACT)
    real = F.col("score").cast("double")
    good = real.isNotNull() & ~F.isnan(real) & (F.abs(real) < float("inf")) & exact.isNotNull()
    rows = scores.select(*keys, F.when(good, real).alias("score"), F.when(good, exact).alias("_exact"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("score").isNull()).alias("invalid"), F.sum("_exact").alias("score_sum"))
    totals = materialise(totals, "score-totals")
    place = totals.select(*keys, F.greatest(F.lit(1), F.call_function("div", F.col("frames") + 19, F.lit(20))).alias("_rank"), F.lit(0).cast("long").alias("_before"))
    left = rows.where("score IS NOT NULL").select(*keys, "score")
    for width in SCORE_BINS:
        binned = left.withColumn("_bin", F.floor(F.col("score") / width))
        upto = Window.partitionBy(*keys).orderBy("_bin")
        counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
        reached = counts.join(place, keys).where(F.col("_before") + F.col("_upto") >= F.col("_rank"))
        chosen = reached.groupBy(*keys).agg(F.min("_bin").alias("_bin"), F.max("_rank").alias("_rank"), F.min(F.col("_before") + F.col("_upto") - F.col("_n")).alias("_before"))
        place = materialise(chosen, "score-bins")
        left = materialise(binned.join(place.select(*keys, "_bin"), [*keys, "_bin"]).select(*keys, "score"), "score-rows")
        place = place.drop("_bin")
    upto = Window.partitionBy(*keys).orderBy("score")
    last = left.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto)).join(place, keys)
    p5 = last.where(F.col("_before") + F.col("_upto") >= F.col("_rank")).groupBy(*keys).agg(F.min("score").alias("p5"))
    pooled = totals.join(p5, keys, "left")
    if expected is None:
        complete = F.col("invalid") == 0
    else:
        pooled = expected.join(pooled, keys, "left")
        complete = (F.col("frames") == F.col("expected_frames")) & (F.col("invalid") == 0)
    complete = holds(complete & (F.col("frames") > 0))
    passed = holds(complete & (F.col("score_sum") >= F.lit(mean_floor).cast(_EXACT) * F.col("frames")) & (F.col("p5") >= p5_floor))
    shown = lambda value: F.when(complete, value)
    return pooled.select(
        *keys, F.coalesce("frames", F.lit(0)).cast("long").alias("frames"), F.coalesce("invalid", F.lit(0)).cast("long").alias("invalid"), shown(F.col("score_sum")).alias("score_sum"),
        shown(F.col("score_sum").cast("double") / F.col("frames")).alias("mean"), shown(F.col("p5")).alias("p5"), complete.alias("complete"), passed.alias("passed"),
    )


def real_scorer_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], mean_floor: str, p5_floor: float, tolerance: float = 0.0001) -> DataFrame:
    """Two scorers agree when both score every frame, no frame differs by more than
    ``tolerance`` and both reach the same verdict.  Frame numbers are unique inside a group."""
    keys = list(keys)
    a = left.select(*keys, "frame_no", F.col("score").alias("a"))
    b = right.select(*keys, "frame_no", F.col("score").alias("b"))
    gaps = a.join(b, [*keys, "frame_no"], "full_outer").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference")
    )
    verdict = lambda df, side: pool_real_scores(df, keys, mean_floor, p5_floor).select(*keys, F.col("passed").alias(f"{side}_passed"), F.col("complete").alias(f"{side}_complete"))
    joined = gaps.join(verdict(left, "left"), keys, "left").join(verdict(right, "right"), keys, "left")
    whole = F.col("left_complete") & F.col("right_complete") & (F.col("unpaired") == 0)
    same = whole & (F.col("max_difference") <= tolerance) & (F.col("left_passed") == F.col("right_passed"))
    flag = lambda c: holds(F.col(c))
    return joined.select(*keys, "frames", "unpaired", F.when(holds(whole), F.col("max_difference")).alias("max_difference"), flag("left_passed").alias("left_passed"), flag("right_passed").alias("right_passed"), holds(same).alias("passed"))


def scorer_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: int, mean_floor: Column, p5_floor: Column) -> DataFrame:
    """Two scorers agree when no frame differs by more than ``tolerance`` and both
    reach the same verdict.  Frame numbers are unique inside a group."""
    keys = list(keys)
    a = left.select(*keys, "frame_no", F.col("score").alias("a"))
    b = right.select(*keys, "frame_no", F.col("score").alias("b"))
    gaps = a.join(b, [*keys, "frame_no"], "full_outer").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference")
    )
    verdict = lambda df, name: pool_scores(df, keys, mean_floor, p5_floor).select(*keys, F.col("passed").alias(name))
    joined = gaps.join(verdict(left, "left_passed"), keys, "left").join(verdict(right, "right_passed"), keys, "left")
    ok = (F.col("unpaired") == 0) & (F.col("max_difference") <= tolerance) & (F.col("left_passed") == F.col("right_passed"))
    return joined.withColumn("passed", holds(ok))


def combine_views(native: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weaker of two score views; both must cover the same number of frames."""
    b = fallback.select(*keys, *[F.col(c).alias(f"f_{c}") for c in ("frames", "mean", "p5", "passed")])
    rows = native.join(b, list(keys), "full_outer")
    same = holds(F.col("frames") == F.col("f_frames"))
    return rows.select(
        *keys, F.least("mean", "f_mean").alias("mean"), F.least("p5", "f_p5").alias("p5"),
        holds(same & F.col("passed") & F.col("f_passed")).alias("passed"), F.when(~same, "views cover different frames").alias("reason"),
    )


def near_boundary(views: Column, floors: Sequence[tuple[str, int]], margin: int) -> Column:
    """Any view within ``margin`` of a floor; ``views`` is array<struct<mean,p5>>."""
    return F.exists(views, lambda v: _any([F.abs(v[name] - floor) <= margin for name, floor in floors]))


def _any(flags: Sequence[Column]) -> Column:
    result = flags[0]
    for flag in flags[1:]:
        result = result | flag
    return result


def meets_policy(passed: Column, mean: Column, p5: Column, frames: Column, mean_floor: Column, p5_floor: Column, top: int = 10_000) -> Column:
    """Producer's pass flag backed by scores inside [floor, top] and real frames."""
    return holds(passed & mean.between(mean_floor, top) & p5.between(p5_floor, top) & (frames > 0))


def requirement(size: Column, mode: str = "fixed", percent: str = "25") -> Column:
    """Bytes that must be saved: ceil(size * percent / 100) exactly, or size-aware
    max(100 MB, min(ceil(size/4), 1 GB))."""
    if mode == "size-aware":
        return F.greatest(F.lit(100_000_000), F.least(F.call_function("div", size + 3, F.lit(4)), F.lit(1_000_000_000)))
    whole, _, part = percent.partition(".")
    den = 100 * 10 ** len(part)
    exact = size.cast("decimal(20,0)") * F.lit(int(whole + part))
    return F.call_function("div", exact + (den - 1), F.lit(den))


def savings_decision(source: Column, output: Column, required: Column) -> Column:
    """Reason text of the size gate; the first value means eligible."""
    enough = (output < source) & (source - output >= required)
    return (
        F.when(~holds((source > 0) & (output > 0)), "positive sizes are required").when(enough, "meets size threshold")
        .when(output >= source, "output is not smaller").otherwise("savings are below the minimum")
    )


def _flag(condition: Column) -> Column:
    return F.max(holds(condition).cast("int"))


def trial_facts(references: DataFrame, samples: DataFrame) -> DataFrame:
    """Per (report, trial): sizes, coverage of the shared references, and flags.

    Samples are first reduced per reference, so a duplicate is a count.
    """
    refs = references.groupBy("report").agg(
        F.count(F.lit(1)).alias("refs"), F.count_distinct("reference").alias("distinct_refs"), F.sum("bytes").alias("reference_bytes"),
        F.min(holds(F.col("bytes") > 0).cast("int")).alias("refs_positive"),
    )
    known = references.select("report", "reference", F.lit(1).alias("known")).distinct()
    error = F.col("error").isNotNull()
    measured_failure = (~F.col("quality_pass")) & (~F.col("quality.passed")) & F.col("preservation_pass") & F.col("decode_pass")
    by_reference = samples.groupBy("report", "trial", "reference").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min(holds(F.col("bytes") > 0).cast("int")).alias("positive"),
        F.min(holds(F.col("encode_completed") & ~error).cast("int")).alias("encoded"), _flag(error).alias("errors"),
        _flag(measured_failure).alias("measured_failure"),
        _flag(F.col("quality").isNotNull() | F.col("quality_pass") | F.col("preservation_pass") | F.col("decode_pass")).alias("examined"),
        _flag(~holds(F.col("policy_met"))).alias("policy_failed"),
        _flag(~holds(F.col("quality_pass"))).alias("quality_failed"), _flag(~holds(F.col("preservation_pass"))).alias("preservation_failed"),
        _flag(~holds(F.col("decode_pass"))).alias("decode_failed"), _flag(F.col("quality_method").isNull()).alias("no_method"),
        F.min("quality.p5").alias("p5"), F.sum("execution_ms").alias("ms"), F.min("execution_ms").alias("low_ms"), F.count("execution_ms").alias("timed"),
    )
    spread = by_reference.join(known, ["report", "reference"], "left")
    trials = spread.groupBy("report", "trial").agg(
        F.sum("n").alias("samples"), F.count(F.lit(1)).alias("covered"), F.count("known").alias("known"), F.sum("bytes").alias("output_bytes"),
        F.min("positive").alias("positive"), F.min("encoded").alias("encoded"), F.max("errors").alias("errors"),
        *[F.max(c).alias(c) for c in ("measured_failure", "examined", "policy_failed", "quality_failed", "preservation_failed", "decode_failed", "no_method")],
        F.min("p5").alias("min_p5"), F.sum("ms").alias("total_ms"), F.min("low_ms").alias("least_ms"), F.sum("timed").alias("timed"),
    )
    return trials.join(refs, "report", "right").where(F.col("trial").isNotNull())


def too_little_saved(output: Column, reference: Column, minimum_bp: int) -> Column:
    """Output not smaller, or saving less than ``minimum_bp`` basis points."""
    return (output >= reference) | (output.cast("decimal(20,0)") * 10_000 > reference.cast("decimal(20,0)") * (10_000 - minimum_bp))


def size_bound(references: DataFrame, samples: DataFrame, minimum_bp: int) -> DataFrame:
    """Trials whose partial samples already exceed the budget: even zero bytes for
    the rest cannot pass.  Unknown, failed or duplicate evidence is inconclusive."""
    f = trial_facts(references, samples)
    sound = (
        (F.col("refs") >= 3) & (F.col("distinct_refs") == F.col("refs")) & (F.col("refs_positive") == 1) & (F.col("samples") == F.col("covered"))
        & (F.col("known") == F.col("covered")) & (F.col("positive") == 1) & (F.col("encoded") == 1)
    )
    over = F.col("output_bytes").cast("decimal(20,0)") * 10_000 > F.col("reference_bytes").cast("decimal(20,0)") * (10_000 - minimum_bp)
    return f.where(holds(sound & over)).select(
        "report", "trial", F.col("output_bytes").alias("output_bytes_lower_bound"), "reference_bytes", F.col("samples").alias("completed_samples"), F.col("refs").alias("total_samples")
    )


REASONS = (
    "source_identity_mismatch", "encoder_not_runtime_verified", "target_playback_not_verified", "full_source_metadata_not_preservable_by_candidate",
    "unsupported_codec", "missing_encoder_settings", "unmatched_reference_samples",
)


def candidates(reports: DataFrame, references: DataFrame, trials: DataFrame, samples: DataFrame, minimum_bp: int) -> DataFrame:
    """Assessment of every trial, with the sorted set of reasons against it.

    Assessments: eligible, insufficient_savings, quality_rejected,
    size_screened, speed_screened, dominated_unmeasured, inconclusive.
    """
    facts = trial_facts(references, samples)
    per_report = references.groupBy("report").agg(F.count(F.lit(1)).alias("_refs"), F.sum("bytes").alias("_reference_bytes"))
    t = trials.join(per_report, "report").join(facts.drop("refs", "reference_bytes"), ["report", "trial"], "left")
    t = t.withColumns({"refs": F.col("_refs"), "reference_bytes": F.col("_reference_bytes")}).join(
        reports.select("report", F.col("source_id").alias("report_source")), "report"
    )
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    complete = (count("samples") == F.col("refs")) & (count("covered") == F.col("refs")) & (count("known") == F.col("refs"))
    structural = [
        holds(F.col("source_id") == F.col("report_source")), holds(F.col("runtime_supported")), holds(F.col("playback_compatible")),
        F.coalesce(F.col("preservable"), F.lit(True)), holds(F.col("codec").isin(*CODECS)), holds(F.col("encoder").isNotNull() & (F.size("settings") > 0)), complete,
    ]
    subset = (count("samples") == count("covered")) & (count("known") == count("covered"))
    flag = lambda name: holds(F.col(name))
    yes = lambda name: count(name) == 1
    t = t.withColumns({
        "_structural": F.array_compact(F.array(*[F.when(~ok, name) for ok, name in zip(structural, REASONS)])),
        "_valid": (count("samples") == 0) | yes("positive"), "_encoded": (count("samples") > 0) & yes("encoded"), "_subset": subset,
    })
    only_unmatched = F.size(F.array_except("_structural", F.array(F.lit("unmatched_reference_samples")))) == 0
    clean = F.size("_structural") == 0
    poor = too_little_saved(F.col("output_bytes"), F.col("reference_bytes"), minimum_bp)
    bound = (
        (F.col("refs") >= 3) & F.col("_subset") & F.col("_encoded") & yes("positive")
        & (F.col("output_bytes").cast("decimal(20,0)") * 10_000 > F.col("reference_bytes").cast("decimal(20,0)") * (10_000 - minimum_bp))
    )
    per_sample = [
        ("policy_failed", "quality_policy_evidence_missing_or_failed"), ("errors", "sample_processing_error"), ("quality_failed", "quality_pass_missing_or_failed"),
        ("preservation_failed", "preservation_pass_missing_or_failed"), ("decode_failed", "decode_pass_missing_or_failed"), ("no_method", "missing_quality_method"),
    ]
    found = F.array_compact(F.array(*[F.when(yes(c), name) for c, name in per_sample], F.when((count("samples") > 0) & (count("positive") == 0), "invalid_output_size")))
    t = t.withColumn("_reasons", F.array_sort(F.array_union("_structural", found)))
    partial = flag("quality_early_screen") & (F.array_join("_structural", ",") == "unmatched_reference_samples") & F.col("_subset")
    rejected = (clean | partial) & F.col("_valid") & (count("errors") == 0) & yes("measured_failure")
    assessment = (
        F.when(flag("dominated") & clean, "dominated_unmeasured")
        .when(flag("early_bound") & only_unmatched & holds(bound), "size_screened")
        .when(flag("speed_rejected") & F.col("_valid") & F.col("_encoded") & only_unmatched & F.col("_subset"), "speed_screened")
        .when(flag("size_rejected") & clean & F.col("_valid") & F.col("_encoded") & holds(poor), "size_screened")
        .when(rejected, "quality_rejected")
        .when(F.size("_reasons") > 0, "inconclusive")
        .when(holds(poor), "insufficient_savings").otherwise("eligible")
    )
    only = lambda text: F.array(F.lit(text))
    t = t.withColumn("assessment", assessment)
    reasons = (
        F.when(F.col("assessment") == "dominated_unmeasured", only("not_competitive_with_validated_candidate"))
        .when(F.col("assessment").isin("size_screened", "insufficient_savings"), only("insufficient_savings"))
        .when(F.col("assessment") == "speed_screened", only("insufficient_measured_speed_gain"))
        .when(F.col("assessment") == "quality_rejected", only("measured_quality_below_threshold")).otherwise(F.col("_reasons"))
    )
    saved = F.call_function("div", (F.col("reference_bytes") - F.col("output_bytes")).cast("decimal(20,0)") * 10_000, F.col("reference_bytes"))
    timed = (count("samples") > 0) & (count("timed") == count("samples")) & (F.col("least_ms") >= MIN_SCENE_MS) & (F.col("total_ms") >= MIN_TOTAL_MS) & F.col("_subset")
    return t.select(
        "report", "trial", "codec", "encoder", "assessment", reasons.alias("reasons"), "output_bytes", "reference_bytes", saved.alias("savings_bp"),
        F.when(holds(timed), F.col("total_ms")).alias("measured_ms"),
    )


def report_decision(reports: DataFrame, references: DataFrame, assessed: DataFrame) -> DataFrame:
    """Action and reason code of each report from its trials' assessments."""
    refs = references.groupBy("report").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("reference").alias("distinct_refs"))
    kinds = assessed.groupBy("report").agg(
        F.count(F.lit(1)).alias("trials"),
        *[F.count_if(F.col("assessment") == k).alias(f"n_{k}") for k in ("eligible", "insufficient_savings", "quality_rejected", "size_screened", "speed_screened")],
    )
    rows = reports.join(refs, "report", "left").join(kinds, "report", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    size_count, quality_count = n("n_size_screened") + n("n_insufficient_savings"), n("n_quality_rejected")
    settled = n("trials") == size_count + quality_count
    settled_or_slow = n("trials") == size_count + quality_count + n("n_speed_screened")
    usable = holds(F.col("color_mode").isin("sdr", "pq", "hlg"))
    enough = holds((F.col("distinct_refs") == F.col("refs")) & ((F.col("refs") >= 3) | holds(F.col("whole_source"))))
    some = n("trials") > 0
    code = (
        F.when(usable & ~enough, "invalid_report").when(usable & (n("n_eligible") > 0), "candidate_selected").when(usable & some & settled, "already_efficient_for_settings")
        .when(usable & some & settled_or_slow, "bounded_speed_search_inconclusive").otherwise("evaluation_inconclusive")
    )
    action = F.when(~usable, "specialized_review").when(code == "candidate_selected", "encode_copy").otherwise("keep_original")
    category = (
        F.when(code == "already_efficient_for_settings", F.when(size_count == 0, "quality").when(quality_count == 0, "savings").otherwise("size_quality"))
        .when(code == "bounded_speed_search_inconclusive", "size_quality").when(usable & enough & some & (code == "evaluation_inconclusive"), "error")
    )
    return rows.select(
        "report", action.alias("action"), code.alias("reason_code"), category.alias("outcome_category"), n("trials").alias("trials"),
        n("n_eligible").alias("eligible"), size_count.alias("size_rejected"), quality_count.alias("quality_rejected"),
    )


def choose(reports: DataFrame, references: DataFrame, assessed: DataFrame, samples: DataFrame) -> DataFrame:
    """Winner of each report: the smallest eligible trial, or the fastest one
    within 5 % and 512 MiB that is at least 20 % quicker overall, slower in no
    scene, and gains more than the comparison cost.

    ``reports``: ``source_bytes, duration_s, comparison_s``; ``references``:
    ``window_s``.
    """
    eligible = assessed.where(F.col("assessment") == "eligible")
    smallest = eligible.groupBy("report").agg(F.min(F.struct("output_bytes", "trial", "measured_ms")).alias("s"))
    windows = references.groupBy("report").agg(F.sum("window_s").alias("sampled_s"))
    scene = samples.groupBy("report", "trial", "reference").agg(F.max("execution_ms").alias("ms"))
    base = smallest.select("report", F.col("s.trial").alias("trial")).join(scene, ["report", "trial"]).select("report", "reference", F.col("ms").alias("base_ms"))
    slower = scene.join(base, ["report", "reference"]).groupBy("report", "trial").agg(
        F.count_if(F.col("ms") > F.col("base_ms")).alias("slower_scenes"), F.count(F.lit(1)).alias("shared_scenes")
    )
    rows = eligible.join(smallest, "report").join(windows, "report").join(reports.select("report", "source_bytes", "duration_s", "comparison_s"), "report")
    rows = rows.join(slower, ["report", "trial"], "left")
    d = lambda c: c.cast("decimal(20,0)")
    gain_ms = (F.col("s.measured_ms") - F.col("measured_ms")) * F.col("duration_s")
    fast = (
        (gain_ms > F.col("comparison_s") * 1000 * F.col("sampled_s"))
        & (d(F.col("output_bytes")) * 100 <= d(F.col("s.output_bytes")) * (100 + MAX_EXTRA_PERCENT))
        & (d(F.col("output_bytes") - F.col("s.output_bytes")) * d(F.col("source_bytes")) <= d(F.col("reference_bytes")) * MAX_EXTRA_BYTES)
        & (F.col("measured_ms") * 10 <= F.col("s.measured_ms") * 8) & (F.col("slower_scenes") == 0)
    )
    quick = F.min(F.when(holds(fast), F.struct("measured_ms", "output_bytes", "trial")))
    return rows.groupBy("report").agg(F.first("s").alias("s"), quick.alias("q")).select(
        "report", F.coalesce("q.trial", "s.trial").alias("selected"), F.coalesce("q.output_bytes", "s.output_bytes").alias("output_bytes"),
        F.col("s.trial").alias("smallest"), F.col("q").isNotNull().alias("faster_chosen"),
    )


def dominated(reports: DataFrame, references: DataFrame, trials: DataFrame, samples: DataFrame, incumbents: DataFrame) -> DataFrame:
    """Complete unexamined trials that cannot beat a validated smaller incumbent:
    more than 5 % larger, or over 512 MiB larger at full-file scale.

    ``incumbents``: one eligible trial per report (``report, incumbent``).
    """
    f = trial_facts(references, samples).join(trials.select("report", "trial", "runtime_supported", "playback_compatible"), ["report", "trial"])
    complete = (
        (F.col("samples") == F.col("refs")) & (F.col("known") == F.col("refs")) & (F.col("covered") == F.col("refs")) & (F.col("positive") == 1)
        & (F.col("encoded") == 1) & F.col("runtime_supported") & F.col("playback_compatible")
    )
    sized = f.where(holds(complete)).select("report", "trial", "output_bytes", "reference_bytes", "examined")
    best = incumbents.join(sized.select("report", F.col("trial").alias("incumbent"), F.col("output_bytes").alias("incumbent_bytes")), ["report", "incumbent"])
    rows = sized.join(best, "report").join(reports.select("report", "source_bytes"), "report")
    d = lambda c: c.cast("decimal(20,0)")
    relative = d(F.col("output_bytes")) * 100 > d(F.col("incumbent_bytes")) * (100 + MAX_EXTRA_PERCENT)
    absolute = d(F.col("output_bytes") - F.col("incumbent_bytes")) * d(F.col("source_bytes")) > d(F.col("reference_bytes")) * MAX_EXTRA_BYTES
    beaten = (F.col("trial") != F.col("incumbent")) & (F.col("output_bytes") > F.col("incumbent_bytes")) & (F.col("examined") == 0) & (relative | absolute)
    return rows.where(beaten).select(
        "report", "trial", "incumbent", "output_bytes", "incumbent_bytes", relative.alias("outside_relative"), absolute.alias("outside_projected")
    )


def forecast(reports: DataFrame, references: DataFrame, samples: DataFrame) -> DataFrame:
    """Full-file size from sample rates and from the compression ratio; the larger
    of the two is the estimate.  NULL where windows or sizes are incomplete."""
    joined = samples.join(references.select("report", "reference", F.col("bytes").alias("ref_bytes"), "window_s"), ["report", "reference"], "left")
    rate = F.col("bytes") / F.col("window_s")
    t = joined.groupBy("report", "trial").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("reference").alias("covered"),
        F.min(holds((F.col("bytes") > 0) & (F.col("window_s") > 0) & (F.col("ref_bytes") > 0)).cast("int")).alias("sound"),
        F.sum("bytes").alias("encoded"), F.sum("window_s").alias("seconds"), F.sum("ref_bytes").alias("ref_total"), F.min(rate).alias("low_rate"), F.max(rate).alias("high_rate"),
    )
    refs = references.groupBy("report").agg(F.count(F.lit(1)).alias("refs"))
    rows = t.join(refs, "report").join(reports.select("report", "source_bytes", "duration_s"), "report")
    ok = (F.col("samples") == F.col("refs")) & (F.col("covered") == F.col("refs")) & (F.col("sound") == 1) & (F.col("seconds") <= F.col("duration_s") * 1.01)
    by_rate = F.col("encoded") / F.col("seconds") * F.col("duration_s")
    by_ratio = F.col("encoded") / F.col("ref_total") * F.col("source_bytes")
    whole = lambda c: F.when(holds(ok), F.bround(c).cast("long"))
    return rows.select(
        "report", "trial", whole(F.greatest(by_rate, by_ratio)).alias("estimated_bytes"), whole(by_rate).alias("rate_bytes"), whole(by_ratio).alias("ratio_bytes"),
        whole(F.col("low_rate") * F.col("duration_s")).alias("low_bytes"), whole(F.col("high_rate") * F.col("duration_s")).alias("high_bytes"),
        whole(F.least(F.col("low_rate") * F.col("duration_s"), by_ratio)).alias("range_low"), whole(F.greatest(F.col("high_rate") * F.col("duration_s"), by_ratio)).alias("range_high"),
    )


def timings(samples: DataFrame) -> DataFrame:
    """Measured encode time of each trial; NULL unless every scene has one
    completed timing of at least half a second and they total three seconds."""
    t = samples.groupBy("report", "trial").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("reference").alias("scenes"), F.count("execution_ms").alias("timed"),
        F.min("execution_ms").alias("least_ms"), F.sum("execution_ms").alias("total_ms"),
    )
    ok = (F.col("samples") == F.col("scenes")) & (F.col("timed") == F.col("samples")) & (F.col("least_ms") >= MIN_SCENE_MS) & (F.col("total_ms") >= MIN_TOTAL_MS)
    return t.select("report", "trial", "scenes", F.when(holds(ok), F.col("total_ms")).alias("measured_ms"))


def speed_screen(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """Reject a scene's faster setting unless it took at most 80 % of the baseline.

    ``baseline``: the baseline trial's samples; a missing scene rejects.
    """
    usable = lambda c: F.when(c >= MIN_SCENE_MS, c)
    b = baseline.groupBy("report", "reference").agg(F.max("execution_ms").alias("_b"))
    rows = samples.join(b, ["report", "reference"], "left")
    before, after = usable(F.col("_b")), usable(F.col("execution_ms"))
    return rows.select("report", "trial", "reference", before.alias("baseline_ms"), after.alias("candidate_ms"), (~holds(after * 10 <= before * 8)).alias("rejected"))


def encoder_scores(trials: DataFrame, samples: DataFrame) -> DataFrame:
    """Best over trials of the weakest scene, per encoder of a report."""
    weakest = samples.groupBy("report", "trial").agg(F.coalesce(F.min("quality.p5"), F.lit(0)).alias("weakest"))
    return trials.join(weakest, ["report", "trial"], "left").groupBy("report", "encoder").agg(F.max(F.coalesce("weakest", F.lit(0))).alias("score"))


def hardest_reference(samples: DataFrame) -> DataFrame:
    """Scene with the lowest fifth percentile in any trial; first scene on ties."""
    scene = samples.groupBy("report", "reference").agg(F.min("quality.p5").alias("p5"))
    return scene.groupBy("report").agg(F.min(F.when(F.col("p5").isNotNull(), F.struct("p5", "reference"))).alias("_h")).select(
        "report", F.coalesce("_h.reference", F.lit(0)).alias("reference"), "_h.p5"
    )


def rate_retry(reports: DataFrame, trials: DataFrame, samples: DataFrame, encoder: str) -> DataFrame:
    """Trial to repeat with a higher peak rate: the best of the worst failed
    scenes, with ceiling clamp(ceil(6 * average Mbit/s), 20, 1000)."""
    failed = holds((~F.col("quality.passed")) & F.col("preservation_pass") & F.col("decode_pass"))
    t = samples.groupBy("report", "trial").agg(F.min(F.when(failed, F.col("quality.p5"))).alias("worst"), F.count("error").alias("errors"))
    usable = (F.col("encoder") == encoder) & F.col("runtime_supported") & F.col("playback_compatible")
    rows = trials.where(usable).join(t.where(F.col("errors") == 0), ["report", "trial"]).where(F.col("worst").isNotNull())
    parent = rows.groupBy("report").agg(F.max(F.struct("worst", "trial")).alias("_p"))
    # ceil(bytes*8*6 / (seconds*10^6)) without floating point
    bits, per = F.col("source_bytes").cast("decimal(20,0)") * 48, F.col("duration_s").cast("decimal(12,0)") * 1_000_000
    ceiling = F.least(F.lit(1000), F.greatest(F.lit(20), F.call_function("div", bits + per - 1, per)))
    return parent.join(reports, "report").select("report", F.col("_p.trial").alias("parent_trial"), F.col("_p.worst").alias("worst_p5"), ceiling.alias("ceiling_mbps"))


def assess_scenes(scenes: DataFrame, keys: Sequence[str], minimum_bp: int) -> DataFrame:
    """All scenes pass and the summed sizes meet the saving."""
    total = scenes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scenes"), F.min(holds(F.col("passed")).cast("int")).alias("_all"), F.sum("source_bytes").alias("source_bytes"), F.sum("output_bytes").alias("output_bytes")
    )
    needed = requirement(F.col("source_bytes"), "fixed", f"{minimum_bp / 100:g}")
    return total.select(
        *keys, "scenes", "source_bytes", "output_bytes", (F.col("_all") == 1).alias("all_passed"),
        savings_decision(F.col("source_bytes"), F.col("output_bytes"), needed).alias("decision"),
    )


def validation_order(references: DataFrame, trials: DataFrame, samples: DataFrame) -> DataFrame:
    """Deferred trials with their sort key: complete sizes first, smallest first."""
    f = trial_facts(references, samples)
    complete = (F.col("samples") == F.col("refs")) & (F.col("known") == F.col("refs")) & (F.col("covered") == F.col("refs")) & (F.col("positive") == 1) & (F.col("encoded") == 1)
    sized = f.select("report", "trial", F.when(holds(complete), F.col("output_bytes")).alias("size"))
    return trials.join(sized, ["report", "trial"], "left").select(
        "report", "trial", F.col("size").isNull().alias("size_unknown"), F.coalesce("size", F.lit(0)).alias("size")
    ).orderBy("report", "size_unknown", "size", "trial")


# Quality steps tried after size-limited, quality-limited and mixed trials.
STEPS = {"size": (28, 26, 27, 30, 29, 32), "quality": (20, 18, 22, 23, 24, 25), "mixed": (23, 22, 24, 25, 20, 18)}


# Encoders that are refined; those of the first kind by constant quality.
CQ_ENCODERS = ("hevc_nvenc", "av1_nvenc", "h264_nvenc")
ONE_TRY_ENCODERS = ("hevc_amf", "av1_amf", "h264_amf", "hevc_qsv", "av1_qsv", "h264_qsv")


def adaptive_candidates(trials: DataFrame, samples: DataFrame, limit: int = 8) -> DataFrame:
    """Next settings to try, interleaved fairly over encoders by score.

    Constant-quality encoders get a list of steps; with a bounded output preset
    (``output_preset`` other than original) they get the slow preset once, and
    other encoders their transparent setting once, unless already tried.  At
    most six steps exist per encoder, so the interleave is an ordering of a short
    list per report; ``limit`` is the trial budget.
    """
    absent = {"output_preset": F.lit("original"), "error": F.lit(None).cast("string")}
    trials = trials.withColumns({c: v for c, v in absent.items() if c not in trials.columns})
    usable = trials.where(F.col("runtime_supported") & F.col("playback_compatible") & F.col("encoder").isin(*CQ_ENCODERS, *ONE_TRY_ENCODERS))
    score = encoder_scores(trials, samples).select("report", "encoder", "score")
    state = trials.join(
        samples.groupBy("report", "trial").agg(
            _flag(~F.col("quality.passed")).alias("failed"), F.min(holds(F.col("quality.passed")).cast("int")).alias("all_passed"), F.count("error").alias("errors")
        ), ["report", "trial"], "left",
    ).groupBy("report", "encoder").agg(
        F.min((holds(F.col("size_rejected")) & F.col("error").isNull() & (F.coalesce("errors", F.lit(0)) == 0)).cast("int")).alias("size_limited"),
        _flag(F.element_at("settings", F.lit("quality")) == "transparent").alias("transparent"), _flag(F.element_at("settings", F.lit("nvenc_preset")) == "p7").alias("slowest"),
        F.max(F.coalesce("output_preset", F.lit("original")) != "original").alias("bounded"),
        F.max(F.coalesce("failed", F.lit(0))).alias("failed"), F.max(F.coalesce("all_passed", F.lit(0))).alias("all_passed"),
    )
    listed = usable.select("report", "encoder").distinct().join(score, ["report", "encoder"]).join(state, ["report", "encoder"])
    steps = lambda name: F.array(*[F.lit(s) for s in STEPS[name]])
    order = F.when(F.col("size_limited") == 1, steps("size")).when((F.col("failed") == 1) & (F.col("all_passed") == 0), steps("quality")).otherwise(steps("mixed"))
    none, once = F.array().cast("array<int>"), F.array(F.lit(None).cast("int"))
    tried = (F.col("transparent") == 1) | (F.col("bounded") & (F.col("slowest") == 1) & F.col("encoder").isin(*CQ_ENCODERS))
    by_steps = F.col("encoder").isin(*CQ_ENCODERS) & ~F.col("bounded")
    order = F.when(by_steps, order).when(tried, none).otherwise(once)
    rows = listed.select("report", "encoder", "score", F.when(by_steps, "balanced").otherwise("transparent").alias("quality"), F.posexplode(order).alias("turn", "step"))
    fair = Window.partitionBy("report").orderBy("turn", F.desc("score"), "encoder")
    return rows.withColumn("position", F.row_number().over(fair)).where(F.col("position") <= limit)


# Hardware presets from fast to slow.
PRESETS = ("p4", "p5", "p6", "p7")


def faster_presets(selected: DataFrame, measured: DataFrame) -> DataFrame:
    """Quicker presets worth measuring against each selected setting, minus those
    already measured.  ``selected``: ``report, encoder, preset, cq``."""
    pairs = selected.withColumn("faster", F.explode(F.array(F.lit("p4"), F.lit("p5")))).where(
        F.col("preset").isin(*PRESETS) & F.col("encoder").isin("hevc_nvenc", "av1_nvenc", "h264_nvenc") & (F.col("faster") < F.col("preset"))
    )
    seen = measured.select("report", "encoder", F.col("preset").alias("faster"), "cq").distinct()
    return pairs.join(seen, ["report", "encoder", "faster", "cq"], "left_anti")


def trial_overview(samples: DataFrame, newest: int = 20) -> DataFrame:
    """Scene scores of the newest runs, each beside its trial's passed / total.

    One row per scene rather than a list, so a trial may have any number.
    """
    every = F.col("quality_pass") & F.col("preservation_pass") & F.col("decode_pass")
    per = samples.groupBy("report", "trial").agg(F.count_if(holds(every)).alias("passed"), F.count(F.lit(1)).alias("samples"))
    runs = samples.select("report").distinct().orderBy(F.desc("report")).limit(newest)
    scenes = samples.join(runs, "report").select("report", "trial", "reference", F.col("quality.mean").alias("mean"))
    return scenes.join(per, ["report", "trial"])


def decision_evidence(samples: DataFrame) -> DataFrame:
    """Scene scores that are known, with their pass flag and scoring domain."""
    q = F.col("quality")
    known = q["mean"].isNotNull() & q["p5"].isNotNull()
    return samples.where(known).select("report", "trial", "reference", q["mean"].alias("mean"), q["p5"].alias("p5"), q["passed"].alias("passed"), "domain")


def constrain(trials: DataFrame, timelines: DataFrame, codec: str = "av1") -> DataFrame:
    """Trials of one codec are unsupported where the source's mastering metadata
    changes.  ``timelines``: ``report, changing, source_codec``."""
    t = timelines.select("report", (F.col("changing") & (F.col("source_codec") == "hevc")).alias("_limited"))
    rows = trials.join(t, "report", "left")
    return rows.withColumn("preservable", F.when(holds(F.col("_limited")) & (F.col("codec") == codec), F.lit(False)).otherwise(F.col("preservable"))).drop("_limited")


def resume_order(trials: DataFrame, references: DataFrame, samples: DataFrame, codec: str = "av1") -> DataFrame:
    """Dominated trials of other codecs to examine again, smallest first."""
    again = trials.where(holds(F.col("dominated")) & (F.col("codec") != codec))
    return validation_order(references, again, samples)
