"""Trial, score and savings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesleuth.operators import trials as op
from framesleuth.plans import tables
from framesleuth.plans.registry import plain, query
from framesleuth.plans.tables import PACKET_SQL, TRIAL_SQL, cents, packets, table

MIN_BP = 1000


@query(
    "score_pool",
    f"""WITH {TRIAL_SQL} SELECT report, trial, reference, frames, score_sum, score_sum // frames AS mean, p5, true AS complete,
      score_sum >= 9400 * frames AND p5 >= 9000 AS passed FROM pooled""",
)
def score_pool(spark, folder):
    return plain(tables.pooled(spark, folder))


@query(
    "score_pool_profiles",
    f"""WITH {TRIAL_SQL}, pr AS (SELECT * FROM (VALUES ('strict', 9500, 9000), ('balanced', 9400, 9000), ('space-saver', 9000, 9000)) v(profile, m, p))
    SELECT profile, trial, count(*) AS scenes, count(*) FILTER (WHERE score_sum // frames BETWEEN m AND 10000 AND p5 BETWEEN p AND 10000 AND score_sum >= 9400 * frames AND p5 >= 9000) AS met
    FROM pooled, pr GROUP BY 1, 2""",
)
def score_pool_profiles(spark, folder):
    pooled = tables.pooled(spark, folder)
    # Three fixed profiles: every scene is judged once per profile.
    judged = pooled.withColumn("f", F.explode(F.array(*[
        F.struct(F.lit(n).alias("profile"), F.lit(m * 100).alias("m"), F.lit(p * 100).alias("p")) for n, (m, p) in op.PROFILES.items()
    ])))
    met = op.meets_policy(F.col("passed"), F.col("mean"), F.col("p5"), F.col("frames"), F.col("f.m"), F.col("f.p"))
    return plain(judged.groupBy(F.col("f.profile").alias("profile"), "trial").agg(F.count(F.lit(1)).alias("scenes"), F.count_if(met).alias("met")))


_CPU = "9000 + level % 1000"


@query(
    "scorer_parity",
    f"""WITH {PACKET_SQL}, g AS (SELECT track, ordinal, {_CPU} AS a, {_CPU} + CASE WHEN event_id % 977 = 0 THEN 50 ELSE event_id % 2 END AS b FROM packet),
    pool AS (SELECT track, sum(a) >= 9400 * count(*) AND min(a) FILTER (WHERE ra = greatest(1, (n + 19) // 20)) >= 9000 AS lp,
        sum(b) >= 9400 * count(*) AND min(b) FILTER (WHERE rb = greatest(1, (n + 19) // 20)) >= 9000 AS rp, count(*) AS frames, max(abs(a - b)) AS max_difference FROM
      (SELECT *, row_number() OVER (PARTITION BY track ORDER BY a) AS ra, row_number() OVER (PARTITION BY track ORDER BY b) AS rb, count(*) OVER (PARTITION BY track) AS n FROM g) GROUP BY track)
    SELECT track, frames, CAST(0 AS BIGINT) AS unpaired, max_difference, lp AS left_passed, rp AS right_passed, max_difference <= 1 AND lp = rp AS passed FROM pool""",
)
def scorer_parity(spark, folder):
    p = packets(spark, folder)
    cpu = 9000 + F.col("level") % 1000
    left = p.select("track", F.col("ordinal").alias("frame_no"), cpu.alias("score"))
    gpu = cpu + F.when(F.col("event_id") % 977 == 0, 50).otherwise(F.col("event_id") % 2)
    right = p.select("track", F.col("ordinal").alias("frame_no"), gpu.alias("score"))
    return plain(op.scorer_parity(left, right, ["track"], 1, F.lit(9400), F.lit(9000)))


@query(
    "combined_views",
    f"""WITH {TRIAL_SQL}, n AS (SELECT * FROM pooled), f AS (SELECT * REPLACE ('t' || CAST((k + 3) % 5 + 1 AS VARCHAR) AS trial) FROM pooled)
    SELECT n.report, n.trial, n.reference, least(n.score_sum // n.frames, f.score_sum // f.frames) AS mean, least(n.p5, f.p5) AS p5,
      n.score_sum >= 9400 * n.frames AND n.p5 >= 9000 AND f.score_sum >= 9400 * f.frames AND f.p5 >= 9000 AS passed, '' AS reason,
      least(abs(n.score_sum // n.frames - 9400), abs(f.score_sum // f.frames - 9400)) <= 25 OR least(abs(n.p5 - 9000), abs(f.p5 - 9000)) <= 25 AS near_floor
    FROM n JOIN f ON n.report = f.report AND n.trial = f.trial AND n.reference = f.reference""",
)
def combined_views(spark, folder):
    """Every trial's view beside that of the trial after it."""
    keys = ["report", "trial", "reference"]
    native = tables.pooled(spark, folder)
    before = F.concat(F.lit("t"), ((F.substring("trial", 2, 1).cast("int") + 3) % 5 + 1).cast("string"))
    fallback = native.withColumn("trial", before)
    both = native.select(*keys, F.struct("mean", "p5").alias("v1")).join(fallback.select(*keys, F.struct("mean", "p5").alias("v2")), keys)
    near = both.select(*keys, op.near_boundary(F.array("v1", "v2"), [("mean", 9400), ("p5", 9000)], 25).alias("near_floor"))
    return plain(op.combine_views(native, fallback, keys).join(near, keys))


def _trial_inputs(spark, folder):
    return (tables.reports(spark, folder), tables.references(spark, folder), tables.trials(spark, folder), tables.samples(spark, folder))


_REASONS = """CASE assessment WHEN 'dominated_unmeasured' THEN 'not_competitive_with_validated_candidate' WHEN 'size_screened' THEN 'insufficient_savings' WHEN 'insufficient_savings' THEN 'insufficient_savings'
  WHEN 'speed_screened' THEN 'insufficient_measured_speed_gain' WHEN 'quality_rejected' THEN 'measured_quality_below_threshold'
  ELSE array_to_string(list_sort(list_filter([CASE WHEN NOT runtime_supported THEN 'encoder_not_runtime_verified' END, CASE WHEN NOT playback_compatible THEN 'target_playback_not_verified' END,
    CASE WHEN samples <> refs THEN 'unmatched_reference_samples' END, CASE WHEN quality_failed THEN 'quality_policy_evidence_missing_or_failed' END, CASE WHEN errors THEN 'sample_processing_error' END,
    CASE WHEN quality_failed THEN 'quality_pass_missing_or_failed' END, CASE WHEN decode_failed THEN 'decode_pass_missing_or_failed' END], lambda x: x IS NOT NULL)), ',') END"""
_TIMED = "CASE WHEN samples > 0 AND low_ms >= 500 AND ms >= 3000 THEN ms ELSE -1 END"


@query(
    "candidate_eligibility",
    f"""WITH {TRIAL_SQL} SELECT report, trial, codec, encoder, assessment, {_REASONS} AS reasons, output_bytes, reference_bytes,
      (reference_bytes - output_bytes) * 10000 // reference_bytes AS savings_bp, {_TIMED} AS measured_ms FROM assessed""",
)
def candidate_eligibility(spark, folder):
    result = op.candidates(*_trial_inputs(spark, folder), MIN_BP)
    return plain(result.withColumn("reasons", F.array_join("reasons", ",")))


_DECISION = """d AS (SELECT report, count(*) AS trials, count(*) FILTER (WHERE assessment = 'eligible') AS eligible,
    count(*) FILTER (WHERE assessment IN ('size_screened', 'insufficient_savings')) AS size_rejected, count(*) FILTER (WHERE assessment = 'quality_rejected') AS quality_rejected,
    count(*) FILTER (WHERE assessment = 'speed_screened') AS slow, max(refs) AS refs FROM assessed GROUP BY 1),
    c AS (SELECT d.*, color_mode, CASE WHEN color_mode = 'dv' THEN 'evaluation_inconclusive' WHEN refs < 3 THEN 'invalid_report' WHEN eligible > 0 THEN 'candidate_selected' WHEN trials = size_rejected + quality_rejected THEN 'already_efficient_for_settings'
      WHEN trials = size_rejected + quality_rejected + slow THEN 'bounded_speed_search_inconclusive' ELSE 'evaluation_inconclusive' END AS reason_code FROM d JOIN rep USING (report))"""


@query(
    "report_decision",
    f"""WITH {TRIAL_SQL}, {_DECISION}
    SELECT report, CASE WHEN color_mode = 'dv' THEN 'specialized_review' WHEN reason_code = 'candidate_selected' THEN 'encode_copy' ELSE 'keep_original' END AS action, reason_code,
      CASE WHEN reason_code = 'already_efficient_for_settings' THEN CASE WHEN size_rejected = 0 THEN 'quality' WHEN quality_rejected = 0 THEN 'savings' ELSE 'size_quality' END
        WHEN reason_code = 'bounded_speed_search_inconclusive' THEN 'size_quality' WHEN color_mode <> 'dv' AND refs >= 3 AND reason_code = 'evaluation_inconclusive' THEN 'error' ELSE '' END AS outcome_category,
      trials, eligible, size_rejected, quality_rejected FROM c""",
)
def report_decision(spark, folder):
    reports, references, trials, samples = _trial_inputs(spark, folder)
    return plain(op.report_decision(reports, references, op.candidates(reports, references, trials, samples, MIN_BP)))


@query(
    "size_bound",
    f"""WITH {TRIAL_SQL} SELECT report, trial, output_bytes AS output_bytes_lower_bound, reference_bytes, samples AS completed_samples, refs AS total_samples
    FROM fact WHERE refs >= 3 AND samples > 0 AND NOT errors AND output_bytes * 10000 > reference_bytes * 9000""",
)
def size_bound(spark, folder):
    _, references, _, samples = _trial_inputs(spark, folder)
    return plain(op.size_bound(references, samples, MIN_BP))


@query(
    "choose_candidate",
    f"""WITH {TRIAL_SQL}, e AS (SELECT *, CASE WHEN low_ms >= 500 AND ms >= 3000 THEN ms END AS m FROM assessed WHERE assessment = 'eligible'),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY output_bytes, trial) AS rn FROM e) WHERE rn = 1),
    sc AS (SELECT a.report, a.trial, count(*) FILTER (WHERE a.ms > b.ms) AS slower FROM smp a JOIN s ON s.report = a.report JOIN smp b ON b.report = s.report AND b.trial = s.trial AND b.reference = a.reference GROUP BY 1, 2),
    f AS (SELECT e.report, e.trial, e.output_bytes, row_number() OVER (PARTITION BY e.report ORDER BY e.m, e.output_bytes, e.trial) AS rn FROM e JOIN s ON s.report = e.report JOIN sc ON sc.report = e.report AND sc.trial = e.trial JOIN rep ON rep.report = e.report
      WHERE (s.m - e.m) * 3600 > 60 * 1000 * 60 * e.refs AND e.output_bytes * 100 <= s.output_bytes * 105 AND CAST(e.output_bytes - s.output_bytes AS HUGEINT) * source_bytes <= CAST(e.reference_bytes AS HUGEINT) * 536870912
        AND e.m * 10 <= s.m * 8 AND slower = 0)
    SELECT s.report, coalesce(f.trial, s.trial) AS selected, coalesce(f.output_bytes, s.output_bytes) AS output_bytes, s.trial AS smallest, f.trial IS NOT NULL AS faster_chosen
    FROM s LEFT JOIN f ON f.report = s.report AND f.rn = 1""",
)
def choose_candidate(spark, folder):
    reports, references, trials, samples = _trial_inputs(spark, folder)
    assessed = op.candidates(reports, references, trials, samples, MIN_BP)
    return plain(op.choose(reports, references, assessed, samples))


@query(
    "dominance",
    f"""WITH {TRIAL_SQL}, c AS (SELECT * FROM fact WHERE samples = refs AND NOT errors AND runtime_supported AND playback_compatible),
    i AS (SELECT report, arg_min(trial, output_bytes) AS incumbent, min(output_bytes) AS incumbent_bytes FROM c GROUP BY 1)
    SELECT c.report, trial, incumbent, output_bytes, incumbent_bytes, output_bytes * 100 > incumbent_bytes * 105 AS outside_relative,
      CAST(output_bytes - incumbent_bytes AS HUGEINT) * source_bytes > CAST(reference_bytes AS HUGEINT) * 536870912 AS outside_projected
    FROM c JOIN i USING (report) JOIN rep USING (report) WHERE trial IN ('t1', 't2') AND output_bytes > incumbent_bytes
      AND (output_bytes * 100 > incumbent_bytes * 105 OR CAST(output_bytes - incumbent_bytes AS HUGEINT) * source_bytes > CAST(reference_bytes AS HUGEINT) * 536870912)""",
)
def dominance(spark, folder):
    reports, references, trials, samples = _trial_inputs(spark, folder)
    # Only the first two settings are still unexamined.
    blank = F.col("trial").isin("t1", "t2")
    held = samples.withColumns({
        "quality": F.when(~blank, F.col("quality")), **{c: F.when(~blank, F.col(c)) for c in ("quality_pass", "preservation_pass", "decode_pass")}
    })
    usable = trials.where(F.col("runtime_supported") & F.col("playback_compatible")).select("report", "trial")
    sizes = op.trial_facts(references, samples).where((F.col("samples") == F.col("refs")) & (F.col("errors") == 0)).join(usable, ["report", "trial"])
    best = sizes.groupBy("report").agg(F.min(F.struct("output_bytes", "trial"))["trial"].alias("incumbent"))
    return plain(op.dominated(reports, references, trials, held, best))


@query(
    "size_forecast",
    f"""WITH {TRIAL_SQL}, j AS (SELECT smp.report, smp.trial, count(*) AS n, CAST(sum(smp.bytes) AS BIGINT) AS e, count(*) * 60 AS sec, CAST(sum(ref.bytes) AS BIGINT) AS r, min(smp.bytes / 60) AS lo, max(smp.bytes / 60) AS hi
      FROM smp JOIN ref ON ref.report = smp.report AND ref.reference = smp.reference GROUP BY 1, 2),
    k AS (SELECT j.*, refs, source_bytes, e / sec * 3600 AS br, e / r * source_bytes AS bq FROM j JOIN rt USING (report) JOIN rep USING (report))
    SELECT report, trial, CASE WHEN n = refs THEN CAST(round_even(greatest(br, bq), 0) AS BIGINT) ELSE -1 END AS estimated_bytes, CASE WHEN n = refs THEN CAST(round_even(br, 0) AS BIGINT) ELSE -1 END AS rate_bytes,
      CASE WHEN n = refs THEN CAST(round_even(bq, 0) AS BIGINT) ELSE -1 END AS ratio_bytes, CASE WHEN n = refs THEN CAST(round_even(lo * 3600, 0) AS BIGINT) ELSE -1 END AS low_bytes,
      CASE WHEN n = refs THEN CAST(round_even(hi * 3600, 0) AS BIGINT) ELSE -1 END AS high_bytes, CASE WHEN n = refs THEN CAST(round_even(least(lo * 3600, bq), 0) AS BIGINT) ELSE -1 END AS range_low,
      CASE WHEN n = refs THEN CAST(round_even(greatest(hi * 3600, bq), 0) AS BIGINT) ELSE -1 END AS range_high FROM k""",
)
def size_forecast(spark, folder):
    reports, references, _, samples = _trial_inputs(spark, folder)
    return plain(op.forecast(reports, references, samples))


@query(
    "encode_timings",
    f"""WITH {TRIAL_SQL} SELECT report, trial, samples AS scenes, CASE WHEN low_ms >= 500 AND ms >= 3000 THEN ms ELSE -1 END AS measured_ms FROM fact WHERE samples > 0""",
)
def encode_timings(spark, folder):
    return plain(op.timings(tables.samples(spark, folder)))


@query(
    "speed_screen",
    f"""WITH {TRIAL_SQL}, b AS (SELECT report, reference, ms FROM smp WHERE trial = 't2'), j AS (SELECT s.*, CASE WHEN b.ms >= 500 THEN b.ms END AS bm, CASE WHEN s.ms >= 500 THEN s.ms END AS am FROM smp s LEFT JOIN b USING (report, reference))
    SELECT report, trial, reference, coalesce(bm, -1) AS baseline_ms, coalesce(am, -1) AS candidate_ms, NOT coalesce(am * 10 <= bm * 8, false) AS rejected FROM j""",
)
def speed_screen(spark, folder):
    samples = tables.samples(spark, folder)
    return plain(op.speed_screen(samples, samples.where(F.col("trial") == "t2")))


@query(
    "encoder_scores",
    f"""WITH {TRIAL_SQL}, h AS (SELECT report, min({{'p': p5, 'r': reference}}) AS h FROM smp GROUP BY 1)
    SELECT report, encoder, max(coalesce(min_p5, 0)) AS score, max(h.h.r) AS hardest, max(h.h.p) AS hardest_p5 FROM fact JOIN h USING (report) GROUP BY 1, 2""",
)
def encoder_scores(spark, folder):
    _, _, trials, samples = _trial_inputs(spark, folder)
    hardest = op.hardest_reference(samples).select("report", F.col("reference").alias("hardest"), F.col("p5").alias("hardest_p5"))
    return plain(op.encoder_scores(trials, samples).join(hardest, "report"))


@query(
    "rate_retry",
    f"""WITH {TRIAL_SQL}, w AS (SELECT smp.report, smp.trial, min(p5) FILTER (WHERE NOT passed AND decode_pass) AS worst, bool_or(error) AS errors FROM smp GROUP BY 1, 2),
    p AS (SELECT report, max({{'w': worst, 't': trial}}) AS p FROM w JOIN trial USING (report, trial) WHERE encoder = 'h264_nvenc' AND runtime_supported AND playback_compatible AND NOT errors AND worst IS NOT NULL GROUP BY 1)
    SELECT report, p.p.t AS parent_trial, p.p.w AS worst_p5, CAST(least(1000, greatest(20, (CAST(source_bytes AS HUGEINT) * 48 + 3600000000 - 1) // 3600000000)) AS BIGINT) AS ceiling_mbps FROM p JOIN rep USING (report)""",
)
def rate_retry(spark, folder):
    reports, _, trials, samples = _trial_inputs(spark, folder)
    return plain(op.rate_retry(reports, trials, samples, "h264_nvenc"))


@query(
    "scene_assessment",
    f"""WITH {TRIAL_SQL}, g AS (SELECT smp.report, smp.trial, count(*) AS scenes, CAST(sum(ref.bytes) AS BIGINT) AS source_bytes, CAST(sum(smp.bytes) AS BIGINT) AS output_bytes, bool_and(passed AND decode_pass) AS all_passed
      FROM smp JOIN ref ON ref.report = smp.report AND ref.reference = smp.reference GROUP BY 1, 2)
    SELECT *, CASE WHEN output_bytes < source_bytes AND source_bytes - output_bytes >= (source_bytes * 125 + 999) // 1000 THEN 'meets size threshold'
      WHEN output_bytes >= source_bytes THEN 'output is not smaller' ELSE 'savings are below the minimum' END AS decision FROM g""",
)
def scene_assessment(spark, folder):
    _, references, _, samples = _trial_inputs(spark, folder)
    scenes = samples.join(references.select("report", "reference", F.col("bytes").alias("source_bytes")), ["report", "reference"]).select(
        "report", "trial", "source_bytes", F.col("bytes").alias("output_bytes"), (F.col("quality_pass") & F.col("decode_pass")).alias("passed")
    )
    return plain(op.assess_scenes(scenes, ["report", "trial"], 1250))


@query(
    "validation_order",
    f"WITH {TRIAL_SQL} SELECT report, trial, NOT (samples = refs AND NOT errors) AS size_unknown, CASE WHEN samples = refs AND NOT errors THEN output_bytes ELSE 0 END AS size FROM fact",
)
def validation_order(spark, folder):
    _, references, trials, samples = _trial_inputs(spark, folder)
    return plain(op.validation_order(references, trials.select("report", "trial"), samples))


@query(
    "round_robin",
    f"""WITH {TRIAL_SQL}, v AS (SELECT *, CASE WHEN report % 3 = 1 AND k = 5 THEN 'av1_qsv' WHEN report % 3 = 2 AND k = 5 THEN 'libx264' ELSE encoder END AS enc, report % 7 = 3 AS bounded,
        CASE WHEN report % 6 = 1 AND k = 5 THEN 'transparent' ELSE 'balanced' END AS quality, CASE WHEN report % 14 = 3 THEN 'p7' ELSE preset END AS shown, report % 5 = 0 AS size_rejected, report % 10 = 0 AND k = 2 AS failed_trial FROM fact),
    g AS (SELECT report, enc AS encoder, max(coalesce(min_p5, 0)) AS score, bool_or(quality_failed) AS failed, bool_or(samples > 0 AND NOT quality_failed) AS allp, bool_or(runtime_supported AND playback_compatible) AS usable,
        bool_and(size_rejected AND NOT failed_trial AND NOT errors) AS size_limited, bool_or(quality = 'transparent') AS transparent, bool_or(shown = 'p7') AS slowest, bool_or(bounded) AS bounded FROM v GROUP BY 1, 2),
    s AS (SELECT report, encoder, score, CASE WHEN encoder LIKE '%_nvenc' AND NOT bounded THEN 'balanced' ELSE 'transparent' END AS quality,
        CASE WHEN encoder LIKE '%_nvenc' AND NOT bounded THEN CASE WHEN size_limited THEN [28, 26, 27, 30, 29, 32] WHEN failed AND NOT allp THEN [20, 18, 22, 23, 24, 25] ELSE [23, 22, 24, 25, 20, 18] END
          WHEN encoder LIKE '%_nvenc' AND (slowest OR transparent) OR transparent THEN [] ELSE [-1] END AS l FROM g WHERE usable AND encoder <> 'libx264'),
    u AS (SELECT report, encoder, score, quality, i - 1 AS turn, l[i] AS step FROM s, (SELECT unnest(range(1, 7)) AS i) WHERE i <= len(l)),
    r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY turn, score DESC, encoder) AS position FROM u)
    SELECT report, encoder, score, quality, CAST(turn AS BIGINT) AS turn, CAST(step AS BIGINT) AS step, position FROM r WHERE position <= 8""",
)
def round_robin(spark, folder):
    """Other vendors' encoders, bounded presets, size limits and failed trials among the trials."""
    _, _, trials, samples = _trial_inputs(spark, folder)
    r, k = F.col("report"), F.col("k")
    shown = F.when(r % 14 == 3, "p7").otherwise(F.element_at("settings", F.lit("preset")))
    varied = trials.withColumns({
        "encoder": F.when((r % 3 == 1) & (k == 5), "av1_qsv").when((r % 3 == 2) & (k == 5), "libx264").otherwise(F.col("encoder")),
        "output_preset": F.when(r % 7 == 3, "smaller").otherwise("original"), "size_rejected": r % 5 == 0, "error": F.when((r % 10 == 0) & (k == 2), "stopped"),
        "settings": F.create_map(F.lit("quality"), F.when((r % 6 == 1) & (k == 5), "transparent").otherwise("balanced"), F.lit("nvenc_preset"), shown),
    })
    return plain(op.adaptive_candidates(varied, samples))


@query(
    "faster_presets",
    f"""WITH {TRIAL_SQL}, s AS (SELECT report, encoder, preset, 23 AS cq FROM trial), f AS (SELECT s.*, v.f AS faster FROM s, (VALUES ('p4'), ('p5')) v(f) WHERE v.f < preset)
    SELECT DISTINCT report, encoder, preset, CAST(cq AS BIGINT) AS cq, faster FROM f WHERE NOT EXISTS (SELECT 1 FROM trial t WHERE t.report = f.report AND t.encoder = f.encoder AND t.preset = f.faster)""",
)
def faster_presets(spark, folder):
    t = tables.trials(spark, folder).select("report", "encoder", F.element_at("settings", F.lit("preset")).alias("preset"), F.lit(23).alias("cq"))
    selected = t.distinct()
    return plain(op.faster_presets(selected, t))


@query(
    "trial_overview",
    f"""WITH {TRIAL_SQL}, n AS (SELECT DISTINCT report FROM smp ORDER BY report DESC LIMIT 20), c AS (SELECT report, trial, count(*) FILTER (WHERE passed AND decode_pass) AS passed, count(*) AS samples FROM smp GROUP BY 1, 2)
    SELECT smp.report, smp.trial, reference, mean, c.passed, c.samples FROM smp JOIN n USING (report) JOIN c ON c.report = smp.report AND c.trial = smp.trial""",
)
def trial_overview(spark, folder):
    return plain(op.trial_overview(tables.samples(spark, folder)))


@query(
    "decision_evidence",
    f"WITH {TRIAL_SQL} SELECT report, trial, reference, mean, p5, passed, CASE WHEN report % 2 = 0 THEN 'hdr-common-render-v1' ELSE 'sdr' END AS domain FROM smp",
)
def decision_evidence(spark, folder):
    return plain(op.decision_evidence(tables.samples(spark, folder)))


@query(
    "constrained_trials",
    f"""WITH {TRIAL_SQL} SELECT report, trial, codec, NOT (codec = 'av1' AND report % 3 = 0 AND report % 2 = 0) AS preservable, dominated AND codec <> 'av1' AS examine_again FROM trial""",
)
def constrained_trials(spark, folder):
    _, references, trials, samples = _trial_inputs(spark, folder)
    changing = tables.reports(spark, folder).select(
        "report", (F.col("report") % 3 == 0).alias("changing"), F.when(F.col("report") % 2 == 0, "hevc").otherwise("h264").alias("source_codec")
    )
    limited = op.constrain(trials, changing).select("report", "trial", "codec", F.coalesce("preservable", F.lit(True)).alias("preservable"))
    again = op.resume_order(trials, references, samples).select("report", "trial", F.lit(True).alias("examine_again"))
    return plain(limited.join(again, ["report", "trial"], "left"))


@query(
    "savings_requirement",
    """WITH s AS (SELECT DISTINCT CAST(round(o_totalprice * 100) AS BIGINT) * 400 AS source, CAST(round(o_totalprice * 100) AS BIGINT) * (400 - o_orderkey % 160) AS output, o_orderkey FROM orders)
    SELECT o_orderkey, (source * 125 + 999) // 1000 AS fixed_bytes, greatest(100000000, least((source + 3) // 4, 1000000000)) AS aware_bytes, greatest(100000000, least((source + 3) // 4, 1000000000)) < source AS possible,
      CASE WHEN output < source AND source - output >= greatest(100000000, least((source + 3) // 4, 1000000000)) THEN 'meets size threshold' WHEN output >= source THEN 'output is not smaller' ELSE 'savings are below the minimum' END AS decision FROM s""",
)
def savings_requirement(spark, folder):
    o = table(spark, folder, "orders")
    price = cents(F.col("o_totalprice"))
    rows = o.select("o_orderkey", (price * 400).alias("source"), (price * (400 - F.col("o_orderkey") % 160)).alias("output"))
    aware = op.requirement(F.col("source"), "size-aware")
    return plain(rows.select(
        "o_orderkey", op.requirement(F.col("source"), "fixed", "12.5").alias("fixed_bytes"), aware.alias("aware_bytes"), (aware < F.col("source")).alias("possible"),
        op.savings_decision(F.col("source"), F.col("output"), aware).alias("decision"),
    ))
