"""Alignment: keyframe planning, contiguous-slice search, band and interval
joins.  None of them forms all pairs inside a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesleuth.functions.checks import first_failure, verdicts
from framesleuth.functions.rational import differs
from framesleuth.operators import ordered
from framesleuth.session import materialise

# Two primes below 2^31: products of two residues fit a BIGINT.
_PRIMES = (2147483647, 2147483629)
_BASE = 1_000_003
_DIGITS = 16  # any non-negative ordinal


def plan_keyframes(
    packets: DataFrame, requests: DataFrame, keys: Sequence[str], *, tick: int = 1, max_span: int = 60_000_000, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Keyframe pair that encloses each requested window.

    ``requests``: ``request_id, requested, seconds, span, source_end`` (same
    integer unit as the packet clocks).  A start lies within
    [max(0, requested - 2*span), requested + span]; its end is a keyframe within
    [max(start, requested) + seconds, min(source_end, start + 2*span)] with a
    later decode time.  The pair with the smallest (start before request,
    distance, end, start dts) wins.

    Starts meet requests through time buckets one span wide.  The end of a
    start is looked up in order (first keyframe at or after the target), not by
    pairing; only where that keyframe's decode clock runs backwards are the
    other keyframes of the allowed window examined.
    """
    keys = list(keys)
    usable = F.col("flags").contains("K") & ~F.col("flags").contains("D") & F.col("pts").isNotNull() & F.col("dts").isNotNull()
    key = packets.where(usable).select(*keys, "pts", "dts")
    asked = requests.where(
        (F.col("seconds") > 0) & (F.col("span") >= F.col("seconds")) & (F.col("span") <= max_span)
        & (F.col("requested") >= 0) & (F.col("source_end") > F.col("requested"))
    )
    width = asked.groupBy(*keys).agg(F.max("span").alias("_width"))
    first, last = F.greatest(F.lit(0), F.col("requested") - 2 * F.col("span")), F.col("requested") + F.col("span")
    div = lambda a, b: F.call_function("div", a, b)
    spread = asked.join(width, keys).withColumn("_bucket", F.explode(F.sequence(div(first, F.col("_width")), div(last, F.col("_width")))))
    starts = (
        key.join(width, keys).withColumn("_bucket", div(F.col("pts"), F.col("_width"))).drop("_width")
        .join(spread.drop("_width"), [*keys, "_bucket"])
        .where((F.col("pts") >= first) & (F.col("pts") <= last) & (F.col("pts") + F.col("seconds") <= F.col("source_end")) & (F.col("dts") >= tick))
        .withColumn("target", F.greatest("pts", "requested") + F.col("seconds"))
        .withColumn("limit", F.least(F.col("source_end"), F.col("pts") + 2 * F.col("span")))
        .select(*keys, "request_id", "requested", "pts", "dts", "target", "limit")
    )
    # Merge targets into the ordered keyframes; the next keyframe is a suffix scan.
    none = F.lit(None).cast("long")
    marks = key.select(*keys, F.col("pts").alias("_at"), F.lit(1).alias("_phase"), none.alias("_id"), none.alias("_start"), F.col("dts").alias("_dts"))
    marks = marks.groupBy(*keys, "_at", "_phase", "_id", "_start").agg(F.max("_dts").alias("_dts"))
    asks = starts.select(*keys, F.col("target").alias("_at"), F.lit(0).alias("_phase"), F.col("request_id").cast("long").alias("_id"), F.col("pts").alias("_start"), F.col("dts").alias("_dts"))
    placed = ordered.arrange(marks.unionByName(asks), keys, ["_at", "_phase", "_id", "_start", "_dts"])
    found = ordered.scan(
        placed, keys, ordered.PLACE, block_rows,
        following=ordered.next_known(F.when(F.col("_phase") == 1, F.struct(F.col("_at").alias("pts"), F.col("_dts").alias("dts")))),
    ).where(F.col("_phase") == 0)
    found = found.select(
        *keys, F.col("_id").alias("request_id"), F.col("_start").alias("pts"), F.col("_dts").alias("dts"),
        F.col("following.pts").alias("end_pts"), F.col("following.dts").alias("end_dts"),
    )
    ended = starts.withColumn("request_id", F.col("request_id").cast("long")).join(found.distinct(), [*keys, "request_id", "pts", "dts"])
    inside = F.col("end_pts") <= F.col("limit")
    direct = ended.where(inside & (F.col("end_dts") > F.col("dts")))
    backwards = ended.where(inside & (F.col("end_dts") <= F.col("dts"))).drop("end_pts", "end_dts")
    reach = F.sequence(div(F.col("target"), F.col("_width")), div(F.col("limit"), F.col("_width")))
    backwards = backwards.where(F.col("target") <= F.col("limit")).join(width, keys).withColumn("_bucket", F.explode(reach)).drop("_width")
    later = key.join(width, keys).select(
        *keys, div(F.col("pts"), F.col("_width")).alias("_bucket"), F.col("pts").alias("end_pts"), F.col("dts").alias("end_dts")
    )
    retried = backwards.join(later, [*keys, "_bucket"]).where(
        (F.col("end_pts") >= F.col("target")) & (F.col("end_pts") <= F.col("limit")) & (F.col("end_dts") > F.col("dts"))
    )
    rank = F.struct(
        (F.col("pts") < F.col("requested")).cast("int"), F.abs(F.col("pts") - F.col("requested")), F.col("end_pts"), F.col("dts")
    )
    best = F.min_by(F.struct("pts", "dts", "end_pts", "end_dts"), rank)
    chosen = direct.select(*ended.columns).unionByName(retried.select(*ended.columns)).groupBy(*keys, "request_id").agg(best.alias("_b"))
    planned = chosen.select(
        *keys, "request_id", F.col("_b.pts").alias("keyframe_pts"), F.col("_b.dts").alias("keyframe_dts"),
        (F.col("_b.dts") - tick).alias("seek"), (F.col("_b.end_dts") - F.col("_b.dts")).alias("seconds"),
        F.col("_b.end_pts").alias("end_keyframe_pts"), F.col("_b.end_dts").alias("end_keyframe_dts"),
    )
    any_start = starts.select(*keys, F.col("request_id").cast("long").alias("request_id"), F.lit(True).alias("_started")).distinct()
    listed = requests.select(*keys, F.col("request_id").cast("long").alias("request_id"))
    legal = asked.select(*keys, F.col("request_id").cast("long").alias("request_id"), F.lit(True).alias("_legal"))
    result = listed.join(legal, [*keys, "request_id"], "left").join(any_start, [*keys, "request_id"], "left").join(planned, [*keys, "request_id"], "left")
    reason = (
        F.when(F.col("_legal").isNull(), "invalid sampling bounds").when(F.col("_started").isNull(), "no keyframe within sampling bounds")
        .when(F.col("keyframe_pts").isNull(), "no complete boundary within sampling bounds")
    )
    return result.withColumn("reason", reason).drop("_legal", "_started")


def _power(exponent: Column, prime: int) -> Column:
    """_BASE ** exponent mod prime, from one 16-entry table per hex digit."""
    result = None
    for place in range(_DIGITS):
        step = pow(_BASE, 16**place, prime)
        table = F.expr("array(" + ",".join(f"{pow(step, i, prime)}L" for i in range(16)) + ")")
        digit = F.shiftrightunsigned(exponent, 4 * place).bitwiseAND(F.lit(15)).cast("int")
        part = F.get(table, digit)
        result = part if result is None else (result * part) % prime
    return result


def _weights(name: str = "hash", ordinal: str = "ordinal") -> list[Column]:
    seed = F.xxhash64(name)
    return [(F.pmod(seed, F.lit(p)) * _power(F.col(ordinal), p)) % p for p in _PRIMES]


def find_slices(source: DataFrame, samples: DataFrame, keys: Sequence[str], expected_shift: Column | None = None, tolerance: int = 0, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Where each sample occurs in its source as one contiguous run of payloads.

    Rabin-Karp on the payload hashes: prefix sums of ``hash * B**ordinal`` give
    the fingerprint of every window by subtraction, so the cost is linear even
    when most payloads are equal (silence, black).  ``matches`` counts the
    positions with the sample's fingerprint (and shift, when one is expected);
    ``payload_matches`` ignores the shift.  ``start`` is the single position.

    ``samples`` has ``sample_id, ordinal (dense from 1), hash, pts``.
    """
    keys = list(keys)
    weighted = source.select(*keys, "ordinal", "hash", "pts", *[w.alias(f"_w{i}") for i, w in enumerate(_weights())])
    # Read twice below (window starts and ends), so the prefix sums are written.
    prefix = materialise(ordered.scan(
        weighted, keys, "ordinal", block_rows, _p0=ordered.running_sum(F.col("_w0")), _p1=ordered.running_sum(F.col("_w1"))
    ).select(*keys, "ordinal", "hash", "pts", "_w0", "_w1", "_p0", "_p1"), "prefix")
    heads = samples.select("sample_id", *keys, "ordinal", "hash", "pts", *[w.alias(f"_w{i}") for i, w in enumerate(_weights())])
    heads = heads.groupBy("sample_id", *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by(F.struct("hash", "pts"), F.col("ordinal")).alias("_head"),
        *[(F.sum(f"_w{i}") % p).alias(f"_f{i}") for i, p in enumerate(_PRIMES)],
    )
    first = heads.select("sample_id", *keys, "rows", F.col("_head.hash").alias("hash"), F.col("_head.pts").alias("_sample_pts"), "_f0", "_f1")
    starts = prefix.join(first, [*keys, "hash"]).select(
        "sample_id", *keys, "ordinal", "rows", "_sample_pts", F.col("pts").alias("_source_pts"), "_f0", "_f1",
        (F.col("_p0") - F.col("_w0")).alias("_b0"), (F.col("_p1") - F.col("_w1")).alias("_b1"),
        (F.col("ordinal") + F.col("rows") - 1).alias("_end"),
    )
    ends = prefix.select(*keys, F.col("ordinal").alias("_end"), F.col("_p0").alias("_e0"), F.col("_p1").alias("_e1"))
    windows = starts.join(ends, [*keys, "_end"])
    same = [
        F.pmod(F.col(f"_e{i}") - F.col(f"_b{i}"), F.lit(p)) == (_power(F.col("ordinal") - 1, p) * F.col(f"_f{i}")) % p
        for i, p in enumerate(_PRIMES)
    ]
    hits = windows.where(same[0] & same[1])
    shift = F.col("_sample_pts") - F.col("_source_pts")
    placed = F.lit(True) if expected_shift is None else F.coalesce(F.abs(shift - expected_shift) <= tolerance, F.lit(False))
    counted = hits.groupBy("sample_id", *keys).agg(
        F.count(F.lit(1)).alias("payload_matches"), F.count_if(placed).alias("matches"), F.min(F.when(placed, F.col("ordinal"))).alias("_start")
    )
    return (
        heads.select("sample_id", *keys, "rows").join(counted, ["sample_id", *keys], "left")
        .withColumn("payload_matches", F.coalesce("payload_matches", F.lit(0)))
        .withColumn("matches", F.coalesce("matches", F.lit(0)))
        .withColumn("start", F.when(F.col("matches") == 1, F.col("_start")))
        .drop("_start")
    )


def _beside_source(source: DataFrame, samples: DataFrame, keys: Sequence[str], slices: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sample rows next to the source rows of their unique slice."""
    at = slices.where(F.col("start").isNotNull()).select("sample_id", *keys, "start")
    left = samples.join(at, ["sample_id", *keys]).withColumn("source_ordinal", F.col("start") + F.col("ordinal") - 1)
    right = source.select(*keys, F.col("ordinal").alias("source_ordinal"), *[F.col(f).alias(f"s_{f}") for f in fields])
    return left.join(right, [*keys, "source_ordinal"], "left")


def align_slices(source: DataFrame, samples: DataFrame, keys: Sequence[str], tolerance: int = 0, expected_shift: Column | None = None, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Each sample must be exactly one contiguous slice with a single time shift.

    Payload equality of the unique candidate is confirmed row by row, so a
    fingerprint collision cannot pass.
    """
    keys = list(keys)
    slices = find_slices(source, samples, keys, expected_shift, tolerance, block_rows)
    rows = _beside_source(source, samples, keys, slices, ["hash", "pts", "dts", "dur"])
    by_row = [F.col(k) - F.col(f"s_{k}") for k in ("pts", "dts")]
    available = [F.col(k).isNull() == F.col(f"s_{k}").isNull() for k in ("pts", "dts", "dur")]
    checks = [
        (F.col("hash") == F.col("s_hash"), "payload differs"),
        (available[0] & available[1] & available[2], "timestamp availability changed"),
        (~differs(F.col("dur"), F.col("s_dur"), tolerance), "duration changed"),
    ]
    judged = verdicts(
        rows.withColumn("reason", first_failure(checks)), ["sample_id", *keys],
        low=F.least(F.min(by_row[0]), F.min(by_row[1])), high=F.greatest(F.max(by_row[0]), F.max(by_row[1])),
        shift=F.min_by(F.coalesce(*by_row), "ordinal"),
    ).drop("rows_checked", "status", "first_bad_ordinal", "failures").withColumnRenamed("reason", "_row_reason")
    result = slices.join(judged, ["sample_id", *keys], "left")
    moved = (F.col("high") - F.col("shift") > tolerance) | (F.col("shift") - F.col("low") > tolerance)
    if expected_shift is not None:
        moved = moved | (F.abs(F.col("shift") - expected_shift) > tolerance)
    reason = (
        F.when((F.col("payload_matches") > 0) & (F.col("matches") == 0), "shift differs from the other tracks")
        .when(F.col("matches") != 1, "not one unique contiguous slice")
        .when(F.col("_row_reason").isNotNull(), F.col("_row_reason"))
        .when(F.col("shift").isNull(), "no verifiable timestamps")
        .when(moved, "alignment changed")
    )
    return result.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "pass").otherwise("fail")).drop(
        "_row_reason", "low", "high"
    )


def restored_clocks(source: DataFrame, samples: DataFrame, keys: Sequence[str], shift: Column, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Source clock plus shift for every row of an unchanged, uniquely placed sample.

    ``reason`` is set where the source clock is missing or does not increase.
    """
    keys = list(keys)
    slices = find_slices(source, samples, keys, block_rows=block_rows)
    rows = _beside_source(source, samples, keys, slices, ["pts", "hash"]).withColumn("restored", F.col("s_pts") + shift)
    rows = ordered.scan(rows, ["sample_id", *keys], "ordinal", block_rows, before=ordered.lag(F.col("restored")))
    checks = [
        (F.col("hash") == F.col("s_hash"), "payload differs"),
        (F.col("restored").isNotNull(), "missing original clock"),
        (F.col("before").isNull() | (F.col("restored") > F.col("before")), "original clocks not increasing"),
    ]
    return rows.select("sample_id", *keys, "ordinal", "restored", first_failure(checks).alias("reason"))


def rebuild_clocks(packets: DataFrame, clocks: DataFrame, keys: Sequence[str], begin: Column, end: Column) -> DataFrame:
    """Microsecond times from native ticks and the track's clock, then the rows
    presented inside [begin, end]."""
    from framesleuth.functions.rational import ticks as rescale

    micro = lambda c: rescale(F.col(c), F.col("base_num"), F.col("base_den"), F.lit(1), F.lit(1_000_000))
    timed = packets.join(clocks, list(keys)).withColumns({"pts": micro("pts_ticks"), "dts": micro("dts_ticks"), "dur": micro("dur_ticks")})
    return timed.where(F.col("pts").between(begin, end)).drop("base_num", "base_den")


def duration_plan(source: DataFrame, samples: DataFrame, keys: Sequence[str], block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Source duration for every packet of a uniquely placed sample, by position.

    A position named twice cannot carry one duration and is marked.
    """
    keys = list(keys)
    slices = find_slices(source, samples, keys, block_rows=block_rows)
    rows = _beside_source(source, samples, keys, slices, ["dur", "hash"]).where(F.col("hash") == F.col("s_hash"))
    repeated = rows.groupBy("sample_id", *keys, "pos").agg(
        F.count(F.lit(1)).alias("n"), F.min("s_dur").alias("duration"), F.min("size").alias("size"), F.min("hash").alias("hash")
    )
    return repeated.select(
        "sample_id", *keys, "pos", F.when(F.col("n") == 1, F.col("duration")).alias("duration"), "size", "hash",
        F.when(F.col("n") > 1, "laced packets need another representation").alias("reason"),
    )


def window_bytes(packets: DataFrame, windows: DataFrame, keys: Sequence[str], closed: bool = False, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Packets and bytes presented inside each window ``[begin, finish)`` (or
    closed).  ``windows``: ``window_id, begin, finish``."""
    return ordered.range_totals(packets, windows, keys, "pts", "size", "begin", "finish", "window_id", closed, block_rows).select(
        *keys, "window_id", F.col("points").alias("packets"), F.col("total").alias("bytes")
    )


def unique_in_band(records: DataFrame, values: DataFrame, keys: Sequence[str], tolerance: int, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """The record within ``tolerance`` of each value, when there is exactly one.

    ``records``: ``at``; ``values``: ``value_id, value``.
    """
    bands = values.select(*keys, "value_id", (F.col("value") - tolerance).alias("low"), (F.col("value") + tolerance).alias("high"))
    totals = ordered.range_totals(records.withColumn("_one", F.lit(1)), bands, keys, "at", "_one", "low", "high", "value_id", True, block_rows)
    unique = F.col("points") == 1
    return totals.select(
        *keys, "value_id", F.col("points").alias("candidates"), F.when(unique, F.col("last_at")).alias("matched_at"),
        F.when(~unique, "no unique source record").alias("reason"),
    )
