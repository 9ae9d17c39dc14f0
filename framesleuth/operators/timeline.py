"""Audits and repairs of ordered timelines (one row per group unless noted)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesleuth.functions.checks import holds
from framesleuth.functions.rational import TOLERANCE_US, differs
from framesleuth.operators import ordered
from framesleuth.operators.compare import zip_rows
from framesleuth.session import materialise

MAX_STARTUP_LEAD_US = 100_000
SEEK_SPREAD_US = 2_000_000


def audit_timeline(packets: DataFrame, keys: Sequence[str], initial_allowance: int = 0) -> DataFrame:
    """Decode clock must be known and strictly increase in file order.

    Up to ``initial_allowance`` leading rows may lack a decode time.
    """
    rows = ordered.scan(packets, keys, previous=ordered.last_known(F.col("dts"), inclusive=False))
    excused = F.col("dts").isNull() & F.col("pts").isNotNull() & (F.col("ordinal") <= initial_allowance) & F.col("previous").isNull()
    missing = (F.col("pts").isNull() | F.col("dts").isNull()) & ~excused
    back = holds(~missing & (F.col("dts") <= F.col("previous")))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(missing).alias("missing"), F.count_if(back).alias("non_increasing"),
        F.min(F.when(missing | back, F.col("ordinal"))).alias("first_bad_ordinal"),
    ).withColumn("status", F.when(F.col("missing") + F.col("non_increasing") == 0, "pass").otherwise("fail"))


def reorder_prefix(packets: DataFrame, frames: DataFrame, keys: Sequence[str], delay: Column, seek_preroll: bool = False) -> DataFrame:
    """Leading packets without decode time, accepted only when decoded frames
    show exactly the packets' presentation times; otherwise 0.

    ``delay`` bounds the run (1..16).  With ``seek_preroll`` up to ``delay``
    pictures before the first key picture may be undecodable.
    """
    keys = list(keys)
    rows = ordered.scan(packets, keys, previous=ordered.last_known(F.col("dts"), inclusive=False))
    shape = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        (F.coalesce(F.min(F.when(F.col("dts").isNotNull(), F.col("ordinal"))), F.count(F.lit(1)) + 1) - 1).alias("missing"),
        F.count_if(F.col("pts").isNull() | (F.col("dts").isNull() & F.col("previous").isNotNull()) | holds(F.col("dts") <= F.col("previous"))).alias("bad"),
        F.min_by(F.struct("pts", "flags"), "ordinal").alias("_first"),
    )
    seen = ordered.scan(frames.select(*keys, "ordinal", "pts"), keys, previous=ordered.lag(F.col("pts")))
    fallen = seen.groupBy(*keys).agg(
        F.count_if(~holds(F.col("previous").isNull() | (F.col("pts") > F.col("previous")))).alias("falling"),
        F.min_by("pts", "ordinal").alias("_first_frame"),
    )
    shape = shape.join(fallen, keys, "left")
    count_by = lambda df, name: df.groupBy(*keys, "pts").agg(F.count(F.lit(1)).alias(name))
    paired = count_by(packets, "p").join(count_by(frames, "f"), [*keys, "pts"], "full_outer").join(shape, keys)
    odd = F.coalesce("p", F.lit(0)) != F.coalesce("f", F.lit(0))
    leading = F.col("pts") < F.col("_first.pts")
    may_lead = F.lit(seek_preroll) & F.col("_first.flags").contains("K") & (F.col("_first_frame") == F.col("_first.pts"))
    result = paired.groupBy(*keys).agg(
        F.count_if(odd).alias("odd"), F.count_if(odd & leading & holds(may_lead)).alias("odd_leading"),
        F.sum(F.when(leading, F.coalesce("p", F.lit(0))).otherwise(0)).alias("leading"),
        *[F.first(c).alias(c) for c in ("packets", "missing", "bad", "falling")],
    )
    times_agree = (F.col("odd") == 0) | ((F.col("odd") == F.col("odd_leading")) & (F.col("leading") <= delay))
    ok = (
        delay.between(1, 16) & F.col("missing").between(1, delay) & (F.col("packets") > F.col("missing")) & (F.col("bad") == 0)
        & (F.col("falling") == 0) & times_agree
    )
    return result.select(*keys, F.when(holds(ok), F.col("missing")).otherwise(0).alias("accepted"))


def startup_lead(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far audio runs ahead of the first video packet, in file order.

    ``media`` is ``video``, ``audio`` or other; the lead is NULL when no video
    packet exists or a clock before it is unknown.
    """
    av = packets.where(F.col("media").isin("video", "audio"))
    rows = ordered.scan(
        av, keys,
        top=ordered.running_max(F.when(F.col("media") == "audio", F.col("pts")), inclusive=False),
        unknown=ordered.running_sum(F.col("pts").isNull().cast("long")),
    )
    at = F.when(F.col("media") == "video", F.col("ordinal"))
    found = rows.groupBy(*keys).agg(F.min_by(F.struct("pts", "top", "unknown"), at).alias("_v"))
    lead = F.when(F.col("_v.unknown") == 0, F.greatest(F.lit(0), F.coalesce(F.col("_v.top") - F.col("_v.pts"), F.lit(0))))
    return found.select(*keys, lead.alias("lead_us"), holds(lead <= MAX_STARTUP_LEAD_US).alias("passed"))


def seek_alignment(packets: DataFrame, tracks: DataFrame, keys: Sequence[str], tolerance: int = SEEK_SPREAD_US) -> DataFrame:
    """First packet of every listed track lies within ``tolerance`` of the others."""
    first = packets.groupBy(*keys, "track").agg(F.min_by("pts", "ordinal").alias("first_pts"))
    listed = tracks.select(*keys, "track").distinct().join(first, [*keys, "track"], "left")
    result = listed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tracks"), F.count("first_pts").alias("present"), (F.max("first_pts") - F.min("first_pts")).alias("spread_us")
    )
    return result.withColumn("passed", holds((F.col("tracks") == F.col("present")) & (F.col("spread_us") <= tolerance)))


def filled_timestamps(reference: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Timestamps the output filled in lie between known source anchors, in order."""
    rows = zip_rows(reference, output, keys, ["hash", "pts", "dts", "dur"])
    rows = ordered.scan(
        rows, keys, before=ordered.last_known(F.col("a_pts"), inclusive=False), after=ordered.next_known(F.col("a_pts")),
    )
    ok = F.col("a_here") & F.col("b_here") & (F.col("a_hash") == F.col("b_hash"))
    changed = F.lit(False)
    for field in ("pts", "dts"):
        a, b = F.col(f"a_{field}"), F.col(f"b_{field}")
        filled = a.isNull() & b.isNotNull()
        between = (b >= F.col("before")) & (b <= F.col("after") + TOLERANCE_US)
        ok = ok & F.when(filled, between).otherwise(~differs(a, b, TOLERANCE_US))
        changed = changed | filled
    ok = ok & ~differs(F.col("a_dur"), F.col("b_dur"), TOLERANCE_US)
    ok = ok & (F.col("a_pts").isNull() | F.col("before").isNull() | (F.col("a_pts") >= F.col("before")))
    result = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_checked"), F.count_if(~holds(ok)).alias("bad"), F.count_if(holds(changed)).alias("filled")
    )
    return result.withColumn("accepted", (F.col("bad") == 0) & (F.col("filled") > 0))


def terminal_duration(reference: DataFrame, output: DataFrame, keys: Sequence[str], preserved_priming: bool = False) -> DataFrame:
    """Exactly one duration differs, on the last packet, where the source ends
    short and the output repeats the previous packet's length."""
    before = ordered.scan(reference, keys, previous_dur=ordered.lag(F.col("dur")))
    rows = zip_rows(before, output.withColumn("previous_dur", F.lit(None).cast("long")), keys, ["hash", "pts", "dts", "dur", "previous_dur"])
    close = lambda f: F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= TOLERANCE_US
    primed = F.lit(preserved_priming) & (F.col("ordinal") == 1) & F.col("b_dur").isNull() & (F.col("a_dur") > 0)
    sound = (F.col("a_hash") == F.col("b_hash")) & close("pts") & close("dts") & (primed | ((F.col("a_dur") > 0) & (F.col("b_dur") > 0)))
    mismatch = holds(~primed & ~close("dur"))
    result = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(~holds(sound)).alias("bad"), F.count_if(mismatch).alias("mismatches"),
        F.max(F.when(mismatch, F.col("ordinal"))).alias("_at"),
        F.max_by(F.struct("a_dur", "b_dur", "a_previous_dur"), "ordinal").alias("_last"),
    )
    last = F.col("_last")
    shape = (
        (F.col("bad") == 0) & (F.col("packets") >= 2) & (F.col("mismatches") == 1) & (F.col("_at") == F.col("packets"))
        & (last["a_dur"] < last["a_previous_dur"]) & (last["a_previous_dur"] <= 100_000)
        & (F.abs(last["b_dur"] - last["a_previous_dur"]) <= TOLERANCE_US)
    )
    return result.select(*keys, "packets", "bad", "mismatches", holds(shape).alias("accepted"))


def terminal_padding(source: DataFrame, output: DataFrame, keys: Sequence[str], frame_samples: int, sample_rate: int, base_num: int, base_den: int) -> DataFrame:
    """Lost terminal duration proved by the last packet's discard padding.

    Durations are in ticks of base_num/base_den seconds; ``skip_samples`` and
    ``discard_padding`` come from the packet's side data.
    """
    fields = ["hash", "size", "flags", "pts", "dts", "dur", "skip_samples", "discard_padding"]
    rows = zip_rows(source, output, keys, fields)
    same = lambda f: F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    sound = F.col("a_hash").isNotNull() & F.col("a_pts").isNotNull() & F.col("a_dts").isNotNull()
    for f in ("hash", "size", "flags", "pts", "dts", "skip_samples", "discard_padding"):
        sound = sound & same(f)
    change = holds(F.col("a_dur") != F.col("b_dur")) | (F.col("a_dur").isNull() != F.col("b_dur").isNull())
    last = F.max_by(F.struct("a_dur", "b_dur", "a_skip_samples", "a_discard_padding"), "ordinal")
    result = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(~holds(sound)).alias("bad"), F.count_if(change).alias("changes"),
        F.max(F.when(change, F.col("ordinal"))).alias("_at"), last.alias("_last"),
    )
    l = F.col("_last")
    # |ticks*base - samples/rate| <= base, cleared of denominators
    near = lambda ticks, samples: F.abs(ticks * base_num * sample_rate - samples * base_den) <= base_num * sample_rate
    padding = l["a_discard_padding"]
    reason = (
        F.when((F.col("packets") > 0) & (F.col("bad") == 0) & (F.col("changes") == 0), "nothing to restore")
        .when(F.col("bad") > 0, "packet payload, side data or clock changed")
        .when((F.col("changes") != 1) | (F.col("_at") != F.col("packets")), "difference is not exclusively terminal")
        .when(~holds((F.coalesce(l["a_skip_samples"], F.lit(0)) == 0) & (padding > 0) & (padding < frame_samples)), "no unchanged discard padding")
        .when(~holds((l["a_dur"] > 0) & (l["a_dur"] < l["b_dur"])), "duration not representable")
        .when(~holds(near(l["a_dur"], F.lit(frame_samples) - padding)), "does not match decoded padding")
        .when(~holds(near(l["b_dur"], F.lit(frame_samples))), "output is not the complete frame")
    )
    return result.select(*keys, "packets", "changes", reason.alias("reason"), F.when(reason.isNull(), l["a_dur"]).alias("duration_ticks"))


def initial_timestamp(reference: DataFrame, output: DataFrame, keys: Sequence[str], missing_duration: bool = False) -> DataFrame:
    """Only the first packet's presentation time (or duration) is anomalous."""
    rows = zip_rows(reference, output, keys, ["hash", "pts", "dts", "dur"])
    first = F.col("ordinal") == 1
    ok = F.col("a_hash") == F.col("b_hash")
    for f in ("pts", "dts", "dur"):
        skipped = first & F.lit(f == ("dur" if missing_duration else "pts"))
        ok = ok & (skipped | (F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= TOLERANCE_US))
    row = F.struct("a_pts", "a_dts", "a_dur", "b_pts", "b_dts", "b_dur")
    pick = lambda n: F.max(F.when(F.col("ordinal") == n, row))
    result = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(~holds(ok)).alias("bad"), pick(1).alias("x"), pick(2).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    if missing_duration:
        shape = x["b_dur"].isNull() & (x["a_dur"] > 0) & (y["a_pts"] > x["a_pts"]) & (y["b_pts"] > x["b_pts"])
    else:
        shape = (
            (x["a_dur"] > 0) & (x["a_pts"] - x["a_dts"] == x["a_dur"]) & (x["a_pts"] == y["a_pts"])
            & (x["b_pts"] == x["b_dts"]) & (y["b_pts"] > x["b_pts"])
        )
    return result.select(*keys, "packets", "bad", holds((F.col("bad") == 0) & (F.col("packets") >= 2) & shape).alias("accepted"))


def missing_durations(reference: DataFrame, output: DataFrame, keys: Sequence[str], materialised: bool = False) -> DataFrame:
    """Durations absent on one side only (the output's, or the source's when
    ``materialised``), everything else equal within 2 ms."""
    rows = zip_rows(reference, output, keys, ["hash", "pts", "dts", "dur"])
    given, absent = ("b_dur", "a_dur") if materialised else ("a_dur", "b_dur")
    gap = F.col(absent).isNull() & F.col(given).isNotNull()
    ok = (F.col("a_hash") == F.col("b_hash"))
    for f in ("pts", "dts"):
        ok = ok & (F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= TOLERANCE_US)
    ok = ok & F.when(gap, F.col(given) > 0).otherwise(~differs(F.col("a_dur"), F.col("b_dur"), TOLERANCE_US))
    result = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(~holds(ok)).alias("bad"), F.count_if(gap).alias("missing")
    )
    return result.withColumn("accepted", (F.col("bad") == 0) & (F.col("missing") > 0))


def infer_durations(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a missing duration replaced by the gap to the next packet."""
    rows = ordered.scan(packets, keys, next_pts=ordered.lead(F.col("pts")))
    gap = F.col("next_pts") - F.col("pts")
    return rows.withColumn("inferred", F.col("dur").isNull() & (gap > 0)).withColumn("dur", F.coalesce("dur", F.when(gap > 0, gap))).drop("next_pts")


def decode_clock_delay(packets: DataFrame, keys: Sequence[str], block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Smallest fixed delay that makes a strictly increasing decode clock precede
    presentation.  The clock ``last = max(dts, last + 1)`` has the closed form
    ``ordinal + max(dts - ordinal)`` over the rows so far."""
    rows = ordered.scan(packets, keys, "ordinal", block_rows, top=ordered.running_max(F.col("dts") - F.col("ordinal")))
    clock = F.col("ordinal") + F.col("top")
    incomplete = F.count_if(F.col("pts").isNull() | F.col("dts").isNull())
    delay = F.greatest(F.lit(0), F.max(clock - F.col("pts"))) + 1
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), incomplete.alias("incomplete"), F.max(clock).alias("last_clock"), delay.alias("_d")).select(
        *keys, "packets", "last_clock", F.when(F.col("incomplete") == 0, F.col("_d")).alias("delay"),
        F.when(F.col("incomplete") > 0, "incomplete packet clocks").alias("reason"),
    )


def missing_tail(frames: DataFrame, keys: Sequence[str], minimum: int = 17) -> DataFrame:
    """Final missing timestamp = its coded clock plus the upper-median offset.

    All offsets must lie within one microsecond, so at most two values occur and
    the median needs only their counts.  ``clock`` is the coded picture time and
    ``coded_type`` its picture type.
    """
    rows = ordered.scan(frames, keys, previous=ordered.last_known(F.col("pts"), inclusive=False))
    offset = F.col("pts") - F.col("clock")
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count("pts").alias("known"), F.min(offset).alias("low"), F.max(offset).alias("high"),
        F.count_if(~holds(F.col("pict_type") == F.col("coded_type"))).alias("retyped"),
        F.count_if(holds(F.col("pts") <= F.col("previous"))).alias("falling"),
        F.max_by(F.struct("pts", "clock"), "ordinal").alias("_last"), F.max("pts").alias("latest"), F.sum(offset.cast("decimal(20,0)")).alias("_sum"),
    )
    # With low and low + 1 the only values, the sum tells how many are high.
    joined = facts.withColumn("low_count", F.col("known") - (F.col("_sum") - F.col("known") * F.col("low")))
    # Upper median: element number known div 2 (from zero) of the sorted offsets.
    median = F.when(F.col("low_count") > F.call_function("div", F.col("known"), F.lit(2)), F.col("low")).otherwise(F.col("high"))
    recovered = F.col("_last.clock") + median
    reason = (
        F.when(F.col("frames") < minimum, "insufficient tail evidence").when(F.col("_last.pts").isNotNull(), "final picture has a timestamp")
        .when(F.col("retyped") > 0, "picture order or type changed").when(F.col("known") != F.col("frames") - 1, "only the final timestamp can be recovered")
        .when(F.col("falling") > 0, "timestamps not increasing").when(F.col("high") - F.col("low") > 1, "coded clock disagrees")
        .when(recovered <= F.col("latest"), "recovered timestamp does not follow")
    )
    return joined.select(*keys, "frames", reason.alias("reason"), F.when(reason.isNull(), recovered).alias("recovered"))


def change_points(frames: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """Frames, frames with a payload, and changes from row to row (NULL counts)."""
    rows = ordered.scan(frames.withColumn("_v", payload), keys, before=ordered.lag(F.struct(F.col("_v").alias("v"))))
    changed = F.col("before").isNotNull() & ~F.col("_v").eqNullSafe(F.col("before.v"))
    first = F.min_by(F.struct("_v"), "ordinal")["_v"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count("_v").alias("present_frames"), F.count_if(changed).alias("changes"), first.alias("first_payload")
    ).withColumns({"changing": F.col("changes") > 0, "complete": F.col("present_frames") == F.col("frames")})


def trailing_eta(progress: DataFrame, keys: Sequence[str], window_s: int = 120, minimum_s: int = 10) -> DataFrame:
    """Remaining seconds from the recent throughput of the current stage.

    ``label, percent, elapsed, eta`` in log order.  Going back from the last
    line, lines belong to the current run while the label stays and neither
    elapsed nor percent exceeds the last line's; only the trailing window
    counts.  Without enough history the reported eta stands.
    """
    final = progress.groupBy(*keys).agg(F.max_by(F.struct("label", "percent", "elapsed", "eta", "ordinal"), "ordinal").alias("_z"))
    rows = progress.join(final, list(keys))
    z = F.col("_z")
    breaks = (F.col("label") != z["label"]) | (F.col("elapsed") > z["elapsed"]) | (F.col("percent") > z["percent"]) | (z["elapsed"] - F.col("elapsed") > window_s)
    last_break = rows.groupBy(*keys).agg(F.max(F.when(breaks, F.col("ordinal"))).alias("_b"))
    run = rows.join(last_break, list(keys)).where(F.col("ordinal") > F.coalesce("_b", F.lit(0)))
    facts = run.groupBy(*keys).agg(
        F.first("_z").alias("_z"), F.count(F.lit(1)).alias("lines"), F.min_by(F.struct("elapsed", "percent"), "ordinal").alias("_a")
    )
    span, gain = z["elapsed"] - F.col("_a.elapsed"), z["percent"] - F.col("_a.percent")
    measured = F.when((F.col("lines") > 1) & (span >= minimum_s) & (gain > 0), F.bround((100 - z["percent"]) * span / gain).cast("long"))
    return facts.select(*keys, z["label"].alias("label"), z["percent"].alias("percent"), "lines", F.coalesce(measured, z["eta"]).alias("eta"))


def prefix_by_time(frames: DataFrame, keys: Sequence[str], length: Column) -> DataFrame:
    """Frames before first + length, and the first time at or beyond it."""
    rows = ordered.scan(frames, keys, previous=ordered.lag(F.col("pts")))
    facts = rows.groupBy(*keys).agg(
        F.min("pts").alias("_first"), F.count(F.lit(1)).alias("frames"),
        F.count_if(~holds(F.col("previous").isNull() | (F.col("pts") > F.col("previous")))).alias("falling"),
    )
    # Times rise, so the split needs only a count and a minimum around the bound.
    bounded = frames.join(facts.select(*keys, (F.col("_first") + length).alias("_end")), list(keys))
    split = bounded.groupBy(*keys).agg(
        F.count_if(F.col("pts") < F.col("_end")).alias("prefix_frames"), F.min(F.when(F.col("pts") >= F.col("_end"), F.col("pts"))).alias("endpoint")
    )
    joined = facts.join(split, list(keys))
    reason = (
        F.when((F.col("frames") < 2) | (F.col("falling") > 0), "timestamps must be finite and increasing")
        .when(F.col("endpoint").isNull(), "no complete sample endpoint")
    )
    return joined.select(*keys, "frames", "prefix_frames", "endpoint", reason.alias("reason"))


def keep_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Last ``n`` rows of each key; Spark trims each task to n before shuffling.

    Above ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark does not trim,
    so each key is cut to ``n`` in salted parts first.
    """
    if n > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
        rows = salted.withColumn("_rn", F.row_number().over(parts)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= n).drop("_rn")


def keep_newest_keys(rows: DataFrame, key: str, updated: str, n: int) -> DataFrame:
    """Rows of the ``n`` most recently updated keys (a retention limit)."""
    newest = rows.groupBy(key).agg(F.max(updated).alias("_u")).orderBy(F.desc("_u"), key).limit(n)
    return rows.join(newest.select(key), key)


def within_ttl(rows: DataFrame, updated: str, now: Column, ttl: int) -> DataFrame:
    return rows.where((F.col(updated) <= now) & (now - F.col(updated) <= ttl))


def _walked(n_keys: int, least_us: int, ends: bool):
    """Task over readings in order of ``keys, _block, ordinal``, each with the reading its block begins after.

    ``ends``: the last reading that counts of every block; else the rates.
    """

    def task(batches):
        import pyarrow as pa

        block, at, counter = None, None, None
        fields = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if fields is None:
                kept = [batch.schema.field(k) for k in range(n_keys)]
                last = [("_block", pa.int64()), ("end_at", pa.int64()), ("end_counter", pa.float64())] if ends else [("ordinal", pa.int64()), ("rate", pa.float64())]
                fields = pa.schema([*kept, *(pa.field(*f) for f in last)])
            out = []
            for mine, ordinal, now, used, from_at, from_counter in zip(zip(*columns[: n_keys + 1]), *columns[n_keys + 1 :]):
                if mine != block:
                    if ends and block is not None:
                        out.append((*block, at, counter))
                    block, at, counter = mine, from_at, from_counter
                if now is None or used is None or used != used:
                    continue
                if at is not None:
                    if now - at < least_us or used < counter:
                        continue
                    if now > at and not ends:
                        out.append((*mine[:-1], ordinal, (used - counter) * 1e6 / (now - at)))
                at, counter = now, used
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
        if ends and block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*block, at, counter), fields)], schema=fields)

    return task


def taken_rates(samples: DataFrame, keys: Sequence[str], least_us: int = 1_000_000, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """``keys, ordinal, rate``: readings that count, each compared with the last that counted.

    The first reading counts; then each that is at least ``least_us`` after the last
    one and not below it; with 0, one at the same time counts without a rate.  Readings
    without a time or counter are ignored.  Which readings count depends on those before, so a group
    of more than ``block_rows`` readings is walked in blocks: each block begins where the block before ended in the last
    round, and rounds go on until no block's end moves.  The first block is right
    after one round and every further one after at most one more; walks from
    different beginnings soon meet, so a few rounds do for groups of any size.
    A task walks many blocks, one after the other.
    ``samples``: keys, ordinal, at_us (not falling), counter.
    """
    keys = list(keys)
    key_types = ", ".join(f"{k} {dict(samples.dtypes)[k]}" for k in keys)
    rows = samples.select(*keys, F.expr(f"(ordinal - 1) div {block_rows}").alias("_block"), F.col("ordinal").cast("long").alias("ordinal"), F.col("at_us").cast("long").alias("at_us"), F.col("counter").cast("double").alias("counter"))
    rows = materialise(rows, "readings")

    def joined(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
        """By keys that may be null; columns of the left side, then other ones of the right."""
        right = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
        met = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names))
        return left.join(right, met, how).drop(*(f"_r_{n}" for n in names))

    def walk(held: DataFrame, ends: bool) -> DataFrame:
        order = [*keys, "_block", "ordinal"]
        placed = held.select(*order, "at_us", "counter", "from_at", "from_counter").repartition(*keys, "_block").sortWithinPartitions(*order)
        return placed.mapInArrow(_walked(len(keys), least_us, ends), f"{key_types}, _block long, end_at long, end_counter double" if ends else f"{key_types}, ordinal long, rate double")

    fresh = {"from_at": F.lit(None).cast("long"), "from_counter": F.lit(None).cast("double")}
    parted = rows.where("_block > 0").select(*keys).distinct()  # groups of several blocks
    if parted.isEmpty():
        return walk(rows.withColumns(fresh), False)
    long = materialise(joined(rows, parted, keys, "left_semi"), "readings")
    after = Window.partitionBy(*keys).orderBy("_block")
    begins = materialise(long.select(*keys, "_block").distinct().withColumns(fresh), "begins")
    while True:
        ends = walk(joined(long, begins, [*keys, "_block"], "inner"), True)
        # One row for each block.
        found = materialise(ends.select(*keys, "_block", F.lag("end_at").over(after).alias("from_at"), F.lag("end_counter").over(after).alias("from_counter")), "begins")
        same = joined(found, begins.withColumnsRenamed({"from_at": "_at", "from_counter": "_counter"}), [*keys, "_block"], "inner")
        moved = not same.where(~(F.col("from_at").eqNullSafe(F.col("_at")) & F.col("from_counter").eqNullSafe(F.col("_counter")))).isEmpty()
        begins = found
        if not moved:
            break
    return walk(joined(rows, begins, [*keys, "_block"], "left"), False)


def counter_rates(samples: DataFrame, keys: Sequence[str], keep: int = 20, least_us: int = 1_000_000, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Rate between counter readings; last ``keep`` rates, latest and peak, per key.

    Rates are counter units per second.  A reading within ``least_us`` of the last
    one that counted, or below it, is ignored.
    """
    keys = list(keys)
    kept = keep_latest(taken_rates(samples, keys, least_us, block_rows), keys, [F.desc("ordinal")], keep)
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rates"), F.max_by("rate", "ordinal").alias("latest_rate"), F.max("rate").alias("peak_rate")
    )


def allocation_target(original: Column, rates: Column, peak: Column) -> Column:
    """Cores to keep: at most two released, room for 1.2 times the peak use plus
    a half, 1..16; unchanged before three rates are known."""
    needed = F.ceil(peak * 1.2 + 0.5).cast("long")
    return F.when(rates < 3, original).otherwise(F.least(F.lit(16), F.greatest(F.lit(1), original - 2, needed)))


def track_spans(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, first start and last end of every track; unresolved durations counted."""
    return packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.min("pts").alias("first_us"), F.max(F.col("pts") + F.col("dur")).alias("last_us"),
        F.count_if(~holds(F.col("dur") > 0)).alias("unresolved"),
    )


def duration_header(spans: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Does a container's duration mean elapsed length or absolute end?

    ``headers``: ``declared_start, declared_duration`` per file, microseconds;
    agreement within one microsecond of text rounding.
    """
    whole = spans.groupBy(*keys).agg(F.min("first_us").alias("start"), F.max("last_us").alias("end"), F.sum("unresolved").alias("unresolved"))
    rows = whole.join(headers, list(keys))
    mode = F.when(F.abs(F.col("declared_duration") - (F.col("end") - F.col("start"))) <= 1, "elapsed").when(
        F.abs(F.col("declared_duration") - F.col("end")) <= 1, "absolute-end"
    )
    reason = (
        F.when(F.col("unresolved") > 0, "packet duration is unresolved")
        .when((F.col("start") == 0) | (F.col("end") <= F.col("start")), "not an offset case")
        .when(F.abs(F.col("declared_start") - F.col("start")) > 1, "declared start differs")
        .when(mode.isNull(), "matches neither span nor endpoint")
    )
    return rows.select(*keys, "start", "end", mode.alias("mode"), reason.alias("reason"))


def duration_header_case(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two headers of the same spans that differ only in that representation."""
    a = before.select(*keys, F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("mode").alias("a_mode"), F.col("reason").alias("a_reason"))
    b = after.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("mode").alias("b_mode"), F.col("reason").alias("b_reason"))
    rows = a.join(b, list(keys), "full_outer")
    same = (F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end"))
    reason = F.coalesce(
        "a_reason", "b_reason", F.when(~holds(same), "packet extent changed"),
        F.when(~holds(F.col("a_mode") != F.col("b_mode")), "not a representation difference"),
    )
    return rows.select(*keys, "a_mode", "b_mode", reason.alias("reason"))


def track_fingerprints(packets: DataFrame, keys: Sequence[str], fields: Sequence[str], block_rows: int = 4096) -> DataFrame:
    """Count and order-sensitive SHA-256 of every track.

    A tree: rows are hashed in blocks of ``block_rows`` ordinals and the block
    digests again in blocks, three levels deep or until each track has one, so no
    task ever holds more than ``block_rows`` digests of one track.
    """
    if block_rows < 2:
        raise ValueError("a block holds two rows at least")
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("N/A")) for f in fields]
    level = packets.select(*keys, (F.col("ordinal") - 1).alias("_at"), F.sha2(F.concat_ws("|", *parts), 256).alias("_digest"), F.lit(1).cast("long").alias("_n"))
    # The levels that the longest track needs; three suffice up to block_rows ** 3 rows.
    longest, levels = packets.agg(F.max("ordinal")).first()[0] or 0, 3
    while block_rows**levels < longest:
        levels += 1
    for _ in range(levels):
        level = level.groupBy(*keys, F.expr(f"_at div {block_rows}").alias("_at")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_digest"))), lambda x: x["_digest"]), ""), 256).alias("_digest"),
            F.sum("_n").alias("_n"),
        )
    return level.groupBy(*keys).agg(F.sum("_n").alias("packets"), F.max("_digest").alias("fingerprint"))


def sequence_coverage(records: DataFrame, keys: Sequence[str], index: str, required: Column) -> DataFrame:
    """Index must equal the row position 0..n-1 and reach ``required`` rows."""
    facts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~holds(F.col(index) == F.col("ordinal") - 1)).alias("misplaced"),
        F.min(F.when(~holds(F.col(index) == F.col("ordinal") - 1), F.col("ordinal"))).alias("first_bad_ordinal"),
    )
    reason = F.when(F.col("misplaced") > 0, "coverage is missing, duplicated or reordered").when(F.col("records") < required, "coverage incomplete")
    return facts.withColumn("reason", reason)


def constant_value(frames: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The one value all frames agree on; NULL if any differs or is unknown.

    Minimum and maximum decide this without collecting distinct values.
    """
    facts = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    same = (F.col("_n") == F.col("frames")) & (F.col("_lo") == F.col("_hi"))
    return facts.select(*keys, "frames", F.when(same, F.col("_lo")).alias("constant"))


def scan_witness(frames: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared format confirmed by every decoded frame.

    ``declared``: ``width, height, pix_fmt, header_width, header_height``; a
    header value of NULL or 0 is filled from the frames, otherwise it must agree.
    """
    f = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), *[F.min(c).alias(f"lo_{c}") for c in ("width", "height", "pix_fmt")],
        *[F.max(c).alias(f"hi_{c}") for c in ("width", "height", "pix_fmt")],
    )
    rows = declared.join(f, list(keys), "left")
    agree = F.lit(True)
    for c in ("width", "height", "pix_fmt"):
        agree = agree & (F.col(f"lo_{c}") == F.col(c)) & (F.col(f"hi_{c}") == F.col(c))
    header = F.lit(True)
    for c in ("width", "height"):
        header = header & (F.col(f"header_{c}").isNull() | F.col(f"header_{c}").isin(0) | (F.col(f"header_{c}") == F.col(c)))
    reason = (
        F.when(F.col("frames").isNull(), "no decoded pictures").when(~holds(agree), "decoded format does not match")
        .when(~holds(header), "header and decoded geometry disagree")
    )
    return rows.select(*keys, F.coalesce("frames", F.lit(0)).alias("frames"), "width", "height", "pix_fmt", reason.alias("reason"))


def priming(first_packets: DataFrame, streams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skipped start samples of audio tracks, from each track's first packet.

    ``start_us`` is the stream's declared start; packet time plus skip must
    meet it within one sample.
    """
    first = first_packets.groupBy(*keys).agg(F.min_by(F.struct("pts", "skip_samples", "discard_padding"), "ordinal").alias("p"))
    rows = streams.where((F.col("codec") == "aac") & (F.col("codec_type") == "audio")).join(first, list(keys)).where(F.col("p.skip_samples") > 0)
    skip, rate = F.col("p.skip_samples"), F.col("sample_rate")
    # |pts + skip/rate - start| <= 1/rate, cleared of the denominator
    gap = F.abs((F.col("p.pts") - F.col("start_us")) * rate + skip * 1_000_000)
    reason = F.when(
        ~holds((F.coalesce(F.col("p.discard_padding"), F.lit(0)) == 0) & (rate > 0) & (skip <= rate)), "unsupported priming evidence"
    ).when(~holds(gap <= 1_000_000), "priming does not match initial timestamp")
    return rows.select(*keys, skip.alias("samples"), rate.alias("rate"), "start_us", reason.alias("reason"))


def unit_inventory(units: DataFrame) -> DataFrame:
    """Codec units by kind and layer."""
    return units.groupBy("unit_type", "layer").agg(F.count(F.lit(1)).alias("units"), F.sum("size").alias("bytes"))


def metadata_digest(records: DataFrame, keys: Sequence[str], document: Column, kind: Column, block_rows: int = 4096) -> DataFrame:
    """Ordered digest of canonical metadata records, beside each kind that occurs
    (one row per kind)."""
    canonical = records.withColumn("_doc", document).withColumn("_kind", kind)
    prints = track_fingerprints(canonical, keys, ["_doc"], block_rows)
    kinds = canonical.groupBy(*keys, F.col("_kind").alias("kind")).agg(F.count(F.lit(1)).alias("records"))
    return prints.join(kinds, list(keys))
