"""Exact clock and ratio arithmetic on integers; no floating point.

A rational is a struct ``(num decimal(38,0), den decimal(38,0))`` with a
positive denominator.  Equality is cross multiplication.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no aspect ratio declared".
UNKNOWN_RATIO = ("", "N/A", "unknown", "unspecified", "0:1", "0/1")

_RATIO = r"^\s*(-?\d{1,18})\s*(?:[:/]\s*(\d{1,18})\s*)?$"
TOLERANCE_US = 2000  # decoded and copied timelines: 1/500 s
MICROSECOND = 1


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _clock(value: Column) -> Column:
    return value.cast("decimal(9,0)")


def micros(stamp: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, stamp.cast("timestamp_ntz"))


def nearest_tick(num: Column, den: Column) -> Column:
    """num/den rounded to the nearest integer, halves away from zero (den > 0)."""
    size = F.call_function("div", 2 * F.abs(num) + den, 2 * den)
    return F.when(num < 0, -size).otherwise(size)


def floor_div(num: Column, den: Column) -> Column:
    """Integer floor of num/den for den > 0, also for negative num."""
    quotient = F.call_function("div", num, den)
    return quotient - F.when((num % den) < 0, 1).otherwise(0)


def ticks(value: Column, from_num: Column, from_den: Column, to_num: Column, to_den: Column, rounding: str = "nearest") -> Column:
    """Re-express ``value`` ticks of clock from_num/from_den on clock to_num/to_den."""
    num = _wide(value) * _clock(from_num) * _clock(to_den)
    den = (_clock(from_den) * _clock(to_num)).cast("decimal(18,0)")
    return nearest_tick(num, den) if rounding == "nearest" else floor_div(num, den)


def serialized_witness(raw_ticks: Column, base_num: Column, base_den: Column, stamp_us: Column) -> Column:
    """True when an integer clock agrees with its six-decimal text within half a microsecond."""
    gap = F.abs(_wide(raw_ticks) * _clock(base_num) * F.lit(1_000_000) - _wide(stamp_us) * _clock(base_den))
    return 2 * gap <= base_den


def packet_ticks(raw_ticks: Column, base_num: Column, base_den: Column, stamp_us: Column) -> Column:
    """Native integer clock of a packet; NULL when it cannot be established.

    A missing integer is recovered from the text only when one tick is longer
    than the text's own microsecond uncertainty.
    """
    recovered = F.when(
        base_num * 1_000_000 > base_den, nearest_tick(_wide(stamp_us) * _clock(base_den), base_num * 1_000_000)
    )
    value = F.coalesce(raw_ticks, recovered)
    return F.when(serialized_witness(value, base_num, base_den, stamp_us), value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once and written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(text: Column) -> Column:
    """Parse ``a:b``, ``c/d`` or ``n`` to an exact rational; NULL if it is none of these."""

    def parse(t: Column) -> Column:
        num = F.regexp_extract(t, _RATIO, 1).try_cast("decimal(38,0)")
        den = F.coalesce(F.nullif(F.regexp_extract(t, _RATIO, 2), F.lit("")), F.lit("1")).try_cast("decimal(38,0)")
        return F.when(num.isNotNull() & (den > 0), F.struct(num.alias("num"), den.alias("den")))

    return let(text, parse)


def _product(a: Column, b: Column) -> Column:
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")


def ratios_equal(a: Column, b: Column) -> Column:
    return _product(a["num"], b["den"]) == _product(b["num"], a["den"])


def equivalent_ratio(left: Column, right: Column) -> Column:
    """Same text, or the same positive rational under either spelling."""
    pair = F.struct(ratio(left).alias("a"), ratio(right).alias("b"))
    same = let(pair, lambda x: (x["a"]["num"] > 0) & (x["b"]["num"] > 0) & ratios_equal(x["a"], x["b"]))
    return left.eqNullSafe(right) | F.coalesce(same, F.lit(False))


def known_ratio(text: Column) -> Column:
    """Ratio text, or NULL for any spelling of "not declared"."""
    return F.when(~text.isin(*UNKNOWN_RATIO), text)


def effective_pixel_aspect(sar: Column, dar: Column, width: Column, height: Column) -> Column:
    """Pixel aspect from declared SAR and DAR; NULL when they conflict or are invalid.

    With a display ratio the pixel ratio is dar*height/width, and a declared
    SAR has to agree with it.  With neither, pixels are square.
    """
    inputs = F.struct(
        known_ratio(sar).alias("s"), known_ratio(dar).alias("d"), ratio(known_ratio(sar)).alias("sr"), ratio(known_ratio(dar)).alias("dr"),
        width.cast("long").alias("w"), height.cast("long").alias("h"),
    )

    def resolve(x: Column) -> Column:
        declared, display = x["sr"], x["dr"]
        bad = (x["s"].isNotNull() & ~F.coalesce(declared["num"] > 0, F.lit(False))) | (x["d"].isNotNull() & ~F.coalesce(display["num"] > 0, F.lit(False)))
        inferred = F.struct(_product(display["num"], x["h"]).alias("num"), _product(display["den"], x["w"]).alias("den"))
        square = F.struct(F.lit(1).cast("decimal(38,0)").alias("num"), F.lit(1).cast("decimal(38,0)").alias("den"))
        has_size = F.coalesce((x["w"] > 0) & (x["h"] > 0), F.lit(False))
        return F.when(bad, None).when(
            display.isNotNull(), F.when(has_size & (declared.isNull() | ratios_equal(declared, inferred)), inferred)
        ).otherwise(F.coalesce(declared, square))

    return let(inputs, resolve)


def compatible_measured_rate(left: Column, right: Column, frames: Column) -> Column:
    """Average rates equal, or within 1e-6 with at most 2 ms drift over all frames."""

    def near(x: Column) -> Column:
        an, ad, bn, bd = (x[i][j].cast("decimal(12,0)") for i in ("a", "b") for j in ("num", "den"))
        cross_l, cross_r = (an * bd).cast("decimal(24,0)"), (bn * ad).cast("decimal(24,0)")
        gap = F.abs(cross_l - cross_r)
        close = gap.cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)") <= F.greatest(cross_l, cross_r)
        # |1/a - 1/b| = gap / (an*bn)
        drift = gap.cast("decimal(24,0)") * (frames * 500).cast("decimal(13,0)") <= (an * bn).cast("decimal(24,0)")
        return (frames >= 2) & (an > 0) & (bn > 0) & close & drift

    pair = F.struct(ratio(left).alias("a"), ratio(right).alias("b"))
    return equivalent_ratio(left, right) | F.coalesce(let(pair, near), F.lit(False))


def differs(left: Column, right: Column, tolerance: int | Column = 0) -> Column:
    """True where only one side is known, or both are and lie further apart."""
    return (
        F.when(left.isNull() & right.isNull(), F.lit(False))
        .when(left.isNull() | right.isNull(), F.lit(True))
        .otherwise(F.abs(left - right) > tolerance)
    )
