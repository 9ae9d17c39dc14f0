"""Ordered computation over groups of any size.

A plain window over ``(file, track)`` puts a whole track into one task, and one
track may hold a third of all rows.  Everything here works in two levels
instead: rows are placed in total order across many partitions, cut into blocks
of at most ``block_rows`` rows, each block is reduced to one summary row, and a
window over the few summary rows carries state from block to block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesleuth.session import materialise

BLOCK_ROWS = 65536
PLACE = "_place"
# monotonically_increasing_id puts the partition number above this many bits.
_PARTITION_BITS = 33


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def arrange(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``_place``: a unique number that increases in ``(keys, order)`` order.

    Range partitioning on keys *and* order splits a hot group.  The order must
    be total inside a group.  The result is written, because the number depends
    on physical placement.
    """
    wanted = [*_columns(keys), *_columns(order)]
    spread = df.repartitionByRange(*wanted).sortWithinPartitions(*wanted)
    return materialise(spread.withColumn(PLACE, F.monotonically_increasing_id()), "placed")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ordinal: str = "ordinal") -> DataFrame:
    """Dense 1-based position of each row inside its group."""
    placed = arrange(df, keys, order).withColumn("_part", F.shiftright(PLACE, _PARTITION_BITS))
    parts = placed.groupBy(*keys, "_part").agg(F.min(PLACE).alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        placed.join(offsets, [*keys, "_part"])
        .withColumn(ordinal, F.col(PLACE) - F.col("_from") + F.col("_skip") + 1)
        .drop("_part", "_from", "_skip", PLACE)
    )


class Scan(NamedTuple):
    """One prefix or suffix computation, split into its four parts."""

    local: Callable  # (window inside the block) -> Column
    summary: Callable  # (order column) -> aggregate Column over the block
    carry: Callable  # (summary column, window over blocks) -> Column
    combine: Callable  # (local column, carried column) -> Column


def _rows(window, start, end):
    return window.rowsBetween(start, end)


def lag(value: Column) -> Scan:
    """Value of the previous row of the group; NULL on the first row."""
    held = F.struct(value.alias("v"))
    return Scan(
        lambda w: F.lag(held).over(w),
        lambda at: F.max_by(held, at),
        lambda s, w: F.lag(s).over(w),
        lambda here, carried: F.coalesce(here, carried)["v"],
    )


def lead(value: Column) -> Scan:
    """Value of the next row of the group; NULL on the last row."""
    held = F.struct(value.alias("v"))
    return Scan(
        lambda w: F.lead(held).over(w),
        lambda at: F.min_by(held, at),
        lambda s, w: F.lead(s).over(w),
        lambda here, carried: F.coalesce(here, carried)["v"],
    )


def last_known(value: Column, inclusive: bool = True) -> Scan:
    """Latest non-null value at or before (or strictly before) each row."""
    end = Window.currentRow if inclusive else -1
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(_rows(w, Window.unboundedPreceding, end)),
        lambda at: F.max_by(value, F.when(value.isNotNull(), at)),
        lambda s, w: F.last(s, ignorenulls=True).over(_rows(w, Window.unboundedPreceding, -1)),
        lambda here, carried: F.coalesce(here, carried),
    )


def next_known(value: Column, inclusive: bool = True) -> Scan:
    """Earliest non-null value at or after (or strictly after) each row."""
    start = Window.currentRow if inclusive else 1
    return Scan(
        lambda w: F.first(value, ignorenulls=True).over(_rows(w, start, Window.unboundedFollowing)),
        lambda at: F.min_by(value, F.when(value.isNotNull(), at)),
        lambda s, w: F.first(s, ignorenulls=True).over(_rows(w, 1, Window.unboundedFollowing)),
        lambda here, carried: F.coalesce(here, carried),
    )


def _running(reduce: Callable, merge: Callable, value: Column, inclusive: bool) -> Scan:
    end = Window.currentRow if inclusive else -1
    return Scan(
        lambda w: reduce(value).over(_rows(w, Window.unboundedPreceding, end)),
        lambda at: reduce(value),
        lambda s, w: reduce(s).over(_rows(w, Window.unboundedPreceding, -1)),
        merge,
    )


def running_max(value: Column, inclusive: bool = True) -> Scan:
    return _running(F.max, lambda a, b: F.greatest(a, b), value, inclusive)


def running_min(value: Column, inclusive: bool = True) -> Scan:
    return _running(F.min, lambda a, b: F.least(a, b), value, inclusive)


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    def merge(a, b):
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    return _running(F.sum, merge, value, inclusive)


def scan(df: DataFrame, keys: Sequence[str], order: str = "ordinal", block_rows: int = BLOCK_ROWS, **outputs: Scan) -> DataFrame:
    """Add one column per scan, following the integer column ``order``.

    ``order`` is unique inside a group (a dense ordinal or ``_place``), so a
    block can never hold more than ``block_rows`` rows whatever the skew.
    """
    keys = list(keys)
    base = df.withColumn("_block", F.expr(f"{order} div {block_rows}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_block")
    summaries = base.groupBy(*keys, "_block").agg(
        *[s.summary(F.col(order)).alias(f"_s_{name}") for name, s in outputs.items()]
    )
    carried = summaries.select(
        *keys, "_block", *[s.carry(F.col(f"_s_{name}"), across).alias(f"_c_{name}") for name, s in outputs.items()]
    )
    local = base.withColumns({f"_l_{name}": s.local(inside) for name, s in outputs.items()})
    joined = local.join(carried, [*keys, "_block"])
    return joined.withColumns(
        {name: s.combine(F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, s in outputs.items()}
    ).drop("_block", *[f"_l_{n}" for n in outputs], *[f"_c_{n}" for n in outputs])


def range_totals(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    at: str,
    measure: str,
    low: str,
    high: str,
    range_id: str,
    closed: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Count and sum of the points inside each range, without pairing them.

    Each range contributes two edges that are merged into the ordered points; a
    running count and sum read at both edges gives the totals.  Cost is linear
    in points plus ranges however they overlap.  ``last_at`` is the greatest
    point at or before the upper edge.  ``closed`` includes the upper bound.
    """
    keys = list(keys)
    marks = points.where(F.col(at).isNotNull()).select(
        *keys, F.col(at).alias("_at"), F.lit(1).alias("_phase"), F.lit(None).cast("string").alias(range_id),
        F.lit(0).alias("_sign"), F.col(measure).cast("long").alias("_measure"),
    )
    ends = F.array(
        F.struct(F.col(low).alias("at"), F.lit(0).alias("phase"), F.lit(-1).alias("sign")),
        F.struct(F.col(high).alias("at"), F.lit(2 if closed else 0).alias("phase"), F.lit(1).alias("sign")),
    )
    edges = ranges.select(*keys, F.col(range_id).cast("string").alias(range_id), F.explode(ends).alias("_e")).select(
        *keys, F.col("_e.at").alias("_at"), F.col("_e.phase").alias("_phase"), range_id,
        F.col("_e.sign").alias("_sign"), F.lit(None).cast("long").alias("_measure"),
    )
    placed = arrange(marks.unionByName(edges), keys, ["_at", "_phase", range_id, "_sign", "_measure"])
    point = F.col("_phase") == 1
    counted = scan(
        placed, keys, PLACE, block_rows,
        _count=running_sum(F.when(point, 1).otherwise(0)),
        _total=running_sum(F.coalesce("_measure", F.lit(0))),
        _last=last_known(F.when(point, F.col("_at"))),
    ).where(F.col("_sign") != 0)
    return counted.groupBy(*keys, range_id).agg(
        F.sum(F.col("_sign") * F.col("_count")).alias("points"),
        F.sum(F.col("_sign") * F.col("_total")).alias("total"),
        F.max(F.when(F.col("_sign") == 1, F.col("_last"))).alias("last_at"),
    )
