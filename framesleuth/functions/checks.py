"""Fail-closed predicates and verdict rows.

A check is a pair ``(passes, reason)``.  Unknown evidence never passes: a NULL
predicate counts as a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = tuple[Column, "str | Column"]


def holds(predicate: Column) -> Column:
    """True only where the predicate is known to be true."""
    return F.coalesce(predicate, F.lit(False))


def _text(reason: str | Column) -> Column:
    return F.lit(reason) if isinstance(reason, str) else reason


def first_failure(checks: Sequence[Check]) -> Column:
    """Reason of the first check that does not hold, NULL when all hold."""
    return F.coalesce(*[F.when(~holds(ok), _text(reason)) for ok, reason in checks])


def failed_names(checks: Sequence[Check]) -> Column:
    """Array with the reason of every check that does not hold, in order."""
    return F.array_compact(F.array(*[F.when(~holds(ok), _text(reason)) for ok, reason in checks]))


def verdicts(rows: DataFrame, keys: Sequence[str], ordinal: str = "ordinal", reason: str = "reason", **extra: Column) -> DataFrame:
    """One row per group: status, first reason by ordinal, and counts.

    Only mergeable aggregates, so a group of any size is combined map-side.
    """
    at = F.when(F.col(reason).isNotNull(), F.col(ordinal))
    return (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows_checked"),
            F.count(reason).alias("failures"),
            F.min(at).alias("first_bad_ordinal"),
            F.min_by(F.col(reason), at).alias("reason"),
            *[column.alias(name) for name, column in extra.items()],
        )
        .withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))
    )


def with_empty_groups(result: DataFrame, expected: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Add a failing verdict for listed groups that produced no evidence at all."""
    return (
        expected.select(*keys).distinct().join(result, list(keys), "left")
        .withColumn("rows_checked", F.coalesce("rows_checked", F.lit(0)))
        .withColumn("failures", F.coalesce("failures", F.lit(1)))
        .withColumn("reason", F.when(F.col("status").isNull(), reason).otherwise(F.col("reason")))
        .withColumn("status", F.coalesce("status", F.lit("fail")))
    )
