"""Writers for inventories, reports and timestamp lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesleuth.functions.labels import csv_cell
from framesleuth.operators import ordered
from framesleuth.operators.library import inventory_summary


def write_inventory(rows: DataFrame, path: str) -> None:
    """Inventory as JSON lines and its summary beside it."""
    rows.write.json(f"{path}/files")
    inventory_summary(rows).write.json(f"{path}/summary")


def write_report(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Report as CSV lines with every cell quoted and formulas neutralised."""
    cells = F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns])
    rows.select(cells.alias("value")).write.text(path)


#: Header of the activity report and words for each outcome: fixed values.
ACTIVITY_COLUMNS = ("File", "Activity", "State", "Outcome date (UTC)", "Reason", "Original bytes", "Output bytes", "Confirmed replacement reduction bytes", "Request ID", "App version")
ACTIVITY_LABELS = {
    "replaced": "Successful replacement", "copies": "Validated copy \u2014 original retained", "benefit": "Unchanged \u2014 size or quality checks not met", "errors": "Error / interrupted",
    "cancelled": "Cancelled", "attention": "Needs attention", "other": "Kept / inspected / tested", "active": "Queued / running",
}


def activity_lines(rows: DataFrame) -> DataFrame:
    """``place, value``: the ten columns of the activity report, header first, newest outcome first.

    ``rows``: source, category, state, ended_us (0 if unknown), reason, source_bytes,
    output_bytes, saved_bytes, id, app_version.  The reduction is shown for
    replaced files only.
    """
    label = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in ACTIVITY_LABELS.items()])
    date = F.when(F.col("ended_us") > 0, F.date_format(F.timestamp_micros("ended_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("Not recorded")
    saved = F.when(F.col("state") == "replaced", F.col("saved_bytes"))
    cells = [F.col("source"), label, F.col("state"), date, F.col("reason"), F.col("source_bytes"), F.col("output_bytes"), saved, F.col("id"), F.col("app_version")]
    body = rows.select(F.struct(F.lit(1).alias("part"), (-F.coalesce("ended_us", F.lit(0))).alias("ended"), F.col("id").cast("string").alias("id")).alias("place"), F.concat_ws(",", *map(csv_cell, cells)).alias("value"))
    head = rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ended"), F.lit("").alias("id")).alias("place"), F.concat_ws(",", *(csv_cell(F.lit(c)) for c in ACTIVITY_COLUMNS)).alias("value"))
    return head.unionByName(body)


def write_activity(rows: DataFrame, path: str) -> None:
    """Activity report as CSV with CRLF line ends; parts follow the order of the report, the header in the first."""
    lines = activity_lines(rows)
    lines.repartitionByRange("place").sortWithinPartitions("place").select("value").write.option("lineSep", "\r\n").text(path)


def timestamp_lines(frames: DataFrame, keys: Sequence[str], include_end: bool = False, repeats: bool = False) -> DataFrame:
    """Presentation times in milliseconds with nine decimals, in order.

    Microseconds are exact, so the text is built from integers.  Groups whose
    times do not strictly increase (with ``repeats``: fall) are reported through
    ``reason`` instead.
    With ``include_end`` the last frame adds its end as one more boundary.
    """
    rows = ordered.scan(frames, keys, before=ordered.lag(F.col("pts")), after=ordered.lead(F.struct("pts")))
    bad = F.col("pts").isNull() | (F.col("before") > F.col("pts")) | (~F.lit(repeats) & (F.col("before") == F.col("pts")))
    end = F.when(F.col("after").isNull() & F.lit(include_end) & (F.col("dur") > 0), F.col("pts") + F.col("dur"))
    points = rows.select(*keys, "ordinal", F.when(bad, "timestamps must increase").alias("reason"), F.explode(F.array_compact(F.array("pts", end))).alias("at"))
    text = F.format_string("%d.%03d000000", F.call_function("div", F.col("at"), F.lit(1000)), F.col("at") % 1000)
    return points.select(*keys, "ordinal", "at", text.alias("value"), "reason")


def write_timestamps(frames: DataFrame, keys: Sequence[str], path: str, include_end: bool = False, repeats: bool = False) -> None:
    """Timestamp text under one folder per group, lines in order inside each part;
    part numbers follow the order as well."""
    lines = timestamp_lines(frames, keys, include_end, repeats).where(F.col("reason").isNull())
    ordered_lines = lines.repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at")
    ordered_lines.select(*keys, "value").write.partitionBy(*keys).text(path)
