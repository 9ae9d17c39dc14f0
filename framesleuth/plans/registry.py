"""Registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in plain SQL, if expressible."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Chosen columns without NULLs and with one integer width, so results hash
    the same whatever engine produced them."""
    kinds = dict(df.dtypes)
    columns = []
    for name in names or df.columns:
        kind, column = kinds[name], F.col(name)
        if kind in ("int", "smallint", "tinyint", "bigint"):
            column = F.coalesce(column.cast("long"), F.lit(-1))
        elif kind.startswith("decimal"):
            column = F.coalesce(column.cast("long"), F.lit(-1))
        elif kind == "string":
            column = F.coalesce(column, F.lit(""))
        elif kind == "boolean":
            column = F.coalesce(column, F.lit(False))
        columns.append(column.alias(name))
    return df.select(*columns)


def zip_sql(left: str, right: str, fields: str, keys: str = "track") -> str:
    """SQL text of an ordered full-outer zip of two tables."""
    names = keys.split()
    fs = ", ".join(f"a.{f} AS a_{f}, b.{f} AS b_{f}" for f in fields.split())
    ks = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in names)
    on = " AND ".join(f"a.{k} = b.{k}" for k in [*names, "ordinal"])
    return (
        f"SELECT {ks}, coalesce(a.ordinal, b.ordinal) AS ordinal, a.ordinal IS NOT NULL AS a_here, "
        f"b.ordinal IS NOT NULL AS b_here, {fs} FROM {left} a FULL JOIN {right} b ON {on}"
    )


def reasons_sql(*checks: tuple[str, str]) -> str:
    """CASE giving the first reason whose predicate is not known to hold."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{why}'" for ok, why in checks) + " END"


def verdict_sql(table: str, keys: str = "track", extra: str = "") -> str:
    ks = ", ".join(keys.split())
    return f"""SELECT {ks}, count(*) AS rows_checked, count(reason) AS failures,
      coalesce(min(CASE WHEN reason IS NOT NULL THEN ordinal END), -1) AS first_bad_ordinal,
      coalesce(arg_min(reason, ordinal) FILTER (WHERE reason IS NOT NULL), '') AS reason,
      CASE WHEN count(reason) = 0 THEN 'pass' ELSE 'fail' END AS status{extra}
      FROM {table} GROUP BY {ks}"""


def near_sql(field: str, tolerance: int = 2000) -> str:
    """Both absent, or both present within the tolerance."""
    return (
        f"((a_{field} IS NULL AND b_{field} IS NULL) OR coalesce(abs(a_{field} - b_{field}) <= {tolerance}, false))"
    )
