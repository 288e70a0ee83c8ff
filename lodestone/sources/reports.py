"""Reports as JSON lines or text, one line for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shown(c: str) -> Column:
    return F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")))


def as_json(report: DataFrame) -> DataFrame:
    """Column ``value``: each row as JSON, with its nulls."""
    return report.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in report.columns]), {"ignoreNullFields": "false"}).alias("value"))


def as_text(report: DataFrame) -> DataFrame:
    """Column ``value``: each row as ``name=value`` pairs; arrays and structs must be joined before."""
    return report.select(F.concat_ws("  ", *[_shown(c) for c in report.columns]).alias("value"))


def write_report(report: DataFrame, path: str, json: bool = True) -> None:
    """Write a report to a new folder; a report without rows gives a folder without lines."""
    (as_json(report) if json else as_text(report)).write.text(path)
