"""Stamps of runs, edits, files and reports: fixed once a run, so every row of it has the same one."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stamp(now: datetime | None = None) -> int:
    """Whole seconds since 1970: what a run writes into ``time_stamp``."""
    return int((now or datetime.now(UTC)).timestamp())


def stamped(df: DataFrame, stamp: int, edited: bool = False) -> DataFrame:
    """Rows with the run's stamp; of an edit they are also marked as edited."""
    d = df.withColumn("time_stamp", F.lit(stamp).cast("long"))
    return d.withColumn("edited", F.lit(1).cast("long")) if edited else d


def file_name(name: str, extension: str, now: datetime | None = None) -> str:
    """``name_2024-01-31_235959_UTC.extension``."""
    t = now or datetime.now(UTC)
    return f"{name}_{t:%Y-%m-%d_%H%M%S}_{t.tzname() or 'UTC'}.{extension}"


def report_date(at: Column | None = None, pattern: str = "MMMM d, yyyy") -> Column:
    """The date that a report shows."""
    return F.date_format(F.current_date() if at is None else at, pattern)
