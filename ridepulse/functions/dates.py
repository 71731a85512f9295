"""Pruning of ride tables that are partitioned by booking month.

Silver ride tables may carry ``booking_month`` (the first day of the month of
``booking_timestamp``, NULL without one) as their partition column.  These filters only
skip partitions: the caller still compares timestamps.  Tables without the column are left
as they are.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOKING_MONTH = "booking_month"


def booking_month() -> Column:
    return F.trunc("booking_timestamp", "month")


def by_month(df: DataFrame) -> DataFrame:
    """``df`` with its partition column, rows of a month together; AQE splits months that are too large for a task."""
    return df.withColumn(BOOKING_MONTH, booking_month()).hint("rebalance", BOOKING_MONTH)


def booked_from(df: DataFrame, start: Column) -> DataFrame:
    return df.where(F.col(BOOKING_MONTH) >= F.trunc(start, "month")) if BOOKING_MONTH in df.columns else df


def booked_until(df: DataFrame, end: Column) -> DataFrame:
    return df.where(F.col(BOOKING_MONTH) <= F.trunc(end, "month")) if BOOKING_MONTH in df.columns else df


def _month_of(path: str) -> str | None:
    """The booking month in a file's path, or None."""
    found = re.search(rf"/{BOOKING_MONTH}=(\d{{4}}-\d{{2}}-\d{{2}})/", path)
    return found and found.group(1)


def newest(df: DataFrame, rows: int) -> DataFrame:
    """``df`` without the months that can't matter for its ``rows`` newest rides.

    The months and their numbers of files are known from the listing of the table, and a file holds a row at least, so
    the newest months with ``rows`` files are enough, unless rows of theirs are filtered away.  Older months stay in the
    plan behind a scalar subquery over those months: it decides at run time, before any of their files is opened,
    whether they are needed.  No job runs here.
    """
    if BOOKING_MONTH not in df.columns or df.isStreaming:
        return df
    files = Counter(map(_month_of, df.inputFiles()))
    files.pop(None, None)
    seen, first = 0, None
    for first in sorted(files, reverse=True):
        seen += files[first]
        if seen >= rows:
            break
    if seen < rows:
        return df
    recent = df.where(F.col(BOOKING_MONTH) >= F.lit(first).cast("date"))
    found = recent.where(F.col("booking_timestamp").isNotNull()).select(F.lit(1)).limit(rows).agg(F.count(F.lit(1))).scalar()
    month = F.coalesce(F.col(BOOKING_MONTH), F.lit("0001-01-02").cast("date"))  # rides without a time are the oldest
    needed = F.when(found < rows, F.lit("0001-01-01")).otherwise(F.lit("9999-12-31")).cast("date")
    return recent.unionByName(df.where((month < F.lit(first).cast("date")) & (month > needed)))
