"""Join helpers with explicit size policy.

* Fixed lookups (a handful of literal rows) are broadcast unconditionally:
  their size is bounded by construction.
* Anything derived from data is broadcast only after its row count has been
  checked against a bound; above the bound the join is left to the planner
  (sort-merge, or AQE's runtime conversion when the real size turns out small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup above this many rows is not treated as a lookup any more.
LOOKUP_ROW_BOUND = 100_000


# Planner estimates at or below this size count as proven small without a job.
STATS_BYTE_BOUND = 1 << 20


def _estimated_bytes(df: DataFrame) -> int | None:
    try:
        # the analyzed plan is already computed; its estimate needs no optimizer run
        return int(df._jdf.queryExecution().analyzed().stats().sizeInBytes().toString())
    except Exception:  # estimates unavailable (e.g. streaming plans)
        return None


def small_lookup(df: DataFrame, max_rows: int = LOOKUP_ROW_BOUND) -> DataFrame:
    """Mark ``df`` for broadcast if it is proven small, else leave the join to the planner.

    Proofs, cheapest first: frames built from local rows are already on the
    driver; a planner size estimate of at most 1 MiB (file sizes of tiny
    lookup tables); otherwise a row count capped at ``max_rows + 1``
    (``limit(max_rows + 1).count()``): of a table that reads few rows, of an aggregate
    that runs it once, here.
    """
    if df.isLocal():
        return F.broadcast(df)
    est = _estimated_bytes(df)
    if est is not None and est <= STATS_BYTE_BOUND:
        return F.broadcast(df)
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def literal_lookup(df: DataFrame) -> DataFrame:
    """Broadcast a lookup built from literal rows (size known at build time)."""
    return F.broadcast(df)
