"""T7 with A9 / A10 on a stream: trailing-window features per city by a watermarked sliding window.

A window of ``window_hours`` that ends at time t holds the rides of [t - window_hours, t): what the forecasts
take with ``as_of=t``.  It closes, and its row is emitted once, when the watermark (latest booking time less
``delay``) has passed its end; a ride that comes later than that is dropped and counted in the
query's progress.  State is one row per open window and city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridepulse.functions.params import validate_horizon
from ridepulse.operators.forecast import _demand, _features, _pressure
from ridepulse.operators.silver import with_event_time


def city_windows(rides: DataFrame, window_hours: int = 6, slide_hours: int = 1, delay: str = "3 minutes") -> DataFrame:
    """(as_of, pickup_city_id, features...) of every closed window that has rides."""
    timed = with_event_time(rides.where(F.col("pickup_city_id").isNotNull()), delay)
    w = F.window("booking_timestamp", f"{int(window_hours)} hours", f"{int(slide_hours)} hours")
    return timed.groupBy(w.alias("w"), "pickup_city_id").agg(*_features(window_hours)).select(
        F.col("w.end").alias("as_of"), "pickup_city_id", "rides_last_6h", "avg_rides_per_hour", "avg_surge_last_6h", "peak_surge_last_6h",
        "cancellation_rate_last_6h")


def demand_windows(rides: DataFrame, horizon_hours: int = 1, **options) -> DataFrame:
    """A9 for every closed window and city with rides."""
    return _demand(city_windows(rides, **options), validate_horizon(horizon_hours))


def pressure_windows(rides: DataFrame, **options) -> DataFrame:
    """A10 for every closed window and city with rides."""
    return _pressure(city_windows(rides, **options))


def late_rows(query: StreamingQuery) -> int:
    """Rows (one per ride and window) that came after their window had closed, over the batches of this run."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
