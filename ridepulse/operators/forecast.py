"""Heuristic forecasts over a trailing window of silver rides.

Both come in a one-city form (the tool) and an all-cities form (A9b/A10b):
one job that aggregates the window once per city and left-joins the result
to the city map, so cities without rides still get a row.  ``as_of``
defaults to ``current_timestamp()``; the window is ``[as_of - window_hours, as_of)``,
open at the end when ``as_of`` is not given.  Feature column names keep the 6-hour wording of the tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridepulse.functions.joins import small_lookup
from ridepulse.functions.numeric import avg2, count_if, pct, rnd
from ridepulse.functions.dates import booked_from, booked_until
from ridepulse.functions.params import validate_city, validate_horizon
from ridepulse.operators.curated import rides_of_city

# Pressure score weights and band limits.
SURGE_WEIGHT, PEAK_WEIGHT, CANCEL_WEIGHT = 55.0, 25.0, 0.2
HIGH_BAND, MEDIUM_BAND = 45.0, 20.0


def _as_of(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def _window(obt: DataFrame, as_of, window_hours: int) -> DataFrame:
    """Rides booked in the window; without ``as_of`` there is no upper bound (a clock that runs
    ahead of the cluster's does not lose a ride)."""
    end = _as_of(as_of)
    start = end - F.make_dt_interval(F.lit(0), F.lit(int(window_hours)), F.lit(0), F.lit(0))
    out = booked_from(obt, start).where(F.col("booking_timestamp") >= start)
    return out if as_of is None else booked_until(out, end).where(F.col("booking_timestamp") < end)


def _surge1() -> Column:
    return F.coalesce(F.col("surge_multiplier"), F.lit(1.0))


def _features(window_hours: int) -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("rides_last_6h"),
        rnd(n / F.lit(float(window_hours))).alias("avg_rides_per_hour"),
        rnd(avg2(_surge1())).alias("avg_surge_last_6h"),
        rnd(F.max(_surge1())).alias("peak_surge_last_6h"),
        pct(count_if(F.col("ride_status_id") == 2), F.greatest(n, F.lit(1))).alias("cancellation_rate_last_6h"),
    ]


def _demand(df: DataFrame, horizon: int) -> DataFrame:
    per_hour = F.coalesce(F.col("avg_rides_per_hour"), F.lit(0.0))
    return (df.withColumn("horizon_hours", F.lit(horizon).cast("long"))
            .withColumn("predicted_rides", rnd(per_hour * F.lit(float(horizon)), 1))
            .withColumn("confidence", F.when(per_hour == 0, F.lit("low")).otherwise(F.lit("medium"))))


def _pressure(df: DataFrame) -> DataFrame:
    def falsy(c):  # the tool treats NULL and 0 alike ("x or default")
        return F.col(c).isNull() | (F.col(c) == 0)
    avg = F.when(falsy("avg_surge_last_6h"), F.lit(1.0)).otherwise(F.col("avg_surge_last_6h"))
    peak = F.when(falsy("peak_surge_last_6h"), avg).otherwise(F.col("peak_surge_last_6h"))
    cancel = F.when(falsy("cancellation_rate_last_6h"), F.lit(0.0)) \
        .otherwise(F.col("cancellation_rate_last_6h"))
    score = rnd((avg - F.lit(1.0)) * F.lit(SURGE_WEIGHT) + (peak - F.lit(1.0)) * F.lit(PEAK_WEIGHT)
                + cancel * F.lit(CANCEL_WEIGHT), 1)
    return (df.withColumn("pressure_score", score)
            .withColumn("pressure_band",
                        F.when(F.col("pressure_score") >= HIGH_BAND, F.lit("high"))
                        .when(F.col("pressure_score") >= MEDIUM_BAND, F.lit("medium"))
                        .otherwise(F.lit("low"))))


def _one_city(obt: DataFrame, city: str, as_of, window_hours: int) -> DataFrame:
    w = rides_of_city(_window(obt, as_of, window_hours), city)
    return w.agg(*_features(window_hours)).withColumn("city", F.lit(city))


def predict_city_demand(obt: DataFrame, city: str, horizon_hours: int = 1, as_of=None,
                        window_hours: int = 6) -> DataFrame:
    """Trailing rides per hour x horizon; confidence low when the rate is 0."""
    city, h = validate_city(city), validate_horizon(horizon_hours)
    out = _demand(_one_city(obt, city, as_of, window_hours), h)
    return out.select("city", "horizon_hours", "rides_last_6h", "avg_rides_per_hour",
                      "avg_surge_last_6h", "cancellation_rate_last_6h", "predicted_rides",
                      "confidence")


def predict_surge_pressure(obt: DataFrame, city: str, as_of=None, window_hours: int = 6) -> DataFrame:
    """A10: weighted score of surge, peak surge and cancellations, banded."""
    city = validate_city(city)
    out = _pressure(_one_city(obt, city, as_of, window_hours))
    return out.select("city", "rides_last_6h", "avg_surge_last_6h", "peak_surge_last_6h",
                      "cancellation_rate_last_6h", "pressure_score", "pressure_band")


def _all_cities(obt: DataFrame, cities: DataFrame, as_of, window_hours: int) -> DataFrame:
    """Window features per city id, left-joined from the (small) current city map."""
    agg = (_window(obt, as_of, window_hours).where(F.col("pickup_city_id").isNotNull())
           .groupBy("pickup_city_id").agg(*_features(window_hours)))
    c = small_lookup(cities.select(F.col("city_id").alias("pickup_city_id"), "city"))
    j = c.join(agg, "pickup_city_id", "left")
    return j.withColumn("rides_last_6h", F.coalesce(F.col("rides_last_6h"), F.lit(0).cast("long"))) \
        .withColumn("avg_rides_per_hour", F.coalesce(F.col("avg_rides_per_hour"), F.lit(0.0))) \
        .withColumn("cancellation_rate_last_6h",
                    F.coalesce(F.col("cancellation_rate_last_6h"), F.lit(0.0)))


def predict_demand_all_cities(obt: DataFrame, cities: DataFrame, horizon_hours: int = 1,
                              as_of=None, window_hours: int = 6) -> DataFrame:
    """A9 for every city of the map in one job (cities without rides: 0, low)."""
    h = validate_horizon(horizon_hours)
    out = _demand(_all_cities(obt, cities, as_of, window_hours), h)
    return out.select(F.col("pickup_city_id").alias("city_id"), "city", "horizon_hours",
                      "rides_last_6h", "avg_rides_per_hour", "avg_surge_last_6h",
                      "cancellation_rate_last_6h", "predicted_rides", "confidence")


def predict_pressure_all_cities(obt: DataFrame, cities: DataFrame, as_of=None,
                                window_hours: int = 6) -> DataFrame:
    """A10 for every city of the map in one job."""
    out = _pressure(_all_cities(obt, cities, as_of, window_hours))
    return out.select(F.col("pickup_city_id").alias("city_id"), "city", "rides_last_6h",
                      "avg_surge_last_6h", "peak_surge_last_6h", "cancellation_rate_last_6h",
                      "pressure_score", "pressure_band")


_BOUND_DEMAND = """
SELECT :city AS city, :horizon AS horizon_hours, COUNT(*) AS rides,
  floor(COUNT(*) / CAST(:hours AS DOUBLE) * CAST(:horizon AS DOUBLE) * 10 + 0.5D) / 10D AS predicted_rides
FROM {rides}
WHERE lower(pickup_city) = lower(:city) AND booking_timestamp < CAST(:end AS TIMESTAMP)
  AND booking_timestamp >= CAST(:end AS TIMESTAMP) - make_dt_interval(0, :hours)"""


def bound_city_demand(obt: DataFrame, city: str, horizon_hours, as_of, window_hours: int = 6) -> DataFrame:
    """A9's rate as a fixed SQL text with named parameter markers (V6): values are bound, never pasted, so no city name
    can change the statement.  The guards (V1, V5) reject bad values first."""
    args = {"city": validate_city(city), "horizon": validate_horizon(horizon_hours), "hours": int(window_hours), "end": str(as_of)}
    out = obt.sparkSession.sql(_BOUND_DEMAND, args=args, rides=obt)
    return out.select("city", F.col("horizon_hours").cast("long").alias("horizon_hours"), "rides", "predicted_rides")
