"""Curated, parameter-checked analytics.

Every operator validates its parameters (``ridepulse.functions.params``),
passes user text only as Column literals, returns aggregates without
passenger or driver names, and returns an empty DataFrame where the
reference returns a "no data" message.

Gold operators (A1-A6) read the star schema: the city filter is applied to
the tiny location dimension, which is then broadcast into the fact scan, so
the fact is never shuffled for the join.  Silver operators (A7, A8) read the
one-big-table, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridepulse.functions.dates import newest
from ridepulse.functions.joins import literal_lookup
from ridepulse.functions.numeric import avg2, avg_long, count_if, pct, rnd, sum2, sum_again, value
from ridepulse.functions.params import (
    validate_city,
    validate_city_list,
    validate_hour_range,
    validate_limit,
)
from ridepulse.operators.gold import Star
from ridepulse.operators.star import _by_city


def _fare0() -> Column:
    return F.coalesce(F.col("total_fare"), F.lit(0.0))


def _surge1() -> Column:
    return F.coalesce(F.col("surge_multiplier"), F.lit(1.0))


def _city_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_rides"),
        sum2(_fare0()).alias("total_revenue"),
        rnd(avg2(_fare0())).alias("avg_fare"),
        rnd(avg2(_surge1())).alias("avg_surge"),
        rnd(avg2(F.col("rating"))).alias("avg_rating"),
    ]


def _cities_matching(star: Star, names: list[str], location_mode: str) -> DataFrame:
    lowered = [n.lower() for n in names]
    # the lookup is marked for broadcast only if it is proven small
    loc = star.location_lookup(location_mode).select("pickup_city_id", "pickup_city")
    return loc.where(F.lower("pickup_city").isin(*lowered))


def revenue_by_city(star: Star, city: str, location_mode: str = "current") -> DataFrame:
    """A1: rides, revenue, average fare (NULL -> 0), surge (NULL -> 1) and rating
    for one city, matched case-insensitively."""
    city = validate_city(city)
    j = star.fact.join(_cities_matching(star, [city], location_mode), "pickup_city_id", "inner")
    return j.groupBy(F.col("pickup_city").alias("city")).agg(*_city_measures())


def top_cities_by_revenue(star: Star, limit: int = 10, location_mode: str = "current") -> DataFrame:
    """A2: cities ranked by revenue with a 1-based ``rank``.

    The fact is pre-aggregated per city id (exact integer partials) before
    meeting the location dimension; the rank window runs on <= 25 rows.
    """
    limit = validate_limit(limit)
    g = (_by_city(star, location_mode).where(F.col("pickup_city").isNotNull())
         .groupBy(F.col("pickup_city").alias("city")).agg(
             F.sum("n").alias("total_rides"),
             value(sum_again("fare0_h")).alias("total_revenue"),
             rnd(value(sum_again("fare0_h")) / F.sum("n")).alias("avg_fare"),
             rnd(value(sum_again("surge1_h")) / F.sum("n")).alias("avg_surge"),
             rnd(value(sum_again("rating_h")) / F.sum("rating_n")).alias("avg_rating")))
    order = [F.col("total_revenue").desc(), F.col("city").asc()]
    top = g.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")) \
        .select("rank", "city", "total_rides", "total_revenue", "avg_fare", "avg_surge", "avg_rating")


def surge_patterns(star: Star, hour_start: int = 0, hour_end: int = 23) -> DataFrame:
    """A3: rides, average / peak surge and revenue per booking hour in a range."""
    h0, h1 = validate_hour_range(hour_start, hour_end)
    fb = star.fact_with_booking(["surge_multiplier", "total_fare"], ["booking_timestamp"])
    hour = F.hour("booking_timestamp").cast("long")
    return (fb.where(F.col("booking_timestamp").isNotNull() & hour.between(h0, h1))
            .groupBy(hour.alias("booking_hour")).agg(
                F.count(F.lit(1)).alias("total_rides"),
                rnd(avg2(_surge1())).alias("avg_surge"),
                rnd(F.max(_surge1())).alias("peak_surge"),
                sum2(_fare0()).alias("total_revenue"))
            .orderBy("booking_hour"))


def city_surge_comparison(star: Star, cities: str, location_mode: str = "current") -> DataFrame:
    """A4: rides, average / peak surge and revenue for up to 10 cities, by average surge."""
    names = validate_city_list(cities)
    j = star.fact.join(_cities_matching(star, names, location_mode), "pickup_city_id", "inner")
    return (j.groupBy(F.col("pickup_city").alias("city")).agg(
        F.count(F.lit(1)).alias("total_rides"),
        rnd(avg2(_surge1())).alias("avg_surge"),
        rnd(F.max(_surge1())).alias("peak_surge"),
        sum2(_fare0()).alias("total_revenue"))
        .orderBy(F.col("avg_surge").desc(), F.col("city").asc()))


def demand_by_city(star: Star, city: str, location_mode: str = "current") -> DataFrame:
    """A5: demand and cancellations for one city (a NULL status counts as not cancelled)."""
    city = validate_city(city)
    fb = star.fact_with_booking(["pickup_city_id", "surge_multiplier"], ["ride_status_id"])
    j = fb.join(_cities_matching(star, [city], location_mode), "pickup_city_id", "inner")
    st = F.col("ride_status_id")
    return j.groupBy(F.col("pickup_city").alias("city")).agg(
        F.count(F.lit(1)).alias("total_rides"),
        count_if(st == 2).alias("cancelled_rides"),
        count_if((st != 2) | st.isNull()).alias("non_cancelled_rides"),
        pct(count_if(st == 2), F.count(F.lit(1))).alias("cancellation_rate"),
        rnd(avg2(_surge1())).alias("avg_surge"))


def kpi_dashboard(star: Star) -> DataFrame:
    """Platform KPIs with fare NULL -> 0 and surge NULL -> 1 before averaging."""
    fb = star.fact_with_booking(["total_fare", "surge_multiplier", "rating", "distance_miles"],
                                ["ride_status_id"])
    return fb.agg(
        F.count(F.lit(1)).alias("total_rides"),
        sum2(_fare0()).alias("total_revenue"),
        rnd(avg2(_fare0())).alias("avg_fare"),
        rnd(avg2(_surge1())).alias("avg_surge"),
        rnd(avg2(F.col("rating"))).alias("avg_rating"),
        rnd(avg2(F.col("distance_miles"))).alias("avg_distance"),
        pct(count_if(F.col("ride_status_id") == 2), F.count(F.lit(1))).alias("cancellation_rate"))


# ---------------------------------------------------------------- silver (OBT)

def rides_of_city(obt: DataFrame, city: str) -> DataFrame:
    """Rides picked up in a city by (case-insensitive) name."""
    return obt.where(F.lower("pickup_city") == F.lit(validate_city(city).lower()))


def silver_city_overview(obt: DataFrame, city: str) -> DataFrame:
    """Per (city, state, region) of the matching name; every group is returned."""
    return rides_of_city(obt, city).groupBy(
        F.col("pickup_city").alias("city"), "state", "region").agg(
        F.count(F.lit(1)).alias("total_rides"),
        sum2(_fare0()).alias("total_revenue"),
        rnd(avg2(F.coalesce(F.col("distance_miles"), F.lit(0.0)))).alias("avg_distance_miles"),
        rnd(avg_long(F.coalesce(F.col("duration_minutes"), F.lit(0).cast("long"))))
        .alias("avg_duration_minutes"),
        rnd(avg2(_surge1())).alias("avg_surge"),
        rnd(avg2(F.col("rating"))).alias("avg_rating"),
        rnd(avg2(F.col("driver_rating"))).alias("avg_driver_rating"))


def silver_vehicle_mix(obt: DataFrame, city: str, limit: int = 8) -> DataFrame:
    """Vehicle types of a city: rides, average fare and surge; top 8 by rides."""
    return (rides_of_city(obt, city).where(F.col("vehicle_type").isNotNull())
            .groupBy("vehicle_type").agg(
                F.count(F.lit(1)).alias("rides"),
                rnd(avg2(_fare0())).alias("avg_fare"),
                rnd(avg2(_surge1())).alias("avg_surge"))
            .orderBy(F.col("rides").desc(), F.col("vehicle_type").asc()).limit(limit))


def silver_payment_mix(obt: DataFrame, city: str, limit: int = 8) -> DataFrame:
    """Payment methods of a city, top 8 by rides."""
    return (rides_of_city(obt, city).where(F.col("payment_method").isNotNull())
            .groupBy("payment_method").agg(F.count(F.lit(1)).alias("rides"))
            .orderBy(F.col("rides").desc(), F.col("payment_method").asc()).limit(limit))


def silver_status_mix(obt: DataFrame, city: str, limit: int = 8) -> DataFrame:
    """A7d: status x cancellation reason of a city (NULLs as 'Unknown' / 'None'), top 8."""
    st = F.coalesce(F.col("ride_status"), F.lit("Unknown"))
    rs = F.coalesce(F.col("cancellation_reason"), F.lit("None"))
    return (rides_of_city(obt, city).groupBy(st.alias("ride_status"), rs.alias("cancellation_reason"))
            .agg(F.count(F.lit(1)).alias("rides"))
            .orderBy(F.col("rides").desc(), F.col("ride_status").asc(),
                     F.col("cancellation_reason").asc()).limit(limit))


SIGNAL_COLUMNS = ["booking_timestamp", "pickup_city", "state", "region", "vehicle_type",
                  "ride_status", "cancellation_reason", "total_fare", "distance_miles",
                  "duration_minutes", "surge_multiplier", "rating"]


def recent_signals(obt: DataFrame, limit: int = 10) -> DataFrame:
    """Newest rides as 12 PII-free columns (ties on time break on ride id)."""
    limit = validate_limit(limit)
    top = (newest(obt, limit).where(F.col("booking_timestamp").isNotNull())
           .orderBy(F.col("booking_timestamp").desc(), F.col("ride_id").asc()).limit(limit))
    return top.select(
        "booking_timestamp", "pickup_city", "state", "region", "vehicle_type", "ride_status",
        "cancellation_reason",
        rnd(_fare0()).alias("total_fare"),
        rnd(F.coalesce(F.col("distance_miles"), F.lit(0.0))).alias("distance_miles"),
        "duration_minutes",
        rnd(_surge1()).alias("surge_multiplier"),
        "rating")


# ---------------------------------------------------------------- A11 context

# Market archetypes by city name.
ARCHETYPES = [
    ("new york", "dense urban commuter market"),
    ("chicago", "dense urban commuter market"),
    ("philadelphia", "dense urban commuter market"),
    ("las vegas", "tourism and event-driven market"),
    ("san diego", "coastal technology and leisure market"),
    ("san jose", "coastal technology and leisure market"),
    ("houston", "car-oriented growth market"),
    ("dallas", "car-oriented growth market"),
    ("san antonio", "car-oriented growth market"),
    ("phoenix", "car-oriented growth market"),
]

# Market signals by city name.
SIGNALS = [
    ("New York", ["airport and commuter peaks", "high late-night demand",
                  "weather-sensitive supply imbalance"]),
    ("Las Vegas", ["event calendar sensitivity", "hotel and airport corridors",
                   "nightlife-driven peaks"]),
    ("Chicago", ["commuter peaks", "winter weather sensitivity", "airport corridor demand"]),
    ("Houston", ["sprawling trip distances", "airport and energy-sector commute demand"]),
    ("Phoenix", ["longer distance trips", "seasonal heat effects", "airport and resort demand"]),
    ("Philadelphia", ["commuter and university demand", "regional rail and airport corridors"]),
    ("San Antonio", ["tourism corridor demand", "family and leisure trip mix"]),
    ("San Diego", ["coastal leisure demand", "airport and event demand"]),
    ("Dallas", ["airport hub demand", "business district commute peaks"]),
    ("San Jose", ["technology commute patterns", "airport and regional business demand"]),
]


def market_context_all(spark, cities: DataFrame) -> DataFrame:
    """A11 for every city of the (current) city map in one job.

    Archetype: by lower-cased name, else ``<region> regional market``.
    Signals: by exact name, else ``[<region> demand patterns, local event
    and commute sensitivity]`` (``general`` / ``regional`` when the region is
    NULL).  Both tables are literal and broadcast.
    """
    arch = literal_lookup(spark.createDataFrame(ARCHETYPES, "a_city string, market_archetype string"))
    sig = literal_lookup(spark.createDataFrame(SIGNALS, "s_city string, context_signals array<string>"))
    region = F.col("region")
    out = (cities.join(arch, F.lower(F.col("city")) == F.col("a_city"), "left")
           .join(sig, F.col("city") == F.col("s_city"), "left"))
    return out.select(
        "city", "state", "region",
        F.coalesce(F.col("market_archetype"),
                   F.concat(F.coalesce(region, F.lit("general")), F.lit(" regional market")))
        .alias("market_archetype"),
        F.coalesce(F.col("context_signals"),
                   F.array(F.concat(F.coalesce(region, F.lit("regional")), F.lit(" demand patterns")),
                           F.lit("local event and commute sensitivity")))
        .alias("context_signals"))


def market_context(spark, cities: DataFrame, city: str) -> DataFrame:
    """Lookup context of one city name (case-insensitive).

    Every city with that name is returned (both Portlands), not just the first
    one in file order; an unknown name gives an empty DataFrame.
    """
    city = validate_city(city)
    return market_context_all(spark, cities).where(
        F.lower("city") == F.lit(city.lower()))
