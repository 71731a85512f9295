"""Dashboard queries over the star schema (Q1-Q9).

Plan shape
----------
Facts are ride-sized; dimensions are ride-sized (booking, passenger, driver,
vehicle) or tiny (payment, location).  Grouped queries therefore
**aggregate the fact on its foreign key first** (partial aggregation
map-side, one shuffle of at most one row per key per task) and join the
dimension to that small result, then re-aggregate by the dimension's
label.  Counts and sums of millionths are exact integers, so the
two-level aggregate equals the row-level one bit for bit.  The live feed picks its rows
first and then reads their dimension rows by id, so no ride-sized dimension is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridepulse.functions.joins import small_lookup
from ridepulse.functions.numeric import count_if, exact_sum, exact_sum_long, micros, pct, rnd, sum_again, value
from ridepulse.functions.params import validate_limit
from ridepulse.operators.gold import Star
from ridepulse.sources.lookups import current_cities


def _measures() -> dict:
    """Measures that every report of the dashboard snapshot is made of."""
    fare0 = F.coalesce("total_fare", F.lit(0.0))
    surge1 = F.coalesce("surge_multiplier", F.lit(1.0))
    return {
        "n": F.count(F.lit(1)), "fare_h": exact_sum("total_fare"), "fare_n": _nn("total_fare"), "fare0_h": exact_sum(fare0),
        "tip0_h": exact_sum(F.coalesce("tip_amount", F.lit(0.0))), "surge_h": exact_sum("surge_multiplier"),
        "surge_n": _nn("surge_multiplier"), "surge1_h": exact_sum(surge1), "surge1_max": F.max(surge1),
        "rating_h": exact_sum("rating"), "rating_n": _nn("rating"), "miles_h": exact_sum("distance_miles"),
        "miles_n": _nn("distance_miles"), "cancelled": count_if(F.col("ride_status_id") == 2)}


SUMMARY_KEYS = ["pickup_city_id", "payment_method_id", "surge_bucket", "vehicle_id", "driver_id"]


def summaries(star: Star) -> DataFrame:
    """All measures over all rides and per city, payment method, surge bucket, vehicle and driver, in one scan.

    ``by`` names the key of a row's group (NULL: all rides).
    """
    fb = star.fact_with_booking(["pickup_city_id", "payment_method_id", "vehicle_id", "driver_id", "total_fare", "tip_amount",
                                 "surge_multiplier", "rating", "distance_miles"], ["ride_status_id"])
    fb = fb.withColumn("surge_bucket", rnd("surge_multiplier", 1))
    by = F.lit(None).cast("string")
    for k in SUMMARY_KEYS:
        by = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(by)
    return fb.groupingSets([[]] + [[F.col(k)] for k in SUMMARY_KEYS], *[F.col(k) for k in SUMMARY_KEYS]).agg(
        by.alias("by"), *[c.alias(n) for n, c in _measures().items()])


def _partial(fact: DataFrame, key: str, measures: dict) -> DataFrame:
    """Fact aggregated on ``key``: ``measures`` maps name -> aggregate Column."""
    return fact.groupBy(key).agg(*[c.alias(n) for n, c in measures.items()])


def _nn(c):
    return F.count(F.col(c) if isinstance(c, str) else c)


def _mean(total: str, n: str):
    return value(total) / F.nullif(F.col(n), F.lit(0))


def kpis(star: Star, pre: DataFrame | None = None) -> DataFrame:
    """Q1: platform KPIs; averages skip NULLs, cancellation % over all rides.

    ``pre`` (here and below): the rows of ``summaries`` for this report.
    """
    if pre is None:
        fb = star.fact_with_booking(["total_fare", "tip_amount", "surge_multiplier", "rating", "distance_miles"], ["ride_status_id"])
        pre = fb.agg(*[c.alias(n) for n, c in _measures().items()])
    return pre.select(
        F.col("n").alias("total_rides"), value("fare_h").alias("total_revenue"),
        rnd(_mean("fare_h", "fare_n")).alias("avg_fare"), rnd(_mean("surge_h", "surge_n")).alias("avg_surge"),
        rnd(_mean("rating_h", "rating_n")).alias("avg_rating"), rnd(_mean("miles_h", "miles_n")).alias("avg_distance"),
        pct(F.col("cancelled"), F.nullif(F.col("n"), F.lit(0))).alias("cancellation_rate"))


FEED_COLUMNS = ["ride_id", "booking_timestamp", "passenger_name", "driver_name",
                "driver_rating", "vehicle_type", "pickup_city", "total_fare",
                "distance_miles", "duration_minutes", "surge_multiplier", "rating"]


def live_feed(star: Star, limit: int = 10, location_mode: str = "current") -> DataFrame:
    """Q2: newest rides with names and labels (12 columns), newest first, ties by ``ride_id``.

    The top-k of fact x booking opens the newest months only.  Its at most ``MAX_LIMIT`` rows are broadcast
    against the ride-sized dimensions, whose few matching rows are then broadcast back: no dimension is
    shuffled, and nothing runs before the result is asked for.
    """
    limit = validate_limit(limit)
    fb = star.fact_with_booking(["passenger_id", "driver_id", "vehicle_id", "pickup_city_id",
                                 "total_fare", "distance_miles", "duration_minutes",
                                 "surge_multiplier", "rating"], ["booking_timestamp"], newest_rows=limit)
    top = fb.orderBy(F.col("booking_timestamp").desc_nulls_last(), F.col("ride_id").asc_nulls_last()).limit(limit)

    def wanted(dim: DataFrame, key: str, *columns: str) -> DataFrame:
        rows = dim.select(key, *columns).join(F.broadcast(top.select(key)), key, "left_semi")
        return F.broadcast(rows)  # one row per id, at most MAX_LIMIT ids

    out = (top.join(wanted(star.dim_passenger, "passenger_id", "passenger_name"), "passenger_id", "left")
           .join(wanted(star.dim_driver, "driver_id", "driver_name", "driver_rating"), "driver_id", "left")
           .join(wanted(star.dim_vehicle, "vehicle_id", "vehicle_type"), "vehicle_id", "left")
           .join(star.location_lookup(location_mode).select("pickup_city_id", "pickup_city"), "pickup_city_id", "left"))
    return out.select(*FEED_COLUMNS).orderBy(F.col("booking_timestamp").desc_nulls_last(), F.col("ride_id").asc_nulls_last())


def _by_city(star: Star, location_mode: str) -> DataFrame:
    """Fact pre-aggregated per pickup city id, joined to the (tiny) location dim."""
    pre = _partial(star.fact, "pickup_city_id", {
        "n": F.count(F.lit(1)),
        "fare_h": exact_sum("total_fare"),
        "fare_n": _nn("total_fare"),
        "fare0_h": exact_sum(F.coalesce("total_fare", F.lit(0.0))),
        "surge1_h": exact_sum(F.coalesce("surge_multiplier", F.lit(1.0))),
        "surge1_max": F.max(F.coalesce("surge_multiplier", F.lit(1.0))),
        "rating_h": exact_sum("rating"),
        "rating_n": _nn("rating"),
    })
    return pre.join(star.location_lookup(location_mode), "pickup_city_id", "left")


def rides_by_city(star: Star, limit: int = 10, location_mode: str = "current",
                  by_city: DataFrame | None = None) -> DataFrame:
    """Q3: rides and revenue per pickup city name; top ``limit`` by rides.

    ``by_city`` lets several reports share one per-city pre-aggregation.
    """
    pre = by_city if by_city is not None else _by_city(star, location_mode)
    g = pre.groupBy(F.col("pickup_city").alias("city")).agg(
        F.sum("n").alias("total_rides"),
        value(sum_again("fare_h")).alias("total_revenue"))
    return g.orderBy(F.col("total_rides").desc(), F.col("city").asc_nulls_first()).limit(limit)


def rides_by_vehicle_type(star: Star, pre: DataFrame | None = None) -> DataFrame:
    """Q4: rides and average fare per vehicle type (NULL type is a group)."""
    pre = pre if pre is not None else _partial(star.fact, "vehicle_id", {
        "n": F.count(F.lit(1)), "fare_h": exact_sum("total_fare"), "fare_n": _nn("total_fare")})
    j = pre.join(star.dim_vehicle.select("vehicle_id", "vehicle_type"), "vehicle_id", "left")
    return (j.groupBy("vehicle_type").agg(
        F.sum("n").alias("total_rides"),
        rnd(value(sum_again("fare_h")) / F.sum("fare_n")).alias("avg_fare"))
        .orderBy(F.col("total_rides").desc(), F.col("vehicle_type").asc_nulls_first()))


def rides_by_payment(star: Star, pre: DataFrame | None = None) -> DataFrame:
    """Q5: rides per payment method."""
    pre = pre if pre is not None else _partial(star.fact, "payment_method_id", {"n": F.count(F.lit(1))})
    pm = small_lookup(star.dim_payment.select("payment_method_id", "payment_method"))
    j = pre.join(pm, "payment_method_id", "left")
    return (j.groupBy("payment_method").agg(F.sum("n").alias("total_rides"))
            .orderBy(F.col("total_rides").desc(), F.col("payment_method").asc_nulls_first()))


def surge_distribution(star: Star, pre: DataFrame | None = None) -> DataFrame:
    """Q6: ride count per surge bucket (one decimal), NULL surge dropped."""
    if pre is None:
        pre = _partial(star.fact.withColumn("surge_bucket", rnd("surge_multiplier", 1)), "surge_bucket", {"n": F.count(F.lit(1))})
    return (pre.where(F.col("surge_bucket").isNotNull())
            .select("surge_bucket", F.col("n").alias("ride_count")).orderBy("surge_bucket"))


def top_drivers(star: Star, limit: int = 5, pre: DataFrame | None = None) -> DataFrame:
    """Q7: leaderboard by driver *name* (homonyms merge), NULL names dropped."""
    pre = pre if pre is not None else _partial(star.fact, "driver_id", {
        "n": F.count(F.lit(1)),
        "fare0_h": exact_sum(F.coalesce("total_fare", F.lit(0.0))),
        "tip0_h": exact_sum(F.coalesce("tip_amount", F.lit(0.0)))})
    d = star.dim_driver.where(F.col("driver_name").isNotNull()) \
        .select("driver_id", "driver_name", "driver_rating")
    j = pre.join(d, "driver_id", "inner")
    g = j.groupBy("driver_name").agg(
        rnd(value(exact_sum_long(micros("driver_rating") * F.col("n")))
            / F.sum(F.when(F.col("driver_rating").isNotNull(), F.col("n")))).alias("driver_rating"),
        F.sum("n").alias("total_rides"),
        value(sum_again("fare0_h")).alias("total_revenue"),
        rnd(value(sum_again("tip0_h")) / F.sum("n")).alias("avg_tip"))
    return g.orderBy(F.col("total_rides").desc(), F.col("driver_name").asc()).limit(limit)


def revenue_by_region(star: Star, cities: DataFrame, join_on: str = "id",
                      location_mode: str = "current", by_city: DataFrame | None = None) -> DataFrame:
    """Q8: rides and revenue per region, NULL region dropped.

    ``join_on="id"`` (default) resolves the region by city id;
    ``join_on="name"`` joins the city *name* back to the city map (the
    literal behaviour: a name shared by two cities counts their rides in
    both regions).  ``cities`` is the current city map.
    """
    g = by_city if by_city is not None else _by_city(star, location_mode)
    mc = small_lookup(current_cities(cities) if "updated_at" in cities.columns else cities)
    if join_on == "id":
        j = g.join(mc.select(F.col("city_id").alias("pickup_city_id"), "region")
                   .withColumnRenamed("region", "mc_region"), "pickup_city_id", "left")
    elif join_on == "name":
        j = g.join(mc.select(F.col("city").alias("pickup_city"),
                             F.col("region").alias("mc_region")), "pickup_city", "left")
    else:
        raise ValueError(f"join_on must be 'id' or 'name', not {join_on!r}")
    return (j.where(F.col("mc_region").isNotNull())
            .groupBy(F.col("mc_region").alias("region"))
            .agg(F.sum("n").alias("total_rides"),
                 value(sum_again("fare0_h")).alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc(), F.col("region").asc()))


def pickup_locations(star: Star, limit: int = 200) -> DataFrame:
    """Q9: valid pickup coordinates with address and fare, ``limit`` rows by ride id."""
    j = star.fact_with_booking(["total_fare"], ["pickup_latitude", "pickup_longitude",
                                                "pickup_address"]) \
        .where(F.col("pickup_latitude").isNotNull() & F.col("pickup_longitude").isNotNull()
               & F.col("pickup_latitude").between(-90, 90)
               & F.col("pickup_longitude").between(-180, 180))
    return (j.orderBy("ride_id").limit(limit)
            .select("pickup_latitude", "pickup_longitude", "pickup_address", "total_fare"))
