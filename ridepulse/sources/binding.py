"""Binding of the shared test tables to ride events.

The driver's test data is a TPC-H-like order schema.  The ride grain is the
**order**: one order is one ride, its line items give the ride's driver
(supplier), vehicle (part), distance and surge, its customer is the
passenger, and the customer's nation is the pickup city.  Every value is a
deterministic integer expression of the keys, so the SQL oracle can build the
identical rides table (``ridepulse.plans.oracle``).

Money is computed in integer cents and divided by 100 once, so fares are
exact two-decimal values; the fare parts follow the vehicle type's rates
(the generator's rule), with a few rides deliberately off by 7 cents, some
NULL fares, tips and coordinates, unknown type / make / payment ids, invalid
and out-of-box coordinates: the cases the operators and checks must handle.

City map: one row per nation (region = the nation's region), valid from
1990-01-01; nation 4 is renamed to the name of nation 3 (two cities, one
name); nations 7 and 11 get a second version from 1998-01-01 (renamed
``<name> METRO``), so the location dimension has real SCD-2 history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridepulse.schemas import RIDE_COLUMNS, RIDES
from ridepulse.sources.lookups import builtin_map

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _cents(c: Column) -> Column:
    return F.floor(c * F.lit(100.0) + F.lit(0.5))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def line_summary(lineitem: DataFrame) -> DataFrame:
    """Per order: driver, vehicle, total quantity and max discount (one aggregate)."""
    return (lineitem.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("drv"),
        F.min("l_partkey").alias("veh"),
        F.sum("l_quantity").cast("long").alias("qty"),
        F.max(F.floor(F.col("l_discount") * F.lit(100.0) + F.lit(0.5))).alias("disc")))


def rides_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 43-column ride table bound from orders, lineitem, customer, supplier, part."""
    # Orders are hash-partitioned on the order key: at scale this is the exchange the
    # join with the line-item summary needs anyway (same key, same partition count),
    # and on small inputs it spreads a one-file table over all cores.
    o = read_table(spark, sf_dir, "orders").repartition("o_orderkey")
    li = line_summary(read_table(spark, sf_dir, "lineitem"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rates = F.broadcast(builtin_map(spark, "map_vehicle_types").select(
        F.col("vehicle_type_id").alias("rt_id"),
        _cents(F.col("base_rate")).alias("base_c"),
        _cents(F.col("per_mile")).alias("mile_c"),
        _cents(F.col("per_minute")).alias("min_c")))

    b = (o.join(li, o.o_orderkey == li.l_orderkey, "left")
         .join(c, o.o_custkey == c.c_custkey, "left")
         .join(s, F.col("drv") == s.s_suppkey, "left")
         .join(p, F.col("veh") == p.p_partkey, "left")
         .withColumn("k", F.col("o_orderkey"))
         .withColumn("vtype", F.lit(1) + F.col("p_size") % 6)
         .join(rates, F.col("vtype") == F.col("rt_id"), "left"))

    k = F.col("k")
    dist_h = F.col("qty") * 10 + k % 10                      # hundredths of a mile
    dur = F.lit(4) + k % 60
    surge_pct = F.lit(100) + F.col("disc") * 10              # 100 .. 200
    dfare_c = F.floor((dist_h * F.col("mile_c") + 50) / F.lit(100.0))
    tfare_c = dur * F.col("min_c")
    sub_c = F.floor(((F.col("base_c") + dfare_c + tfare_c) * surge_pct + 50) / F.lit(100.0))
    tip_c = (F.when(k % 29 == 0, F.lit(None))
             .when(k % 2 == 0, F.lit(0))
             .otherwise((k * 37) % 1200))
    total_c = (sub_c + F.coalesce(tip_c, F.lit(0))
               + F.when(k % 41 == 0, F.lit(7)).otherwise(F.lit(0)))
    cancelled = F.col("o_orderstatus") == "P"
    n_pick, n_drop = F.col("c_nationkey"), F.col("s_nationkey")
    booking = (F.col("o_orderdate")
               + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 7919) % 86400)
               ).cast("timestamp")
    pickup = booking + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1) + k % 5, F.lit(0))
    dropoff = pickup + F.make_dt_interval(F.lit(0), F.lit(0), dur, F.lit(0))

    cols = {
        "ride_id": _s(k),
        "confirmation_number": F.concat(F.lit("CN"), _s(k)),
        "passenger_id": _s("o_custkey"),
        "driver_id": _s("drv"),
        "vehicle_id": _s("veh"),
        "pickup_location_id": F.concat(F.lit("PL"), _s(k)),
        "dropoff_location_id": F.concat(F.lit("DL"), _s(k)),
        "vehicle_type_id": F.col("vtype").cast("long"),
        "vehicle_make_id": (F.lit(1) + F.col("veh") % 8).cast("long"),
        "payment_method_id": (F.lit(1) + k % 5).cast("long"),
        "ride_status_id": F.when(cancelled, F.lit(2)).otherwise(F.lit(1)).cast("long"),
        "pickup_city_id": n_pick.cast("long"),
        "dropoff_city_id": n_drop.cast("long"),
        "cancellation_reason_id": F.when(cancelled, F.lit(1) + k % 3)
                                   .otherwise(F.lit(4)).cast("long"),
        "passenger_name": F.col("c_name"),
        "passenger_email": F.concat(F.lit("c"), _s("o_custkey"), F.lit("@example.com")),
        "passenger_phone": F.concat(F.lit("555-"), _s("o_custkey")),
        "driver_name": F.col("s_name"),
        "driver_rating": _d(F.lit(420) + F.col("drv") % 81) / F.lit(100.0),
        "driver_phone": F.concat(F.lit("556-"), _s("drv")),
        "driver_license": F.concat(F.lit("LIC"), _s("drv")),
        "vehicle_model": F.col("p_name"),
        "vehicle_color": (F.when(F.col("veh") % 3 == 0, F.lit("Black"))
                          .when(F.col("veh") % 3 == 1, F.lit("White"))
                          .when(F.col("veh").isNotNull(), F.lit("Silver"))),
        "license_plate": F.concat(F.lit("PLT"), _s("veh")),
        "pickup_address": F.concat(_s(F.lit(100) + k % 900), F.lit(" Pickup Rd")),
        "pickup_latitude": (F.when(k % 97 == 0, F.lit(91.0))
                            .when(k % 89 == 0, F.lit(None).cast("double"))
                            .when(k % 83 == 0, _d(F.lit(20) + n_pick) + F.lit(0.75))
                            .otherwise(_d(F.lit(20) + n_pick) + _d(k % 500) / F.lit(1000.0))),
        "pickup_longitude": (F.when(k % 101 == 0, F.lit(-181.0))
                             .otherwise(_d(F.lit(-100) - n_pick)
                                        + _d((k * 7) % 500) / F.lit(1000.0))),
        "dropoff_address": F.concat(_s(F.lit(100) + (k * 3) % 900), F.lit(" Dropoff Ave")),
        "dropoff_latitude": _d(F.lit(20) + n_drop) + _d((k * 3) % 500) / F.lit(1000.0),
        "dropoff_longitude": _d(F.lit(-100) - n_drop) + _d((k * 11) % 500) / F.lit(1000.0),
        "distance_miles": _d(dist_h) / F.lit(100.0),
        "duration_minutes": dur.cast("long"),
        "booking_timestamp": booking,
        "pickup_timestamp": _iso(pickup),
        "dropoff_timestamp": _iso(dropoff),
        "base_fare": _d(F.col("base_c")) / F.lit(100.0),
        "distance_fare": _d(dfare_c) / F.lit(100.0),
        "time_fare": _d(tfare_c) / F.lit(100.0),
        "surge_multiplier": _d(surge_pct) / F.lit(100.0),
        "subtotal": _d(sub_c) / F.lit(100.0),
        "tip_amount": _d(tip_c) / F.lit(100.0),
        "total_fare": F.when(k % 53 == 0, F.lit(None).cast("double"))
                       .otherwise(_d(total_c) / F.lit(100.0)),
        "rating": F.when(cancelled, F.lit(None).cast("double"))
                   .otherwise(_d(F.lit(10) + k % 41) / F.lit(10.0)),
    }
    out = b.select(*[cols[n].cast(RIDES[n].dataType).alias(n) for n in RIDE_COLUMNS])
    return out


# The test city map's versioning rule.
RENAMED_NATION, RENAMED_TO_NATION = 4, 3
SECOND_VERSION_NATIONS = (7, 11)
FIRST_VERSION_FROM = "1990-01-01 00:00:00"
SECOND_VERSION_FROM = "1998-01-01 00:00:00"


def cities_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned city map (city_id, city, state, region, updated_at) from nation x region."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    nr = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "inner")
    renamed = F.when(F.col("n_nationkey") == RENAMED_NATION,
                     F.lit(f"NATION_{RENAMED_TO_NATION}")).otherwise(F.col("n_name"))
    state = F.concat(F.lit("ST"), _s("n_nationkey"))
    v1 = nr.select(F.col("n_nationkey").cast("long").alias("city_id"), renamed.alias("city"),
                   state.alias("state"), F.col("r_name").alias("region"),
                   F.lit(FIRST_VERSION_FROM).cast("timestamp").alias("updated_at"))
    v2 = (nr.where(F.col("n_nationkey").isin(*SECOND_VERSION_NATIONS))
          .select(F.col("n_nationkey").cast("long").alias("city_id"),
                  F.concat(F.col("n_name"), F.lit(" METRO")).alias("city"),
                  state.alias("state"), F.col("r_name").alias("region"),
                  F.lit(SECOND_VERSION_FROM).cast("timestamp").alias("updated_at")))
    return v1.unionByName(v2)


def maps_from_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All six lookups: five fixed maps plus the city map derived from the tables."""
    maps = {name: builtin_map(spark, name) for name in
            ["map_vehicle_makes", "map_vehicle_types", "map_ride_statuses",
             "map_payment_methods", "map_cancellation_reasons"]}
    maps["map_cities"] = cities_from_tables(spark, sf_dir)
    return maps
