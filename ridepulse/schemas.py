"""Schemas and column lists of the ride lakehouse.

Every ride-shaped DataFrame in the library carries the 43-field ``RIDES``
schema; the enriched wide table (OBT) adds 15 looked-up columns; gold tables
are projections of the OBT.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S, L, D, T, B = StringType(), LongType(), DoubleType(), TimestampType(), BooleanType()

# The ride event layout, field by field, in event order.
RIDE_FIELDS = [
    ("ride_id", S), ("confirmation_number", S), ("passenger_id", S), ("driver_id", S),
    ("vehicle_id", S), ("pickup_location_id", S), ("dropoff_location_id", S),
    ("vehicle_type_id", L), ("vehicle_make_id", L), ("payment_method_id", L),
    ("ride_status_id", L), ("pickup_city_id", L), ("dropoff_city_id", L),
    ("cancellation_reason_id", L), ("passenger_name", S), ("passenger_email", S),
    ("passenger_phone", S), ("driver_name", S), ("driver_rating", D), ("driver_phone", S),
    ("driver_license", S), ("vehicle_model", S), ("vehicle_color", S), ("license_plate", S),
    ("pickup_address", S), ("pickup_latitude", D), ("pickup_longitude", D),
    ("dropoff_address", S), ("dropoff_latitude", D), ("dropoff_longitude", D),
    ("distance_miles", D), ("duration_minutes", L), ("booking_timestamp", T),
    ("pickup_timestamp", S), ("dropoff_timestamp", S), ("base_fare", D), ("distance_fare", D),
    ("time_fare", D), ("surge_multiplier", D), ("subtotal", D), ("tip_amount", D),
    ("total_fare", D), ("rating", D),
]

RIDES = StructType([StructField(n, t, True) for n, t in RIDE_FIELDS])
RIDE_COLUMNS = [n for n, _ in RIDE_FIELDS]

# Lookup ("map") tables.
MAP_SCHEMAS = {
    "map_vehicle_makes": StructType([
        StructField("vehicle_make_id", L), StructField("vehicle_make", S)]),
    "map_vehicle_types": StructType([
        StructField("vehicle_type_id", L), StructField("vehicle_type", S),
        StructField("description", S), StructField("base_rate", D),
        StructField("per_mile", D), StructField("per_minute", D)]),
    "map_ride_statuses": StructType([
        StructField("ride_status_id", L), StructField("ride_status", S),
        StructField("is_completed", B)]),
    "map_payment_methods": StructType([
        StructField("payment_method_id", L), StructField("payment_method", S),
        StructField("is_card", B), StructField("requires_auth", B)]),
    "map_cities": StructType([
        StructField("city_id", L), StructField("city", S), StructField("state", S),
        StructField("region", S), StructField("updated_at", T)]),
    "map_cancellation_reasons": StructType([
        StructField("cancellation_reason_id", L), StructField("cancellation_reason", S)]),
}

# Columns the enrichment adds, in OBT order (lookup, [(source column, output name)]).
OBT_LOOKUP_COLUMNS = [
    ("map_vehicle_makes", [("vehicle_make", "vehicle_make")]),
    ("map_vehicle_types", [("vehicle_type", "vehicle_type"), ("description", "description"),
                           ("base_rate", "base_rate"), ("per_mile", "per_mile"),
                           ("per_minute", "per_minute")]),
    ("map_ride_statuses", [("ride_status", "ride_status")]),
    ("map_payment_methods", [("payment_method", "payment_method"), ("is_card", "is_card"),
                             ("requires_auth", "requires_auth")]),
    ("map_cities", [("city", "pickup_city"), ("state", "state"), ("region", "region"),
                    ("updated_at", "city_updated_at")]),
    ("map_cancellation_reasons", [("cancellation_reason", "cancellation_reason")]),
]
OBT_COLUMNS = RIDE_COLUMNS + [out for _, cols in OBT_LOOKUP_COLUMNS for _, out in cols]

# Gold table layouts.
DIM_COLUMNS = {
    "dim_passenger": ["passenger_id", "passenger_name", "passenger_email", "passenger_phone"],
    "dim_driver": ["driver_id", "driver_name", "driver_rating", "driver_phone", "driver_license"],
    "dim_vehicle": ["vehicle_id", "vehicle_make_id", "vehicle_type_id", "vehicle_model",
                    "vehicle_color", "license_plate", "vehicle_make", "vehicle_type"],
    "dim_payment": ["payment_method_id", "payment_method", "is_card", "requires_auth"],
    "dim_booking": ["ride_id", "confirmation_number", "dropoff_location_id", "ride_status_id",
                    "dropoff_city_id", "cancellation_reason_id", "dropoff_address",
                    "dropoff_latitude", "dropoff_longitude", "booking_timestamp",
                    "dropoff_timestamp", "pickup_address", "pickup_latitude",
                    "pickup_longitude", "pickup_location_id"],
    "dim_location": ["pickup_city_id", "pickup_city", "city_updated_at", "region", "state"],
}
DIM_KEYS = {
    "dim_passenger": ["passenger_id"],
    "dim_driver": ["driver_id"],
    "dim_vehicle": ["vehicle_id"],
    "dim_payment": ["payment_method_id"],
    "dim_booking": ["ride_id"],
    "dim_location": ["pickup_city_id", "city_updated_at"],
}
FACT_COLUMNS = ["ride_id", "pickup_city_id", "payment_method_id", "driver_id", "passenger_id",
                "vehicle_id", "distance_miles", "duration_minutes", "base_fare",
                "distance_fare", "time_fare", "surge_multiplier", "total_fare", "tip_amount",
                "rating", "base_rate", "per_mile", "per_minute"]

# SCD-2 bookkeeping columns.
START_AT, END_AT = "__START_AT", "__END_AT"
