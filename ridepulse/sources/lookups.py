"""Lookup ("map") tables: loaders and the fixed small maps (S3).

Lookups are tiny dimension tables (a handful of rows).  They are the only
inputs the library broadcasts unconditionally, because their size is bounded
by construction (see ``ridepulse.functions.joins.small_lookup``).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridepulse.schemas import MAP_SCHEMAS

# Lookup rows that ride events reference by id.
VEHICLE_TYPES = [
    (1, "UberX", "Standard", 2.5, 1.75, 0.35),
    (2, "UberXL", "Extra Large", 3.5, 2.25, 0.45),
    (3, "UberPOOL", "Shared Ride", 2.0, 1.5, 0.3),
    (4, "Uber Comfort", "Comfortable", 3.0, 2.0, 0.4),
    (5, "Uber Black", "Premium", 5.0, 3.5, 0.6),
]
VEHICLE_MAKES = [
    (1, "Toyota"), (2, "Honda"), (3, "Ford"), (4, "Chevrolet"),
    (5, "Nissan"), (6, "BMW"), (7, "Mercedes"),
]
PAYMENT_METHODS = [
    (1, "Credit Card", True, True),
    (2, "Debit Card", True, True),
    (3, "Digital Wallet", False, False),
    (4, "Cash", False, False),
]
RIDE_STATUSES = [(1, "Completed", True), (2, "Cancelled", False)]
CANCELLATION_REASONS = [
    (1, "Driver cancelled"), (2, "Passenger cancelled"), (3, "No show"), (4, None),
]

BUILTIN_ROWS = {
    "map_vehicle_types": VEHICLE_TYPES,
    "map_vehicle_makes": VEHICLE_MAKES,
    "map_payment_methods": PAYMENT_METHODS,
    "map_ride_statuses": RIDE_STATUSES,
    "map_cancellation_reasons": CANCELLATION_REASONS,
}

MAP_NAMES = ["map_vehicle_makes", "map_vehicle_types", "map_ride_statuses",
             "map_payment_methods", "map_cities", "map_cancellation_reasons"]


def builtin_map(spark: SparkSession, name: str) -> DataFrame:
    """One of the fixed small lookups as a local DataFrame."""
    return spark.createDataFrame(BUILTIN_ROWS[name], MAP_SCHEMAS[name])


def load_map(spark: SparkSession, name: str, path: str) -> DataFrame:
    """S3: read a JSON array-of-objects lookup file with its explicit schema.

    ``updated_at`` in the city map is an ISO string with a zone offset; the
    schema makes Spark parse it to a timestamp.
    """
    return (spark.read.schema(MAP_SCHEMAS[name])
            .option("multiLine", True)
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")
            .json(path))


def single_version_cities(spark: SparkSession, rows) -> DataFrame:
    """A city map from (city_id, city, state, region, updated_at-iso) tuples."""
    def ts(v):
        if v is None or isinstance(v, datetime):
            return v
        return datetime.fromisoformat(v).astimezone(timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(a, b, c, d, ts(e)) for a, b, c, d, e in rows],
                                 MAP_SCHEMAS["map_cities"])


def current_cities(cities: DataFrame) -> DataFrame:
    """The latest version of each city of a (possibly versioned) city map.

    The map is small (cities x versions); the aggregate keeps it that way.
    """
    latest = (cities.groupBy("city_id")
              .agg(F.max_by(F.struct("city", "state", "region", "updated_at"),
                            "updated_at").alias("v")))
    return latest.select("city_id", "v.city", "v.state", "v.region", "v.updated_at")
