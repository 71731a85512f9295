import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ridepulse.schemas import RIDE_COLUMNS, RIDES  # noqa: E402
from ridepulse.session import checkpoint_dir, local_session  # noqa: E402
from ridepulse.sources.lookups import builtin_map, single_version_cities  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="ridepulse-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="run-")


def ride(**kw):
    """A ride row with sensible defaults; override any of the 43 fields."""
    base = {c: None for c in RIDE_COLUMNS}
    base.update({
        "ride_id": "r1", "passenger_id": "p1", "driver_id": "d1", "vehicle_id": "v1",
        "vehicle_type_id": 1, "vehicle_make_id": 1, "payment_method_id": 1, "ride_status_id": 1,
        "pickup_city_id": 1, "dropoff_city_id": 1, "cancellation_reason_id": 4,
        "passenger_name": "Pat", "driver_name": "Dee", "driver_rating": 4.5,
        "pickup_latitude": 40.5, "pickup_longitude": -74.0, "distance_miles": 3.0,
        "duration_minutes": 10, "booking_timestamp": datetime(2024, 1, 1, 12, 0, 0),
        "pickup_timestamp": "2024-01-01T12:03:00", "dropoff_timestamp": "2024-01-01T12:13:00",
        "base_fare": 2.5, "distance_fare": 5.25, "time_fare": 3.5, "surge_multiplier": 1.0,
        "subtotal": 11.25, "tip_amount": 0.0, "total_fare": 11.25, "rating": 5.0,
    })
    base.update(kw)
    return tuple(base[c] for c in RIDE_COLUMNS)


def rides_df(spark, rows):
    return spark.createDataFrame(rows, RIDES)


CITY_ROWS = [
    (1, "New York", "NY", "Northeast", "2026-01-26T12:12:00+00:00"),
    (2, "Los Angeles", "CA", "West", "2026-02-08T05:14:00+00:00"),
    (27, "Portland", "ME", "Northeast", "2026-01-02T05:30:00+00:00"),
    (45, "Portland", "OR", "West", "2026-01-10T00:00:00+00:00"),
]


def small_maps(spark, city_rows=CITY_ROWS):
    maps = {n: builtin_map(spark, n) for n in ["map_vehicle_makes", "map_vehicle_types",
                                               "map_ride_statuses", "map_payment_methods",
                                               "map_cancellation_reasons"]}
    maps["map_cities"] = single_version_cities(spark, city_rows)
    return maps
