"""Values the SQL oracle states for itself, so that a wrong value in the library shows up.

Nothing here is imported from the operators that it checks.
"""

# Lookup rows.
VEHICLE_TYPES = [
    (1, "UberX", "Standard", 2.5, 1.75, 0.35),
    (2, "UberXL", "Extra Large", 3.5, 2.25, 0.45),
    (3, "UberPOOL", "Shared Ride", 2.0, 1.5, 0.3),
    (4, "Uber Comfort", "Comfortable", 3.0, 2.0, 0.4),
    (5, "Uber Black", "Premium", 5.0, 3.5, 0.6),
]
VEHICLE_MAKES = [(1, "Toyota"), (2, "Honda"), (3, "Ford"), (4, "Chevrolet"), (5, "Nissan"), (6, "BMW"), (7, "Mercedes")]
PAYMENT_METHODS = [(1, "Credit Card", True, True), (2, "Debit Card", True, True),
                   (3, "Digital Wallet", False, False), (4, "Cash", False, False)]
RIDE_STATUSES = [(1, "Completed", True), (2, "Cancelled", False)]
CANCELLATION_REASONS = [(1, "Driver cancelled"), (2, "Passenger cancelled"), (3, "No show"), (4, None)]

# Gold layouts.
FACT = ["ride_id", "pickup_city_id", "payment_method_id", "driver_id", "passenger_id", "vehicle_id", "distance_miles",
        "duration_minutes", "base_fare", "distance_fare", "time_fare", "surge_multiplier", "total_fare", "tip_amount",
        "rating", "base_rate", "per_mile", "per_minute"]
BOOKING = ["ride_id", "confirmation_number", "dropoff_location_id", "ride_status_id", "dropoff_city_id",
           "cancellation_reason_id", "dropoff_address", "dropoff_latitude", "dropoff_longitude", "booking_timestamp",
           "dropoff_timestamp", "pickup_address", "pickup_latitude", "pickup_longitude", "pickup_location_id"]
LOCATION = ["pickup_city_id", "pickup_city", "city_updated_at", "region", "state"]
DIMENSIONS = {
    "dim_passenger": ("passenger_id", ["passenger_id", "passenger_name", "passenger_email", "passenger_phone"]),
    "dim_driver": ("driver_id", ["driver_id", "driver_name", "driver_rating", "driver_phone", "driver_license"]),
    "dim_vehicle": ("vehicle_id", ["vehicle_id", "vehicle_make_id", "vehicle_type_id", "vehicle_model", "vehicle_color",
                                   "license_plate", "vehicle_make", "vehicle_type"]),
    "dim_payment": ("payment_method_id", ["payment_method_id", "payment_method", "is_card", "requires_auth"]),
}

# The test city map's versions.
RENAMED_NATION, RENAMED_TO_NATION = 4, 3
SECOND_VERSION_NATIONS = (7, 11)
FIRST_VERSION_FROM, SECOND_VERSION_FROM = "1990-01-01 00:00:00", "1998-01-01 00:00:00"

# What a recent ride may show.
SHOWN = ["booking_timestamp", "vehicle_type", "pickup_city", "total_fare", "distance_miles", "duration_minutes",
         "surge_multiplier", "rating", "driver_rating"]

# Market archetypes (lower-case city) and signals (city).
ARCHETYPES = [
    ("new york", "dense urban commuter market"), ("chicago", "dense urban commuter market"),
    ("philadelphia", "dense urban commuter market"), ("las vegas", "tourism and event-driven market"),
    ("san diego", "coastal technology and leisure market"), ("san jose", "coastal technology and leisure market"),
    ("houston", "car-oriented growth market"), ("dallas", "car-oriented growth market"),
    ("san antonio", "car-oriented growth market"), ("phoenix", "car-oriented growth market"),
]
SIGNALS = [
    ("New York", "airport and commuter peaks | high late-night demand | weather-sensitive supply imbalance"),
    ("Las Vegas", "event calendar sensitivity | hotel and airport corridors | nightlife-driven peaks"),
    ("Chicago", "commuter peaks | winter weather sensitivity | airport corridor demand"),
    ("Houston", "sprawling trip distances | airport and energy-sector commute demand"),
    ("Phoenix", "longer distance trips | seasonal heat effects | airport and resort demand"),
    ("Philadelphia", "commuter and university demand | regional rail and airport corridors"),
    ("San Antonio", "tourism corridor demand | family and leisure trip mix"),
    ("San Diego", "coastal leisure demand | airport and event demand"),
    ("Dallas", "airport hub demand | business district commute peaks"),
    ("San Jose", "technology commute patterns | airport and regional business demand"),
]

# Foreign keys (ride column, lookup, lookup key).
KEYS = [
    ("vehicle_type_id", "map_vehicle_types", "vehicle_type_id"), ("vehicle_make_id", "map_vehicle_makes", "vehicle_make_id"),
    ("payment_method_id", "map_payment_methods", "payment_method_id"), ("ride_status_id", "map_ride_statuses", "ride_status_id"),
    ("pickup_city_id", "map_cities", "city_id"), ("dropoff_city_id", "map_cities", "city_id"),
    ("cancellation_reason_id", "map_cancellation_reasons", "cancellation_reason_id"),
]

# Category weights and measure bands of the ride model.  (City weights and boxes
# are long tables: they come from ``sources.markets``.)
WEIGHTS = {
    "vehicle_type_id": [(1, 45), (2, 20), (3, 20), (4, 10), (5, 5)],
    "payment_method_id": [(1, 38), (2, 28), (3, 25), (4, 9)],
    "vehicle_make_id": [(1, 28), (2, 22), (3, 18), (4, 14), (5, 10), (6, 5), (7, 3)],
}
BANDS = {
    "distance_miles": ([0.5, 2.0, 5.0, 10.0, 20.0, 40.0], [25, 40, 22, 10, 3]),
    "surge_multiplier": ([1.0, 1.1, 1.3, 1.6, 2.0, 2.5], [50, 28, 13, 6, 3]),
    "rating": ([1.0, 3.0, 4.0, 4.5, 5.0, 5.0], [2, 5, 18, 45, 30]),
}
