"""Ride-invariant checks as data-quality jobs.

Each check returns the violating rows (``*_violations``) and/or a summary with
one row per rule: ``(rule, checked, violations)``.  Summaries are single-scan
jobs: every rule becomes a pair of conditional counts in one aggregate (or a
one-pass ``explode`` of the measures), so adding rules adds no scans and no
shuffles beyond one tiny partial aggregate.  They run unchanged on a
streaming DataFrame inside ``foreachBatch``; pipeline updates count them on the way (``observe``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridepulse.functions.joins import literal_lookup, small_lookup
from ridepulse.functions.numeric import hundredths, rnd
from ridepulse.sources.markets import CITY_WEIGHTS


def counters(rules: dict[str, tuple[Column, Column]]) -> list[Column]:
    """Two aggregates per rule, ``<rule>__c`` (rows checked) and ``<rule>__v`` (rows violating): for ``agg``, and for
    ``observe`` inside a write or a stream, where they cost no scan."""
    aggs = []
    for name, (checked, bad) in rules.items():
        aggs.append(F.sum(F.when(checked, 1).otherwise(0)).cast("long").alias(f"{name}__c"))
        aggs.append(F.sum(F.when(checked & bad, 1).otherwise(0)).cast("long").alias(f"{name}__v"))
    return aggs


def _summary(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One aggregate over ``df``: per rule, rows checked and rows violating."""
    aggs = counters(rules)
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"{n}__c"), F.lit(0)).alias("checked"),
                     F.coalesce(F.col(f"{n}__v"), F.lit(0)).alias("violations")) for n in rules]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _violations(df: DataFrame, rules: dict[str, tuple[Column, Column]], key: str = "ride_id") -> DataFrame:
    flags = F.filter(F.array(*[F.when(c & b, F.lit(n)) for n, (c, b) in rules.items()]),
                     lambda x: x.isNotNull())
    return df.withColumn("failed_rules", flags).where(F.size("failed_rules") > 0)


# ------------------------------------------------------------------ G1 fares

def _all_not_null(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def _cents_off(actual: Column, expected: Column) -> Column:
    """More than one cent apart (tolerance 0.01), compared in integer hundredths."""
    return F.abs(hundredths(actual) - hundredths(expected)) > 1


def fare_rules(rides: DataFrame | None = None) -> dict[str, tuple[Column, Column]]:
    """Rules of the fare arithmetic; rates are ``base_rate/per_mile/per_minute``
    columns on the rows (the OBT carries the vehicle type's rates)."""
    c = F.col
    exp_dist = rnd(c("distance_miles") * c("per_mile"), 2)
    exp_time = rnd(c("duration_minutes").cast("double") * c("per_minute"), 2)
    exp_sub = rnd((c("base_fare") + c("distance_fare") + c("time_fare")) * c("surge_multiplier"), 2)
    exp_total = rnd(c("subtotal") + F.coalesce(c("tip_amount"), F.lit(0.0)), 2)
    nn = _all_not_null
    return {
        "base_fare": (nn("base_fare", "base_rate"), _cents_off(c("base_fare"), c("base_rate"))),
        "distance_fare": (nn("distance_fare", "distance_miles", "per_mile"),
                          _cents_off(c("distance_fare"), exp_dist)),
        "time_fare": (nn("time_fare", "duration_minutes", "per_minute"),
                      _cents_off(c("time_fare"), exp_time)),
        "subtotal": (nn("subtotal", "base_fare", "distance_fare", "time_fare", "surge_multiplier"),
                     _cents_off(c("subtotal"), exp_sub)),
        "total_fare": (nn("total_fare", "subtotal"), _cents_off(c("total_fare"), exp_total)),
    }


def with_rates(rides: DataFrame, rates: DataFrame) -> DataFrame:
    """Attach a rate table (vehicle_type_id, base_rate, per_mile, per_minute)."""
    r = small_lookup(rates.select("vehicle_type_id", "base_rate", "per_mile", "per_minute"))
    return rides.drop("base_rate", "per_mile", "per_minute").join(r, "vehicle_type_id", "left")


def fare_audit(rides: DataFrame) -> DataFrame:
    """G1 summary."""
    return _summary(rides, fare_rules(rides))


def fare_violations(rides: DataFrame) -> DataFrame:
    """G1 rows."""
    return _violations(rides, fare_rules(rides))


# ------------------------------------------------------------------ G2 coordinates

def boxes_by_rule(cities: DataFrame, lat0: float = 20.0, lon0: float = -100.0,
                  size: float = 0.5) -> DataFrame:
    """City boxes for the test binding: city n covers [lat0+n, lat0+n+size] x
    [lon0-n, lon0-n+size].  ``markets.city_boxes`` has the ride model's own boxes."""
    cid = F.col("city_id").cast("double")
    return cities.select("city_id").distinct().select(
        "city_id",
        (F.lit(lat0) + cid).alias("lat_min"), (F.lit(lat0) + cid + F.lit(size)).alias("lat_max"),
        (F.lit(lon0) - cid).alias("lon_min"), (F.lit(lon0) - cid + F.lit(size)).alias("lon_max"))


def _in_box(lat: Column, lon: Column, p: str) -> Column:
    return (lat.between(F.col(f"{p}lat_min"), F.col(f"{p}lat_max"))
            & lon.between(F.col(f"{p}lon_min"), F.col(f"{p}lon_max")))


def _with_boxes(rides: DataFrame, boxes: DataFrame) -> DataFrame:
    b = small_lookup(boxes)
    pb = b.select(F.col("city_id").alias("__pcid"), *[F.col(c).alias(f"p_{c}") for c in
                                                       ["lat_min", "lat_max", "lon_min", "lon_max"]])
    db = b.select(F.col("city_id").alias("__dcid"), *[F.col(c).alias(f"d_{c}") for c in
                                                       ["lat_min", "lat_max", "lon_min", "lon_max"]])
    return (rides.join(pb, F.col("pickup_city_id") == F.col("__pcid"), "left")
            .join(db, F.col("dropoff_city_id") == F.col("__dcid"), "left"))


def coordinate_rules() -> dict[str, tuple[Column, Column]]:
    plat, plon = F.col("pickup_latitude"), F.col("pickup_longitude")
    dlat, dlon = F.col("dropoff_latitude"), F.col("dropoff_longitude")
    return {
        "pickup_in_city_box": (F.col("__pcid").isNotNull(),
                               plat.isNull() | plon.isNull() | ~_in_box(plat, plon, "p_")),
        "dropoff_in_city_box": (F.col("__dcid").isNotNull(),
                                dlat.isNull() | dlon.isNull() | ~_in_box(dlat, dlon, "d_")),
        "pickup_valid_range": (F.lit(True), plat.isNull() | plon.isNull()
                               | ~plat.between(-90, 90) | ~plon.between(-180, 180)),
    }


def coordinate_check(rides: DataFrame, boxes: DataFrame) -> DataFrame:
    """G2 summary: pickup and dropoff inside the box of their city."""
    return _summary(_with_boxes(rides, boxes), coordinate_rules())


def coordinate_violations(rides: DataFrame, boxes: DataFrame) -> DataFrame:
    return _violations(_with_boxes(rides, boxes), coordinate_rules()) \
        .drop("__pcid", "__dcid", *[f"{p}_{c}" for p in "pd"
                                    for c in ["lat_min", "lat_max", "lon_min", "lon_max"]])


def locate_city(points: DataFrame, boxes: DataFrame, lat: str = "pickup_latitude",
                lon: str = "pickup_longitude", cell_deg: float = 1.0) -> DataFrame:
    """G2 reverse lookup: every city whose box contains the point (NULL: none).

    A range join done as an equi-join: boxes are cut into grid cells
    (``cell_deg`` degrees; a box covers a few cells), points get their cell,
    the broadcast cell table is joined on the cell and filtered by the box.
    No nested-loop join, and the work per point is the number of boxes in
    its cell.
    """
    cell = float(cell_deg)
    cells = (boxes.select(
        "city_id", "lat_min", "lat_max", "lon_min", "lon_max",
        F.explode(F.sequence(F.floor(F.col("lat_min") / cell), F.floor(F.col("lat_max") / cell)))
        .alias("__clat"))
        .select("*", F.explode(F.sequence(F.floor(F.col("lon_min") / cell),
                                          F.floor(F.col("lon_max") / cell))).alias("__clon")))
    cells = small_lookup(cells.select(F.col("city_id").alias("located_city_id"),
                                      "lat_min", "lat_max", "lon_min", "lon_max", "__clat", "__clon"))
    p = points.withColumn("__plat", F.floor(F.col(lat) / cell)) \
        .withColumn("__plon", F.floor(F.col(lon) / cell))
    cond = ((F.col("__plat") == F.col("__clat")) & (F.col("__plon") == F.col("__clon"))
            & F.col(lat).between(F.col("lat_min"), F.col("lat_max"))
            & F.col(lon).between(F.col("lon_min"), F.col("lon_max")))
    return p.join(cells, cond, "left").drop("__plat", "__plon", "__clat", "__clon",
                                             "lat_min", "lat_max", "lon_min", "lon_max")


# ------------------------------------------------------------------ G3 time order

def time_rules() -> dict[str, tuple[Column, Column]]:
    book = F.col("booking_timestamp")
    pick = F.try_to_timestamp(F.col("pickup_timestamp"))
    drop = F.try_to_timestamp(F.col("dropoff_timestamp"))
    lead = F.unix_seconds(pick) - F.unix_seconds(book)
    trip = F.unix_seconds(drop) - F.unix_seconds(pick)
    dur = F.col("duration_minutes")
    return {
        "booking_1_to_5_min_before_pickup": (book.isNotNull() & pick.isNotNull(),
                                             (lead < 60) | (lead > 300)),
        "dropoff_is_pickup_plus_duration": (pick.isNotNull() & drop.isNotNull() & dur.isNotNull(),
                                            trip != dur * 60),
        "duration_at_least_4_min": (dur.isNotNull(), dur < 4),
        "timestamps_parse": (F.col("pickup_timestamp").isNotNull() | F.col("dropoff_timestamp").isNotNull(),
                             (F.col("pickup_timestamp").isNotNull() & pick.isNull())
                             | (F.col("dropoff_timestamp").isNotNull() & drop.isNull())),
    }


def time_order_check(rides: DataFrame) -> DataFrame:
    """G3 summary."""
    return _summary(rides, time_rules())


def time_order_violations(rides: DataFrame) -> DataFrame:
    return _violations(rides, time_rules())


# ------------------------------------------------------------------ G4 status

def status_rules() -> dict[str, tuple[Column, Column]]:
    st, rs, rt = F.col("ride_status_id"), F.col("cancellation_reason_id"), F.col("rating")
    cancelled, completed = st == 2, st == 1
    return {
        "status_known": (F.lit(True), st.isNull() | ~st.isin(1, 2)),
        "cancelled_has_reason_1_to_3": (cancelled, rs.isNull() | ~rs.isin(1, 2, 3)),
        "cancelled_has_no_rating": (cancelled, rt.isNotNull()),
        "completed_has_reason_4": (completed, rs.isNull() | (rs != 4)),
        "completed_has_rating": (completed, rt.isNull()),
    }


def status_check(rides: DataFrame) -> DataFrame:
    """G4 summary."""
    return _summary(rides, status_rules())


def status_violations(rides: DataFrame) -> DataFrame:
    return _violations(rides, status_rules())


# ------------------------------------------------------------------ G5 keys

FOREIGN_KEYS = [  # (ride column, lookup name, lookup key)
    ("vehicle_type_id", "map_vehicle_types", "vehicle_type_id"),
    ("vehicle_make_id", "map_vehicle_makes", "vehicle_make_id"),
    ("payment_method_id", "map_payment_methods", "payment_method_id"),
    ("ride_status_id", "map_ride_statuses", "ride_status_id"),
    ("pickup_city_id", "map_cities", "city_id"),
    ("dropoff_city_id", "map_cities", "city_id"),
    ("cancellation_reason_id", "map_cancellation_reasons", "cancellation_reason_id"),
]


def _flag_keys(rides: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    out = rides
    for col, name, key in FOREIGN_KEYS:
        keys = small_lookup(maps[name].select(F.col(key).alias(f"__k_{col}")).distinct()
                            .withColumn(f"__f_{col}", F.lit(True)))
        out = out.join(keys, F.col(col) == F.col(f"__k_{col}"), "left").drop(f"__k_{col}")
    return out


def key_rules() -> dict[str, tuple[Column, Column]]:
    return {col: (F.col(col).isNotNull(), F.col(f"__f_{col}").isNull()) for col, _, _ in FOREIGN_KEYS}


def key_integrity(rides: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """G5 summary: per foreign key, non-NULL values checked and values without a lookup row.

    One scan: seven broadcast lookups flag the row, one aggregate counts.
    """
    return _summary(_flag_keys(rides, maps), key_rules())


def key_violations(rides: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    out = _violations(_flag_keys(rides, maps), key_rules())
    return out.drop(*[f"__f_{c}" for c, _, _ in FOREIGN_KEYS])


# ------------------------------------------------------------------ G6 shares

# The generator's category weights.
EXPECTED_WEIGHTS = {
    "vehicle_type_id": [(1, 45), (2, 20), (3, 20), (4, 10), (5, 5)],
    "payment_method_id": [(1, 38), (2, 28), (3, 25), (4, 9)],
    "vehicle_make_id": [(1, 28), (2, 22), (3, 18), (4, 14), (5, 10), (6, 5), (7, 3)],
    "pickup_city_id": CITY_WEIGHTS,
}


def share_drift(spark: SparkSession, rides: DataFrame,
                weights: dict[str, list[tuple[int, float]]] | None = None) -> DataFrame:
    """Observed vs expected share per category id, for each weighted column.

    One scan: each ride is exploded into one (dimension, id) pair per
    column, counted in one partial aggregate; shares are computed on the
    small result and full-outer-joined with the expected weights, so unseen
    categories and unexpected ids both appear.
    """
    weights = weights or EXPECTED_WEIGHTS
    dims = list(weights)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"),
                                         F.col(d).cast("long").alias("category_id")) for d in dims]))
    obs = (rides.select(pairs.alias("p")).select("p.*")
           .groupBy("dimension", "category_id").agg(F.count(F.lit(1)).alias("observed_rides")))
    w = Window.partitionBy("dimension")
    obs = obs.withColumn("observed_share", F.col("observed_rides") / F.sum("observed_rides").over(w))
    exp_rows = [(d, int(i), float(v)) for d in dims for i, v in weights[d]]
    exp = spark.createDataFrame(exp_rows, "dimension string, category_id long, weight double")
    exp = exp.withColumn("expected_share", F.col("weight") / F.sum("weight").over(w)).drop("weight")
    j = obs.join(literal_lookup(exp), ["dimension", "category_id"], "full")
    return j.select(
        "dimension", "category_id",
        F.coalesce("observed_rides", F.lit(0).cast("long")).alias("observed_rides"),
        F.coalesce("observed_share", F.lit(0.0)).alias("observed_share"),
        F.coalesce("expected_share", F.lit(0.0)).alias("expected_share"),
        (F.coalesce("observed_share", F.lit(0.0)) - F.coalesce("expected_share", F.lit(0.0)))
        .alias("drift"))


# ------------------------------------------------------------------ G7 bands

# The generator's measure bands (lower edges + top edge) and weights.
BANDS = {
    "distance_miles": ([0.5, 2.0, 5.0, 10.0, 20.0, 40.0], [25, 40, 22, 10, 3]),
    "surge_multiplier": ([1.0, 1.1, 1.3, 1.6, 2.0, 2.5], [50, 28, 13, 6, 3]),
    "rating": ([1.0, 3.0, 4.0, 4.5, 5.0, 5.0], [2, 5, 18, 45, 30]),
}


def _band_index(v: Column, edges: list[float]) -> Column:
    """0-based band of ``v``: [e_i, e_i+1), the last band closed; -1 outside."""
    expr = F.when(v.isNull(), F.lit(None))
    last = len(edges) - 2
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (v >= lo) & ((v <= hi) if i == last else (v < hi))
        expr = expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(-1))


def band_histograms(spark: SparkSession, rides: DataFrame,
                    bands: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """Observed count and share per band vs the expected band weights.

    Band -1 collects values outside every band; NULL measures are skipped.
    """
    bands = bands or BANDS
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"),
                                         _band_index(F.col(m), e).alias("band")) for m, (e, _) in bands.items()]))
    obs = (rides.select(pairs.alias("p")).select("p.*").where(F.col("band").isNotNull())
           .groupBy("measure", "band").agg(F.count(F.lit(1)).alias("observed_rides")))
    w = Window.partitionBy("measure")
    obs = obs.withColumn("observed_share", F.col("observed_rides") / F.sum("observed_rides").over(w))
    rows = []
    for m, (edges, weights) in bands.items():
        total = float(sum(weights))
        for i, wt in enumerate(weights):
            rows.append((m, i, float(edges[i]), float(edges[i + 1]), wt / total))
    exp = spark.createDataFrame(rows, "measure string, band int, band_lo double, band_hi double, "
                                      "expected_share double")
    j = obs.join(literal_lookup(exp), ["measure", "band"], "full")
    return j.select(
        "measure", F.col("band").cast("long").alias("band"), "band_lo", "band_hi",
        F.coalesce("observed_rides", F.lit(0).cast("long")).alias("observed_rides"),
        F.coalesce("observed_share", F.lit(0.0)).alias("observed_share"),
        F.coalesce("expected_share", F.lit(0.0)).alias("expected_share"))
