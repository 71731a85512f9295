"""Shaping, PII and presentation data.

All shaping runs on query *results* (bounded: top-k or small group sets), so
the windows without a partition key here see a handful of rows; the one
operator that reads rides (P9) is a plain grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DecimalType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from ridepulse.functions.numeric import rnd, sum2

# Columns a recent-ride row may carry into an assistant context.
ALLOWED_RIDE_COLUMNS = ["booking_timestamp", "vehicle_type", "pickup_city", "total_fare",
                        "distance_miles", "duration_minutes", "surge_multiplier", "rating",
                        "driver_rating"]
# Columns that identify people; dropped from every snapshot slice.
NAME_COLUMNS = ["passenger_name", "driver_name", "passenger_email", "passenger_phone",
                "driver_phone", "driver_license"]
# Snapshot slices and their row bounds.
SNAPSHOT_LIMITS = {"kpis": 1, "rides_by_city": 25, "rides_by_vehicle_type": 15,
                   "rides_by_payment_method": 15, "surge_distribution": 20,
                   "revenue_by_region": 15, "top_drivers": 15, "recent_rides": 25}


def sanitize(df: DataFrame, allowed: list[str] = ALLOWED_RIDE_COLUMNS) -> DataFrame:
    """Keep only allow-listed columns that are present (order of the allow-list)."""
    return df.select(*[c for c in allowed if c in df.columns])


def drop_names(df: DataFrame) -> DataFrame:
    """Remove personal-name/contact columns wherever they occur."""
    return df.drop(*[c for c in NAME_COLUMNS if c in df.columns])


def iso_text(c: Column) -> Column:
    """Timestamp -> ISO-8601 text like Python's ``isoformat()`` (fraction only when non-zero)."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(
        F.unix_micros(c.cast("timestamp")) % 1_000_000 == 0, whole).otherwise(frac)


def _clean(c: Column, dtype) -> Column:
    if isinstance(dtype, DecimalType):
        return c.cast("double")
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return iso_text(c)
    if isinstance(dtype, DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, ArrayType):
        return F.transform(c, lambda x: _clean(x, dtype.elementType))
    return c


def clean_values(df: DataFrame) -> DataFrame:
    """Decimals -> double, timestamps/dates -> ISO text, recursively in arrays."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _fmt(c: Column, pattern: str, n: int | None) -> Column:
    v = rnd(c, n) if n is not None else c
    return F.when(c.isNull(), F.lit("-")).otherwise(F.format_string(pattern, v))


# Display labels of the feed.
FEED_RENAMES = {"booking_timestamp": "Time", "passenger_name": "Passenger", "driver_name": "Driver",
                "driver_rating": "Driver Rating", "vehicle_type": "Vehicle", "pickup_city": "City",
                "distance_miles": "Dist", "duration_minutes": "Min", "surge_multiplier": "Surge",
                "total_fare": "Fare", "rating": "Rating"}


def format_feed(feed: DataFrame) -> DataFrame:
    """The live feed as display text; NULL -> '-', ``ride_id`` dropped, columns renamed.

    Values are rounded half-up before formatting so every engine prints the
    same digits.
    """
    cols = []
    for c in feed.columns:
        x = F.col(c)
        if c == "ride_id":
            continue
        if c == "booking_timestamp":
            x = F.date_format(x, "MM/dd HH:mm")
        elif c in ("rating", "driver_rating"):
            x = _fmt(x, "%.2f", 2)
        elif c == "total_fare":
            x = _fmt(x, "$%.2f", 2)
        elif c == "surge_multiplier":
            x = _fmt(x, "%.2fx", 2)
        elif c == "distance_miles":
            x = _fmt(x, "%.1fmi", 1)
        elif c == "duration_minutes":
            x = _fmt(x.cast("long"), "%dmin", None)
        cols.append(x.alias(FEED_RENAMES.get(c, c)))
    return feed.select(*cols)


def leaderboard(drivers: DataFrame) -> DataFrame:
    """P5: driver leaderboard with a ``#n`` rank (rides desc, name asc) and display names."""
    w = Window.orderBy(F.col("total_rides").desc(), F.col("driver_name").asc())
    return drivers.select(
        F.concat(F.lit("#"), F.row_number().over(w).cast("string")).alias("Rank"),
        F.col("driver_name").alias("Driver"), F.col("driver_rating").alias("Rating"),
        F.col("total_rides").alias("Rides"), F.col("total_revenue").alias("Revenue ($)"),
        F.col("avg_tip").alias("Avg Tip ($)"))


def compact_number(c: Column) -> Column:
    """1.2M / 3.4K / integer / one decimal; text that is not a number stays text."""
    v = c.try_cast("double")
    a = F.abs(v)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(v.isNull(), c.cast("string"))
            .when(a >= 1_000_000, F.format_string("%.1fM", rnd(v / F.lit(1_000_000.0), 1)))
            .when(a >= 1_000, F.format_string("%.1fK", rnd(v / F.lit(1_000.0), 1)))
            .when(v == F.floor(v), F.format_string("%d", v.cast("long")))
            .otherwise(F.format_string("%.1f", rnd(v, 1))))


KPI_FIELDS = ["total_rides", "total_revenue", "avg_fare", "avg_surge", "avg_rating",
              "avg_distance", "cancellation_rate"]


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """Card values: NULL -> 0; rides and revenue truncated to integers."""
    cols = []
    for c in KPI_FIELDS:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        cols.append((v.cast("long") if c in ("total_rides", "total_revenue") else v).alias(c))
    return kpis.select(*cols)


def with_share(agg: DataFrame, value: str, share: str = "share") -> DataFrame:
    """Each row's fraction of the column total (pie percentages)."""
    return agg.withColumn(share, F.col(value) / F.sum(value).over(Window.partitionBy()))


def pickup_density(star_or_rides: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """Pickups per lat/lon grid cell (valid coordinates only) with revenue.

    Replaces a client-side heat map of a 200-row sample with a distributed
    aggregate over all rides.
    """
    lat, lon = F.col("pickup_latitude"), F.col("pickup_longitude")
    ok = lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
    cell = F.lit(float(cell_deg))
    return (star_or_rides.where(ok)
            .groupBy((F.floor(lat / cell) * cell).alias("cell_lat"),
                     (F.floor(lon / cell) * cell).alias("cell_lon"))
            .agg(F.count(F.lit(1)).alias("rides"),
                 sum2(F.coalesce(F.col("total_fare"), F.lit(0.0))).alias("total_revenue")))


def _bounded(slices: dict[str, DataFrame], orders: dict[str, list[Column]]):
    """(name, rows with ``__pos``) of every slice: cut to its bound in its own order, then ranked,
    stripped of name columns (all slices, not only recent rides), values cleaned (P3)."""
    for name, df in slices.items():
        order = orders.get(name) or [F.lit(1)]
        cut = df.orderBy(*order).limit(SNAPSHOT_LIMITS[name])
        d = drop_names(cut.withColumn("__pos", F.row_number().over(Window.orderBy(*order)).cast("long")))
        if name == "recent_rides":
            d = sanitize(d, ALLOWED_RIDE_COLUMNS + ["__pos"])
        yield name, clean_values(d)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot(slices: dict[str, DataFrame], orders: dict[str, list[Column]]) -> DataFrame:
    """Bounded dashboard snapshot ``(slice, pos, json)``, one JSON object per row of a slice."""
    return _stacked([d.select(F.lit(name).alias("slice"), F.col("__pos").alias("pos"),
                              F.to_json(F.struct(*[F.col(c) for c in d.columns if c != "__pos"])).alias("json"))
                     for name, d in _bounded(slices, orders)])


def snapshot_fields(slices: dict[str, DataFrame], orders: dict[str, list[Column]]) -> DataFrame:
    """P1 in long form ``(slice, pos, field, number, text)``: numbers as double, everything else as text."""
    parts = []
    for name, d in _bounded(slices, orders):
        cells = []
        for f in d.schema.fields:
            if f.name == "__pos":
                continue
            numeric = f.dataType.typeName() in ("long", "integer", "double", "float", "short", "byte")
            value = F.col(f.name)
            cells.append(F.struct(F.lit(f.name).alias("field"),
                                  (value if numeric else F.lit(None)).cast("double").alias("number"),
                                  (F.lit(None) if numeric else value).cast("string").alias("text")))
        parts.append(d.select(F.lit(name).alias("slice"), F.col("__pos").alias("pos"), F.explode(F.array(*cells)).alias("c"))
                     .select("slice", "pos", "c.*"))
    return _stacked(parts)
