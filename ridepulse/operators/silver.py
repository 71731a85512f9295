"""Silver layer: parse, merge, deduplicate and enrich ride events.

All operators are DataFrame -> DataFrame and work on batch and streaming
frames alike (the streaming form of ``dedup_rides`` is ``streaming.flows.unique_rides``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridepulse.functions.joins import small_lookup
from ridepulse.schemas import OBT_LOOKUP_COLUMNS, RIDE_COLUMNS, RIDES


def parse_rides(df: DataFrame, payload: str = "rides", keep: list[str] | None = None, schema=RIDES) -> DataFrame:
    """T1 + T2: JSON text -> the 43 ride columns (or those of another event ``schema``).

    Permissive: malformed JSON gives a row of NULLs, a NULL payload gives a
    NULL struct (flattened to NULLs), missing fields are NULL, extra fields are
    ignored.  ``keep`` carries source columns (e.g. Kafka offsets) along.
    """
    parsed = df.withColumn("__ride", F.from_json(F.col(payload), schema))
    return parsed.select(*(keep or []), "__ride.*")


def normalise_ts(df: DataFrame, column: str = "booking_timestamp") -> DataFrame:
    """Make ``column`` a TIMESTAMP; text that does not parse becomes NULL.

    ``try_to_timestamp`` keeps ANSI mode from failing the job on one bad row.
    """
    dtype = df.schema[column].dataType.simpleString()
    if dtype == "timestamp":
        return df
    if dtype == "string":
        return df.withColumn(column, F.try_to_timestamp(F.col(column)))
    return df.withColumn(column, F.col(column).cast("timestamp"))


def conform(df: DataFrame) -> DataFrame:
    """Select the 43 ride columns in order with their declared types.

    Values that do not convert become NULL (``try_cast``), so one bad row
    never fails a job under ANSI mode.
    """
    cols = []
    for name in RIDE_COLUMNS:
        t = RIDES[name].dataType
        if name in df.columns:
            same = df.schema[name].dataType == t
            cols.append((F.col(name) if same else F.col(name).try_cast(t)).alias(name))
        else:
            cols.append(F.lit(None).cast(t).alias(name))
    return df.select(*cols)


def build_stg(*sources: DataFrame, dedup: bool = True) -> DataFrame:
    """T4 (+T5): append-merge any number of ride sources into ``stg_rides``.

    One plan over a union (never several writers into one sink).  The three
    sources of the pipeline are bulk history, the live stream and the parsed
    archive; the same ride can come through more than one of them, so
    ``dedup=True`` (default) keeps one row per ``ride_id``.  ``dedup=False`` is
    the plain append.
    """
    parts = [normalise_ts(conform(s)) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return dedup_rides(out) if dedup else out


def _smallest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``: one shuffle on the key, one sort, one pass.

    A running count (not a rank) marks the first row, so the planner adds no second,
    local sort in front of the shuffle: it would sort every row and drop hardly any.
    """
    first = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__nth", F.count(F.lit(1)).over(first)).where("__nth = 1").drop("__nth")


def first_per_key(df: DataFrame, keys: list[str], drop_null_keys: bool = True, near_unique: bool = False) -> DataFrame:
    """One row per key, deterministically: the smallest tuple of the other columns (ascending,
    NULLs first) wins, so the choice never depends on partitioning.

    Keys that repeat a lot (drivers, passengers): equal rows are first combined by a hash
    aggregate, map-side, so a key that holds a third of all rows is reduced inside each
    input task; the few different rows of a key are then sorted.  ``near_unique`` keys
    (rides) have nothing to combine and go straight to the sort.
    """
    values = [c for c in df.columns if c not in keys]
    src = df
    if drop_null_keys:
        for k in keys:
            src = src.where(F.col(k).isNotNull())
    if not values:
        return src.select(*keys).distinct()
    if not near_unique:
        src = src.distinct()
    return _smallest(src, keys, [F.col(c).asc_nulls_first() for c in values]).select(*df.columns)


def dedup_rides(df: DataFrame) -> DataFrame:
    """T5 (batch): one row per ``ride_id``; copies of a ride are identical in practice, and the
    smallest-tuple rule makes the pick deterministic otherwise.  Rides without an id can't be
    told apart from their copies: all of them pass (gold leaves them out, counted as rejects)."""
    keyed = first_per_key(df, ["ride_id"], near_unique=True)
    return keyed.unionByName(df.where(F.col("ride_id").isNull()))


def repeated_ids(df: DataFrame) -> DataFrame:
    """The ride ids that more than one row has."""
    ids = df.where(F.col("ride_id").isNotNull()).groupBy("ride_id").agg(F.count(F.lit(1)).alias("__rows"))
    return ids.where("__rows > 1").select("ride_id")


def with_event_time(df: DataFrame, delay: str = "3 minutes",
                    column: str = "booking_timestamp") -> DataFrame:
    """Declare event time with a lateness bound (used before stateful steps)."""
    return df.withWatermark(column, delay)


def city_versions(cities: DataFrame) -> DataFrame:
    """Validity interval of each city-map version: [updated_at, next updated_at).

    The first version of a city also covers everything before it, so a map
    with one row per city behaves exactly like a plain equi-join lookup.
    The map is tiny, so the window runs on a handful of rows.
    """
    w = Window.partitionBy("city_id").orderBy("updated_at")
    return (cities.withColumn("__valid_to", F.lead("updated_at").over(w))
            .withColumn("__first", F.row_number().over(w) == 1))


def build_obt(stg: DataFrame, maps: dict[str, DataFrame],
              event_time: str = "booking_timestamp", city_mode: str = "temporal") -> DataFrame:
    """T6 + T8: the one-big-table: six LEFT lookups, unmatched rides kept.

    Lookups are broadcast (bounded size, checked), so the ride side is never
    shuffled: the whole enrichment is one narrow stage and works unchanged on
    a streaming ``stg``.  The city lookup is temporal: a ride sees the city
    version that was current at its event time (NULL event time -> the
    current version), which is what a stream that re-reads the static map per
    micro-batch produces (``city_mode="temporal"``).  ``city_mode="literal"`` is the plain
    equi-join on the city id: a city with two versions doubles its rides.
    """
    if city_mode not in ("temporal", "literal"):
        raise ValueError(f"unknown city mode {city_mode!r}")
    out = stg
    for name, cols in OBT_LOOKUP_COLUMNS:
        m = maps[name]
        if name == "map_cities":
            cv = city_versions(m)
            sel = [F.col("city_id").alias("__cid"), F.col("__valid_to"), F.col("__first"),
                   F.col("updated_at").alias("__from")] + \
                  [F.col(src).alias(dst) for src, dst in cols if src != "updated_at"] + \
                  [F.col("updated_at").alias("city_updated_at")]
            cv = small_lookup(cv.select(*sel))
            ts = F.col(event_time)
            in_version = F.when(
                ts.isNull(), F.col("__valid_to").isNull()
            ).otherwise(
                (F.col("__valid_to").isNull() | (ts < F.col("__valid_to")))
                & (F.col("__first") | (ts >= F.col("__from"))))
            on = F.col("pickup_city_id") == F.col("__cid")
            out = (out.join(cv, on & in_version if city_mode == "temporal" else on, "left")
                   .drop("__cid", "__valid_to", "__first", "__from"))
        else:
            key = cols and _lookup_key(name)
            sel = [F.col(key).alias("__k")] + [F.col(src).alias(dst) for src, dst in cols]
            lk = small_lookup(m.select(*sel))
            out = out.join(lk, F.col(key) == F.col("__k"), "left").drop("__k")
    return out


def _lookup_key(name: str) -> str:
    return {
        "map_vehicle_makes": "vehicle_make_id",
        "map_vehicle_types": "vehicle_type_id",
        "map_ride_statuses": "ride_status_id",
        "map_payment_methods": "payment_method_id",
        "map_cancellation_reasons": "cancellation_reason_id",
    }[name]
