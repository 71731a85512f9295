"""The streaming medallion pipeline on Structured Streaming (S5-S7, T1-T12 on streams).

Native streaming queries joined by tables; every one has its own checkpoint, and every table is
written by Spark's file sink, so each row arrives exactly once and a restart goes on where it stopped:

1. ``bronze``: raw JSON events -> parsed rides in ``streaming_rides_archive`` (S6, a copy that outlives the
   broker), bulk history -> ``bulk_rides_stream`` (S5).  A source may be added at any time.
2. ``silver``: all bronze rides (T4) -> one row per ride id (T5) -> lookups (T6, stateless: no watermark is
   needed, D2) -> ``silver_obt``, partitioned by booking month.  T5 is a key state over the whole history: a copy of a ride is
   dropped whenever it comes and whatever its booking time says.  Live rides come through the archive, where
   they are parsed once.  The quality rules (G1, G3, G4) are counted on the way (``observe``), without a scan.
3. ``gold``: one consumer per dimension on the silver table, each reading its own columns (S7, T9-T12).

The enriched table is the base of the star: the fact and ``dim_booking`` are projections of it, so a
query that needs both scans it once and joins nothing.  ``dedup=False`` (the literal append) keeps copies in
silver (the live rides and their archive copies) and a keyed ``gold_base`` beside it.

``run_update`` runs the flows in order with ``availableNow`` triggers, the analogue of one triggered pipeline
update.  Checkpoints live under the lake root (shared storage).
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from ridepulse.functions.dates import BOOKING_MONTH, booking_month
from ridepulse.operators.gold import Star
from ridepulse.operators.quality import counters, fare_rules, status_rules, time_rules
from ridepulse.operators.scd import with_end_at
from ridepulse.operators.silver import build_obt, conform, normalise_ts, parse_rides
from ridepulse.schemas import DIM_COLUMNS, DIM_KEYS, FACT_COLUMNS, MAP_SCHEMAS, OBT_LOOKUP_COLUMNS, RIDES
from ridepulse.session import freed_shuffles, settings
from ridepulse.sources.lake import COMPRESSION, Lake
from ridepulse.streaming.dimensions import STATE, first_seen

ARCHIVE = ("bronze", "streaming_rides_archive")
BULK = ("bronze", "bulk_rides_stream")
OBT = ("silver", "silver_obt")
GOLD_BASE = ("gold", "gold_base")
DIMENSIONS = ["dim_passenger", "dim_driver", "dim_vehicle", "dim_payment", "dim_location"]
METRICS = "quality"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
#: Bytes of bronze files that a batch of silver takes (one larger file is a batch of its own): what a batch shuffles is on
#: disk until it ends, so an update needs disk for a batch and not for all that has come.
BATCH_BYTES = 256 << 20
#: The same for a consumer of silver, which reads a few columns of the files.
GOLD_BYTES = 1 << 30
#: Partitions of a batch's shuffles and of a flow's state, if the session has more: batches are bounded, and each state partition
#: is a store of its own that is opened and committed in every batch.  A checkpoint keeps the number it began with.
BATCH_PARTITIONS = 48
#: Batches of an update whose progress, and with it the rule counts, is kept; Spark keeps 100 if nothing is set.
BATCHES = {"spark.sql.streaming.numRecentProgressUpdates": "100000"}

#: Columns of the enriched table; stored with its month as the partition column.
OBT_SCHEMA = StructType(RIDES.fields + [StructField(out, MAP_SCHEMAS[name][src].dataType)
                                        for name, cols in OBT_LOOKUP_COLUMNS for src, out in cols])
STORED_OBT = StructType(OBT_SCHEMA.fields + [StructField(BOOKING_MONTH, DateType())])


def _schema(name: str) -> StructType:
    return StructType([OBT_SCHEMA[c] for c in DIM_COLUMNS[name]])


def checkpoint(lake: Lake, flow: str) -> str:
    return posixpath.join(lake.root, "_checkpoints", flow)


def _into(rows: DataFrame, lake: Lake, table: tuple[str, str], flow: str, available_now: bool = True,
          partition_by: str | None = None) -> StreamingQuery:
    """Append a stream to a table by the file sink."""
    w = rows.writeStream.format("parquet").option("compression", COMPRESSION).outputMode("append").queryName(flow) \
        .option("checkpointLocation", checkpoint(lake, flow)).option("path", lake.path(*table))
    w = w.partitionBy(partition_by) if partition_by else w
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    partitions = min(int(lake.spark.conf.get(SHUFFLE_PARTITIONS)), BATCH_PARTITIONS)
    with settings(lake.spark, {**STATE, SHUFFLE_PARTITIONS: str(partitions)}):  # a stream keeps the settings it starts with
        return w.start()


def read_appended(spark: SparkSession, lake: Lake, table: tuple[str, str], schema: StructType = RIDES,
                  max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Stream a table written by a file sink (its log keeps reads exact).

    The schema is declared, so a table without any file yet is an empty stream.  A trigger takes files up to the number
    or else the bytes given; the others follow in the next ones.
    """
    lake.make_dir(lake.path(*table))
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return r.parquet(lake.path(*table))


def parsed_events(raw: DataFrame) -> DataFrame:
    """Raw JSON text (column ``rides``) -> typed rides."""
    return normalise_ts(parse_rides(raw))


def archive_flow(raw: DataFrame, lake: Lake, available_now: bool = True) -> StreamingQuery:
    """Persist every parsed event, independent of broker retention."""
    return _into(parsed_events(raw), lake, ARCHIVE, "archive", available_now)


def bulk_flow(bulk: DataFrame, lake: Lake, available_now: bool = True) -> StreamingQuery:
    """The bulk history, picked up file by file."""
    return _into(normalise_ts(conform(bulk)), lake, BULK, "bulk", available_now)


def unique_rides(rides: DataFrame) -> DataFrame:
    """T5 on a stream, exact over all months: the first row of every ride id that ever arrives; rides without an id
    can't be told apart from their copies, so all of them pass (as in ``dedup_rides``)."""
    return first_seen(rides, ["ride_id"]).unionByName(rides.where(F.col("ride_id").isNull()))


def silver_flow(spark: SparkSession, lake: Lake, maps: dict[str, DataFrame], dedup: bool = True, available_now: bool = True,
                max_files_per_trigger: int | None = None, files_per_month: int = 1, batch_bytes: int | None = None) -> StreamingQuery:
    """Bronze rides -> ``silver_obt``, in batches of ``batch_bytes`` of each bronze table (``BATCH_BYTES``) or of
    ``max_files_per_trigger`` files.  ``files_per_month``: files that a batch adds to a month."""
    tables = [BULK, ARCHIVE] if dedup else [BULK, ARCHIVE, ARCHIVE]
    rides = None
    for t in tables:
        part = read_appended(spark, lake, t, max_files_per_trigger=max_files_per_trigger, max_bytes_per_trigger=batch_bytes or BATCH_BYTES)
        rides = part if rides is None else rides.unionByName(part)
    spread = F.pmod(F.xxhash64("ride_id"), F.lit(files_per_month))
    months = (unique_rides(rides) if dedup else rides).withColumn(BOOKING_MONTH, booking_month()).repartition(F.col(BOOKING_MONTH), spread)
    obt = build_obt(months, maps).observe(METRICS, *counters(  # the lookups' columns are added behind the shuffle
        {**fare_rules(None), **time_rules(), **status_rules(), "has_ride_id": (F.lit(True), F.col("ride_id").isNull())}))
    return _into(obt.select(*OBT_SCHEMA.fieldNames(), BOOKING_MONTH), lake, OBT, "silver" if dedup else "silver-literal", available_now, BOOKING_MONTH)


def gold_flow(spark: SparkSession, lake: Lake, name: str, available_now: bool = True) -> StreamingQuery:
    """One consumer of the silver table; reads the dimension's own columns of rides that have an id."""
    rides = read_appended(spark, lake, OBT, STORED_OBT, max_bytes_per_trigger=GOLD_BYTES).where(F.col("ride_id").isNotNull())
    if name == "gold_base":
        return _into(first_seen(rides, ["ride_id"]), lake, GOLD_BASE, name, available_now, BOOKING_MONTH)
    return _into(first_seen(rides.select(*DIM_COLUMNS[name]), DIM_KEYS[name]), lake, ("gold", name), name, available_now)


def metrics(*queries: StreamingQuery) -> dict[str, tuple[int, int]]:
    """The quality counts of the queries' batches in this run: rule -> (checked, violations)."""
    out: dict[str, tuple[int, int]] = {}
    for q in queries:
        for p in q.recentProgress:
            row = (p["observedMetrics"] or {}).get(METRICS)
            for k in (row.asDict() if row is not None else {}):
                if k.endswith("__c"):
                    c, v = out.get(k[:-3], (0, 0))
                    out[k[:-3]] = (c + (row[k] or 0), v + (row[k[:-1] + "v"] or 0))
    return out


def read_obt(lake: Lake) -> DataFrame:
    """The enriched rides, with their month as a partition column (a scan skips other months)."""
    return lake.read(*OBT, STORED_OBT)


def read_star(lake: Lake) -> Star:
    """The star schema as maintained by the flows; fact and booking are projections of one base."""
    literal = lake.exists(lake.path(*GOLD_BASE))
    base = (lake.read(*GOLD_BASE, STORED_OBT) if literal else read_obt(lake)).where(F.col("ride_id").isNotNull())
    dims = {n: lake.read("gold", n, _schema(n)) for n in DIMENSIONS}
    dims["dim_location"] = with_end_at(dims["dim_location"], ["pickup_city_id"], "city_updated_at")
    return Star(fact=base.select(*FACT_COLUMNS), dim_booking=base.select(*DIM_COLUMNS["dim_booking"]), base=base, **dims)


def run_update(spark: SparkSession, lake: Lake, maps: dict[str, DataFrame], raw_events: DataFrame | None,
               bulk: DataFrame | None = None, dedup: bool = True, quality: dict | None = None,
               archived: Callable[[], None] | None = None) -> Star:
    """One triggered pipeline update: bronze, silver, gold, each to completion.

    ``raw_events`` is a stream of JSON text (column ``rides``, e.g. ``kafka_rides`` or
    ``raw_event_files``, rate-limited there); ``bulk`` a stream of ride rows.  Empty sources and
    sources that join later are fine.  ``quality`` is filled with the update's rule counts.
    ``archived`` is called when all that has come is in bronze: from then on the later flows read bronze alone.
    """
    with freed_shuffles(spark), settings(spark, BATCHES):
        bronze = [archive_flow(raw_events, lake)] if raw_events is not None else []
        bronze += [bulk_flow(bulk, lake)] if bulk is not None else []
        for q in bronze:
            q.awaitTermination()
        if archived is not None:
            archived()
        silver = silver_flow(spark, lake, maps, dedup)
        silver.awaitTermination()
        if quality is not None:
            quality.update(metrics(silver))
        gold = [gold_flow(spark, lake, name) for name in (DIMENSIONS if dedup else [*DIMENSIONS, "gold_base"])]
        for q in gold:  # the consumers are independent: their jobs share the cluster
            q.awaitTermination()
    return read_star(lake)
