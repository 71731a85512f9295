"""Ride event sources and sinks: Kafka protocol, JSON files, manifests.

The Kafka connector is not bundled with plain PySpark; ``kafka_rides`` and
``publish_rides`` need ``spark-sql-kafka`` on the cluster.  Everything else
(payload shaping, parsing, file sources) runs anywhere, and the streaming
pipeline is tested with file sources.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ridepulse.operators.silver import conform, normalise_ts
from ridepulse.schemas import MAP_SCHEMAS, RIDE_COLUMNS, RIDES

# ISO text without zone, as the event producer writes timestamps.
EVENT_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Consumer settings of the live ride topic.
KAFKA_DEFAULTS = {
    "kafka.sasl.mechanism": "PLAIN",
    "kafka.security.protocol": "SASL_SSL",
    "kafka.request.timeout.ms": "10000",
    "kafka.session.timeout.ms": "10000",
    "maxOffsetsPerTrigger": "10000",
    "failOnDataLoss": "false",
    "startingOffsets": "earliest",
}


def kafka_options(bootstrap_servers: str, topic: str, username: str, password: str,
                  **overrides) -> dict[str, str]:
    """Reader options for a SASL_SSL/PLAIN Kafka-protocol endpoint (rate-limited)."""
    jaas = ("org.apache.kafka.common.security.plain.PlainLoginModule required "
            f'username="{username}" password="{password}";')
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic,
            "kafka.sasl.jaas.config": jaas, **KAFKA_DEFAULTS}
    opts.update({k: str(v) for k, v in overrides.items()})
    return opts


def with_payload(df: DataFrame, column: str = "rides") -> DataFrame:
    """The binary Kafka ``value`` as a string column; other Kafka columns kept."""
    return df.withColumn(column, F.col("value").cast("string"))


def kafka_rides(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """S1 + S2: the raw ride stream (needs the Kafka connector on the classpath)."""
    return with_payload(spark.readStream.format("kafka").options(**options).load())


def ride_events(rides: DataFrame, key: str = "ride_id") -> DataFrame:
    """S8 payload: one JSON text per ride (all 43 fields, NULLs written as null)."""
    body = F.to_json(F.struct(*[F.col(c) for c in RIDE_COLUMNS if c in rides.columns]),
                     {"timestampFormat": EVENT_TS_FORMAT, "ignoreNullFields": "false"})
    return rides.select(F.col(key).cast("string").alias("key"), body.alias("value"))


def publish_rides(rides: DataFrame, options: dict[str, str], topic: str) -> None:
    """Publish rides as JSON events to a Kafka-protocol topic (batch write)."""
    (ride_events(rides).write.format("kafka").options(**options)
     .option("topic", topic).save())


def publish_rides_files(rides: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """S8 offline: the same events as gzipped JSON-lines text files (one event per line; a task reads a file whole,
    so ``rows_per_file`` bounds its work).  The fastest level: events are read once and go."""
    (ride_events(rides).select("value").write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", rows_per_file).text(path))


# Raw ride files carry the booking time as text; it is normalised on read.
RAW_RIDES = StructType([StructField(f.name, StringType() if f.name == "booking_timestamp"
                                    else f.dataType, True) for f in RIDES.fields])


def bulk_rides(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Bulk ride history (batch) with its booking time cast to a timestamp.  ``json``: files of one array each, ``jsonl``:
    a ride in every line."""
    reader = spark.read.schema(RAW_RIDES)
    if fmt in ("json", "jsonl"):
        df = reader.option("multiLine", fmt == "json").json(path)
    else:
        df = reader.format(fmt).load(path)
    return normalise_ts(conform(df))


def bulk_source(spark: SparkSession, path: str, fmt: str = "json",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Bulk history as a *stream* source (files picked up once, rate-limited)."""
    r = spark.readStream.schema(RAW_RIDES)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.option("multiLine", True).json(path) if fmt == "json" else r.format(fmt).load(path)
    return normalise_ts(df)


def raw_event_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw JSON events as a stream of text lines (offline stand-in for the Kafka topic)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).withColumnRenamed("value", "rides")


def _manifest_entries(text: str) -> list[dict]:
    """The entries of a manifest file: one JSON array, or one object per line (or alone)."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    return found if isinstance(found, list) else [found]


def load_manifest(spark: SparkSession, manifest_path: str, base_dir: str, lake,
                  layer: str = "bronze") -> list[str]:
    """Copy every file named in a manifest (``[{"file": name}, ...]``) into the lake.

    Lookup files get their explicit schema; ``bulk_rides`` gets the ride
    schema.  Files hold one JSON array each; an entry with ``"lines": true`` has a ride per line, in any number of
    files.  The manifest is a handful of names; each copy is one Spark job.
    """
    from ridepulse.sources.lookups import load_map
    entries = [e for r in spark.read.text(manifest_path, wholetext=True).collect() for e in _manifest_entries(r.value)]
    for e in entries:
        name, src = e["file"], posixpath.join(base_dir, f"{e['file']}.json")
        df = load_map(spark, name, src) if name in MAP_SCHEMAS else bulk_rides(spark, src, "jsonl" if e.get("lines") else "json")
        lake.write_overwrite(df, layer, name)
    return [e["file"] for e in entries]
