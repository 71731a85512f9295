"""T10-T12 on streams: dimensions kept by Spark's own streaming state.

* First row per key (T10, and SCD-1 with the sequence equal to the key, where the first stored row
  never changes): ``dropDuplicates`` on the key into an append-only table.
* SCD-1 with a real sequence: a streaming aggregate holds each key's row with the largest sequence;
  changed keys replace their rows in a table partitioned by key hash.
* SCD-2: a version is a distinct (key, sequence), so ``dropDuplicates`` on both feeds an append-only table of
  versions; ``__END_AT`` is derived when it is read, so a late version lands inside the history.

State is keyed and lives in the state store.  With ``STATE`` (the flows set it) that is RocksDB on local disk, so a batch
costs what it holds, whatever the table's size; Spark's own default keeps all keys in the heap and copies them for each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ridepulse.sources.lake import Lake

#: Session settings for large state: kept on local disk, changes uploaded with each batch, one bounded buffer and cache for all
#: stores of an executor, no second look-up of a key to count rows.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
         "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
BUCKET = "key_bucket"


def with_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have all keys; the others are no members of a dimension (the update's metrics count them)."""
    return rows.dropna(subset=keys)


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of every key that ever arrives (append mode)."""
    return with_keys(rows, keys).dropDuplicates(keys)


def _descending(sequence: Column, dtype: str) -> Column:
    """A value that sorts the largest sequence first and rows without one last."""
    if dtype in ("timestamp", "timestamp_ntz"):
        value = F.unix_micros(sequence.cast("timestamp"))
    elif dtype == "date":
        value = F.unix_date(sequence).cast("long")
    elif dtype in ("tinyint", "smallint", "int", "bigint"):
        value = sequence.cast("long")
    else:
        raise TypeError(f"sequence of type {dtype} cannot order versions on a stream; use a whole number, date or timestamp")
    return F.struct(sequence.isNull().alias("missing"), (-value).alias("value"))


def latest(rows: DataFrame, keys: list[str], sequence_by: str) -> DataFrame:
    """The row with the largest sequence of every key (update mode); ties: the smallest tuple of the other
    columns, NULLs first, as in the batch form.  One minimum per key, combined before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    order = _descending(F.col(sequence_by), rows.schema[sequence_by].dataType.simpleString())
    best = F.min(F.struct(order.alias("order"), *values)).alias("best")
    return with_keys(rows, keys).groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in values]).select(*rows.columns)


def replace_keys(lake: Lake, layer: str, table: str, keys: list[str], schema: StructType, buckets: int = 16, files: int = 1):
    """The ``foreachBatch`` function that puts changed keys into a table partitioned by key hash.

    Only the partitions of the batch's keys are rewritten (dynamic partition overwrite).  The batch holds the keys'
    full new rows from the state, so a batch that comes again after a failure writes the same table.  ``buckets``
    should give partitions of some 100 MB, ``files`` splits larger ones.
    """
    stored = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn(BUCKET, number).persist()
        try:
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            if touched:
                old = lake.read(layer, table, stored).where(F.col(BUCKET).isin(touched))
                rows = old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)
                part = F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(files))
                rows.repartition(len(touched) * files, F.col(BUCKET), part).write.mode("overwrite").partitionBy(BUCKET) \
                    .option("partitionOverwriteMode", "dynamic").parquet(lake.path(layer, table))
        finally:
            new.unpersist()
    return run
