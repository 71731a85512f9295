"""Slowly changing dimensions (T10-T13), batch form.

``ridepulse.streaming.dimensions`` has the same rules on streams, on Spark's streaming state.

Semantics
---------
SCD-1 (``scd1``): per key, the larger ``sequence_by`` wins; on a tie the
*existing* row stays; among new rows of one batch the ``tiebreak`` columns
decide (ascending, NULLs first).  With ``sequence_by`` equal to the key (the
pipeline's setting) every row of a key ties, so the first stored row never
changes.

SCD-2 (``scd2``): one version per distinct ``(keys, sequence_by)``; a later
version closes the previous one.  ``__START_AT`` is stored, ``__END_AT`` is
derived by ``lead`` at read time so a late (out-of-order) version lands in
the middle of the history without rewriting its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridepulse.operators.silver import _smallest, first_per_key
from ridepulse.schemas import END_AT, START_AT

_TAG = "__src"


#: Types that can order versions.
_ORDERED = ("timestamp", "timestamp_ntz", "date", "tinyint", "smallint", "int", "bigint", "float", "double")


def _check_order(df: DataFrame, sequence_by: str) -> None:
    dtype = df.schema[sequence_by].dataType.simpleString()
    if dtype not in _ORDERED and not dtype.startswith("decimal"):
        raise TypeError(f"sequence_by of type {dtype} cannot order versions; use a numeric or timestamp column")


def scd1(current: DataFrame | None, updates: DataFrame, keys: list[str],
         sequence_by: str | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """Type-1 upsert of ``updates`` into ``current``; returns the new table.

    With a real sequence column the largest value per key comes from a hash aggregate
    (combined map-side, so a hot key costs one row per input task); rows that do not have
    it are left out by an equi-join on key and value, and only the ties are sorted.
    """
    values = [c for c in updates.columns if c not in keys]
    tiebreak = tiebreak if tiebreak is not None else values
    new = updates.withColumn(_TAG, F.lit(1))
    both = new if current is None else current.select(*updates.columns) \
        .withColumn(_TAG, F.lit(0)).unionByName(new)
    both = both.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if sequence_by is not None and sequence_by not in keys:
        _check_order(updates, sequence_by)
        last = both.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(sequence_by).alias("__last"))
        on = F.col(sequence_by).eqNullSafe(F.col("__last"))
        for i, k in enumerate(keys):
            on = on & (F.col(k) == F.col(f"__k{i}"))
        both = both.join(last, on, "left_semi")
    elif current is None and tiebreak == values:  # every row of a key ties: combine equal rows first
        return first_per_key(updates, keys)
    order = [F.col(c).asc_nulls_first() for c in [_TAG, *tiebreak]]
    return _smallest(both, keys, order).select(*updates.columns)


def scd2_versions(current: DataFrame | None, updates: DataFrame, keys: list[str], sequence_by: str) -> DataFrame:
    """One row per distinct ``(keys, sequence_by)``; a stored version wins a tie (no end dates)."""
    other = [c for c in updates.columns if c not in keys and c != sequence_by]
    both = updates.withColumn(_TAG, F.lit(1))
    if current is not None:
        stored = current.drop(END_AT)
        if START_AT in stored.columns and sequence_by not in stored.columns:
            stored = stored.withColumnRenamed(START_AT, sequence_by)
        both = stored.select(*updates.columns).withColumn(_TAG, F.lit(0)).unionByName(both)
    # equal rows are combined map-side (a city has millions of rides and a few versions)
    both = both.where(F.col(sequence_by).isNotNull()).distinct()
    order = [F.col(c).asc_nulls_first() for c in [_TAG, *other]]
    return _smallest(both, [*keys, sequence_by], order).select(*updates.columns)


def scd2(current: DataFrame | None, updates: DataFrame, keys: list[str],
         sequence_by: str, track: list[str] | None = None) -> DataFrame:
    """Type-2 history with ``__START_AT``/``__END_AT``.

    Versions are the distinct ``(keys, sequence_by)`` pairs (existing version
    wins a tie).  Rows with a NULL ``sequence_by`` are not versions and are
    dropped (count them with ``scd2_rejects``).  ``track`` optionally merges
    consecutive versions whose tracked columns are all equal.
    """
    versions = scd2_versions(current, updates, keys, sequence_by)
    if track:
        w = Window.partitionBy(*keys).orderBy(sequence_by)
        prev = F.struct(*[F.lag(c).over(w) for c in track])
        cur = F.struct(*[F.col(c) for c in track])
        versions = (versions.withColumn("__same", F.lag(sequence_by).over(w).isNotNull()
                                        & prev.eqNullSafe(cur))
                    .where(~F.col("__same")).drop("__same"))
    return with_end_at(versions.select(*updates.columns), keys, sequence_by)


def with_end_at(versions: DataFrame, keys: list[str], sequence_by: str) -> DataFrame:
    """Derive ``__START_AT``/``__END_AT`` from stored versions (read side of T12)."""
    w = Window.partitionBy(*keys).orderBy(sequence_by)
    return (versions.withColumn(START_AT, F.col(sequence_by))
            .withColumn(END_AT, F.lead(sequence_by).over(w)))


def scd2_rejects(updates: DataFrame, sequence_by: str) -> DataFrame:
    """Rows an SCD-2 target cannot version (NULL ``sequence_by``), counted."""
    return updates.where(F.col(sequence_by).isNull()).agg(F.count(F.lit(1)).alias("rejected"))


def current(dim: DataFrame) -> DataFrame:
    """The open version of every key of an SCD-2 table."""
    return dim.where(F.col(END_AT).isNull())


def as_of_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
               ts: str, how: str = "left", dim_is_small: bool = True) -> DataFrame:
    """Join each fact to the dimension version valid at ``facts[ts]``.

    ``start <= ts < end`` (open end = current); the first version also covers
    earlier times.  An equi-join on the key with a range filter: no range or
    nested-loop join is needed.  A small dimension (the location history is
    cities x versions) is broadcast after a size check.
    """
    from ridepulse.functions.joins import small_lookup
    w = Window.partitionBy(dim_key).orderBy(START_AT)
    d = dim.withColumn("__first", F.row_number().over(w) == 1) \
        .withColumnRenamed(dim_key, "__dk")
    d = small_lookup(d) if dim_is_small else d
    t = F.col(ts)
    cond = ((F.col(fact_key) == F.col("__dk"))
            & (F.col(END_AT).isNull() | (t < F.col(END_AT)))
            & (F.col("__first") | (t >= F.col(START_AT))))
    out = facts.join(d, cond, how).drop("__first")
    return out.withColumnRenamed("__dk", dim_key) if dim_key != fact_key else out.drop("__dk")


def as_of_sorted(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, ts: str, salts: int = 8) -> DataFrame:
    """T13 for a large history: the result of ``as_of_join(how="left")`` by one union and one sort.

    Versions and facts of a key are sorted by time together, and each fact takes the last version before it, so the
    work does not grow with the versions per key (the join meets every fact with all of them).  Facts are spread
    over ``salts`` parts of their key and the versions copied to each, so a key that holds a third of all facts
    is not one task's work.
    """
    columns = [c for c in dim.columns if c != dim_key]
    first = F.row_number().over(Window.partitionBy(dim_key).orderBy(START_AT)) == 1
    # the first version also covers earlier times: its own time is NULL, which sorts first
    versions = dim.where(F.col(dim_key).isNotNull()).select(
        F.col(dim_key).alias("__key"), F.when(~first, F.col(START_AT)).alias("__at"), F.lit(0).alias("__kind"),
        F.struct(*columns).alias("__version")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = facts.select(F.struct(*facts.columns).alias("__fact"), F.col(fact_key).alias("__key"), F.col(ts).alias("__at"), F.lit(1).alias("__kind"),
                        F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int").alias("__salt"))
    line = Window.partitionBy("__key", "__salt").orderBy(F.col("__at").asc_nulls_first(), "__kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(versions, allowMissingColumns=True)
    found = both.withColumn("__version", F.last("__version", ignorenulls=True).over(line)).where("__kind = 1")
    # a fact without a time belongs to an open version only, as in the join
    version = F.when(F.col("__at").isNotNull() | F.col(f"__version.{END_AT}").isNull(), F.col("__version"))
    found = found.withColumn("__version", version)
    key = [F.when(F.col("__version").isNotNull(), F.col("__key")).alias(dim_key)] if dim_key != fact_key else []
    return found.select("__fact.*", *key, *[F.col(f"__version.{c}").alias(c) for c in columns])
