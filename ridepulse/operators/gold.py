"""Gold layer: the star schema (T9 a-g, T10, S7 batch form).

``gold_base`` is the single reader of silver that every gold table derives
from.  In batch it is the OBT reduced to one row per ride (the fact is keyed
by ``ride_id``); the dimensions are first-seen rows per key; the location
dimension is SCD-2 on ``city_updated_at``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ridepulse.functions.dates import newest
from ridepulse.operators.scd import current as scd_current
from ridepulse.operators.scd import scd2
from ridepulse.operators.silver import first_per_key
from ridepulse.schemas import DIM_COLUMNS, DIM_KEYS, FACT_COLUMNS


def gold_base(obt: DataFrame) -> DataFrame:
    """S7 (batch): one row per ride of the enriched table (rides without an id
    cannot be keyed and are left out of gold)."""
    return first_per_key(obt, ["ride_id"], near_unique=True)


def fact(base: DataFrame) -> DataFrame:
    """T9g: the ride fact (18 columns)."""
    return base.select(*FACT_COLUMNS)


def _dim(base: DataFrame, name: str) -> DataFrame:
    return first_per_key(base.select(*DIM_COLUMNS[name]), DIM_KEYS[name])


def dim_passenger(base: DataFrame) -> DataFrame:
    """T9a + T10: passengers, first-seen row per ``passenger_id``."""
    return _dim(base, "dim_passenger")


def dim_driver(base: DataFrame) -> DataFrame:
    """T9b + T10: drivers, first-seen row per ``driver_id``."""
    return _dim(base, "dim_driver")


def dim_vehicle(base: DataFrame) -> DataFrame:
    """T9c + T10: vehicles, first-seen row per ``vehicle_id``."""
    return _dim(base, "dim_vehicle")


def dim_payment(base: DataFrame) -> DataFrame:
    """T9d + T10: payment methods, first-seen row per id."""
    return _dim(base, "dim_payment")


def dim_booking(base: DataFrame) -> DataFrame:
    """T9e: booking details, one row per ride (base is already unique per ride)."""
    return base.select(*DIM_COLUMNS["dim_booking"]).where("ride_id IS NOT NULL")


def dim_location(base: DataFrame) -> DataFrame:
    """T9f + T12: pickup cities with SCD-2 history on ``city_updated_at``.

    Versions are the distinct (city, updated_at) pairs seen in the rides;
    rides whose city lookup missed (NULL ``city_updated_at``) are no version.
    """
    loc = base.select(*DIM_COLUMNS["dim_location"]).where("pickup_city_id IS NOT NULL")
    return scd2(None, loc, ["pickup_city_id"], "city_updated_at")


@dataclass
class Star:
    """The gold tables of one build."""
    fact: DataFrame
    dim_passenger: DataFrame
    dim_driver: DataFrame
    dim_vehicle: DataFrame
    dim_payment: DataFrame
    dim_booking: DataFrame
    dim_location: DataFrame
    base: DataFrame | None = None
    _lookups: dict = field(default_factory=dict, repr=False)

    def location_lookup(self, mode: str = "current") -> DataFrame:
        """The location dimension marked for broadcast, size-checked once per star."""
        key = f"location:{mode}"
        if key not in self._lookups:
            from ridepulse.functions.joins import small_lookup
            self._lookups[key] = small_lookup(self.location(mode))
        return self._lookups[key]

    def fact_with_booking(self, fact_cols: list[str], booking_cols: list[str],
                          newest_rows: int | None = None) -> DataFrame:
        """``fact LEFT JOIN dim_booking USING (ride_id)`` restricted to the columns given.

        When both tables are projections of one gold base (same key set, one
        row per ride), the join is the identity on that base and is skipped:
        one scan, no shuffle.  ``newest_rows`` asks for no more than the newest months that
        hold so many rides.
        """
        cols = list(dict.fromkeys(["ride_id"] + fact_cols + booking_cols))
        if self.base is not None:
            return (newest(self.base, newest_rows) if newest_rows else self.base).select(*cols)
        f = self.fact.select(*dict.fromkeys(["ride_id"] + fact_cols))
        b = self.dim_booking.select(*dict.fromkeys(["ride_id"] + booking_cols))
        return f.join(b, "ride_id", "left").select(*cols)

    def location(self, mode: str = "current") -> DataFrame:
        """The location dimension for star joins on ``pickup_city_id`` alone.

        ``current`` (default): open versions only, one row per city.
        ``all_versions``: every version (a city with two versions counts its
        rides twice, the literal behaviour of a join without a current-row
        filter).
        """
        if mode == "current":
            return scd_current(self.dim_location)
        if mode == "all_versions":
            return self.dim_location
        raise ValueError(f"unknown location mode {mode!r}")


def build_star(obt: DataFrame, already_unique: bool = False) -> Star:
    """The star from the OBT (or from a gold base that is already one row per ride)."""
    base = obt if already_unique else gold_base(obt)
    return Star(
        fact=fact(base),
        dim_passenger=dim_passenger(base),
        dim_driver=dim_driver(base),
        dim_vehicle=dim_vehicle(base),
        dim_payment=dim_payment(base),
        dim_booking=dim_booking(base),
        dim_location=dim_location(base),
        base=base,
    )
