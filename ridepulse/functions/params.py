"""Parameter guards for the curated operators (V1-V5).

One declarative guard per kind of parameter.  User text never becomes SQL text (V6):
operators take the guarded values and use them only as Column literals.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

# Limits of the curated operators.
MAX_LIMIT = 25
MAX_CITY_COMPARISON = 10
MAX_PREDICTION_HOURS = 24
CITY_MIN_LEN, CITY_MAX_LEN = 2, 80


@dataclass(frozen=True)
class Whole:
    """A whole number in a closed range."""

    name: str
    low: int
    high: int

    def __call__(self, value) -> int:
        try:
            number = int(value)
        except (TypeError, ValueError):
            number = None
        if number is None or number not in range(self.low, self.high + 1):
            raise ValueError(f"{self.name}: expected a whole number in [{self.low}, {self.high}], got {value!r}")
        return number


validate_limit = Whole("limit", 1, MAX_LIMIT)                         # V3
validate_horizon = Whole("forecast horizon", 1, MAX_PREDICTION_HOURS)  # V5
_HOUR = Whole("hour of day", 0, 23)


def validate_hour_range(first, last) -> tuple[int, int]:
    """V4: two hours of the day, in ascending order (a range does not wrap past midnight)."""
    low, high = sorted((_HOUR(first), _HOUR(last)))
    return low, high


def validate_city(city) -> str:
    """V1: a city name without surrounding blanks."""
    name = "" if city is None else str(city).strip()
    if not CITY_MIN_LEN <= len(name) <= CITY_MAX_LEN:
        raise ValueError(f"city: expected {CITY_MIN_LEN} to {CITY_MAX_LEN} characters, got {len(name)}")
    return name


def _distinct(names: Iterable[str]) -> list[str]:
    """The first spelling of each name, in order, whatever the case."""
    kept: dict[str, str] = {}
    for n in names:
        kept.setdefault(n.lower(), n)
    return list(kept.values())


def validate_city_list(cities) -> list[str]:
    """V2: comma-separated cities, each guarded by V1, repeats (in any case) left out."""
    names = _distinct(map(validate_city, ("" if cities is None else str(cities)).split(",")))
    if len(names) > MAX_CITY_COMPARISON:
        raise ValueError(f"cities: at most {MAX_CITY_COMPARISON} can be compared, got {len(names)}")
    return names
