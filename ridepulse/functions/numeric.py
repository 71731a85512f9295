"""Exact, order-independent numeric helpers (all built-in Column expressions).

Aggregating doubles makes the last bits depend on summation order, i.e. on
partitioning.  Measures are summed as integer millionths instead: a ``LongType``
sum is exact, stays inside whole-stage codegen, combines map-side, and gives the
same answer on 8 or 8,000 partitions.  Results are rounded once, after the
aggregate.  Six decimals are kept per value.  A sum is kept in two longs, the low ``LOW_BITS`` bits of every
value and the rest, so it can't overflow: values may reach 9.2e12, sums 9e18, over 8e12 rows.

Rounding is half-up, ``floor(x * 10^n + 0.5) / 10^n``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, n: int = 2) -> Column:
    """Half-up rounding to ``n`` decimals, returned as double."""
    scale = float(10 ** n)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


#: Millionths in one.
MICRO = 1_000_000.0


def micros(c) -> Column:
    """A measure as a long number of millionths."""
    return F.floor(col(c) * F.lit(MICRO) + F.lit(0.5))


def hundredths(c) -> Column:
    """A two-decimal amount as a long number of hundredths (for comparing amounts in cents)."""
    return F.floor(col(c) * F.lit(100.0) + F.lit(0.5))


LOW_BITS = 20


def _limbs(high: Column, low: Column) -> Column:
    """Two sums as one struct, the low one's carry moved to the high one."""
    return F.struct((high + F.shiftright(low, LOW_BITS)).alias("high"), low.bitwiseAND((1 << LOW_BITS) - 1).alias("low"))


def exact_sum_long(m: Column) -> Column:
    """SUM of a long column that can't overflow, as (high, low)."""
    return _limbs(F.sum(F.shiftright(m, LOW_BITS)), F.sum(m.bitwiseAND((1 << LOW_BITS) - 1)))


def exact_sum(c) -> Column:
    """SUM of a measure in millionths as (high, low): to be summed again by ``sum_again``."""
    return exact_sum_long(micros(c))


def sum_again(total: str) -> Column:
    """SUM of a column of (high, low) sums."""
    return _limbs(F.sum(F.col(total)["high"]), F.sum(F.col(total)["low"]))


def value(total) -> Column:
    """The amount of a (high, low) sum as double; NULL when every input was NULL."""
    t = col(total)
    return (t["high"].cast("double") * F.lit(float(1 << LOW_BITS)) + t["low"].cast("double")) / F.lit(MICRO)


def sum2(c) -> Column:
    """SUM of a measure, exact; NULL when every input is NULL."""
    return value(exact_sum(c))


def avg2(c) -> Column:
    """AVG of a measure (NULLs skipped), before rounding."""
    return sum2(c) / F.count(col(c))


def avg_long(c) -> Column:
    """AVG of an integer measure as double (NULLs skipped)."""
    return F.sum(col(c)).cast("double") / F.count(col(c))


def count_if(cond: Column) -> Column:
    """Conditional count as BIGINT: SUM(CASE WHEN cond THEN 1 ELSE 0 END)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pct(part: Column, whole: Column, n: int = 1) -> Column:
    """``round(100 * part / whole, n)`` in double arithmetic."""
    return rnd(F.lit(100.0) * part / whole, n)
