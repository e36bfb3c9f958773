"""Column expressions over one asset's series, with the rules for missing and degenerate values in one place."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def own(key: str = "asset", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, until: int = 0, key: str = "asset", order: str = "ts") -> WindowSpec:
    """The n rows that end ``until`` rows before the current one."""
    return own(key, order).rowsBetween(-(n - 1) - until, -until)


def log_return(now: Column, before: Column) -> Column:
    """ln(now / before); 0 where either price is missing or not positive."""
    return F.when((now > 0) & (before > 0), F.ln(now / before)).otherwise(F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    """x / y of doubles: over 0 infinite with the sign of x, NaN for 0 / 0, where Spark's own division fails; null where either is missing."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / y)


def correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson's r as an aggregate; 0 for fewer than ``least`` pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    r = F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-18, spread))
    return F.when(F.count(F.when(both, 1)) < least, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def sample_deviation(x: Column) -> Column:
    """Sample standard deviation as an aggregate; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def slope(y: str, x: str, least: int = 3) -> Column:
    """Least-squares slope of y on x as an aggregate; 0 for too few pairs or a constant x."""
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) < least, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)))


def money_flow(close: Column, volume: Column, cls: Column) -> Column:
    """Traded money: crypto volume is money already, all other volume counts shares; null without volume."""
    return F.when(volume > 0, F.when(cls == 2, volume).otherwise(close * volume))


def location(open_: Column, high: Column, low: Column, close: Column) -> Column:
    """Where in its range a bar closes, -1 to 1; without a range the sign of its move."""
    within = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ((close - low) - (high - close)) / (high - low)))
    return F.when(high > low, within).otherwise(F.coalesce(F.signum(close - open_), F.lit(0.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def severity(magnitude: Column) -> Column:
    """A magnitude on a scale of 1 to 100, rounded to even."""
    return clamp(F.bround(100 * (1 - F.exp(-magnitude / 4))), 1.0, 100.0)


def upper_median(values: Column) -> Column:
    """The upper middle of an array, null if empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
