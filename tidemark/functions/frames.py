"""Window specs with the strictness rules used throughout the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def if_full(w: WindowSpec, n: int, probe: Column, value: Column) -> Column:
    """``value`` only where the trailing frame holds ``n`` non-null probes, else NULL."""
    return F.when(F.count(probe).over(trailing(w, n)) == n, value)


def full_avg(c: Column, w: WindowSpec, n: int) -> Column:
    return if_full(w, n, c, F.avg(c).over(trailing(w, n)))


def full_std(c: Column, w: WindowSpec, n: int) -> Column:
    return if_full(w, n, c, F.stddev_samp(c).over(trailing(w, n)))


def last_known(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(so_far(w))


def ratio_change(c: Column, w: WindowSpec, n: int = 1) -> Column:
    """Relative change to the value ``n`` rows back; NULL where that value is 0 or missing."""
    return F.try_divide(c, F.lag(c, n).over(w)) - 1
