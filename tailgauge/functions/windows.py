"""Row frames counted in sessions, never in calendar days."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered_by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def before(w: WindowSpec, sessions: int) -> WindowSpec:
    """The given number of sessions strictly before the current one."""
    return w.rowsBetween(-sessions, -1)


def ending_here(w: WindowSpec, sessions: int) -> WindowSpec:
    """The given number of sessions, the current one included."""
    return w.rowsBetween(-(sessions - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def when_full(value: Column, counted: Column | str, frame: WindowSpec, sessions: int) -> Column:
    """``value`` once the frame holds ``sessions`` non-missing entries, else NULL."""
    return F.when(F.count(counted).over(frame) == sessions, value)


def full_window_quantile(value: str, frame: WindowSpec, sessions: int, probability: float) -> Column:
    """Linear-interpolated quantile of a full frame, NULL while it fills.

    The frame length is fixed, so both neighbours of the quantile sit at known
    places of the sorted frame; sorting an array is several times cheaper than a
    framed ``percentile``, which builds a map of counts for every row.
    """
    position = probability * (sessions - 1)
    low = int(position)
    ordered = F.sort_array(F.collect_list(value).over(frame))
    below, above = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(min(low + 1, sessions - 1)))
    return when_full(below + (above - below) * F.lit(position - low), value, frame, sessions)
