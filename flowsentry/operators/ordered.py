"""Per-key time-ordered computation that never puts a whole key into one task.

A hot key (one flooding source, one long flow) may own a third of all rows, so no window here is
partitioned by the key alone over raw rows. Rows are cut into time slices. Whatever needs order
runs inside (key, slice); what crosses slices is carried by one row per (key, slice), whose number
depends on the time span and not on the traffic.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SECOND_US

Fold = Callable[[Column], Column]


SLICE_US = 10 * SECOND_US


def slice_width(gap_us: int) -> int:
    """Slice width for sessions: never wider than the gap that ends one."""
    return min(SLICE_US, gap_us)


def slice_start(us: str | Column, width_us: int) -> Column:
    """Start of the fixed-width time slice that holds `us` (epoch microseconds)."""
    us = F.col(us) if isinstance(us, str) else us
    return us - F.pmod(us, F.lit(int(width_us)))


def number_sessions(slices: DataFrame, keys: list[str], gap_us: int, *,
                    split_at_gap: bool = False, first: str = "first_us",
                    last: str = "last_us", slice_col: str = "slice") -> DataFrame:
    """Add `session_us`, the start of the idle-gap session each (key, slice) row belongs to.

    Needs slices no wider than the gap, so that a session never ends inside a slice. A session ends
    when the idle time is longer than the gap (`split_at_gap`: longer or equal).
    """
    order = Window.partitionBy(*keys).orderBy(slice_col)
    idle = F.col(first) - F.lag(last).over(order)
    ends = (idle >= gap_us) if split_at_gap else (idle > gap_us)
    starts = F.when(idle.isNull() | ends, F.col(first))
    return slices.withColumn("_start", starts).withColumn(
        "session_us",
        F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def session_slices(rows: DataFrame, keys: list[str], us: str, gap_us: int, **kw) -> DataFrame:
    """(keys, slice, first_us, last_us, n, session_us): sessions found on pre-aggregated slices.

    The aggregation combines on the map side, so a hot key costs one small row per map task and
    slice; raw rows are neither sorted nor collected. Rows find their session again by
    (key, `slice_start(us, slice_width(gap_us))`); narrow slices keep that join even for a hot key.
    """
    slices = (rows.groupBy(*keys, slice_start(us, slice_width(gap_us)).alias("slice"))
              .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"),
                   F.count(F.lit(1)).alias("n")))
    return number_sessions(slices, keys, gap_us, **kw)


def running(events: DataFrame, keys: list[str], order: list[str],
            measures: dict[str, Fold], slice_us: int = SLICE_US) -> DataFrame:
    """Running value of each measure per key in `order`, the current row included.

    `order[0]` holds microseconds. `measures` maps a column to a fold that may be applied again to
    its own results (`F.sum`, `F.min`, `F.max`); the column is replaced by its running value.
    """
    sliced = events.withColumn("_slice", slice_start(order[0], slice_us))
    totals = sliced.groupBy(*keys, "_slice").agg(*[fold(m).alias(m) for m, fold in measures.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(
        *keys, "_slice", F.lit(0).alias("_row"),
        *[fold(m).over(before).alias(m) for m, fold in measures.items()])
    opening = opening.filter(reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in measures]))
    both = sliced.withColumn("_row", F.lit(1)).unionByName(opening, allowMissingColumns=True)
    inside = (Window.partitionBy(*keys, "_slice").orderBy("_row", *order)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = both.select(
        *[c for c in both.columns if c not in measures],
        *[fold(m).over(inside).alias(m) for m, fold in measures.items()])
    return out.filter("_row = 1").drop("_row", "_slice")


def first_occurrences(rows: DataFrame, keys: list[str], value: str, us: str, row_id: str) -> DataFrame:
    """(keys, value, us, id) of the earliest row of each distinct value, found by aggregation."""
    first = (rows.groupBy(*keys, value)
             .agg(F.min(F.struct(F.col(us).alias("us"), F.col(row_id).alias("id"))).alias("at")))
    return first.select(*keys, value, F.col("at.us").alias(us), F.col("at.id").alias(row_id))
