"""As-of joins: the nearest earlier or later row of another table, for series of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.series import Layout, Series
from ..schema import KEY, TIME, duration_us, micros
from .features import EVENT_DEFAULTS, HOUR_US

DIRECTIONS = ("backward", "forward")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    columns: list[str] | None = None,
    tolerance: str | int | None = None,
    exact: bool = True,
    direction: str = "backward",
    prefix: str = "",
    tie: list[str] | None = None,
    *,
    key: str = KEY,
    time: str = TIME,
    layout: Layout | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the nearest row of ``right`` at or before its time.

    ``direction="forward"`` takes the nearest at or after it, ``exact=False`` leaves rows of the same time out,
    and rows farther than ``tolerance`` do not match. Both tables have ``key`` and ``time``. Unmatched rows keep NULLs; a
    NULL key or time matches nothing. Of right rows of one time the last by ``tie`` counts (the first when looking
    ahead), any without it. The right columns are named ``prefix`` and their name, which must be new.

    Both tables go into one ordered series, so there is one exchange and no pair of rows is ever built. A series
    that holds most rows is sliced like any other; each slice gets the one right row before it. Fit a
    ``layout`` on the union of both tables' keys and times.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    columns = columns if columns is not None else [c for c in right.columns if c != key]
    ahead = direction == "forward"
    # Of one time, the right rows stand on the side from which they are met.
    met_first = exact != ahead
    order = [f"_tie{i}" for i in range(len(tie or []))]
    payload = F.struct(micros(time).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key), F.col(time), payload.alias("_right"), F.lit(0 if met_first else 1).alias("_side"), *[F.col(c).alias(n) for c, n in zip(tie or [], order)]
    )
    rows = left.withColumn("_side", F.lit(1 if met_first else 0))
    both = rows.unionByName(found, allowMissingColumns=True)
    is_right = F.col("_right").isNotNull()
    layout = layout or Layout.fit(both.select(key, time), key, time)
    side = {"carry_ahead": [is_right]} if ahead else {"carry_back": [is_right]}
    s = Series(both, layout, tie=["_side", *order], **side)
    w = s.reversed if ahead else s.window
    nearest = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = s.close(s.df.withColumn("_found", nearest).filter(~is_right))
    near = F.col("_found")
    if tolerance is not None:
        near = F.when(F.abs(near["t"] - micros(time)) <= duration_us(tolerance), near)
    near = F.when(F.col(time).isNotNull(), near)
    return joined.select(*left.columns, *[near[f"c{i}"].alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def hours_since_events(
    df: DataFrame, events: DataFrame, name: str, default: float = EVENT_DEFAULTS["meal"], *, layout: Layout | None = None
) -> DataFrame:
    """``time_since_last_<name>`` in hours, the events being a table of their own; ``default`` before the first."""
    last = asof_join(df, events.select(KEY, TIME), [TIME], prefix="_last_", layout=layout)
    hours: Column = (micros(TIME) - micros(f"_last_{TIME}")) / F.lit(HOUR_US)
    return last.withColumn(f"time_since_last_{name}", F.coalesce(hours, F.lit(default))).drop(f"_last_{TIME}")
