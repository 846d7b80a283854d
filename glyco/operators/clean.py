"""Row filters and duplicate removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import T_US, Layout, Series, settle
from ..schema import KEY, TIME, duration_us

KEEP = ("last", "first", "most_complete")


def drop_invalid_time(df: DataFrame, time: str = TIME) -> DataFrame:
    """Drop rows without a time."""
    return df.filter(F.col(time).isNotNull())


def drop_all_null_rows(df: DataFrame, keys: tuple[str, ...] = (KEY, TIME)) -> DataFrame:
    """Drop rows in which every value column is missing."""
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keys])


def dedupe_exact(df: DataFrame) -> DataFrame:
    """One of each set of equal rows."""
    return df.dropDuplicates()


def dedupe_near(
    df: DataFrame,
    keep: str = "last",
    tolerance: str | int = "60 seconds",
    *,
    layout: Layout | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """Thin out readings closer than ``tolerance`` to the reading right before.

    The gap is always to the neighbouring reading, kept or not, so a chain of close
    readings collapses to its last or first one. With ``most_complete`` each close
    pair loses the reading with more missing values, the later one on a tie.
    """
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    tol = duration_us(tolerance)
    values = [c for c in df.columns if c not in (KEY, TIME)]
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in values], F.lit(0))
    s = Series(df.withColumn("_nulls", nulls), layout, back_rows=1, ahead_rows=1, tie=tie)
    w = s.window
    near_previous = F.coalesce(F.col(T_US) - F.lag(T_US).over(w) <= tol, F.lit(False))
    near_next = F.coalesce(F.lead(T_US).over(w) - F.col(T_US) <= tol, F.lit(False))
    if keep == "last":
        drop = near_next
    elif keep == "first":
        drop = near_previous
    else:
        loses_to_next = near_next & (F.lead("_nulls").over(w) < F.col("_nulls"))
        loses_to_previous = near_previous & ~(F.col("_nulls") < F.lag("_nulls").over(w))
        drop = loses_to_next | F.coalesce(loses_to_previous, F.lit(False))
    return s.close(s.df.withColumn("_drop", drop).filter(~F.col("_drop")), "_drop", "_nulls")


def clean(
    df: DataFrame,
    keep: str = "last",
    tolerance: str | int = "60 seconds",
    *,
    layout: Layout | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """Exact duplicates, near duplicates and empty rows removed."""
    layout = layout or Layout.fit(df)
    return drop_all_null_rows(dedupe_near(settle(dedupe_exact(df), layout), keep, tolerance, layout=layout, tie=tie))


def clean_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts and retention rate of a cleaning step."""
    a = before.agg(F.count(F.lit(1)).alias("rows_in"))
    b = after.agg(F.count(F.lit(1)).alias("rows_out"))
    return a.join(b).select(
        "rows_in",
        "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("removed"),
        F.try_divide(F.col("rows_out") * 100.0, F.col("rows_in")).alias("retention_rate"),
    )


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns a table lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
