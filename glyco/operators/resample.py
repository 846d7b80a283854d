"""Regular time grids.

Empty grid rows are added to the input before one grouped aggregation, so the
grid costs no join and a long series is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.series import Layout
from ..schema import KEY, TIME, duration_us, micros
from .impute import impute_limited

DAY_US = 86_400_000_000

# Aggregate per measure; other numbers take the mean, text its first value.
DEFAULT_AGGREGATES = {
    "CGM": "mean",
    "Basal": "mean",
    "TotalBolusInsulinDelivered": "sum",
    "CorrectionDelivered": "sum",
    "FoodDelivered": "sum",
    "CarbSize": "sum",
}

# Fixed values: (how the name is tested, text, aggregate), first match wins; else first value.
NAME_RULES = [
    ("contains_case", "CGM", "mean"),
    ("contains", "glucose", "mean"),
    ("contains", "insulin", "sum"),
    ("contains", "bolus", "sum"),
    ("contains", "correction", "sum"),
    ("contains", "basal", "mean"),
    ("contains", "food", "sum"),
    ("contains", "carb", "sum"),
    ("starts", "time_since", "mean"),
    ("starts", "is_", "max"),
    ("ends", "_binary", "max"),
]


def aggregate_for(name: str) -> str:
    """Aggregate chosen by the column's name."""
    tests = {
        "contains_case": lambda text: text in name,
        "contains": lambda text: text in name.lower(),
        "starts": name.startswith,
        "ends": name.endswith,
    }
    return next((agg for how, text, agg in NAME_RULES if tests[how](text)), "first")


def _aggregate(name: str, how: str) -> Column:
    c = F.col(name)
    if how == "mean":
        return F.avg(c)
    if how == "sum":
        return F.coalesce(F.sum(c), F.lit(0.0))
    if how == "max":
        return F.max(c)
    if how == "first":
        return F.min_by(c, F.when(c.isNotNull(), F.col("_t")))
    raise ValueError(f"unknown aggregate {how}")


def grid(df: DataFrame, freq: str | int, key: str = KEY, time: str = TIME) -> DataFrame:
    """``(key, _bin)`` for every bin from the first to the last reading of a series.

    Days are listed first and bins per day after, so no single array grows with
    the length of a series in bins.
    """
    step = duration_us(freq)
    block = step * max(1, DAY_US // step)
    t = micros(time)
    first_bin, last_bin = F.floor(F.min(t) / step) * step, F.floor(F.max(t) / step) * step
    spans = df.groupBy(key).agg(first_bin.alias("_lo"), last_bin.alias("_hi")).filter("_lo is not null")
    blocks = spans.withColumn("_b", F.explode(F.sequence("_lo", "_hi", F.lit(block))))
    last = F.least(F.col("_b") + (block - step), F.col("_hi"))
    return blocks.select(key, F.explode(F.sequence("_b", last, F.lit(step))).alias("_bin"))


def _resampled(
    df: DataFrame, freq: str | int, aggregates: dict[str, str], with_grid: bool, key: str, time: str
) -> DataFrame:
    step = duration_us(freq)
    values = [c for c in df.columns if c not in (key, time)]
    t = micros(time)
    rows = df.filter(F.col(time).isNotNull()).select(
        key, (F.floor(t / step) * step).alias("_bin"), t.alias("_t"), *values
    )
    if with_grid:
        rows = rows.unionByName(grid(df, freq, key, time), allowMissingColumns=True)
    out = rows.groupBy(key, "_bin").agg(*[_aggregate(c, aggregates[c]).alias(c) for c in values])
    stamp = F.timestamp_micros(F.col("_bin"))
    zoneless = isinstance(df.schema[time].dataType, T.TimestampNTZType)
    return out.select(
        (stamp.cast("timestamp_ntz") if zoneless else stamp).alias(time), key, *values
    )


def resample(
    df: DataFrame,
    freq: str | int = "5 minutes",
    aggregates: dict[str, str] | None = None,
    *,
    key: str = KEY,
    time: str = TIME,
) -> DataFrame:
    """Bins from the first to the last reading; bins without any value are dropped.

    The sum of an empty bin is 0, so a summed column keeps the empty bins.
    """
    values = [c for c in df.columns if c not in (key, time)]
    given = {**DEFAULT_AGGREGATES, **(aggregates or {})}
    chosen = {}
    for c in values:
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        chosen[c] = given.get(c, "mean" if numeric else "first")
    summed = "sum" in chosen.values()
    out = _resampled(df, freq, chosen, summed, key, time)
    # Without a summed column an empty bin has no value and would be dropped again.
    return out if summed else out.dropna(how="all", subset=values)


def resample_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after and their ratio."""
    a = before.agg(F.count(F.lit(1)).alias("original_rows"))
    b = after.agg(F.count(F.lit(1)).alias("resampled_rows"))
    return a.join(b).withColumn(
        "compression_ratio", F.try_divide(F.col("resampled_rows").cast("double"), F.col("original_rows"))
    )


def fill_limit(freq: str | int, max_gap: str | int) -> int:
    """Consecutive bins to fill."""
    return max(1, duration_us(max_gap) // duration_us(freq))


def fill_limited(
    df: DataFrame,
    columns: list[str],
    freq: str | int,
    max_gap: str | int = "30 minutes",
    method: str = "linear",
    *,
    layout: Layout | None = None,
) -> DataFrame:
    """Fill the first bins of each gap, at most ``max_gap`` long."""
    return impute_limited(df, columns, method, fill_limit(freq, max_gap), layout=layout)


def resample_by_name(
    df: DataFrame,
    freq: str | int = "5 minutes",
    max_gap: str | int = "30 minutes",
    method: str = "linear",
    *,
    key: str = KEY,
    time: str = TIME,
    layout: Layout | None = None,
) -> DataFrame:
    """All bins of a series, aggregates chosen by column name, short gaps filled; ``layout`` is that of the grid."""
    values = [c for c in df.columns if c not in (key, time)]
    out = _resampled(df, freq, {c: aggregate_for(c) for c in values}, True, key, time)
    numeric = [c for c in values if isinstance(out.schema[c].dataType, T.NumericType)]
    return fill_limited(out, numeric, freq, max_gap, method, layout=layout)


def resampling_info(spark, freq: str = "5 minutes", max_gap: str = "30 minutes", method: str = "linear") -> DataFrame:
    """Settings of the resampler and the resulting fill limit."""
    row = (freq, method, duration_us(max_gap) // 60_000_000, fill_limit(freq, max_gap))
    return spark.createDataFrame(
        [row], "target_frequency string, interpolation_method string, max_gap_minutes long, max_gap_periods long"
    )
