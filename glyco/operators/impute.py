"""Missing-value strategies.

Ordered strategies work per series; statistics are over the whole column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.quantiles import quantiles
from ..plans.series import T_US, Layout, Series, row_index, settle
from ..schema import KEY, TIME, duration_us

STRATEGIES = ("forward_fill", "interpolation", "median", "mean", "zero_fill", "drop")

# Strategy per measure when none is given; other columns use the median.
DEFAULT_STRATEGIES = {
    "CGM": "interpolation",
    "Basal": "forward_fill",
    "TotalBolusInsulinDelivered": "zero_fill",
    "CorrectionDelivered": "zero_fill",
    "FoodDelivered": "zero_fill",
    "CarbSize": "zero_fill",
}

PAST = (Window.unboundedPreceding, Window.currentRow)


def impute_ffill(df: DataFrame, columns: list[str], *, layout: Layout | None = None) -> DataFrame:
    """Last known value; the head of a series takes its first known value."""
    present = [F.col(c).isNotNull() for c in columns]
    s = Series(df, layout, carry_back=present, carry_ahead=present)
    filled = s.df.withColumns(
        {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(s.window.rowsBetween(*PAST)),
                F.last(c, ignorenulls=True).over(s.reversed.rowsBetween(*PAST)),
            )
            for c in columns
        }
    )
    return s.close(filled).select(df.columns)


def impute_interpolate(
    df: DataFrame,
    columns: list[str],
    mode: str = "position",
    max_gap: str | int | None = None,
    limit: int | None = None,
    *,
    layout: Layout | None = None,
) -> DataFrame:
    """Straight line between the neighbouring known values.

    ``mode="position"`` spaces rows evenly, ``"time"`` uses their times. Leading gaps
    stay, trailing gaps repeat the last value. ``max_gap`` leaves longer gaps alone,
    ``limit`` fills only the first rows of a gap.
    """
    if mode not in ("position", "time"):
        raise ValueError("mode must be position or time")
    layout = layout or Layout.fit(df)
    present = [F.col(c).isNotNull() for c in columns]
    s = Series(settle(row_index(df, layout, "_rn"), layout), layout, carry_back=present, carry_ahead=present, tie=["_rn"])
    past, future = s.window.rowsBetween(*PAST), s.reversed.rowsBetween(*PAST)
    wide = s.df.withColumns(
        {
            name: value
            for c in columns
            for known in [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_rn").alias("r"), F.col(T_US).alias("t")))]
            for name, value in (
                (f"_lo_{c}", F.last(known, ignorenulls=True).over(past)),
                (f"_hi_{c}", F.last(known, ignorenulls=True).over(future)),
            )
        }
    )
    at = ("r", "_rn") if mode == "position" else ("t", T_US)
    out = {}
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        share = F.try_divide(F.col(at[1]) - lo[at[0]], hi[at[0]] - lo[at[0]])
        value = F.when(hi["v"].isNull(), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * share)
        allowed = F.lit(True)
        if max_gap is not None:
            allowed = allowed & F.coalesce(hi["t"] - lo["t"] <= duration_us(max_gap), F.lit(True))
        if limit is not None:
            allowed = allowed & (F.col("_rn") - lo["r"] <= limit)
        out[c] = F.coalesce(F.col(c), F.when(allowed, value))
    return s.close(wide.withColumns(out)).select(df.columns)


def impute_limited(
    df: DataFrame, columns: list[str], method: str, limit: int, *, layout: Layout | None = None
) -> DataFrame:
    """``linear``, ``ffill`` or ``bfill`` over at most ``limit`` consecutive rows of a gap."""
    if method == "linear":
        return impute_interpolate(df, columns, limit=limit, layout=layout)
    if method not in ("ffill", "bfill"):
        raise ValueError("method must be linear, ffill or bfill")
    back = method == "ffill"
    rows = {"back_rows": limit} if back else {"ahead_rows": limit}
    s = Series(df, layout, **rows)
    frame = s.window.rowsBetween(-limit, 0) if back else s.window.rowsBetween(0, limit)
    pick = F.last if back else F.first
    filled = s.df.withColumns({c: pick(c, ignorenulls=True).over(frame) for c in columns})
    return s.close(filled).select(df.columns)


def _fill_values(df: DataFrame, columns: list[str], statistic: str) -> dict[str, object]:
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    other = [c for c in columns if c not in numeric]
    values: dict[str, object] = {}
    if numeric and statistic == "median":
        values = {c: q[0] for c, q in quantiles(df, numeric, [0.5]).items()}
    elif numeric:
        values = df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    for c in other:
        top = (
            df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), F.asc(c)).first()
        )
        values[c] = top[c] if top else "Unknown"
    return values


def impute_statistic(df: DataFrame, columns: list[str], statistic: str = "median") -> DataFrame:
    """Median or mean for numbers, the most frequent value (else ``Unknown``) for text."""
    if statistic not in ("median", "mean"):
        raise ValueError("statistic must be median or mean")
    values = _fill_values(df, columns, statistic)
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
            for c, v in values.items()
            if v is not None
        }
    )


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become 0."""
    return df.fillna(0, subset=columns)


def impute_drop(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a missing value are dropped."""
    return df.dropna(subset=columns)


def impute(
    df: DataFrame, strategies: dict[str, str] | None = None, *, layout: Layout | None = None
) -> DataFrame:
    """Apply a strategy per column; unlisted columns take the median (text: the mode)."""
    chosen = {
        c: {**DEFAULT_STRATEGIES, **(strategies or {})}.get(c, "median")
        for c in df.columns
        if c not in (KEY, TIME)
    }
    unknown = set(chosen.values()) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    groups: dict[str, list[str]] = {}
    for c, strategy in chosen.items():
        groups.setdefault(strategy, []).append(c)
    layout = layout or Layout.fit(df)
    out = df
    for statistic in ("median", "mean"):
        if statistic in groups:
            out = impute_statistic(out, groups[statistic], statistic)
    if "zero_fill" in groups:
        out = impute_zero(out, groups["zero_fill"])
    if "interpolation" in groups:
        out = impute_interpolate(settle(out, layout), groups["interpolation"], layout=layout)
    if "forward_fill" in groups:
        out = impute_ffill(settle(out, layout), groups["forward_fill"], layout=layout)
    if "drop" in groups:
        out = impute_drop(out, groups["drop"])
    return out


def impute_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing values per column before and after, and the share that was filled."""
    from .quality import missing_stats

    a = missing_stats(before).select("column", F.col("missing").alias("missing_before"))
    b = missing_stats(after).select("column", F.col("missing").alias("missing_after"))
    return a.join(b, "column").withColumn(
        "imputation_rate",
        F.coalesce(
            F.try_divide((F.col("missing_before") - F.col("missing_after")) * 100.0, F.col("missing_before")),
            F.lit(0.0),
        ),
    )
