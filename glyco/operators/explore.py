"""Exploratory and monitoring measures per subject and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..plans.quantiles import group_quantiles
from ..plans.series import T_US, Layout, Series
from ..schema import KEY, TARGET, TIME, duration_us, micros
from .evaluate import histogram
from .features import IOB_ROWS, insulin_on_board


def gap_histogram(df: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """Number of readings by whole seconds since the previous reading."""
    s = Series(df.select(KEY, TIME), layout, back_rows=1)
    gaps = s.df.withColumn("gap_seconds", F.floor((F.col(T_US) - F.lag(T_US).over(s.window)) / 1_000_000))
    return s.close(gaps).filter(F.col("gap_seconds").isNotNull()).groupBy("gap_seconds").agg(F.count(F.lit(1)).alias("n"))


def value_histogram(df: DataFrame, column: str = TARGET, bins: int = 60) -> DataFrame:
    """Equal bins of a column."""
    return histogram(df, F.col(column), bins)


def box_stats(df: DataFrame, column: str = TARGET, whisker: float = 1.5, *, key: str = KEY) -> DataFrame:
    """Quartiles per participant and the outermost values within the whiskers."""
    q = group_quantiles(df, [key], column, [0.25, 0.5, 0.75]).select(
        F.col(key).alias("_k"),
        F.col("quantiles")[0].alias("q25"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q75"),
    )
    reach = (F.col("q75") - F.col("q25")) * whisker
    inside = F.col(column).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        df.select(key, column)
        .join(q, F.col(key).eqNullSafe(F.col("_k")))
        .groupBy(key, "q25", "median", "q75")
        .agg(
            F.min(F.when(inside, F.col(column))).alias("whisker_low"),
            F.max(F.when(inside, F.col(column))).alias("whisker_high"),
            F.count_if(~inside).alias("n_fliers"),
        )
    )


def tir_by_participant(df: DataFrame, low: float = E.HYPO, high: float = E.RANGE_HIGH) -> DataFrame:
    """Percentage of readings in range, one decimal, lowest first."""
    share = F.avg(E.in_range(F.col(TARGET), low, high).cast("double")) * 100
    return df.groupBy(KEY).agg(F.round(share, 1).alias("tir_percent")).orderBy("tir_percent", KEY)


def daily_missing(df: DataFrame, column: str = TARGET) -> DataFrame:
    """Share of readings without a value per participant and day."""
    return df.groupBy(KEY, F.to_date(TIME).alias("day")).agg(
        F.avg(F.col(column).isNull().cast("double")).alias("missing_fraction")
    )


def daily_missing_matrix(df: DataFrame, days: list | None = None, column: str = TARGET) -> DataFrame:
    """One row per participant and one column per listed day; by default every day of the table."""
    if days is None:
        found = df.select(F.to_date(TIME).alias("d")).filter("d is not null").distinct()
        days = sorted(r.d for r in found.collect())  # one value per calendar day
    return (
        df.groupBy(KEY)
        .agg(
            *[
                F.avg(F.when(F.to_date(TIME) == F.lit(d).cast("date"), F.col(column).isNull().cast("double"))).alias(str(d))
                for d in days
            ]
        )
    )


def variability_flag(df: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Sample deviation per participant and whether it is high."""
    return df.groupBy(KEY).agg(F.stddev_samp(TARGET).alias("sd")).withColumn("high_variability", F.col("sd") > threshold)


def overnight_rise(df: DataFrame, start_hour: int = 3, end_hour: int = 6) -> DataFrame:
    """Last minus first glucose between two hours (inclusive), per participant and night."""
    t = micros(TIME)
    clock = F.pmod(t, F.lit(86_400_000_000))
    night = df.filter(F.col(TARGET).isNotNull() & clock.between(start_hour * 3_600_000_000, end_hour * 3_600_000_000))
    return (
        night.groupBy(KEY, F.to_date(TIME).alias("night"))
        .agg((F.max_by(TARGET, t) - F.min_by(TARGET, t)).alias("rise"), F.count(F.lit(1)).alias("readings"))
    )


def basal_bg_correlation(df: DataFrame, *, layout: Layout | None = None, carry: bool = True) -> DataFrame:
    """Pearson correlation of basal rate and glucose per participant.

    With ``carry`` the last known basal rate is used for a reading that has none. The correlation is null
    where either measure is constant, as it is for a single pair.
    """
    if carry:
        s = Series(df.select(KEY, TIME, "Basal", TARGET), layout, carry_back=[F.col("Basal").isNotNull()])
        last = F.last("Basal", ignorenulls=True).over(s.window.rowsBetween(Window.unboundedPreceding, 0))
        df = s.close(s.df.withColumn("Basal", last))
    pairs = df.filter(F.col("Basal").isNotNull() & F.col(TARGET).isNotNull())
    # ``corr`` divides by the spread and fails under ANSI rules where that is zero.
    spread = F.stddev_pop("Basal") * F.stddev_pop(TARGET)
    correlation = F.try_divide(F.covar_pop("Basal", TARGET), spread).alias("correlation")
    return pairs.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), correlation)


def daily_statistics(df: DataFrame, hyper: float = E.HYPER) -> DataFrame:
    """Sums per participant and day from which any longer window can be built."""
    c = F.col(TARGET)
    return df.groupBy(KEY, F.to_date(TIME).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(c).alias("n"),
        F.sum(c).alias("total"),
        F.sum(c * c).alias("squares"),
        F.count_if(E.in_range(c)).alias("in_range"),
        F.count_if(c > hyper).alias("hyper"),
    )


def rolling_14d_dashboard(df: DataFrame, days: int = 14, hyper: float = E.HYPER) -> DataFrame:
    """Range share, mean, deviation, highs and sensor share over the last days, per day.

    The window runs over one row per participant and day, not over readings.
    """
    daily = daily_statistics(df, hyper).withColumn("_d", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(KEY).orderBy("_d").rangeBetween(-(days - 1), 0)
    sums = {c: F.sum(c).over(w) for c in ("rows", "n", "total", "squares", "in_range", "hyper")}
    summed = daily.select(KEY, "day", *[v.alias(k) for k, v in sums.items()])
    n = F.col("n")
    spread = F.col("squares") - F.try_divide(F.col("total") * F.col("total"), n)
    variance = F.when(n > 1, F.greatest(F.try_divide(spread, n - 1), F.lit(0.0)))
    return summed.select(
        KEY,
        "day",
        F.try_divide(F.col("in_range") * 100.0, n).alias("tir_percent"),
        F.try_divide(F.col("total"), n).alias("avg_glucose"),
        F.sqrt(variance).alias("sd_glucose"),
        F.col("hyper").alias("n_hyper"),
        F.try_divide(n * 100.0, F.col("rows")).alias("sensor_on_percent"),
    )


def _window_of(df: DataFrame, length: str | int, end) -> DataFrame:
    """Rows in the last ``length`` up to ``end`` (default: each participant's own last reading)."""
    t = micros(TIME)
    if end is not None:
        stop = micros(F.lit(end).cast("timestamp_ntz"))
        return df.filter((t <= stop) & (t > stop - duration_us(length)))
    last = df.groupBy(F.col(KEY).alias("_k")).agg(F.max(t).alias("_last"))
    return (
        df.join(last, F.col(KEY).eqNullSafe(F.col("_k")))
        .filter(t > F.col("_last") - duration_us(length))
        .drop("_k", "_last")
    )


def sensor_uptime(
    df: DataFrame, window: str = "24 hours", cadence: str = "5 minutes", alert_above: float = 20.0, end=None
) -> DataFrame:
    """Readings received against expected in the last window, with an alert flag."""
    expected = duration_us(window) / duration_us(cadence)
    have = F.least(F.count(TARGET) / F.lit(expected), F.lit(1.0)) * 100
    return (
        _window_of(df, window, end)
        .groupBy(KEY)
        .agg(F.count(TARGET).alias("readings"), have.alias("uptime_percent"))
        .withColumn("alert", 100.0 - F.col("uptime_percent") > alert_above)
    )


def latest_metrics(df: DataFrame, window: str = "60 minutes", end=None) -> DataFrame:
    """Mean glucose, range share and sensor share of the last window, per participant."""
    c = F.col(TARGET)
    return (
        _window_of(df, window, end)
        .groupBy(KEY)
        .agg(
            F.avg(c).alias("avg_bg"),
            (F.avg(E.in_range(c).cast("double")) * 100).alias("time_in_range_pct"),
            (F.count(c) * 100.0 / F.count(F.lit(1))).alias("sensor_on_pct"),
        )
    )


def worst_days(df: DataFrame, n: int = 3) -> DataFrame:
    """The days with the least time in range, per participant (a top-n report)."""
    daily = daily_statistics(df).filter(F.col("n") > 0)
    ranked = daily.withColumn("tir_percent", F.col("in_range") * 100.0 / F.col("n"))
    w = Window.partitionBy(KEY).orderBy("tir_percent", "day")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(KEY, "day", "tir_percent", "rank")


def patient_snapshot(df: DataFrame, *, rows: int | None = IOB_ROWS, layout: Layout | None = None) -> DataFrame:
    """Latest glucose, its trend, mean, insulin on board (of ``rows`` rows), time since the last meal and reading."""
    with_iob = insulin_on_board(df, rows=rows, layout=layout).withColumnRenamed("insulin_on_board", "_iob")
    t, c = micros(TIME), F.col(TARGET)
    known = F.when(c.isNotNull(), t)
    # Two newest readings: the second newest is the newest before the newest.
    per = with_iob.groupBy(KEY).agg(
        F.max_by(c, known).alias("latest_bg"),
        F.max(known).alias("_reading"),
        F.avg(c).alias("avg_bg"),
        F.max_by("_iob", t).alias("insulin_on_board"),
        F.max(t).alias("_last"),
        F.max(F.when(F.col("FoodDelivered") > 0, t)).alias("_meal"),
    )
    earlier = (
        df.select(F.col(KEY).alias("_k"), c.alias("_v"), t.alias("_t"))
        .filter(F.col("_v").isNotNull())
        .join(per.select(F.col(KEY).alias("_p"), "_reading"), F.col("_k").eqNullSafe(F.col("_p")))
        .filter(F.col("_t") < F.col("_reading"))
        .groupBy("_k")
        .agg(F.max_by("_v", "_t").alias("_previous"))
    )
    joined = per.join(earlier, F.col(KEY).eqNullSafe(F.col("_k")), "left")
    trend = F.when(F.col("_previous").isNull(), "stable").when(F.col("latest_bg") > F.col("_previous"), "rising")
    return joined.select(
        KEY,
        "latest_bg",
        trend.otherwise("falling").alias("trend"),
        "avg_bg",
        "insulin_on_board",
        ((F.col("_last") - F.col("_reading")) / 60_000_000.0).alias("minutes_since_reading"),
        ((F.col("_last") - F.col("_meal")) / 60_000_000.0).alias("minutes_since_meal"),
        E.glucose_status(F.col("latest_bg")).alias("status"),
    )


def status_of_readings(df: DataFrame, value: str = TARGET, *, layout: Layout | None = None) -> DataFrame:
    """Status, trend against the previous reading, and advice for every reading."""
    known = df.filter(F.col(value).isNotNull())
    s = Series(known, layout, back_rows=1)
    before: Column = F.lag(value).over(s.window)
    trend = F.when(before.isNull(), "stable").when(F.col(value) > before, "rising").otherwise("falling")
    out = s.close(s.df.withColumn("trend", trend))
    out = out.withColumn("status", E.glucose_status(F.col(value)))
    return out.withColumn("advice", E.status_advice(F.col("status")))
