"""Window features per series.

Ordering columns are whole microseconds, so row frames and time frames share one
exchange and one sort. A rolling window of length L is ``(t - L, t]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..plans.series import T_US, Layout, Series, settle
from ..schema import TARGET, TIME, duration_us
from .impute import PAST

HOUR_US = 3_600_000_000.0

INSULIN_WINDOWS = (("1h", "1 hour"), ("3h", "3 hours"), ("6h", "6 hours"))
ROLLING_WINDOWS = (("30min", "30 minutes"), ("1h", "1 hour"), ("2h", "2 hours"))
LAG_MINUTES = (5, 10, 15, 30, 45, 60, 90, 120)
CADENCE_MINUTES = 5
IOB_ROWS = 100  # earlier rows that active insulin looks at by default

Windows = tuple[tuple[str, str], ...]

# Hours reported before the first event of a series.
EVENT_DEFAULTS = {"meal": 24.0, "bolus": 12.0, "basal": 6.0}

TEMPORAL = (
    "hour_of_day day_of_week day_of_month month is_weekend hour_sin hour_cos day_sin day_cos "
    "time_since_last_meal time_since_last_bolus time_since_last_basal"
).split()
INSULIN = (
    "cumulative_insulin_1h cumulative_insulin_3h cumulative_insulin_6h cumulative_bolus_1h "
    "cumulative_bolus_3h cumulative_correction_1h insulin_on_board active_insulin_effect "
    "bolus_to_basal_ratio correction_ratio avg_basal_rate_1h"
).split()
GLUCOSE = (
    "glucose_trend_15min glucose_trend_30min glucose_trend_60min glucose_rate_of_change "
    "glucose_acceleration glucose_variability_1h glucose_variability_3h glucose_cv_1h "
    "time_in_range_3h time_in_range_6h time_below_range_3h time_above_range_3h is_hypoglycemic "
    "is_hyperglycemic is_in_target_range glucose_risk_index glucose_stability_index"
).split()
LAG = [f"{TARGET}_lag_{m}min" for m in LAG_MINUTES] + [
    f"{TARGET}_rolling_{s}_{w}" for w, _ in ROLLING_WINDOWS for s in ("mean", "std")
]
FAMILIES = {"temporal": TEMPORAL, "insulin": INSULIN, "glucose": GLUCOSE, "lag": LAG}
ALL_FEATURES = [name for names in FAMILIES.values() for name in names]


def feature_groups(spark) -> DataFrame:
    """Feature name and family."""
    rows = [(name, family) for family, names in FAMILIES.items() for name in names]
    return spark.createDataFrame(rows, "feature string, family string")


def over_time(w: WindowSpec, length: str | int) -> WindowSpec:
    """The frame ``(t - length, t]``."""
    return w.rangeBetween(-(duration_us(length) - 1), 0)


# --- expressions over an open series -------------------------------------------------


def _hours_since(w: WindowSpec, event: Column, default: float) -> Column:
    # Rows of equal time are peers, so their order does not matter.
    last = F.max(F.when(event, F.col(T_US))).over(w.rangeBetween(*PAST))
    return F.coalesce((F.col(T_US) - last) / F.lit(HOUR_US), F.lit(default))


def _basal_changed(w: WindowSpec) -> Column:
    return F.coalesce(F.abs(F.col("Basal") - F.lag("Basal").over(w)) > 0.01, F.lit(False))


def _dose(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


BOLUS, CORRECTION, BASAL = "TotalBolusInsulinDelivered", "CorrectionDelivered", "Basal"


def _insulin_sums(w: WindowSpec, windows: Windows) -> dict[str, Column]:
    short, middle, _ = [over_time(w, length) for _, length in windows]
    (s, _), (m, _), _ = windows
    out = {
        f"cumulative_insulin_{name}": F.sum(_dose(BOLUS) + _dose(BASAL)).over(over_time(w, length))
        for name, length in windows
    }
    out[f"cumulative_bolus_{s}"] = F.sum(_dose(BOLUS)).over(short)
    out[f"cumulative_bolus_{m}"] = F.sum(_dose(BOLUS)).over(middle)
    out[f"cumulative_correction_{s}"] = F.sum(_dose(CORRECTION)).over(short)
    out[f"avg_basal_rate_{s}"] = F.avg(_dose(BASAL)).over(short)
    return out


def _bolus_reach(rows: int | None, duration: float) -> dict[str, int]:
    return {"back_rows": rows} if rows else {"back_span": duration_us(f"{duration} minutes")}


class _ActiveDoses:
    """Sums of the boluses that act at a row, as differences of running sums.

    A dose at time t counts ``u * exp(k t)`` for what is left of it, and ``u`` and ``u * t`` for the
    two straight lines of its effect. Times are taken from the start of a bucket as long as the duration, so
    that nothing grows with the series; the doses in reach of a row lie in its bucket and the one before, which
    even and odd sums keep apart. All terms are positive, so of two starting points (a number of rows back,
    a time back) the larger running sum is the later one. A dose that is no finite positive number does not count.
    """

    def __init__(self, w: WindowSpec, rows: int | None, duration: float, peak: float):
        self.width, self.duration, self.peak = duration_us(f"{duration} minutes"), duration, peak
        bucket = F.floor(F.col(T_US) / self.width)
        self.odd = F.pmod(bucket, F.lit(2)) == 1
        self.since = (F.col(T_US) - bucket * self.width) / 60_000_000.0
        self.rate = E.DECAY_CONSTANT / duration / 60.0
        given = (F.col(BOLUS) > 0) & (F.col(BOLUS) < float("inf"))
        dose = F.when(given, F.col(BOLUS)).otherwise(0.0)
        terms = {"n": F.when(given, 1).otherwise(0)}
        for side, mine in (("odd", self.odd), ("even", ~self.odd)):
            u = F.when(mine, dose).otherwise(0.0)
            terms |= {f"e_{side}": u * F.exp(self.since * self.rate), f"u_{side}": u, f"v_{side}": u * self.since}
        self.terms = {f"_{name}": term for name, term in terms.items()}
        first = Window.unboundedPreceding
        # Without a limit rows of the same time do not count, within a number of rows those before do.
        self.frames = {
            "now": w.rangeBetween(first, -1) if rows is None else w.rowsBetween(first, -1),
            "gone": w.rangeBetween(first, -self.width),
            "past_peak": w.rangeBetween(first, -duration_us(f"{peak} minutes") - 1),
        }
        if rows is not None:
            self.frames["row"] = w.rowsBetween(first, -rows - 1)
        self.limited = rows is not None

    def _names(self, on_board: bool, effect: bool) -> dict[str, list[str]]:
        """Terms whose running sum is needed at each point."""
        at_start = ["_n"] + [f"_{t}_{s}" for t, used in (("e", on_board), ("u", effect), ("v", effect)) if used for s in ("odd", "even")]
        wanted = {"now": at_start, "gone": at_start, "past_peak": [n for n in at_start if n[1] in "uv"]}
        return wanted | ({"row": at_start} if self.limited else {})

    def sums(self, on_board: bool, effect: bool) -> dict[str, Column]:
        """Running sums as columns, over ``terms``."""
        return {
            f"{name}_{point}": F.coalesce(F.sum(name).over(self.frames[point]), F.lit(0))
            for point, names in self._names(on_board, effect).items()
            for name in names
        }

    def _between(self, term: str, start: str, end: str) -> Column:
        def at(point: str) -> Column:
            sums = F.col(f"{term}_{point}")
            return F.greatest(sums, F.col(f"{term}_row")) if self.limited and point != "now" else sums

        return at(end) - at(start)

    def _sides(self, term: str, start: str, end: str) -> tuple[Column, Column]:
        """The sum in the row's own bucket and in the one before."""
        odd, even = self._between(f"_{term}_odd", start, end), self._between(f"_{term}_even", start, end)
        return F.when(self.odd, odd).otherwise(even), F.when(self.odd, even).otherwise(odd)

    def on_board(self) -> Column:
        own, before = self._sides("e", "gone", "now")
        left = (own + before * F.exp(F.lit(-self.rate * self.duration))) * F.exp(-self.since * self.rate)
        return F.when(self._between("_n", "gone", "now") > 0, left).otherwise(0.0)

    def effect(self) -> Column:
        def minutes(start: str, end: str) -> tuple[Column, Column]:
            """Units, and units times minutes since they were given."""
            (u0, u1), (v0, v1) = self._sides("u", start, end), self._sides("v", start, end)
            return u0 + u1, u0 * self.since - v0 + u1 * (self.since + self.duration) - v1

        _, rising = minutes("past_peak", "now")
        units, falling = minutes("gone", "past_peak")
        total = rising / self.peak + (units * self.duration - falling) / (self.duration - self.peak)
        return F.when(self._between("_n", "gone", "now") > 0, total).otherwise(0.0)

    def helpers(self, on_board: bool, effect: bool) -> list[str]:
        return [*self.terms, *self.sums(on_board, effect)]


def _glucose_changes(w: WindowSpec) -> dict[str, Column]:
    def back(name: str, k: int) -> Column:
        return F.lag(name, k).over(w) if k else F.col(name)

    def slope(k: int) -> Column:
        rise = back(TARGET, k) - back(TARGET, k + 1)
        minutes = (back(T_US, k) - back(T_US, k + 1)) / 60_000_000.0
        return F.try_divide(rise, minutes)

    c = F.col(TARGET)
    zero = F.lit(0.0)
    out = {
        f"glucose_trend_{CADENCE_MINUTES * k}min": F.coalesce(c - F.lag(c, k).over(w), zero)
        for k in (3, 6, 12)
    }
    out["glucose_rate_of_change"] = F.coalesce(slope(0), zero)
    out["glucose_acceleration"] = F.coalesce(slope(0) - slope(1), zero)
    return out


def _spread(w: WindowSpec, length: str) -> Column:
    return F.coalesce(F.stddev_samp(TARGET).over(over_time(w, length)), F.lit(0.0))


def _variability(w: WindowSpec, windows: Windows) -> dict[str, Column]:
    (s, short), (m, middle), _ = windows
    mean = F.avg(TARGET).over(over_time(w, short))
    return {
        f"glucose_variability_{s}": _spread(w, short),
        f"glucose_variability_{m}": _spread(w, middle),
        f"glucose_cv_{s}": F.coalesce(F.try_divide(_spread(w, short), mean), F.lit(0.0)),
    }


def _share(w: WindowSpec, test: Column, length: str) -> Column:
    # A comparison with a missing reading counts as false.
    return F.avg(F.coalesce(test, F.lit(False)).cast("double")).over(over_time(w, length))


def _time_in_range(w: WindowSpec, windows: Windows) -> dict[str, Column]:
    c = F.col(TARGET)
    _, (m, middle), (l, long) = windows
    return {
        f"time_in_range_{m}": _share(w, E.in_range(c), middle),
        f"time_in_range_{l}": _share(w, E.in_range(c), long),
        f"time_below_range_{m}": _share(w, c < E.HYPO, middle),
        f"time_above_range_{m}": _share(w, c > E.RANGE_HIGH, middle),
    }


def _states(hyper: float = E.HYPER) -> dict[str, Column]:
    c = F.col(TARGET)

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    centre = (E.HYPO + E.RANGE_HIGH) / 2
    return {
        "is_hypoglycemic": flag(c < E.HYPO),
        "is_hyperglycemic": flag(c > hyper),
        "is_in_target_range": flag(E.in_range(c)),
        "glucose_risk_index": F.abs(c - centre) / centre,
    }


def _rolling(w: WindowSpec, column: str, windows: Windows, mean: float | None) -> dict[str, Column]:
    out = {}
    for name, length in windows:
        frame = over_time(w, length)
        out[f"{column}_rolling_mean_{name}"] = F.coalesce(F.avg(column).over(frame), F.lit(mean).cast("double"))
        out[f"{column}_rolling_std_{name}"] = F.coalesce(F.stddev_samp(column).over(frame), F.lit(0.0))
    return out


def _lags(w: WindowSpec, column: str, steps: dict[str, int], mean: float | None) -> dict[str, Column]:
    return {
        f"{column}_lag_{name}": F.coalesce(F.lag(column, k).over(w), F.lit(mean).cast("double"))
        for name, k in steps.items()
    }


def _longest(windows: Windows) -> int:
    return max(duration_us(length) for _, length in windows)


# --- operators -----------------------------------------------------------------------


def calendar_features(df: DataFrame, time: str = TIME) -> DataFrame:
    """Hour, weekday, day, month, weekend."""
    return df.withColumns(E.calendar(F.col(time)))


def cyclical_features(df: DataFrame, time: str = TIME) -> DataFrame:
    """Sine and cosine of hour and weekday."""
    return df.withColumns(E.cyclical(F.col(time)))


def time_since_event(df: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """Hours since the last meal, bolus and basal change; the current row counts."""
    layout = layout or Layout.fit(df)
    first = Series(df, layout, back_rows=1)
    marked = settle(first.close(first.df.withColumn("_basal", _basal_changed(first.window))), layout)
    meal, bolus, basal = F.col("FoodDelivered") > 0, F.col(BOLUS) > 0, F.col("_basal")
    s = Series(marked, layout, carry_back=[meal, bolus, basal])
    out = s.df.withColumns(
        {
            "time_since_last_meal": _hours_since(s.window, meal, EVENT_DEFAULTS["meal"]),
            "time_since_last_bolus": _hours_since(s.window, bolus, EVENT_DEFAULTS["bolus"]),
            "time_since_last_basal": _hours_since(s.window, basal, EVENT_DEFAULTS["basal"]),
        }
    )
    return s.close(out, "_basal")


def rolling_insulin(
    df: DataFrame, windows: Windows = INSULIN_WINDOWS, *, layout: Layout | None = None
) -> DataFrame:
    """Insulin totals over three windows, bolus over two, correction and mean basal over one."""
    s = Series(df, layout, back_span=_longest(windows))
    return s.close(s.df.withColumns(_insulin_sums(s.window, windows)))


def insulin_on_board(
    df: DataFrame, duration: float = E.INSULIN_DURATION, *, rows: int | None = IOB_ROWS, layout: Layout | None = None
) -> DataFrame:
    """Units of the boluses in the previous ``rows`` rows that still act; ``rows=None`` takes all within ``duration``."""
    s = Series(df, layout, **_bolus_reach(rows, duration))
    doses = _ActiveDoses(s.window, rows, duration, E.INSULIN_PEAK)
    summed = s.df.withColumns(doses.terms).withColumns(doses.sums(True, False))
    return s.close(summed.withColumn("insulin_on_board", doses.on_board()), *doses.helpers(True, False))


def active_insulin_effect(
    df: DataFrame,
    duration: float = E.INSULIN_DURATION,
    peak: float = E.INSULIN_PEAK,
    *,
    rows: int | None = IOB_ROWS,
    layout: Layout | None = None,
) -> DataFrame:
    """Current effect of the boluses in the previous ``rows`` rows; ``rows=None`` takes all within ``duration``."""
    s = Series(df, layout, **_bolus_reach(rows, duration))
    doses = _ActiveDoses(s.window, rows, duration, peak)
    summed = s.df.withColumns(doses.terms).withColumns(doses.sums(False, True))
    return s.close(summed.withColumn("active_insulin_effect", doses.effect()), *doses.helpers(False, True))


def insulin_ratios(df: DataFrame) -> DataFrame:
    """Bolus per basal and correction per bolus."""
    return df.withColumns(
        {
            "bolus_to_basal_ratio": E.ratio_or_zero(_dose(BOLUS), _dose(BASAL)),
            "correction_ratio": E.ratio_or_zero(_dose(CORRECTION), _dose(BOLUS)),
        }
    )


def _filled(df: DataFrame, layout: Layout, column: str = TARGET) -> DataFrame:
    s = Series(df, layout, carry_back=[F.col(column).isNotNull()])
    value = F.last(column, ignorenulls=True).over(s.window.rowsBetween(*PAST))
    return settle(s.close(s.df.withColumn(column, value)), layout)


def glucose_trends(df: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """Changes over 3, 6 and 12 readings of the forward-filled glucose."""
    layout = layout or Layout.fit(df)
    s = Series(_filled(df, layout), layout, back_rows=12)
    changes = _glucose_changes(s.window)
    return s.close(s.df.withColumns({k: v for k, v in changes.items() if "trend" in k}))


def rate_of_change(df: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """mg/dL per minute and its change."""
    layout = layout or Layout.fit(df)
    s = Series(_filled(df, layout), layout, back_rows=2)
    changes = _glucose_changes(s.window)
    return s.close(s.df.withColumns({k: v for k, v in changes.items() if "trend" not in k}))


def glucose_variability(
    df: DataFrame, windows: Windows = INSULIN_WINDOWS, *, layout: Layout | None = None
) -> DataFrame:
    """Deviation over two windows and the coefficient of variation."""
    layout = layout or Layout.fit(df)
    s = Series(_filled(df, layout), layout, back_span=_longest(windows))
    return s.close(s.df.withColumns(_variability(s.window, windows)))


def rolling_time_in_range(
    df: DataFrame, windows: Windows = INSULIN_WINDOWS, *, layout: Layout | None = None
) -> DataFrame:
    """Share of readings in, below and above the range."""
    layout = layout or Layout.fit(df)
    s = Series(_filled(df, layout), layout, back_span=_longest(windows))
    return s.close(s.df.withColumns(_time_in_range(s.window, windows)))


def glucose_states(df: DataFrame, hyper: float = E.HYPER) -> DataFrame:
    """Hypo, hyper and in-range flags."""
    flags = _states(hyper)
    return df.withColumns({k: v for k, v in flags.items() if k.startswith("is_")})


def glucose_risk_index(df: DataFrame) -> DataFrame:
    """Distance from the centre of the range, relative to the centre."""
    return df.withColumn("glucose_risk_index", _states()["glucose_risk_index"])


def glucose_stability_index(
    df: DataFrame, window: str = "1 hour", *, layout: Layout | None = None
) -> DataFrame:
    """1 / (1 + deviation)."""
    layout = layout or Layout.fit(df)
    s = Series(_filled(df, layout), layout, back_span=duration_us(window))
    return s.close(s.df.withColumn("glucose_stability_index", 1.0 / (1.0 + _spread(s.window, window))))


def lag_features(
    df: DataFrame,
    column: str = TARGET,
    minutes: tuple[int, ...] = LAG_MINUTES,
    *,
    layout: Layout | None = None,
) -> DataFrame:
    """Values some readings earlier; missing ones take the last known, then the column mean."""
    layout = layout or Layout.fit(df)
    mean = df.agg(F.avg(column)).first()[0]
    steps = {f"{m}min": m // CADENCE_MINUTES for m in minutes}
    # A lag of the forward-filled column is the forward-filled lag.
    filled = _filled(df.withColumn("_raw", F.col(column)), layout, column)
    s = Series(filled, layout, back_rows=max(steps.values()))
    out = s.close(s.df.withColumns(_lags(s.window, column, steps, mean)))
    return out.withColumn(column, F.col("_raw")).drop("_raw")


def rolling_stats(
    df: DataFrame,
    column: str = TARGET,
    windows: Windows = ROLLING_WINDOWS,
    *,
    layout: Layout | None = None,
) -> DataFrame:
    """Rolling mean and deviation; an empty window takes the column mean and 0."""
    mean = df.agg(F.avg(column)).first()[0]
    s = Series(df, layout, back_span=_longest(windows))
    return s.close(s.df.withColumns(_rolling(s.window, column, windows, mean)))


def all_features(
    df: DataFrame, *, layout: Layout | None = None, mean: float | None = None, iob_rows: int | None = IOB_ROWS
) -> DataFrame:
    """The 54 features over two passes of the same ordering; glucose comes out forward-filled.

    ``iob_rows`` limits how many earlier rows active insulin looks at, None to all within its duration.

    ``mean`` is the glucose mean used for readings without a past; it is measured
    when not given (give the training mean to features of other data).
    """
    layout = layout or Layout.fit(df)
    first = Series(df, layout, back_rows=1, carry_back=[F.col(TARGET).isNotNull()])
    value = F.last(TARGET, ignorenulls=True).over(first.window.rowsBetween(*PAST))
    prepared = settle(
        first.close(first.df.withColumns({"_basal": _basal_changed(first.window), TARGET: value})), layout
    )
    if mean is None:
        mean = prepared.agg(F.avg(TARGET)).first()[0]
    meal, bolus, basal = F.col("FoodDelivered") > 0, F.col(BOLUS) > 0, F.col("_basal")
    s = Series(
        prepared,
        layout,
        back_rows=iob_rows or 0,
        back_span=max(_longest(INSULIN_WINDOWS), *_bolus_reach(None, E.INSULIN_DURATION).values()),
        carry_back=[meal, bolus, basal],
    )
    w = s.window
    steps = {f"{m}min": m // CADENCE_MINUTES for m in LAG_MINUTES}
    doses = _ActiveDoses(w, iob_rows, E.INSULIN_DURATION, E.INSULIN_PEAK)
    wide = s.df.withColumns(doses.terms).withColumns(
        {
            "time_since_last_meal": _hours_since(w, meal, EVENT_DEFAULTS["meal"]),
            "time_since_last_bolus": _hours_since(w, bolus, EVENT_DEFAULTS["bolus"]),
            "time_since_last_basal": _hours_since(w, basal, EVENT_DEFAULTS["basal"]),
            **doses.sums(True, True),
            **_insulin_sums(w, INSULIN_WINDOWS),
            **_glucose_changes(w),
            **_variability(w, INSULIN_WINDOWS),
            **_time_in_range(w, INSULIN_WINDOWS),
            "glucose_stability_index": 1.0 / (1.0 + _spread(w, "1 hour")),
            **_lags(w, TARGET, steps, mean),
            **_rolling(w, TARGET, ROLLING_WINDOWS, mean),
        }
    )
    active = wide.withColumns({"insulin_on_board": doses.on_board(), "active_insulin_effect": doses.effect()})
    out = s.close(active, *doses.helpers(True, True), "_basal").withColumns(
        {**E.calendar(F.col(TIME)), **E.cyclical(F.col(TIME)), **_states()}
    )
    # Downstream steps see an undelivered dose as 0.
    return insulin_ratios(out).withColumns({c: _dose(c) for c in (BOLUS, CORRECTION, BASAL)})
