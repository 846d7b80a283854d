"""Window features and scaling."""

from __future__ import annotations


from glyco.operators import features as X
from glyco.operators.scaling import Scaler, scale_clean
from glyco.plans.pipelines import engineer_features as engineer
from glyco.plans.pipelines import preprocess as run_preprocess
from glyco.sources.events import load_cgm

from .base import cgm_sql, query, r, rounded

W = "PARTITION BY participant_id ORDER BY epoch_us(EventDateTime)"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
DAYS = (("1d", "1 day"), ("3d", "3 days"), ("7d", "7 days"))
HOURS = (("1h", "1 hour"), ("3h", "3 hours"), ("6h", "6 hours"))
US = {"hour": 3_600_000_000, "hours": 3_600_000_000, "day": 86_400_000_000, "days": 86_400_000_000, "minutes": 60_000_000}
BASE = "event_id"


def us(length):
    n, unit = length.split()
    return int(n) * US[unit]


def over(length):
    return f"OVER ({W} RANGE BETWEEN {us(length) - 1} PRECEDING AND CURRENT ROW)"


@query(
    "calendar_features",
    """SELECT event_id, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, day(ts)::INT AS day_of_month,
       month(ts)::INT AS month, (isodow(ts) >= 6)::INT AS is_weekend FROM events""",
)
def calendar_features(spark, d):
    names = ["hour_of_day", "day_of_week", "day_of_month", "month", "is_weekend"]
    return X.calendar_features(load_cgm(spark, d)).select(BASE, *names)


CYCLES = ", ".join(
    r(f"{fn}(2 * pi() * {value} / {period})", name)
    for fn, value, period, name in [
        ("sin", "hour(ts)", 24, "hour_sin"), ("cos", "hour(ts)", 24, "hour_cos"),
        ("sin", "(isodow(ts) - 1)", 7, "day_sin"), ("cos", "(isodow(ts) - 1)", 7, "day_cos"),
    ]
)


@query("cyclical_features", f"SELECT event_id, {CYCLES} FROM events")
def cyclical_features(spark, d):
    names = ["hour_sin", "hour_cos", "day_sin", "day_cos"]
    return rounded(X.cyclical_features(load_cgm(spark, d)).select(BASE, *names))


def since(event, default):
    last = f"max(CASE WHEN {event} THEN epoch_us(EventDateTime) END) OVER ({W} {PAST})"
    return f"coalesce((epoch_us(EventDateTime) - {last}) / 3600000000.0::DOUBLE, {default})"


CHANGED = f"changed AS (SELECT *, coalesce(abs(Basal - lag(Basal) OVER ({W})) > 0.01, FALSE) AS basal_changed FROM cgm)"
SINCE = {
    "time_since_last_meal": since("FoodDelivered > 0", 24),
    "time_since_last_bolus": since("TotalBolusInsulinDelivered > 0", 12),
    "time_since_last_basal": since("basal_changed", 6),
}


@query("time_since_event", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in SINCE.items()) + " FROM changed", CHANGED))
def time_since_event(spark, d):
    return rounded(X.time_since_event(load_cgm(spark, d)).select(BASE, *SINCE))


def insulin_sums(windows):
    (s, short), (m, middle), _ = windows
    dose = {k: f"coalesce({c}, 0)" for k, c in {"bolus": "TotalBolusInsulinDelivered", "basal": "Basal", "corr": "CorrectionDelivered"}.items()}
    out = {f"cumulative_insulin_{n}": f"sum({dose['bolus']} + {dose['basal']}) {over(length)}" for n, length in windows}
    out[f"cumulative_bolus_{s}"] = f"sum({dose['bolus']}) {over(short)}"
    out[f"cumulative_bolus_{m}"] = f"sum({dose['bolus']}) {over(middle)}"
    out[f"cumulative_correction_{s}"] = f"sum({dose['corr']}) {over(short)}"
    out[f"avg_basal_rate_{s}"] = f"avg({dose['basal']}) {over(short)}"
    return out


INSULIN_DAYS = insulin_sums(DAYS)


@query("rolling_insulin", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in INSULIN_DAYS.items()) + " FROM cgm"))
def rolling_insulin(spark, d):
    return rounded(X.rolling_insulin(load_cgm(spark, d), DAYS).select(BASE, *INSULIN_DAYS))


def acting(duration, peak):
    """Insulin on board and effect by a bounded self-join on row numbers."""
    minutes = "((epoch_us(a.EventDateTime) - epoch_us(b.EventDateTime)) / 60000000.0::DOUBLE)"
    decay = f"CASE WHEN {minutes} <= 0 THEN 1 WHEN {minutes} >= {duration} THEN 0 ELSE exp(-(4.0::DOUBLE / {duration}) * {minutes} / 60) END"
    effect = (
        f"CASE WHEN {minutes} <= 0 OR {minutes} >= {duration} THEN 0 WHEN {minutes} <= {peak} THEN {minutes} / {peak} "
        f"ELSE ({duration} - {minutes}) / ({duration} - {peak}) END"
    )
    return f"""numbered AS (SELECT *, row_number() OVER ({W}) AS rn FROM cgm),
acting AS (SELECT a.event_id,
  coalesce(sum(b.TotalBolusInsulinDelivered * ({decay})), 0) AS insulin_on_board,
  coalesce(sum(b.TotalBolusInsulinDelivered * ({effect})), 0) AS active_insulin_effect
  FROM numbered a LEFT JOIN numbered b ON a.participant_id = b.participant_id AND b.rn BETWEEN a.rn - 100 AND a.rn - 1
    AND b.TotalBolusInsulinDelivered > 0 AND {minutes} <= {duration}
  GROUP BY a.event_id)"""


LONG = acting("4320.0::DOUBLE", "900.0::DOUBLE")


@query("insulin_on_board", cgm_sql(f"SELECT event_id, {r('insulin_on_board')} FROM acting", LONG))
def insulin_on_board(spark, d):
    return rounded(X.insulin_on_board(load_cgm(spark, d), 4320.0).select(BASE, "insulin_on_board"))


@query("active_insulin_effect", cgm_sql(f"SELECT event_id, {r('active_insulin_effect')} FROM acting", LONG))
def active_insulin_effect(spark, d):
    return rounded(X.active_insulin_effect(load_cgm(spark, d), 4320.0, 900.0).select(BASE, "active_insulin_effect"))


# The ratios use the last delivered rate and doses of the imputed series.
RATIOS = f"""carried AS (SELECT event_id, CorrectionDelivered AS corr,
  last_value(Basal IGNORE NULLS) OVER ({W} {PAST}) AS basal,
  last_value(TotalBolusInsulinDelivered IGNORE NULLS) OVER ({W} {PAST}) AS bolus FROM cgm)"""


@query(
    "insulin_ratios",
    cgm_sql(
        f"SELECT event_id, {r('CASE WHEN coalesce(basal, 0) > 0 THEN coalesce(bolus, 0) / basal ELSE 0 END', 'bolus_to_basal_ratio')}, "
        f"{r('CASE WHEN coalesce(bolus, 0) > 0 THEN coalesce(corr, 0) / bolus ELSE 0 END', 'correction_ratio')} FROM carried",
        RATIOS,
    ),
)
def insulin_ratios(spark, d):
    from pyspark.sql import functions as F

    from glyco.operators.features import PAST as FRAME
    from glyco.plans.series import Series

    df = load_cgm(spark, d)
    doses = ["Basal", "TotalBolusInsulinDelivered"]
    s = Series(df, carry_back=[F.col(c).isNotNull() for c in doses])
    carried = s.close(s.df.withColumns({c: F.last(c, True).over(s.window.rowsBetween(*FRAME)) for c in doses}))
    return rounded(X.insulin_ratios(carried).select(BASE, "bolus_to_basal_ratio", "correction_ratio"))


FILLED = f"filled AS (SELECT * REPLACE (last_value(CGM IGNORE NULLS) OVER ({W} {PAST}) AS CGM) FROM cgm)"


def back(c, k):
    return f"lag({c}, {k}) OVER ({W})" if k else c


def slope(k):
    t = "epoch_us(EventDateTime)"
    return f"({back('CGM', k)} - {back('CGM', k + 1)}) / nullif(({back(t, k)} - {back(t, k + 1)}) / 60000000.0::DOUBLE, 0)"


TRENDS = {f"glucose_trend_{5 * k}min": f"coalesce(CGM - lag(CGM, {k}) OVER ({W}), 0)" for k in (3, 6, 12)}
RATES = {
    "glucose_rate_of_change": f"coalesce({slope(0)}, 0)",
    "glucose_acceleration": f"coalesce({slope(0)} - {slope(1)}, 0)",
}


@query("glucose_trends", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in TRENDS.items()) + " FROM filled", FILLED))
def glucose_trends(spark, d):
    return rounded(X.glucose_trends(load_cgm(spark, d)).select(BASE, *TRENDS))


@query("rate_of_change", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in RATES.items()) + " FROM filled", FILLED))
def rate_of_change(spark, d):
    return rounded(X.rate_of_change(load_cgm(spark, d)).select(BASE, *RATES))


def variability(windows):
    (s, short), (m, middle), _ = windows
    sd = f"coalesce(stddev_samp(CGM) {over(short)}, 0)"
    return {
        f"glucose_variability_{s}": sd,
        f"glucose_variability_{m}": f"coalesce(stddev_samp(CGM) {over(middle)}, 0)",
        f"glucose_cv_{s}": f"coalesce({sd} / avg(CGM) {over(short)}, 0)",
    }


def time_in_range(windows):
    _, (m, middle), (l, long) = windows

    def share(test, length):
        return f"avg(coalesce({test}, FALSE)::INT::DOUBLE) {over(length)}"

    return {
        f"time_in_range_{m}": share("CGM BETWEEN 70 AND 180", middle),
        f"time_in_range_{l}": share("CGM BETWEEN 70 AND 180", long),
        f"time_below_range_{m}": share("CGM < 70", middle),
        f"time_above_range_{m}": share("CGM > 180", middle),
    }


VAR_DAYS, TIR_DAYS = variability(DAYS), time_in_range(DAYS)


@query("glucose_variability", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in VAR_DAYS.items()) + " FROM filled", FILLED))
def glucose_variability(spark, d):
    return rounded(X.glucose_variability(load_cgm(spark, d), DAYS).select(BASE, *VAR_DAYS))


@query("rolling_time_in_range", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in TIR_DAYS.items()) + " FROM filled", FILLED))
def rolling_time_in_range(spark, d):
    return rounded(X.rolling_time_in_range(load_cgm(spark, d), DAYS).select(BASE, *TIR_DAYS))


STATES = {
    "is_hypoglycemic": "coalesce(CGM < 70, FALSE)::INT",
    "is_hyperglycemic": "coalesce(CGM > 250, FALSE)::INT",
    "is_in_target_range": "coalesce(CGM BETWEEN 70 AND 180, FALSE)::INT",
}


@query("glucose_states", cgm_sql("SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in STATES.items()) + " FROM cgm"))
def glucose_states(spark, d):
    return X.glucose_states(load_cgm(spark, d)).select(BASE, *STATES)


@query("glucose_risk_index", cgm_sql(f"SELECT event_id, {r('abs(CGM - 125) / 125', 'glucose_risk_index')} FROM cgm"))
def glucose_risk_index(spark, d):
    return rounded(X.glucose_risk_index(load_cgm(spark, d)).select(BASE, "glucose_risk_index"))


def stability(length):
    return f"1 / (1 + coalesce(stddev_samp(CGM) {over(length)}, 0))"


@query("glucose_stability_index", cgm_sql(f"SELECT event_id, {r(stability('2 days'), 'glucose_stability_index')} FROM filled", FILLED))
def glucose_stability_index(spark, d):
    return rounded(X.glucose_stability_index(load_cgm(spark, d), "2 days").select(BASE, "glucose_stability_index"))


def lags(mean):
    return {f"CGM_lag_{m}min": f"coalesce(lag(CGM, {m // 5}) OVER ({W}), {mean})" for m in X.LAG_MINUTES}


def rolling(windows, mean):
    out = {}
    for n, length in windows:
        out[f"CGM_rolling_mean_{n}"] = f"coalesce(avg(CGM) {over(length)}, {mean})"
        out[f"CGM_rolling_std_{n}"] = f"coalesce(stddev_samp(CGM) {over(length)}, 0)"
    return out


RAW_MEAN, FILLED_MEAN = "(SELECT avg(CGM) FROM cgm)", "(SELECT avg(CGM) FROM filled)"


@query("lag_features", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in lags(RAW_MEAN).items()) + " FROM filled", FILLED))
def lag_features(spark, d):
    return rounded(X.lag_features(load_cgm(spark, d)).select(BASE, *lags("")))


@query("rolling_stats", cgm_sql("SELECT event_id, " + ", ".join(r(e, n) for n, e in rolling(DAYS, RAW_MEAN).items()) + " FROM cgm"))
def rolling_stats(spark, d):
    return rounded(X.rolling_stats(load_cgm(spark, d), windows=DAYS).select(BASE, *rolling(DAYS, "")))


# --- all features and scaling --------------------------------------------------------

READY = f"""ready AS (SELECT * REPLACE (last_value(CGM IGNORE NULLS) OVER ({W} {PAST}) AS CGM),
  coalesce(abs(Basal - lag(Basal) OVER ({W})) > 0.01, FALSE) AS basal_changed FROM cgm)"""
SHORT = acting("360.0::DOUBLE", "75.0::DOUBLE")
ROLL = (("30min", "30 minutes"), ("1h", "1 hour"), ("2h", "2 hours"))
READY_MEAN = "(SELECT avg(CGM) FROM ready)"
EVERY = {
    "hour_of_day": "hour(EventDateTime)", "day_of_week": "isodow(EventDateTime) - 1", "day_of_month": "day(EventDateTime)",
    "month": "month(EventDateTime)", "is_weekend": "(isodow(EventDateTime) >= 6)::INT",
    "hour_sin": "sin(2 * pi() * hour(EventDateTime) / 24)", "hour_cos": "cos(2 * pi() * hour(EventDateTime) / 24)",
    "day_sin": "sin(2 * pi() * (isodow(EventDateTime) - 1) / 7)", "day_cos": "cos(2 * pi() * (isodow(EventDateTime) - 1) / 7)",
    **SINCE, **insulin_sums(HOURS),
    "insulin_on_board": "insulin_on_board", "active_insulin_effect": "active_insulin_effect",
    "bolus_to_basal_ratio": "CASE WHEN Basal > 0 THEN coalesce(TotalBolusInsulinDelivered, 0) / Basal ELSE 0 END",
    "correction_ratio": "CASE WHEN TotalBolusInsulinDelivered > 0 THEN coalesce(CorrectionDelivered, 0) / TotalBolusInsulinDelivered ELSE 0 END",
    **TRENDS, **RATES, **variability(HOURS), **time_in_range(HOURS), **STATES,
    "glucose_risk_index": "abs(CGM - 125) / 125", "glucose_stability_index": stability("1 hour"),
    **lags(READY_MEAN), **rolling(ROLL, READY_MEAN),
}
FEATURES = "features AS (SELECT event_id, participant_id, EventDateTime, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in EVERY.items()) + " FROM ready JOIN acting USING (event_id))"


@query("all_features", cgm_sql("SELECT event_id, " + ", ".join(r(n) for n in X.ALL_FEATURES) + " FROM features", READY, SHORT, FEATURES))
def all_features(spark, d):
    from pyspark.sql import functions as F

    df = X.all_features(load_cgm(spark, d))
    return rounded(df.select(BASE, *[F.col(c).cast("double").alias(c) for c in X.ALL_FEATURES]))


def clipped(c):
    return f"greatest(least({c}, q3_{c} + 3 * (q3_{c} - q1_{c})), q1_{c} - 3 * (q3_{c} - q1_{c}))"


def cleaned(columns, source):
    cuts = ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in columns
    )
    return (
        f"quarts AS (SELECT {cuts} FROM {source}),\ncleaned AS (SELECT event_id, "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN q2_{c} ELSE {clipped(c)} END AS {c}" for c in columns)
        + f" FROM {source}, quarts)"
    )


# A scaled value divides by a deviation that can be tiny, so constant columns scale by 1.
ALL_STATS = "stats AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in X.ALL_FEATURES) + " FROM cleaned)"


def scaled(c):
    return f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END"


@query(
    "engineer_features",
    cgm_sql(
        "SELECT event_id, " + ", ".join(r(scaled(c), c) for c in X.ALL_FEATURES) + " FROM cleaned, stats",
        READY, SHORT, FEATURES, cleaned(X.ALL_FEATURES, "features"), ALL_STATS,
    ),
)
def engineer_features(spark, d):
    df, _ = engineer(load_cgm(spark, d))
    return rounded(df.select(BASE, *X.ALL_FEATURES))


COVERAGE = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS feature, '{family}' AS family, count(*) - count({name}) AS missing, {r(f'(count(*) - count({name})) * 100.0::DOUBLE / count(*)', 'percentage')} FROM features"
    for family, names in X.FAMILIES.items()
    for name in names
)


@query("feature_groups", cgm_sql(COVERAGE, READY, SHORT, FEATURES))
def feature_groups(spark, d):
    from pyspark.sql import functions as F

    from glyco.operators.quality import missing_stats

    # Families of the features that the table's rows produce, with their coverage.
    df = X.all_features(load_cgm(spark, d))
    coverage = missing_stats(df, X.ALL_FEATURES).withColumnRenamed("column", "feature")
    return rounded(X.feature_groups(spark).join(F.broadcast(coverage), "feature"))


SC = ["CGM", "FoodDelivered", "Basal"]
CLEAN = cleaned(SC, "cgm")


@query("scale_clean", cgm_sql("SELECT event_id, " + ", ".join(r(c) for c in SC) + " FROM cleaned", CLEAN))
def scale_clean_query(spark, d):
    return rounded(scale_clean(load_cgm(spark, d).select("event_id", *SC), SC))


KINDS = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def fitted(kind):
    a, b = KINDS[kind]
    return "fitted AS (SELECT " + ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in SC) + " FROM cleaned)"


def scaler_query(kind):
    def run(spark, d):
        df = load_cgm(spark, d).select("event_id", *SC)
        return rounded(Scaler.fit(df, SC, kind).transform(df))

    sql = cgm_sql("SELECT event_id, " + ", ".join(r(f"({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END", c) for c in SC) + " FROM cleaned, fitted", CLEAN, fitted(kind))
    query(f"scale_{kind}", sql)(run)


for _kind in KINDS:
    scaler_query(_kind)


@query(
    "scale_transform",
    cgm_sql(
        "SELECT event_id, " + ", ".join(r(f"(CASE WHEN cgm.{c} IS NULL THEN q2_{c} ELSE {clipped('cgm.' + c).replace('_cgm.', '_')} END - a_{c}) / b_{c}", c) for c in SC)
        + " FROM cgm, quarts, fitted",
        CLEAN.replace("FROM cgm)", "FROM cgm WHERE EventDateTime < TIMESTAMP '2024-01-20')").replace("FROM cgm, quarts", "FROM cgm, quarts WHERE EventDateTime < TIMESTAMP '2024-01-20'"),
        fitted("standard"),
    ),
)
def scale_transform(spark, d):
    from pyspark.sql import functions as F

    # Fitted on the earlier weeks, stored, read back, applied to everything.
    df = load_cgm(spark, d)
    train = df.filter(F.col("EventDateTime") < F.lit("2024-01-20").cast("timestamp_ntz"))
    scaler = Scaler.from_params(Scaler.fit(train, SC).params(spark))
    return rounded(scaler.transform(df).select("event_id", *SC))


@query("scale_inverse", cgm_sql("SELECT event_id, " + ", ".join(r(c) for c in SC) + " FROM cleaned", CLEAN))
def scale_inverse(spark, d):
    df = load_cgm(spark, d).select("event_id", *SC)
    scaler = Scaler.fit(df, SC)
    return rounded(scaler.inverse(scaler.transform(df)))


@query(
    "scaler_params",
    cgm_sql(
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", 'standard' AS kind, {r(f"q1_{c} - 3 * (q3_{c} - q1_{c})", "clip_low")},
            {r(f"q3_{c} + 3 * (q3_{c} - q1_{c})", "clip_high")}, {r(f"q2_{c}", "fill")}, {r(f"a_{c}", "centre")}, {r(f"b_{c}", "width")} FROM quarts, fitted"""
            for c in SC
        ),
        CLEAN,
        fitted("standard"),
    ),
)
def scaler_params(spark, d):
    return rounded(Scaler.fit(load_cgm(spark, d), SC).params(spark))


@query("preprocess")
def preprocess(spark, d):
    return rounded(run_preprocess(load_cgm(spark, d).drop("event_id"), "6 hours", tolerance="1 hour"))


