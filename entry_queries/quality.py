"""Profiles, cleaning, imputation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyco.functions.expressions import parse_time, participant_from_path
from glyco.operators import clean as C
from glyco.operators import impute as I
from glyco.operators import outliers as O
from glyco.operators import quality as Q
from glyco.schema import VALUE_RANGES
from glyco.sources.events import load_cgm

from .base import MEASURES, cgm_sql, per_column, query, r, rounded

ALL = ["event_id", "EventDateTime", "participant_id", "DeviceMode", *MEASURES]
LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
NEXT = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
W = "PARTITION BY participant_id ORDER BY EventDateTime"


@query("validate_schema")
def validate_schema(spark, d):
    return Q.validate_schema(load_cgm(spark, d))


@query("type_stats")
def type_stats(spark, d):
    return Q.type_stats(load_cgm(spark, d))


@query(
    "range_check",
    cgm_sql(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", {r(f'min({c})', 'min_value')}, {r(f'max({c})', 'max_value')}, "
            f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS out_of_range, "
            f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) = 0 AS within_range FROM cgm"
            for c, (lo, hi) in VALUE_RANGES.items()
        )
    ),
)
def range_check(spark, d):
    return rounded(Q.range_check(load_cgm(spark, d)))


MISSING = per_column(
    ALL,
    "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percentage FROM cgm",
)


@query("missing_stats", cgm_sql(f'SELECT "column", missing, {r("percentage")} FROM ({MISSING})'))
def missing_stats(spark, d):
    return rounded(Q.missing_stats(load_cgm(spark, d), ALL))


@query("null_fraction", cgm_sql(f'SELECT "column", {r("percentage / 100", "null_frac")} FROM ({MISSING})'))
def null_fraction(spark, d):
    return rounded(Q.null_fraction(load_cgm(spark, d)))


@query(
    "low_coverage_columns",
    cgm_sql(f'SELECT "column", {r("100 - percentage", "coverage")} FROM ({MISSING}) WHERE 100 - percentage < 25'),
)
def low_coverage_columns(spark, d):
    return rounded(Q.low_coverage_columns(load_cgm(spark, d), 25.0))


@query(
    "longest_null_run",
    cgm_sql(
        per_column(
            MEASURES,
            f"""SELECT '{{c}}' AS "column", coalesce(max(n), 0) AS longest_run FROM (
              SELECT count(*) AS n FROM (
                SELECT participant_id, {{c}}, count({{c}}) OVER ({W}) AS island FROM cgm)
              WHERE {{c}} IS NULL GROUP BY participant_id, island)""",
        )
    ),
)
def longest_null_run(spark, d):
    return Q.longest_null_run(load_cgm(spark, d), MEASURES)


PROFILE = per_column(
    MEASURES,
    "SELECT '{c}' AS \"column\", "
    + ", ".join(
        r(e, n)
        for e, n in [
            ("min({c})", "min"), ("max({c})", "max"), ("avg({c})", "mean"), ("stddev_samp({c})", "std"),
            ("quantile_cont({c}, 0.5)", "median"), ("quantile_cont({c}, 0.25)", "q25"), ("quantile_cont({c}, 0.75)", "q75"),
        ]
    )
    + " FROM cgm",
)


@query("numeric_profile", cgm_sql(PROFILE))
def numeric_profile(spark, d):
    return rounded(Q.numeric_profile(load_cgm(spark, d), MEASURES))


KEYS = ["participant_id", "DeviceMode", "CGM"]
DUPS = "SELECT sum(n)::BIGINT AS records, sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM cgm GROUP BY participant_id, DeviceMode, CGM)"


@query("duplicate_count", cgm_sql(DUPS))
def duplicate_count(spark, d):
    return Q.duplicate_count(load_cgm(spark, d), KEYS)


SCORE = f"""SELECT records, duplicates, {r("avg_missing")},
  {r("greatest(100 - least(avg_missing, 50) - least(duplicates * 200.0::DOUBLE / records, 20), 0)", "quality_score")}
FROM ({DUPS}), (SELECT avg(p) AS avg_missing FROM ({per_column(KEYS, "SELECT (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS p FROM cgm")}))"""


@query("quality_score", cgm_sql(SCORE))
def quality_score(spark, d):
    return rounded(Q.quality_score(load_cgm(spark, d).select(*KEYS)))


ALL_DUPS = f"(SELECT sum(n - 1)::BIGINT AS d, sum(n)::BIGINT AS t FROM (SELECT count(*) AS n FROM cgm GROUP BY {', '.join(ALL)}))"


@query(
    "quality_recommendations",
    cgm_sql(
        f"""SELECT 'missing_values' AS rule, 'impute ' || "column" || ': more than 20% missing' AS message FROM ({MISSING}) WHERE percentage > 20
        UNION ALL SELECT 'duplicates', 'remove ' || d || ' duplicate records' FROM {ALL_DUPS} WHERE d > 0
        UNION ALL SELECT 'low_score', 'clean the data: quality score below 70' FROM (SELECT avg(percentage) AS a FROM ({MISSING})), {ALL_DUPS}
          WHERE 100 - least(a, 50) - least(d * 200.0::DOUBLE / t, 20) < 70"""
    ),
)
def quality_recommendations(spark, d):
    return Q.quality_recommendations(load_cgm(spark, d))


@query("quality_report")
def quality_report(spark, d):
    return rounded(Q.quality_report(load_cgm(spark, d)))


@query("drop_invalid_time", "SELECT event_id, ts AS EventDateTime FROM events WHERE event_type <> 'error'")
def drop_invalid_time(spark, d):
    # Readings of a failed device get an unusable time, so that the operator has rows to drop.
    time = F.when(F.col("DeviceMode") != "error", F.col("EventDateTime"))
    return C.drop_invalid_time(load_cgm(spark, d).select("event_id", time.alias("EventDateTime")))


VALUES = ["participant_id", "EventDateTime", *MEASURES]


@query(
    "drop_all_null_rows",
    cgm_sql(f"SELECT {', '.join(VALUES)} FROM cgm WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in MEASURES)),
)
def drop_all_null_rows(spark, d):
    return C.drop_all_null_rows(load_cgm(spark, d).select(*VALUES))


DOUBLED = "both_halves AS (SELECT * FROM cgm UNION ALL SELECT * FROM cgm WHERE DeviceMode = 'click')"


def doubled(spark, d):
    df = load_cgm(spark, d)
    return df.unionByName(df.filter(F.col("DeviceMode") == "click"))


@query("union_tables", cgm_sql("SELECT event_id, CGM, NULL::DOUBLE AS Basal FROM cgm UNION ALL SELECT event_id, NULL, Basal FROM cgm"))
def union_tables(spark, d):
    df = load_cgm(spark, d)
    return C.union_tables([df.select("event_id", "CGM"), df.select("event_id", "Basal")])


@query("dedupe_exact", cgm_sql("SELECT DISTINCT event_id, participant_id, EventDateTime, CGM FROM both_halves", DOUBLED))
def dedupe_exact(spark, d):
    return C.dedupe_exact(doubled(spark, d)).select("event_id", "participant_id", "EventDateTime", "CGM")


NULLS = " + ".join(f"({c} IS NULL)::INT" for c in ["event_id", "DeviceMode", *MEASURES])
NEAR = f"""near_rows AS (SELECT *, n,
  epoch_us(EventDateTime) - lag(epoch_us(EventDateTime)) OVER w AS back,
  lead(epoch_us(EventDateTime)) OVER w - epoch_us(EventDateTime) AS ahead,
  lag(n) OVER w AS back_n, lead(n) OVER w AS ahead_n
  FROM (SELECT *, {NULLS} AS n FROM cgm) WINDOW w AS ({W}))"""
TOL = 4 * 3600 * 1_000_000
NEAR_COLS = "event_id, participant_id, EventDateTime, CGM"


def near(keep):
    def run(spark, d):
        return C.dedupe_near(load_cgm(spark, d), keep, "4 hours").select(*NEAR_COLS.split(", "))

    return run


query("dedupe_near_last", cgm_sql(f"SELECT {NEAR_COLS} FROM near_rows WHERE NOT coalesce(ahead <= {TOL}, FALSE)", NEAR))(near("last"))
query("dedupe_near_first", cgm_sql(f"SELECT {NEAR_COLS} FROM near_rows WHERE NOT coalesce(back <= {TOL}, FALSE)", NEAR))(near("first"))
query(
    "dedupe_near_most_complete",
    cgm_sql(
        f"""SELECT {NEAR_COLS} FROM near_rows WHERE NOT (coalesce(ahead <= {TOL}, FALSE) AND coalesce(ahead_n < n, FALSE))
            AND NOT (coalesce(back <= {TOL}, FALSE) AND NOT coalesce(n < back_n, FALSE))""",
        NEAR,
    ),
)(near("most_complete"))


@query(
    "clean",
    cgm_sql(
        f"""SELECT {NEAR_COLS} FROM near_rows WHERE NOT coalesce(ahead <= {TOL}, FALSE)
            ORDER BY participant_id, EventDateTime""",
        NEAR,
    ),
)
def clean(spark, d):
    return C.clean(doubled(spark, d), "last", "4 hours").select(*NEAR_COLS.split(", "))


@query(
    "clean_stats",
    cgm_sql(
        f"""SELECT rows_in, rows_out, rows_in - rows_out AS removed, {r("rows_out * 100.0::DOUBLE / rows_in", "retention_rate")}
            FROM (SELECT count(*) AS rows_in FROM both_halves), (SELECT count(*) AS rows_out FROM near_rows WHERE NOT coalesce(ahead <= {TOL}, FALSE))""",
        NEAR,
        DOUBLED,
    ),
)
def clean_stats(spark, d):
    df = doubled(spark, d)
    return rounded(C.clean_stats(df, C.clean(df, "last", "4 hours")))


# --- imputation ----------------------------------------------------------------------

IDS = "event_id, participant_id, EventDateTime"


@query(
    "impute_ffill",
    cgm_sql(
        f"SELECT {IDS}, "
        + ", ".join(
            r(f"coalesce(last_value({c} IGNORE NULLS) OVER ({W} {LAST}), first_value({c} IGNORE NULLS) OVER ({W} {NEXT}))", c)
            for c in ("Basal", "CGM")
        )
        + " FROM cgm"
    ),
)
def impute_ffill(spark, d):
    df = load_cgm(spark, d).select(*IDS.split(", "), "Basal", "CGM")
    return rounded(I.impute_ffill(df, ["Basal", "CGM"]))


INTERP = f"""numbered AS (SELECT {IDS}, CGM, row_number() OVER ({W}) AS rn, epoch_us(EventDateTime) AS t FROM cgm),
around AS (SELECT *,
  last_value(CGM IGNORE NULLS) OVER ({W} {LAST}) AS lo, first_value(CGM IGNORE NULLS) OVER ({W} {NEXT}) AS hi,
  max(CASE WHEN CGM IS NOT NULL THEN rn END) OVER ({W} {LAST}) AS rlo, min(CASE WHEN CGM IS NOT NULL THEN rn END) OVER ({W} {NEXT}) AS rhi,
  max(CASE WHEN CGM IS NOT NULL THEN t END) OVER ({W} {LAST}) AS tlo, min(CASE WHEN CGM IS NOT NULL THEN t END) OVER ({W} {NEXT}) AS thi
  FROM numbered)"""


def interp(at, lo, hi, allowed="TRUE"):
    value = f"CASE WHEN hi IS NULL THEN lo ELSE lo + (hi - lo) * ({at} - {lo})::DOUBLE / nullif({hi} - {lo}, 0) END"
    return cgm_sql(
        f"SELECT {IDS}, {r(f'coalesce(CGM, CASE WHEN {allowed} THEN {value} END)', 'CGM')} FROM around", INTERP
    )


@query("impute_interpolate", interp("rn", "rlo", "rhi"))
def impute_interpolate(spark, d):
    return rounded(I.impute_interpolate(load_cgm(spark, d).select(*IDS.split(", "), "CGM"), ["CGM"]))


@query(
    "impute_interpolate_time",
    interp("t", "tlo", "thi", f"coalesce(thi - tlo <= {24 * 3600 * 1_000_000}, TRUE)"),
)
def impute_interpolate_time(spark, d):
    df = load_cgm(spark, d).select(*IDS.split(", "), "CGM")
    return rounded(I.impute_interpolate(df, ["CGM"], mode="time", max_gap="24 hours"))


@query("impute_median", cgm_sql(f"SELECT event_id, {r('coalesce(Basal, (SELECT quantile_cont(Basal, 0.5) FROM cgm))', 'Basal')}, {r('coalesce(CGM, (SELECT quantile_cont(CGM, 0.5) FROM cgm))', 'CGM')} FROM cgm"))
def impute_median(spark, d):
    return rounded(I.impute_statistic(load_cgm(spark, d).select("event_id", "Basal", "CGM"), ["Basal", "CGM"]))


MODE = "SELECT m FROM (SELECT CASE WHEN CGM IS NOT NULL THEN DeviceMode END AS m FROM cgm) WHERE m IS NOT NULL GROUP BY m ORDER BY count(*) DESC, m LIMIT 1"


@query("impute_mean", cgm_sql(f"SELECT event_id, {r('coalesce(CGM, (SELECT avg(CGM) FROM cgm))', 'CGM')}, coalesce(CASE WHEN CGM IS NOT NULL THEN DeviceMode END, ({MODE})) AS DeviceMode FROM cgm"))
def impute_mean(spark, d):
    df = load_cgm(spark, d).select(
        "event_id", "CGM", F.when(F.col("CGM").isNotNull(), F.col("DeviceMode")).alias("DeviceMode")
    )
    return rounded(I.impute_statistic(df, ["CGM", "DeviceMode"], "mean"))


@query("impute_zero", cgm_sql("SELECT event_id, coalesce(FoodDelivered, 0) AS FoodDelivered, coalesce(TotalBolusInsulinDelivered, 0) AS TotalBolusInsulinDelivered FROM cgm"))
def impute_zero(spark, d):
    columns = ["FoodDelivered", "TotalBolusInsulinDelivered"]
    return I.impute_zero(load_cgm(spark, d).select("event_id", *columns), columns)


@query("impute_drop", cgm_sql("SELECT event_id, CGM FROM cgm WHERE CGM IS NOT NULL"))
def impute_drop(spark, d):
    return I.impute_drop(load_cgm(spark, d).select("event_id", "CGM"), ["CGM"])


ZEROED = ["TotalBolusInsulinDelivered", "CorrectionDelivered", "FoodDelivered", "CarbSize"]
IMPUTED = f"""imputed AS (SELECT a.event_id, a.participant_id, a.EventDateTime, c.DeviceMode,
  coalesce(a.CGM, CASE WHEN hi IS NULL THEN lo ELSE lo + (hi - lo) * (rn - rlo)::DOUBLE / nullif(rhi - rlo, 0) END) AS CGM,
  coalesce(last_value(c.Basal IGNORE NULLS) OVER w1, first_value(c.Basal IGNORE NULLS) OVER w2) AS Basal,
  {', '.join(f'coalesce(c.{x}, 0) AS {x}' for x in ZEROED)}
  FROM around a JOIN cgm c USING (event_id)
  WINDOW w1 AS (PARTITION BY a.participant_id ORDER BY a.EventDateTime {LAST}), w2 AS (PARTITION BY a.participant_id ORDER BY a.EventDateTime {NEXT}))"""


@query("impute", cgm_sql(f"SELECT {IDS}, DeviceMode, {', '.join(r(c) for c in MEASURES)} FROM imputed", INTERP, IMPUTED))
def impute(spark, d):
    return rounded(I.impute(load_cgm(spark, d)).select(*ALL))


@query(
    "impute_stats",
    cgm_sql(
        per_column(
            MEASURES,
            f"""SELECT '{{c}}' AS "column", b.m AS missing_before, a.m AS missing_after,
                {r("coalesce((b.m - a.m) * 100.0::DOUBLE / nullif(b.m, 0), 0)", "imputation_rate")}
                FROM (SELECT count(*) - count({{c}}) AS m FROM cgm) b, (SELECT count(*) - count({{c}}) AS m FROM imputed) a""",
        ),
        INTERP,
        IMPUTED,
    ),
)
def impute_stats(spark, d):
    df = load_cgm(spark, d)
    return rounded(I.impute_stats(df.select(*MEASURES), I.impute(df).select(*MEASURES)))


# --- outliers ------------------------------------------------------------------------

OUT = ["CGM", "FoodDelivered", "Basal"]
IQR = "iqr AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
    for c in OUT
) + " FROM cgm)"
ZED = "zed AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, stddev_samp({c}) AS ss_{c}" for c in OUT) + " FROM cgm)"


def by_iqr(c):
    return f"coalesce({c} < lo_{c} OR {c} > hi_{c}, FALSE)"


def by_z(c):
    return f"coalesce(abs(({c} - m_{c}) / s_{c}) > 3, FALSE)"


@query("outliers_iqr", cgm_sql("SELECT event_id, " + ", ".join(f"{by_iqr(c)} AS outlier_{c}" for c in OUT) + " FROM cgm, iqr", IQR))
def outliers_iqr(spark, d):
    return O.outliers_iqr(load_cgm(spark, d), OUT).select("event_id", *[f"outlier_{c}" for c in OUT])


@query("outliers_zscore", cgm_sql("SELECT event_id, " + ", ".join(f"{by_z(c)} AS outlier_{c}" for c in OUT) + " FROM cgm, zed", ZED))
def outliers_zscore(spark, d):
    return O.outliers_zscore(load_cgm(spark, d), OUT).select("event_id", *[f"outlier_{c}" for c in OUT])


@query("outliers_domain", cgm_sql("SELECT event_id, coalesce(CGM < 45 OR CGM > 300, FALSE) AS outlier_CGM, coalesce(Basal > 2, FALSE) AS outlier_Basal FROM cgm"))
def outliers_domain(spark, d):
    df = O.outliers_domain(load_cgm(spark, d), {"CGM": (45, 300), "Basal": (None, 2)})
    return df.select("event_id", "outlier_CGM", "outlier_Basal")


@query("outlier_mask", cgm_sql("SELECT event_id, " + ", ".join(f"{by_iqr(c)} OR {by_z(c)} AS outlier_{c}" for c in OUT) + " FROM cgm, iqr, zed", IQR, ZED))
def outlier_mask(spark, d):
    return O.outlier_mask(load_cgm(spark, d), OUT).select("event_id", *[f"outlier_{c}" for c in OUT])


@query("outliers_isolation_forest")
def outliers_isolation_forest(spark, d):
    df = load_cgm(spark, d).select("event_id", "CGM")
    return O.IsolationForest.fit(df, ["CGM"]).flag(df)


def report_sql(flag, low, high, *ctes):
    any_flag = " OR ".join(flag(c) for c in OUT)
    return cgm_sql(
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {flag(c)}) AS outliers,
            count(*) FILTER (WHERE ({any_flag}) AND {c} IS NOT NULL) AS row_outliers,
            {r(f"count(*) FILTER (WHERE ({any_flag}) AND {c} IS NOT NULL) * 100.0::DOUBLE / count(*)", "row_percentage")},
            {r(f"avg({c})", "mean")}, {r(f"stddev_samp({c})", "std")},
            {r(low.format(c=c), "threshold_low")}, {r(high.format(c=c), "threshold_high")}
            FROM cgm, {', '.join(x.split(' AS ')[0] for x in ctes)}"""
            for c in OUT
        ),
        *ctes,
    )


@query("outlier_report", report_sql(by_iqr, "any_value(lo_{c})", "any_value(hi_{c})", IQR))
def outlier_report(spark, d):
    return rounded(O.outlier_report(load_cgm(spark, d), OUT))


@query("outlier_report_zscore", report_sql(by_z, "any_value(m_{c} - 3 * ss_{c})", "any_value(m_{c} + 3 * ss_{c})", ZED))
def outlier_report_zscore(spark, d):
    return rounded(O.outlier_report(load_cgm(spark, d), OUT, "zscore"))


def treated_sql(value, *ctes):
    """CGM after a treatment of its IQR outliers."""
    new = f"CASE WHEN {by_iqr('CGM')} THEN {value} ELSE CGM END"
    return cgm_sql(f"SELECT event_id, {r(new, 'CGM')} FROM cgm, iqr, cuts", IQR, *ctes)


CUTS = "cuts AS (SELECT quantile_cont(CGM, 0.01) AS p1, quantile_cont(CGM, 0.99) AS p99, quantile_cont(CGM, 0.05) AS p5, quantile_cont(CGM, 0.95) AS p95 FROM cgm)"


def treat(treatment, settings=None):
    def run(spark, d):
        df = load_cgm(spark, d).select("event_id", "CGM")
        return rounded(O.treat_outliers(df, ["CGM"], ("iqr",), treatment, settings or {}))

    return run


query("treat_clip", treated_sql("greatest(least(CGM, p99), p1)", CUTS))(treat("clip"))
query("treat_remove", treated_sql("NULL", CUTS))(treat("remove"))
query("treat_winsorize", treated_sql("greatest(least(CGM, p95), p5)", CUTS))(treat("winsorize"))


@query(
    "treat_log",
    cgm_sql(
        f"SELECT event_id, {r(f'CASE WHEN {by_iqr("CGM")} THEN ln(1 + CGM) ELSE CGM END', 'CGM')} FROM cgm, iqr WHERE CGM IS NOT NULL",
        IQR,
    ),
)
def treat_log(spark, d):
    df = load_cgm(spark, d).select("event_id", "CGM").dropna(subset=["CGM"])
    return rounded(O.treat_outliers(df, ["CGM"], ("iqr",), "transform", {}))


@query("treat_boxcox")
def treat_boxcox(spark, d):
    df = load_cgm(spark, d).select("event_id", (F.col("CGM") - 80).alias("shifted"))
    return rounded(O.treat_outliers(df, ["shifted"], ("iqr",), "transform", {}))


@query(
    "outlier_treatment_stats",
    cgm_sql(
        f"""SELECT 'CGM' AS "column", count(*) FILTER (WHERE {by_iqr('CGM')}) AS outliers_detected,
        count(*) FILTER (WHERE {by_iqr('CGM')} AND greatest(least(CGM, p99), p1) <> CGM) AS outliers_treated,
        {r(f"count(*) FILTER (WHERE {by_iqr('CGM')}) * 100.0::DOUBLE / count(*)", "outlier_percentage")} FROM cgm, iqr, cuts""",
        IQR,
        CUTS,
    ),
)
def outlier_treatment_stats(spark, d):
    return rounded(O.treatment_stats(load_cgm(spark, d), ["CGM"], methods=("iqr",), settings={}))


# --- paths and times -----------------------------------------------------------------

@query(
    "participant_from_path",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'subject_' || user_id ELSE 'file_' || user_id END
       AS participant FROM events""",
)
def participant_path(spark, d):
    load = spark.read.parquet(f"{d}/events.parquet")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    path = (
        F.when(kind == "click", F.concat(F.lit("/data/Subject%20"), user, F.lit("/log.csv")))
        .when(kind == "view", F.concat(F.lit("/data/Subject"), user, F.lit("/x.y.csv")))
        .otherwise(F.concat(F.lit("/data/other/file_"), user, F.lit(".csv")))
    )
    return load.select("event_id", participant_from_path(path).alias("participant"))


@query(
    "parse_datetime",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS parsed FROM events",
)
def parse_datetime(spark, d):
    df = load_cgm(spark, d)
    text = F.when(
        F.col("DeviceMode") != "error", F.date_format("EventDateTime", "yyyy-MM-dd HH:mm:ss")
    ).otherwise("not a time")
    return df.select("event_id", parse_time(text).alias("parsed"))


@query("validate_dataset")
def validate_dataset(spark, d):
    from glyco.plans.pipelines import validate_dataset as run

    return rounded(run(load_cgm(spark, d)))
