"""Evaluation of prediction pairs (a reading against the known reading before it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyco.functions import expressions as X
from glyco.functions import zones as Z
from glyco.operators import evaluate as E
from glyco.sources.events import load_cgm, load_pairs

from .base import pairs_sql, query, r, rounded

BY = "participant_id"
IN_T, IN_P = "y_true BETWEEN 70 AND 180", "y_pred BETWEEN 70 AND 180"


def part(n, of):
    return f"coalesce({n}::DOUBLE / nullif({of}, 0), 0)"


def cell(t, p):
    return f"(count(*) FILTER (WHERE {t} AND {p}))"


def confusion(t, p):
    return cell(t, p), cell(f"NOT ({t})", p), cell(f"NOT ({t})", f"NOT ({p})"), cell(t, f"NOT ({p})")


def share(test):
    return f"avg(({test})::INT::DOUBLE) * 100"


def tir():
    tp, fp, tn, fn = confusion(IN_T, IN_P)
    return {
        "true_tir_percent": share(IN_T),
        "predicted_tir_percent": share(IN_P),
        "tir_prediction_accuracy": share(f"({IN_T}) = ({IN_P})"),
        "tir_sensitivity": part(tp, f"({tp} + {fn})") + " * 100",
        "tir_specificity": part(tn, f"({tn} + {fp})") + " * 100",
        "tir_absolute_error": f"abs({share(IN_T)} - {share(IN_P)})",
    }


def detection(name, t, p):
    tp, fp, tn, fn = confusion(t, p)
    return {
        f"{name}_sensitivity": part(tp, f"({tp} + {fn})") + " * 100",
        f"{name}_specificity": part(tn, f"({tn} + {fp})") + " * 100",
        f"{name}_precision": part(tp, f"({tp} + {fp})") + " * 100",
        f"{name}_accuracy": f"({tp} + {tn}) * 100.0::DOUBLE / count(*)",
        f"{name}_f1_score": part(f"(2 * {tp})", f"(2 * {tp} + {fp} + {fn})") + " * 100",
        f"true_{name}_rate": share(t),
        f"predicted_{name}_rate": share(p),
    }


HYPO = detection("hypoglycemia", "y_true < 70", "y_pred < 70")


def hyper(limit):
    return detection("hyperglycemia", f"y_true > {limit}", f"y_pred > {limit}")


MARD = "avg(CASE WHEN y_true > 0 THEN abs((y_true - y_pred) / y_true) END) * 100"
ERRORS = {
    "mae": "avg(abs(y_true - y_pred))",
    "mse": "avg((y_true - y_pred) * (y_true - y_pred))",
    "rmse": "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))",
    "r2": "1 - sum((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true) * count(*), 0)",
}
GLUCOSE = {
    "mard": MARD,
    "time_in_range_accuracy": share(f"({IN_T}) = ({IN_P})"),
    "hypoglycemia_detection_rate": f"{cell('y_true < 70', 'y_pred < 70')} * 100.0::DOUBLE / nullif({cell('y_true < 70', 'TRUE')}, 0)",
    "hyperglycemia_detection_rate": f"{cell('y_true > 180', 'y_pred > 180')} * 100.0::DOUBLE / nullif({cell('y_true > 180', 'TRUE')}, 0)",
    "glucose_bias": "avg(y_pred - y_true)",
    "glucose_precision": "stddev_pop(y_pred - y_true)",
}


def columns(measures):
    return ", ".join(r(e, n) for n, e in measures.items())


def per_group(measures, extra=""):
    return pairs_sql(f"SELECT participant_id, {columns(measures)}{extra} FROM pairs GROUP BY participant_id")


def overall(measures, extra=""):
    return pairs_sql(f"SELECT {columns(measures)}{extra} FROM pairs")


COUNT = ", count(*) AS valid_predictions"


def measure(name, sql, func):
    query(name, sql)(lambda spark, d: rounded(func(load_pairs(spark, d))))


measure("mard", overall({"mard": MARD}), E.mard)
measure("mae_mse_rmse_r2", overall(ERRORS, COUNT), E.regression_metrics)
measure("tir_accuracy", overall(tir()), E.tir_accuracy)
measure("hypo_detection", overall(HYPO), E.hypo_detection)
measure("hyper_detection", overall(hyper(250)), lambda p: E.hyper_detection(p, 250.0))
ALL = {"mard": MARD, "mae": ERRORS["mae"], "rmse": ERRORS["rmse"], **tir(), **HYPO, **hyper(250)}
measure("clinical_metrics_all", overall(ALL), E.clinical_metrics_all)
measure("detection_rates_bias_precision", overall(GLUCOSE), E.glucose_metrics)
measure("evaluate_by_group", per_group(ALL), lambda p: E.clinical_metrics_all(p, by=[BY]))
measure("regression_by_group", per_group(ERRORS, COUNT), lambda p: E.regression_metrics(p, [BY]))

SCORE = "(greatest(0, 100 - glucose_mard / 15 * 50) + glucose_time_in_range_accuracy * 0.3::DOUBLE + coalesce(greatest(0, regression_r2 * 20), 0)) / (2 + (regression_r2 IS NOT NULL)::INT)"
WIDE = {**{f"regression_{k}": v for k, v in ERRORS.items()}, **{f"glucose_{k}": v for k, v in GLUCOSE.items()}}
RAW = ", ".join(f"{e} AS {n}" for n, e in WIDE.items())


@query(
    "comprehensive_metrics",
    pairs_sql(
        f"SELECT participant_id, {', '.join(r(n) for n in WIDE)}, regression_valid_predictions, {r(SCORE, 'overall_score')} "
        f"FROM (SELECT participant_id, {RAW}, count(*) AS regression_valid_predictions FROM pairs GROUP BY participant_id)"
    ),
)
def comprehensive_metrics(spark, d):
    return rounded(E.comprehensive_metrics(load_pairs(spark, d), by=[BY]))


@query("overall_score", pairs_sql(f"SELECT {r(SCORE, 'overall_score')} FROM (SELECT {RAW} FROM pairs)"))
def overall_score(spark, d):
    return rounded(E.comprehensive_metrics(load_pairs(spark, d)).select("overall_score"))


@query(
    "mard_band",
    pairs_sql(
        f"""SELECT participant_id, {r('m', 'mard')}, CASE WHEN m < 10 THEN 'excellent' WHEN m < 15 THEN 'good' WHEN m < 20 THEN 'acceptable' ELSE 'poor' END AS band
            FROM (SELECT participant_id, {MARD} AS m FROM pairs GROUP BY participant_id)"""
    ),
)
def mard_band(spark, d):
    table = E.mard(load_pairs(spark, d), [BY])
    return rounded(table.withColumn("band", X.mard_band(F.col("mard"))))


RAW_PAIRS = """raw_pairs AS (SELECT event_id, participant_id, coalesce(y_true, 0) AS y_true, y_pred FROM (
  SELECT event_id, participant_id, CGM AS y_true, lag(CGM) OVER (PARTITION BY participant_id ORDER BY EventDateTime) AS y_pred FROM cgm))"""
POLICY = {
    "reference_positive": "y_true > 0",
    "finite": "y_true IS NOT NULL AND y_pred IS NOT NULL",
    "finite_positive": "y_true > 0 AND y_pred IS NOT NULL",
    "both_positive": "y_true > 0 AND y_pred > 0",
}


@query(
    "valid_pairs",
    pairs_sql("\nUNION ALL\n".join(f"SELECT '{p}' AS policy, count(*) AS n, {r('sum(y_true)', 'total')} FROM raw_pairs WHERE {w}" for p, w in POLICY.items()), RAW_PAIRS),
)
def valid_pairs(spark, d):
    from glyco.plans.series import Series

    s = Series(load_cgm(spark, d), back_rows=1)
    raw = s.close(
        s.df.withColumns({"y_true": F.coalesce("CGM", F.lit(0.0)), "y_pred": F.lag("CGM").over(s.window)})
    )
    out = None
    for policy in E.POLICIES:
        part_ = E.valid_pairs(raw, policy).agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("total"))
        part_ = part_.select(F.lit(policy).alias("policy"), "n", "total")
        out = part_ if out is None else out.unionByName(part_)
    return rounded(out)


# --- error grids: the rules restated as nested branches --------------------------------

ERR = "abs(y_pred - y_true)"
CLARKE = f"""CASE WHEN {ERR} <= 0.2::DOUBLE * y_true OR (y_true < 70 AND y_pred < 70) THEN 'A'
  WHEN y_true < 70 THEN CASE WHEN y_pred <= 180 THEN 'B' ELSE 'C' END
  WHEN y_true > 180 THEN CASE WHEN y_pred < 70 THEN 'C' WHEN y_pred < y_true THEN 'B'
    WHEN {ERR} <= 0.3::DOUBLE * y_true THEN 'B' WHEN {ERR} <= 0.5::DOUBLE * y_true THEN 'C' ELSE 'D' END
  ELSE CASE WHEN y_pred > 180 THEN 'C' WHEN y_pred >= 70 THEN 'B' ELSE 'D' END END"""
SIMPLE = f"""CASE WHEN y_true <= 70 THEN CASE WHEN y_pred <= 70 THEN 'A' WHEN y_pred <= 180 THEN 'B' ELSE 'C' END
  WHEN y_true >= 180 THEN CASE WHEN y_pred < 70 THEN 'E' WHEN y_pred <= y_true + 0.2::DOUBLE * y_true THEN 'A' ELSE 'C' END
  WHEN {ERR} <= 0.2::DOUBLE * y_true THEN 'A'
  WHEN y_pred > y_true THEN CASE WHEN y_pred <= 180 THEN 'B' ELSE 'C' END
  WHEN y_pred >= 70 THEN 'B' WHEN y_pred >= 56 THEN 'D' ELSE 'E' END"""


def parkes(kind):
    k = Z.PARKES[kind]
    lo, hi = f"{1 - k.near}::DOUBLE", f"{1 + k.near}::DOUBLE"
    near = f"{ERR} <= {k.near}::DOUBLE * y_true"
    return f"""CASE WHEN y_true <= 70 THEN CASE WHEN y_pred <= 70 THEN 'A' WHEN y_pred <= {k.low_b} THEN 'B' WHEN y_pred <= {k.low_c} THEN 'C' ELSE 'E' END
  WHEN {near} THEN 'A'
  WHEN y_true <= 180 THEN CASE WHEN {ERR} <= {k.wide}::DOUBLE * y_true THEN 'B'
     WHEN y_pred > y_true THEN CASE WHEN y_pred <= {k.mid_high} THEN 'C' ELSE 'E' END
     WHEN y_pred >= 70 THEN 'B' WHEN y_pred >= {k.mid_low} THEN 'D' ELSE 'E' END
  WHEN y_true <= {k.upper} THEN CASE WHEN y_pred BETWEEN {lo} * y_true AND {hi} * y_true THEN 'B' WHEN y_pred > y_true THEN 'C' WHEN y_pred >= 70 THEN 'B' ELSE 'D' END
  ELSE CASE WHEN y_pred >= {lo} * y_true THEN 'B' WHEN y_pred >= 70 THEN 'C' ELSE 'D' END END"""


RULES = {"clarke": CLARKE, "clarke_simple": SIMPLE, "parkes_type1": parkes("type1"), "parkes_type2": parkes("type2")}
NAMES = {"clarke": "clarke_zone", "clarke_simple": "clarke_zone_simple", "parkes_type1": "parkes_zone_type1", "parkes_type2": "parkes_zone_type2"}


def zone_query(grid):
    def run(spark, d):
        return E.with_zones(load_pairs(spark, d), grid).select("event_id", "zone")

    query(NAMES[grid], pairs_sql(f"SELECT event_id, {RULES[grid]} AS zone FROM pairs"))(run)


def zoned(grid):
    return f"zoned_{grid} AS (SELECT *, {RULES[grid]} AS zone FROM pairs WHERE y_true > 0 AND y_pred > 0)"


def percents(name):
    out = {f"{name}_zone_{z.lower()}_percent": f"count(*) FILTER (WHERE zone = '{z}') * 100.0::DOUBLE / count(*)" for z in Z.ZONES}
    out[f"{name}_clinically_acceptable_percent"] = "count(*) FILTER (WHERE zone IN ('A', 'B')) * 100.0::DOUBLE / count(*)"
    out[f"{name}_dangerous_errors_percent"] = "count(*) FILTER (WHERE zone IN ('D', 'E')) * 100.0::DOUBLE / count(*)"
    return out


def summary_sql(grid, by=""):
    name = grid.split("_")[0]
    kind = f", '{grid.split('_')[1]}' AS parkes_grid_type" if name == "parkes" else ""
    keys = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"SELECT {keys}{columns(percents(name))}, count(*) AS {name}_total_points{kind} FROM zoned_{grid}{tail}"


def summary_query(name, grid, by=""):
    def run(spark, d):
        return rounded(E.zone_summary(load_pairs(spark, d), grid, [by] if by else None))

    query(name, pairs_sql(summary_sql(grid, by), zoned(grid)))(run)


for _grid in RULES:
    zone_query(_grid)
summary_query("clarke_summary", "clarke")
summary_query("clarke_summary_by_participant", "clarke", BY)
summary_query("parkes_summary_type1", "parkes_type1")
summary_query("parkes_summary_type2", "parkes_type2")


def band(value, bands, sign):
    rules = " ".join(f"WHEN {value} {sign} {b} THEN '{t}'" for b, t in bands if b is not None)
    return f"CASE {rules} ELSE '{bands[-1][1]}' END"


def interpretation_sql(grid):
    name = grid.split("_")[0]
    bands = Z.CLARKE_BANDS if name == "clarke" else Z.PARKES_BANDS
    text = " || '; ' || ".join(
        [
            band(f"{name}_clinically_acceptable_percent", bands["acceptable"], ">="),
            band(f"{name}_zone_a_percent", bands["precision"], ">="),
            band(f"{name}_dangerous_errors_percent", bands["danger"], "<="),
        ]
    )
    if name == "parkes":
        text += " || '; Analysis performed using ' || upper(parkes_grid_type) || ' diabetes criteria'"
    return pairs_sql(f"SELECT participant_id, {text} AS interpretation FROM ({summary_sql(grid, BY)})", zoned(grid))


def interpretation_query(name, grid):
    def run(spark, d):
        summary = rounded(E.zone_summary(load_pairs(spark, d), grid, [BY]))
        return E.grid_interpretation(summary, grid).select(BY, "interpretation")

    query(name, interpretation_sql(grid))(run)


interpretation_query("grid_interpretation_clarke", "clarke")
interpretation_query("grid_interpretation_parkes", "parkes_type1")


def lead(diff, small, same, what):
    return (
        f"CASE WHEN abs({diff}) < {small} THEN '{same}' WHEN {diff} > 0 THEN 'Parkes grid shows ' || printf('%.1f', abs({diff})) || '% higher {what}' "
        f"ELSE 'Clarke grid shows ' || printf('%.1f', abs({diff})) || '% higher {what}' END"
    )


def shares(grid):
    return (
        "SELECT count(*) FILTER (WHERE zone IN ('A', 'B')) * 100.0::DOUBLE / count(*) AS ab, "
        f"count(*) FILTER (WHERE zone = 'A') * 100.0::DOUBLE / count(*) AS a FROM zoned_{grid}"
    )


@query(
    "compare_grids",
    pairs_sql(
        f"""SELECT {r('a', 'acceptable_diff')}, {r('z', 'zone_a_diff')},
        {lead('a', 1, 'Similar clinical acceptability between Parkes and Clarke grids', 'clinical acceptability')} || '; ' ||
        {lead('z', 2, 'Similar precision (Zone A) between grids', 'precision')} || '; ' ||
        CASE WHEN a < 0 THEN 'Parkes grid provides more stringent clinical assessment' ELSE 'Results consistent between both clinical assessment methods' END AS comparison
        FROM (SELECT p.ab - c.ab AS a, p.a - c.a AS z FROM ({shares('parkes_type1')}) p, ({shares('clarke')}) c)""",
        zoned("clarke"),
        zoned("parkes_type1"),
    ),
)
def compare_grids(spark, d):
    pairs = load_pairs(spark, d)
    return rounded(E.compare_grids(E.zone_summary(pairs, "parkes_type1"), E.zone_summary(pairs, "clarke")))


@query(
    "zone_descriptions",
    pairs_sql(
        "SELECT grid, z.zone, description, n FROM (VALUES "
        + ", ".join(f"('{g}', '{z}', '{text[z]}')" for g, text in (("clarke", Z.CLARKE_TEXT), ("parkes", Z.PARKES_TEXT)) for z in Z.ZONES)
        + ") AS z(grid, zone, description) JOIN (SELECT 'clarke' AS grid, zone, count(*) AS n FROM zoned_clarke GROUP BY zone UNION ALL "
        "SELECT 'parkes', zone, count(*) FROM zoned_parkes_type1 GROUP BY zone) USING (grid, zone)",
        zoned("clarke"),
        zoned("parkes_type1"),
    ),
)
def zone_descriptions(spark, d):
    pairs = load_pairs(spark, d)
    counts = [
        E.with_zones(pairs, g).groupBy("zone").agg(F.count(F.lit(1)).alias("n")).withColumn("grid", F.lit(g.split("_")[0]))
        for g in ("clarke", "parkes_type1")
    ]
    texts = E.zone_descriptions(spark)
    return texts.join(counts[0].unionByName(counts[1]), ["grid", "zone"]).select("grid", "zone", "description", "n")


SQUARE = "(y_true - y_pred) * (y_true - y_pred)"


@query(
    "losses",
    per_group(
        {
            "mse": f"avg({SQUARE})",
            "mae": "avg(abs(y_true - y_pred))",
            "huber": f"avg(CASE WHEN abs(y_true - y_pred) <= 1 THEN {SQUARE} / 2 ELSE abs(y_true - y_pred) - 0.5 END)",
            "glucose_aware": f"avg({SQUARE} * (1 + CASE WHEN y_true < 70 THEN 2 ELSE 0 END + CASE WHEN y_true > 180 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN NOT ({IN_T}) AND {IN_P} THEN 3 ELSE 0 END))",
        }
    ),
)
def losses(spark, d):
    return rounded(E.losses(load_pairs(spark, d), [BY]))


@query(
    "residual_histogram",
    pairs_sql(
        f"""SELECT bin, count(*) AS n, {r('any_value(lo) + bin * any_value(width)', 'bin_start')} FROM (
            SELECT least(floor((v - lo) / width), 49)::INT AS bin, lo, width FROM (SELECT y_pred - y_true AS v FROM pairs),
              (SELECT min(y_pred - y_true) AS lo, (max(y_pred - y_true) - min(y_pred - y_true)) / 50 AS width FROM pairs)) GROUP BY bin"""
    ),
)
def residual_histogram(spark, d):
    return rounded(E.residual_histogram(load_pairs(spark, d)))


@query(
    "zone_plot_points",
    pairs_sql(
        f"SELECT event_id, {r('y_true')}, {r('y_pred')}, zone, {r('(SELECT greatest(max(y_true), max(y_pred)) * 1.05::DOUBLE FROM zoned_clarke)', 'axis_limit')} FROM zoned_clarke",
        zoned("clarke"),
    ),
)
def zone_plot_points(spark, d):
    return rounded(E.zone_plot_points(load_pairs(spark, d)).select("event_id", "y_true", "y_pred", "zone", "axis_limit"))


# --- forecasts -----------------------------------------------------------------------


@query("forecast_persistence", pairs_sql(f"SELECT event_id, {r('y_true')}, {r('y_pred')} FROM pairs"))
def forecast_persistence(spark, d):
    return rounded(load_pairs(spark, d).select("event_id", "y_true", "y_pred"))


TREND = """known AS (SELECT event_id, participant_id, EventDateTime, CGM, row_number() OVER (PARTITION BY participant_id ORDER BY EventDateTime) AS rn FROM cgm WHERE CGM IS NOT NULL),
points AS (SELECT a.event_id, a.CGM AS y_true, b.CGM AS v, (epoch_us(b.EventDateTime) - epoch_us(a.EventDateTime)) / 60000000.0::DOUBLE AS x
  FROM known a JOIN known b ON a.participant_id = b.participant_id AND b.rn BETWEEN a.rn - 12 AND a.rn - 1 WHERE a.rn > 12)"""


@query(
    "forecast_trend",
    pairs_sql(f"SELECT event_id, {r('any_value(y_true)', 'y_true')}, {r('regr_intercept(v, x)', 'y_pred')} FROM points GROUP BY event_id", TREND),
)
def forecast_trend(spark, d):
    from glyco.operators.forecast import forecast_trend as trend

    return rounded(trend(load_cgm(spark, d)).select("event_id", "y_true", "y_pred"))
