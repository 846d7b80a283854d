"""Clinical and statistical evaluation of prediction pairs.

Input columns ``y_true`` and ``y_pred``; every measure is one aggregation pass and
takes optional group columns (participant, fold, split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import zones as Z

def T() -> Column:
    """Reference value."""
    return F.col("y_true")


def P() -> Column:
    """Predicted value."""
    return F.col("y_pred")


POLICIES = ("reference_positive", "finite", "finite_positive", "both_positive")
PERCENT = 100.0


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_pairs(df: DataFrame, policy: str = "finite_positive") -> DataFrame:
    """Pairs usable under a policy."""
    tests = {
        "reference_positive": T() > 0,
        "finite": _finite(T()) & _finite(P()),
        "finite_positive": _finite(T()) & _finite(P()) & (T() > 0),
        "both_positive": (T() > 0) & (P() > 0),
    }
    if policy not in tests:
        raise ValueError(f"policy must be one of {POLICIES}")
    return df.filter(tests[policy])


def _agg(df: DataFrame, by: list[str] | None, columns: dict[str, Column]) -> DataFrame:
    aggs = [c.alias(name) for name, c in columns.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _required(value: Column, message: str) -> Column:
    """The value, or a failed job when there was nothing to measure."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _part(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def _mard(positive: Column) -> Column:
    return F.avg(F.when(positive, F.abs((T() - P()) / F.when(T() != 0, T())))) * PERCENT


def _mard_measure() -> dict[str, Column]:
    return {"mard": _mard(T() > 0)}


def _errors() -> dict[str, Column]:
    e, n = T() - P(), F.count(F.lit(1))
    spread = F.var_pop(T()) * n
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1.0 - F.try_divide(F.sum(e * e), spread),
        "valid_predictions": n,
    }


def _share(test: Column) -> Column:
    return F.avg(test.cast("double")) * PERCENT


def _confusion(true: Column, predicted: Column) -> tuple[Column, Column, Column, Column]:
    return (
        F.count_if(true & predicted),
        F.count_if(~true & predicted),
        F.count_if(~true & ~predicted),
        F.count_if(true & ~predicted),
    )


def _tir(low: float, high: float) -> dict[str, Column]:
    t, p = E.in_range(T(), low, high), E.in_range(P(), low, high)
    tp, fp, tn, fn = _confusion(t, p)
    return {
        "true_tir_percent": _share(t),
        "predicted_tir_percent": _share(p),
        "tir_prediction_accuracy": _share(t == p),
        "tir_sensitivity": _part(tp, tp + fn) * PERCENT,
        "tir_specificity": _part(tn, tn + fp) * PERCENT,
        "tir_absolute_error": F.abs(_share(t) - _share(p)),
    }


def _detection(name: str, t: Column, p: Column) -> dict[str, Column]:
    tp, fp, tn, fn = _confusion(t, p)
    sensitivity, precision = _part(tp, tp + fn), _part(tp, tp + fp)
    return {
        f"{name}_sensitivity": sensitivity * PERCENT,
        f"{name}_specificity": _part(tn, tn + fp) * PERCENT,
        f"{name}_precision": precision * PERCENT,
        f"{name}_accuracy": _part(tp + tn, tp + fp + tn + fn) * PERCENT,
        f"{name}_f1_score": _part(tp * 2.0, tp * 2.0 + fp + fn) * PERCENT,
        f"true_{name}_rate": _share(t),
        f"predicted_{name}_rate": _share(p),
    }


def _hypo(threshold: float) -> dict[str, Column]:
    return _detection("hypoglycemia", T() < threshold, P() < threshold)


def _hyper(threshold: float) -> dict[str, Column]:
    return _detection("hyperglycemia", T() > threshold, P() > threshold)


def mard(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean absolute relative difference in percent over positive references; none fails."""
    return _agg(df, by, {"mard": _required(_mard(T() > 0), "no positive reference values")})


def regression_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mae, mse, rmse, r2 over finite pairs; NULL and 0 pairs when there are none."""
    return _agg(valid_pairs(df, "finite"), by, _errors())


def tir_accuracy(
    df: DataFrame, by: list[str] | None = None, low: float = E.HYPO, high: float = E.RANGE_HIGH
) -> DataFrame:
    """How well the predictions tell time in range."""
    return _agg(df, by, _tir(low, high))


def hypo_detection(df: DataFrame, by: list[str] | None = None, threshold: float = E.HYPO) -> DataFrame:
    """Detection of values below the threshold."""
    return _agg(df, by, _hypo(threshold))


def hyper_detection(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Detection of values above the threshold, which callers must choose."""
    return _agg(df, by, _hyper(threshold))


def clinical_metrics_all(
    df: DataFrame, hyper_threshold: float = E.HYPER, by: list[str] | None = None
) -> DataFrame:
    """All clinical measures in one pass."""
    errors = _errors()
    return _agg(
        df,
        by,
        {
            **_mard_measure(),
            "mae": errors["mae"],
            "rmse": errors["rmse"],
            **_tir(E.HYPO, E.RANGE_HIGH),
            **_hypo(E.HYPO),
            **_hyper(hyper_threshold),
        },
    )


def _glucose_measures(hyper_threshold: float) -> dict[str, Column]:
    hypo_t, hyper_t = T() < E.HYPO, T() > hyper_threshold
    return {
        "mard": _mard(T() > 0),
        "time_in_range_accuracy": _share(E.in_range(T()) == E.in_range(P())),
        "hypoglycemia_detection_rate": F.try_divide(F.count_if(hypo_t & (P() < E.HYPO)) * PERCENT, F.count_if(hypo_t)),
        "hyperglycemia_detection_rate": F.try_divide(
            F.count_if(hyper_t & (P() > hyper_threshold)) * PERCENT, F.count_if(hyper_t)
        ),
        "glucose_bias": F.avg(P() - T()),
        "glucose_precision": F.stddev_pop(P() - T()),
    }


def glucose_metrics(df: DataFrame, hyper_threshold: float = E.RANGE_HIGH, by: list[str] | None = None) -> DataFrame:
    """Relative error, range agreement, detection rates (NULL without events), bias, precision."""
    return _agg(valid_pairs(df, "finite_positive"), by, _glucose_measures(hyper_threshold))


def overall_score(mard_value: Column, tir_value: Column, r2_value: Column) -> Column:
    """Mean of the available parts: relative error, range agreement, fit."""
    parts = F.array_compact(
        F.array(
            F.when(mard_value.isNotNull(), F.greatest(100.0 - mard_value / 15.0 * 50.0, F.lit(0.0))),
            tir_value * 0.3,
            F.when(r2_value.isNotNull(), F.greatest(r2_value * 20.0, F.lit(0.0))),
        )
    )
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(parts)), F.lit(0.0))


def comprehensive_metrics(
    df: DataFrame, hyper_threshold: float = E.RANGE_HIGH, by: list[str] | None = None, training: DataFrame | None = None
) -> DataFrame:
    """Regression and glucose measures with the overall score, one pass over the finite pairs.

    ``training`` (``training_summary``) adds its columns as ``training_*``, by ``run_id`` = the first of ``by``.
    """
    pairs = valid_pairs(df, "finite")
    # The glucose measures additionally need a positive reference: blank the other pairs there.
    positive = T() > 0
    masked = pairs.withColumns({"_t": F.when(positive, T()), "_p": F.when(positive, P())})
    t, p = F.col("_t"), F.col("_p")
    hypo_t, hyper_t = t < E.HYPO, t > hyper_threshold
    out = _agg(
        masked,
        by,
        {
            **{f"regression_{k}": v for k, v in _errors().items()},
            "glucose_mard": F.avg(F.abs((t - p) / t)) * PERCENT,
            "glucose_time_in_range_accuracy": _share(E.in_range(t) == E.in_range(p)),
            "glucose_hypoglycemia_detection_rate": F.try_divide(
                F.count_if(hypo_t & (p < E.HYPO)) * PERCENT, F.count_if(hypo_t)
            ),
            "glucose_hyperglycemia_detection_rate": F.try_divide(
                F.count_if(hyper_t & (p > hyper_threshold)) * PERCENT, F.count_if(hyper_t)
            ),
            "glucose_glucose_bias": F.avg(p - t),
            "glucose_glucose_precision": F.stddev_pop(p - t),
        },
    )
    out = out.withColumn(
        "overall_score",
        overall_score(F.col("glucose_mard"), F.col("glucose_time_in_range_accuracy"), F.col("regression_r2")),
    )
    if training is None:
        return out
    if not by:
        raise ValueError("training metrics are joined by run, so name the run column in by")
    named = training.select(F.col("run_id").alias("_run"), *[F.col(c).alias(f"training_{c}") for c in training.columns if c != "run_id"])
    return out.join(named, F.col(by[0]).eqNullSafe(F.col("_run")), "left").drop("_run")


def with_zones(df: DataFrame, grid: str = "clarke") -> DataFrame:
    """Column ``zone``; ``grid`` is clarke, clarke_simple, parkes_type1 or parkes_type2."""
    makers = {
        "clarke": lambda: Z.clarke_zone(T(), P()),
        "clarke_simple": lambda: Z.clarke_zone_simple(T(), P()),
        "parkes_type1": lambda: Z.parkes_zone(T(), P(), "type1"),
        "parkes_type2": lambda: Z.parkes_zone(T(), P(), "type2"),
    }
    if grid not in makers:
        raise ValueError(f"grid must be one of {tuple(makers)}")
    return df.withColumn("zone", makers[grid]())


def zone_summary(df: DataFrame, grid: str = "clarke", by: list[str] | None = None) -> DataFrame:
    """Zone percentages, A+B, D+E and the number of pairs with both values positive."""
    zoned = with_zones(valid_pairs(df, "both_positive"), grid)
    name = grid.split("_")[0]
    n, zone = F.count(F.lit(1)), F.col("zone")

    def percent(*wanted: str) -> Column:
        return F.try_divide(F.count_if(zone.isin(*wanted)) * PERCENT, n)

    out = {f"{name}_zone_{z.lower()}_percent": percent(z) for z in Z.ZONES}
    out[f"{name}_clinically_acceptable_percent"] = percent("A", "B")
    out[f"{name}_dangerous_errors_percent"] = percent("D", "E")
    out[f"{name}_total_points"] = F.when(n > 0, n).otherwise(
        F.raise_error(F.lit("no valid glucose pairs")).cast("bigint")
    )
    table = _agg(zoned, by, out)
    if name == "parkes":
        table = table.withColumn("parkes_grid_type", F.lit(grid.split("_")[1]))
    return table


# Texts of the grid reports.
CRITERIA_TEXT = ("Analysis performed using ", " diabetes criteria")
HIGHER_TEXT = {"parkes": "Parkes grid shows ", "clarke": "Clarke grid shows "}
SAME_ACCEPTANCE = "Similar clinical acceptability between Parkes and Clarke grids"
SAME_PRECISION = "Similar precision (Zone A) between grids"
STRINGENT = "Parkes grid provides more stringent clinical assessment"
CONSISTENT = "Results consistent between both clinical assessment methods"


def grid_interpretation(summary: DataFrame, grid: str = "clarke") -> DataFrame:
    """Column ``interpretation`` on a zone summary."""
    name = grid.split("_")[0]
    bands = Z.CLARKE_BANDS if name == "clarke" else Z.PARKES_BANDS
    more = []
    if name == "parkes":
        more = [
            F.concat(F.lit(CRITERIA_TEXT[0]), F.upper("parkes_grid_type"), F.lit(CRITERIA_TEXT[1]))
        ]
    text = Z.interpretation(
        bands,
        F.col(f"{name}_clinically_acceptable_percent"),
        F.col(f"{name}_zone_a_percent"),
        F.col(f"{name}_dangerous_errors_percent"),
        *more,
    )
    return summary.withColumn("interpretation", text)


def compare_grids(parkes: DataFrame, clarke: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Text on how the two summaries differ."""
    both = parkes.join(clarke, by) if by else parkes.join(clarke)
    accept = F.col("parkes_clinically_acceptable_percent") - F.col("clarke_clinically_acceptable_percent")
    precise = F.col("parkes_zone_a_percent") - F.col("clarke_zone_a_percent")

    def lead(diff: Column, small: float, same: str, what: str) -> Column:
        amount = F.format_string("%.1f", F.abs(diff))
        return (
            F.when(F.abs(diff) < small, same)
            .when(diff > 0, F.concat(F.lit(HIGHER_TEXT["parkes"]), amount, F.lit(f"% higher {what}")))
            .otherwise(F.concat(F.lit(HIGHER_TEXT["clarke"]), amount, F.lit(f"% higher {what}")))
        )

    text = F.concat_ws(
        "; ",
        lead(accept, 1, SAME_ACCEPTANCE, "clinical acceptability"),
        lead(precise, 2, SAME_PRECISION, "precision"),
        F.when(accept < 0, STRINGENT).otherwise(CONSISTENT),
    )
    return both.select(*(by or []), accept.alias("acceptable_diff"), precise.alias("zone_a_diff"), text.alias("comparison"))


def zone_descriptions(spark) -> DataFrame:
    """Zone texts of both grids."""
    rows = [("clarke", z, Z.CLARKE_TEXT[z]) for z in Z.ZONES] + [("parkes", z, Z.PARKES_TEXT[z]) for z in Z.ZONES]
    return spark.createDataFrame(rows, "grid string, zone string, description string")


# Weights of the glucose-aware loss.
LOSS_WEIGHTS = {"below": 2.0, "above": 1.5, "false_in_range": 3.0}


def losses(df: DataFrame, by: list[str] | None = None, delta: float = 1.0) -> DataFrame:
    """mse, mae, Huber and the glucose-aware loss."""
    e = F.abs(T() - P())
    square = (T() - P()) * (T() - P())
    extra = (
        F.when(T() < E.HYPO, square * LOSS_WEIGHTS["below"]).otherwise(0.0)
        + F.when(T() > E.RANGE_HIGH, square * LOSS_WEIGHTS["above"]).otherwise(0.0)
        + F.when(~E.in_range(T()) & E.in_range(P()), square * LOSS_WEIGHTS["false_in_range"]).otherwise(0.0)
    )
    huber = F.when(e <= delta, square * 0.5).otherwise(e * delta - 0.5 * delta * delta)
    return _agg(
        df,
        by,
        {
            "mse": F.avg(square),
            "mae": F.avg(e),
            "huber": F.avg(huber),
            "glucose_aware": F.avg(square) + F.avg(extra),
        },
    )


def histogram(df: DataFrame, value: Column, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal bins between the smallest and the largest value; the last bin includes its end."""
    data = df.select(*(by or []), value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    span = data.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    if span["lo"] is None:
        return data.groupBy(*(by or [])).agg(
            F.max(F.lit(0)).alias("bin"), F.max("_v").alias("bin_start"), F.count("_v").alias("n")
        ).limit(0)
    width = (span["hi"] - span["lo"]) / bins or 1.0
    place = F.least(F.floor((F.col("_v") - span["lo"]) / width), F.lit(bins - 1)).cast("int")
    return (
        data.withColumn("bin", place)
        .groupBy(*(by or []), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(span["lo"]) + F.col("bin") * width)
    )


def residual_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Prediction minus reference in equal bins."""
    return histogram(df, P() - T(), bins)


def zone_plot_points(df: DataFrame, grid: str = "clarke") -> DataFrame:
    """Pairs with their zone and the axis limit of the plot."""
    zoned = with_zones(valid_pairs(df, "both_positive"), grid)
    top = zoned.agg(F.greatest(F.max("y_true"), F.max("y_pred"))).first()[0]
    return zoned.withColumn("axis_limit", F.lit(top) * 1.05)
