"""Prediction requests: validation, assembly from event timelines, array features.

A request row: ``subject_id, readings array<double>, carbs array<struct<amount,
timestamp>>, insulin array<struct<units, timestamp>>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READINGS = 12
SLOT_MINUTES = 5
MAX_READING = 600.0


def validate_request(requests: DataFrame) -> DataFrame:
    """Column ``errors`` (array of texts, empty when fine) and ``is_valid``."""
    bad = F.filter(
        F.transform("readings", lambda v, i: F.when((v < 0) | (v > MAX_READING) | v.isNull(), i)),
        lambda i: i.isNotNull(),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.size("readings") != READINGS, F.format_string("expected 12 readings, got %d", F.size("readings"))),
            F.when(F.size(bad) > 0, F.concat(F.lit("readings out of range at "), F.concat_ws(",", bad.cast("array<string>")))),
            F.when(F.exists("carbs", lambda c: c["amount"] < 0), F.lit("negative carbohydrates")),
            F.when(F.exists("insulin", lambda c: c["units"] < 0), F.lit("negative insulin")),
        )
    )
    return requests.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def timeline_to_request(
    timeline: DataFrame, slot: str = "5 minutes", readings: int = READINGS
) -> DataFrame:
    """Event timelines ``(subject_id, ts, type, value)`` to request rows, one per subject and slot.

    A request spans ``readings`` slots, so what is gathered into one row is bounded
    by the events of that span; a subject's long history becomes many requests.
    """
    number, unit = slot.split()
    span = f"{int(number) * readings} {unit}"
    parts = timeline.groupBy("subject_id", F.window("ts", span).alias("_w")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "glucose", F.struct("ts", "value")))).alias("g"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "carbohydrate", F.struct("ts", "value")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "insulin", F.struct("ts", "value")))).alias("i"),
    )

    def named(column: str, amount: str):
        return F.transform(
            column, lambda x: F.struct(x["value"].alias(amount), x["ts"].cast("string").alias("timestamp"))
        )

    return parts.select(
        "subject_id",
        F.col("_w.start").alias("span_start"),
        F.transform("g", lambda x: x["value"]).alias("readings"),
        named("c", "amount").alias("carbs"),
        named("i", "units").alias("insulin"),
    )


def request_features(requests: DataFrame) -> DataFrame:
    """Mean, population deviation, deviations from the mean, carbohydrate and insulin totals.

    Requests with a ``span_start`` also get ``hours``: the hour of day of each reading's slot.
    """
    n = F.size("readings")
    total = F.aggregate("readings", F.lit(0.0), lambda a, v: a + v)
    mean = F.try_divide(total, n)

    def amount(column: str, field: str):
        return F.aggregate(F.coalesce(column, F.array().cast(requests.schema[column].dataType)), F.lit(0.0), lambda a, x: a + F.coalesce(x[field], F.lit(0.0)))

    out = requests.withColumn("mean_glucose", mean)
    squares = F.aggregate(
        "readings", F.lit(0.0), lambda a, v: a + (v - F.col("mean_glucose")) * (v - F.col("mean_glucose"))
    )
    if "span_start" in requests.columns:
        start = F.hour("span_start") + F.minute("span_start") / 60.0
        slots = F.sequence(F.lit(0), F.lit(READINGS - 1))
        out = out.withColumn("hours", F.transform(slots, lambda i: (start + i * SLOT_MINUTES / 60.0) % 24.0))
    return out.withColumns(
        {
            "std_glucose": F.sqrt(F.try_divide(squares, n)),
            "deviations": F.transform("readings", lambda v: v - F.col("mean_glucose")),
            "total_carbs": amount("carbs", "amount"),
            "total_insulin": amount("insulin", "units"),
        }
    )
