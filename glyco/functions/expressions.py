"""Row-level column expressions, all built in and free of Python workers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glucose limits in mg/dL and insulin action in minutes.
HYPO = 70.0
RANGE_HIGH = 180.0
HYPER = 250.0
INSULIN_DURATION = 360.0
INSULIN_PEAK = 75.0
DECAY_CONSTANT = 4.0
# The marker of prediction replies and the advice per status.
PREDICTION_MARKER = "[PREDICTION RESULT]"
STATUS_ADVICE = {
    "LOW": "Consider consuming fast-acting carbohydrates and monitor closely.",
    "NORMAL": "Your blood sugar is expected to be in the target range.",
    "HIGH": "Consider checking for ketones and contacting your healthcare provider "
    "if elevated for extended periods.",
}


def calendar(time: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0), day, month and weekend flag."""
    return {
        "hour_of_day": F.hour(time),
        "day_of_week": F.weekday(time),
        "day_of_month": F.dayofmonth(time),
        "month": F.month(time),
        "is_weekend": (F.weekday(time) >= 5).cast("int"),
    }


def cyclical(time: Column) -> dict[str, Column]:
    """Hour and weekday on the circle."""
    hour = F.hour(time) * (2 * math.pi / 24)
    day = F.weekday(time) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)}


def in_range(c: Column, low: float = HYPO, high: float = RANGE_HIGH) -> Column:
    """Inclusive target range; NULL stays NULL."""
    return (c >= low) & (c <= high)


def decay_fraction(minutes: Column, duration: float = INSULIN_DURATION) -> Column:
    """Share of a bolus still on board after ``minutes``."""
    return (
        F.when(minutes <= 0, 1.0)
        .when(minutes >= duration, 0.0)
        .otherwise(F.exp(minutes * (-DECAY_CONSTANT / duration / 60.0)))
    )


def effect_fraction(minutes: Column, duration: float = INSULIN_DURATION, peak: float = INSULIN_PEAK) -> Column:
    """Triangular insulin effect with its top at ``peak``."""
    rising = minutes / peak
    falling = (duration - minutes) / (duration - peak)
    return F.when((minutes <= 0) | (minutes >= duration), 0.0).otherwise(F.least(rising, falling))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is positive, else 0."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator)).otherwise(0.0)


def glucose_status(value: Column) -> Column:
    """LOW, NORMAL or HIGH."""
    return F.when(value < HYPO, "LOW").when(value <= RANGE_HIGH, "NORMAL").otherwise("HIGH")


def status_advice(status: Column) -> Column:
    """Advice text of a status."""
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in STATUS_ADVICE.items()])


def trend(readings: Column) -> Column:
    """rising or falling from the last two of an array; equal readings count as falling."""
    return F.when(F.size(readings) < 2, "stable").when(
        F.element_at(readings, -1) > F.element_at(readings, -2), "rising"
    ).otherwise("falling")


def participant_from_path(path: Column) -> Column:
    """``.../Subject 7/x.csv`` -> ``subject_7``; else the file stem."""
    parts = F.split(F.url_decode(path), "/")
    folder = F.element_at(F.filter(parts, lambda p: p.contains("Subject")), 1)
    number = F.regexp_extract(folder, r"Subject\s*(\d+)", 1)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    named = F.when(F.size(F.filter(parts, lambda p: p.contains("Subject"))) > 0, number)
    return F.when(F.coalesce(named, F.lit("")) != "", F.concat(F.lit("subject_"), named)).otherwise(stem)


def parse_time(text: Column, fmt: str | None = None) -> Column:
    """Lenient parse to a zone-less timestamp; unparseable text becomes NULL."""
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return parsed.cast("timestamp_ntz")


def strip_prediction_marker(text: Column, role: Column) -> tuple[Column, Column]:
    """Marked messages become assistant messages without the marker: ``(text, role)``."""
    marked = F.startswith(text, F.lit(PREDICTION_MARKER))
    bare = F.trim(F.replace(text, F.lit(PREDICTION_MARKER), F.lit("")))
    return F.when(marked, bare).otherwise(text), F.when(marked, F.lit("assistant")).otherwise(role)


def mard_band(mard: Column) -> Column:
    """excellent below 10, good below 15, acceptable below 20, else poor."""
    return F.when(mard < 10, "excellent").when(mard < 15, "good").when(mard < 20, "acceptable").otherwise("poor")
