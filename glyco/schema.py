"""Core schema of the subject time series and its declared expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "participant_id"
TIME = "EventDateTime"
TARGET = "CGM"

CORE = T.StructType(
    [
        T.StructField(TIME, T.TimestampNTZType()),
        T.StructField(KEY, T.StringType()),
        T.StructField("DeviceMode", T.StringType()),
        T.StructField("BolusType", T.StringType()),
        T.StructField("Basal", T.DoubleType()),
        T.StructField("CorrectionDelivered", T.DoubleType()),
        T.StructField("TotalBolusInsulinDelivered", T.DoubleType()),
        T.StructField("FoodDelivered", T.DoubleType()),
        T.StructField("CarbSize", T.DoubleType()),
        T.StructField(TARGET, T.DoubleType()),
    ]
)

# Allowed range per measure.
VALUE_RANGES = {
    "Basal": (0.0, 10.0),
    "CorrectionDelivered": (0.0, 50.0),
    "TotalBolusInsulinDelivered": (0.0, 50.0),
    "FoodDelivered": (0.0, 200.0),
    "CarbSize": (0.0, 200.0),
    "CGM": (20.0, 600.0),
}

# Tokens read as missing.
NA_TOKENS = ["", "NA", "N/A", "null", "NULL", "nan", "NaN"]

MEASURES = list(VALUE_RANGES)


def micros(time: str | Column = TIME) -> Column:
    """Microseconds since the epoch; session time zone is pinned to UTC."""
    c = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(c.cast("timestamp"))


def duration_us(text: str | int) -> int:
    """``"6 hours"`` -> microseconds; integers pass through."""
    if isinstance(text, int):
        return text
    number, unit = text.split()
    scale = {
        "microsecond": 1,
        "second": 1_000_000,
        "minute": 60_000_000,
        "hour": 3_600_000_000,
        "day": 86_400_000_000,
    }[unit.rstrip("s")]
    return int(float(number) * scale)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (KEY, TIME)) -> list[str]:
    """Numeric columns other than key and time, in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
