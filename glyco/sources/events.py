"""Core schema derived from a generic event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forecast import forecast_persistence
from ..plans.series import Layout
from ..session import prepare


def cgm_from_events(events: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``events(event_id, ts, user_id, event_type, value)`` as device readings; ``extra`` event columns stay."""
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        "event_id",
        F.col("ts").alias("EventDateTime"),
        F.col("user_id").alias("participant_id"),
        kind.alias("DeviceMode"),
        F.when(kind != "error", value + 40).alias("CGM"),
        F.when(kind == "signup", value / 100).alias("Basal"),
        F.when(kind == "purchase", value / 10).alias("TotalBolusInsulinDelivered"),
        F.when((kind == "purchase") & (value > 50), value / 20).alias("CorrectionDelivered"),
        F.when(kind == "click", value).alias("FoodDelivered"),
        F.when(kind == "click", value * 0.8).alias("CarbSize"),
        *(extra or []),
    )


def load_cgm(spark: SparkSession, folder: str) -> DataFrame:
    """Readings from ``folder/events.parquet``."""
    prepare(spark)
    return cgm_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def load_pairs(spark: SparkSession, folder: str, layout: Layout | None = None) -> DataFrame:
    """Prediction pairs: a reading and the known reading before it."""
    return forecast_persistence(load_cgm(spark, folder), layout=layout)
