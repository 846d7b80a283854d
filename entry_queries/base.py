"""Registration of queries and the SQL text shared by their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MEASURES = ["Basal", "CorrectionDelivered", "TotalBolusInsulinDelivered", "FoodDelivered", "CarbSize", "CGM"]

# The device readings as SQL, the same derivation as glyco.sources.events.
CGM = """cgm AS (
SELECT event_id, ts AS EventDateTime, user_id AS participant_id, event_type AS DeviceMode,
       CASE WHEN event_type <> 'error' THEN value + 40 END AS CGM,
       CASE WHEN event_type = 'signup' THEN value / 100 END AS Basal,
       CASE WHEN event_type = 'purchase' THEN value / 10 END AS TotalBolusInsulinDelivered,
       CASE WHEN event_type = 'purchase' AND value > 50 THEN value / 20 END AS CorrectionDelivered,
       CASE WHEN event_type = 'click' THEN value END AS FoodDelivered,
       CASE WHEN event_type = 'click' THEN value * 0.8::DOUBLE END AS CarbSize
FROM events)"""

PAIRS = """pairs AS (
SELECT * FROM (
  SELECT event_id, participant_id, EventDateTime, CGM AS y_true,
         last_value(CGM IGNORE NULLS) OVER (PARTITION BY participant_id ORDER BY EventDateTime
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y_pred
  FROM cgm) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""


def query(name: str, sql: str | None = None):
    """Register a query, with its check when SQL can state it."""

    def register(func):
        QUERIES[name] = func
        if sql is not None:
            ORACLE[name] = sql
        return func

    return register


def cgm_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([CGM, *ctes]) + "\n" + body


def pairs_sql(body: str, *ctes: str) -> str:
    return cgm_sql(body, PAIRS, *ctes)


def r(expr: str, name: str | None = None) -> str:
    """Rounded SQL output column; adding 0 turns -0 into 0."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0 AS {name or expr}"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals and dates as text on the Spark side."""

    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(c, 6) + F.lit(0.0)).alias(f.name)
        return c.cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else c

    return df.select(*[plain(f) for f in df.schema.fields])


def per_column(columns: list[str], template: str) -> str:
    """UNION ALL of a template with ``{c}`` replaced per column."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)
