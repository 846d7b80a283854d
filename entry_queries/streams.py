"""Streaming operators, run over the whole table with ``availableNow`` and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyco.session import checkpoint_dir, prepare
from glyco.sources.events import cgm_from_events
from glyco.streaming import live as L

from .base import cgm_sql, query, r, rounded


def source(spark, d):
    prepare(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return cgm_from_events(L.read_readings(spark, d, schema, "events.parquet"))


def collect(spark, stream, *columns):
    """Run the stream into the shared folder and read the result."""
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    L.run_to_parquet(stream, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/out").select(*columns)


def zoneless(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


# Windows appear once the watermark (largest time less the delay) has passed them.
MARK = "mark AS (SELECT max(EventDateTime) - INTERVAL 10 MINUTE AS m FROM cgm)"
HOURS6 = 6 * 3_600_000_000


@query(
    "stream_resample",
    cgm_sql(
        f"""SELECT participant_id, make_timestamp(b * {HOURS6}) AS EventDateTime, {r('avg(CGM)', 'CGM')}, {r('avg(Basal)', 'Basal')},
        {r('sum(coalesce(TotalBolusInsulinDelivered, 0))', 'TotalBolusInsulinDelivered')}, {r('sum(coalesce(FoodDelivered, 0))', 'FoodDelivered')}, count(*) AS readings
        FROM (SELECT *, epoch_us(EventDateTime) // {HOURS6} AS b FROM cgm) WHERE make_timestamp((b + 1) * {HOURS6}) <= (SELECT m FROM mark) GROUP BY participant_id, b""",
        MARK,
    ),
)
def stream_resample(spark, d):
    out = collect(
        spark,
        L.stream_resample(source(spark, d), "6 hours"),
        "participant_id", *zoneless("EventDateTime"), "CGM", "Basal", "TotalBolusInsulinDelivered", "FoodDelivered", "readings",
    )
    return rounded(out)


@query(
    "stream_latest_metrics",
    cgm_sql(
        f"""SELECT participant_id, window_end, {r('avg(CGM)', 'avg_bg')}, {r('avg((CGM BETWEEN 70 AND 180)::INT::DOUBLE) * 100', 'time_in_range_pct')},
        {r('count(CGM) * 100.0::DOUBLE / count(*)', 'sensor_on_pct')} FROM (
          SELECT *, make_timestamp((epoch_us(EventDateTime) // {HOURS6} + 1 + k) * {HOURS6}) AS window_end FROM cgm, range(4) t(k))
        WHERE window_end <= (SELECT m FROM mark) GROUP BY participant_id, window_end""",
        MARK,
    ),
)
def stream_latest_metrics(spark, d):
    out = collect(
        spark,
        L.stream_latest_metrics(source(spark, d), "24 hours", "6 hours"),
        "participant_id", *zoneless("window_end"), "avg_bg", "time_in_range_pct", "sensor_on_pct",
    )
    return rounded(out)


@query("stream_dedupe", cgm_sql("SELECT participant_id, EventDateTime, CGM FROM cgm"))
def stream_dedupe(spark, d):
    # Every reading arrives twice.
    twice = source(spark, d).unionByName(source(spark, d))
    out = collect(spark, L.stream_dedupe(twice), "participant_id", *zoneless("EventDateTime"), "CGM")
    return out


@query(
    "stream_alerts",
    cgm_sql(
        """SELECT participant_id AS subject_id, EventDateTime AS "at",
        CGM AS value, CASE WHEN CGM < 70 THEN 'glucose below 70 mg/dL' ELSE 'glucose above 250 mg/dL' END AS message,
        CASE WHEN CGM < 70 THEN 'critical' ELSE 'warning' END AS severity FROM cgm WHERE CGM < 70 OR CGM > 250"""
    ),
)
def stream_alerts(spark, d):
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"

    def send(table, batch):
        table.write.mode("overwrite").parquet(f"{run}/alerts/batch={batch}")

    L.stream_alerts(source(spark, d), f"{run}/checkpoint", send).awaitTermination()
    return spark.read.parquet(f"{run}/alerts").select("subject_id", "at", "value", "message", "severity")


@query(
    "stream_sessions",
    cgm_sql(
        """SELECT participant_id, min(EventDateTime) AS session_start, max(EventDateTime) + INTERVAL 24 HOUR AS session_end, count(*) AS readings FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY participant_id ORDER BY EventDateTime) AS s FROM (
            SELECT *, (coalesce(EventDateTime - lag(EventDateTime) OVER (PARTITION BY participant_id ORDER BY EventDateTime) >= INTERVAL 24 HOUR, TRUE))::INT AS fresh FROM cgm))
        GROUP BY participant_id, s HAVING max(EventDateTime) + INTERVAL 24 HOUR <= (SELECT m FROM mark)""",
        MARK,
    ),
)
def stream_sessions(spark, d):
    out = collect(
        spark, L.stream_sessions(source(spark, d)), "participant_id", *zoneless("session_start", "session_end"), "readings"
    )
    return out


def state_sql():
    from .features import CHANGED, SINCE, acting

    names = [*SINCE]
    return cgm_sql(
        "SELECT participant_id, EventDateTime, " + ", ".join(r(SINCE[n], n) for n in names) + f", {r('insulin_on_board')} FROM changed JOIN acting USING (event_id)",
        CHANGED,
        acting("4320.0::DOUBLE", "900.0::DOUBLE"),
    )


@query("stream_time_since_event", state_sql())
def stream_time_since_event(spark, d):
    out = collect(
        spark,
        L.stream_time_since_event(source(spark, d), duration=4320.0),
        "participant_id", *zoneless("EventDateTime"), "time_since_last_meal", "time_since_last_bolus", "time_since_last_basal", "insulin_on_board",
    )
    return rounded(out)


DAY_US = 24 * 3_600_000_000


@query(
    "stream_uptime_alerts",
    cgm_sql(
        f"""SELECT participant_id AS subject_id, make_timestamp((b + 1) * {DAY_US}) AS "at", {r('v', 'value')}, 'sensor readings missing' AS message, 'info' AS severity FROM (
        SELECT participant_id, epoch_us(EventDateTime) // {DAY_US} AS b, least(count(CGM) / 24.0::DOUBLE, 1) * 100 AS v FROM cgm GROUP BY ALL)
        WHERE 100 - v > 20 AND make_timestamp((b + 1) * {DAY_US}) <= (SELECT m FROM mark)""",
        MARK,
    ),
)
def stream_uptime_alerts(spark, d):
    alerts = L.uptime_alerts(L.with_watermark(source(spark, d), "10 minutes"), "24 hours", "1 hour")
    return rounded(collect(spark, alerts, "subject_id", *zoneless("at"), "value", "message", "severity"))
