"""Live measures on streams of device readings (Structured Streaming).

A stream has the columns of the core schema with ``EventDateTime`` as a timestamp.
Rows later than the watermark delay are dropped and counted by Spark
(``numRowsDroppedByWatermark``). Empty bins, whole-column statistics and back-fill
need the whole series and stay batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import expressions as E
from ..operators.features import IOB_ROWS
from ..schema import KEY, TARGET, TIME, duration_us


def read_readings(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", max_files: int = 100
) -> DataFrame:
    """Parquet files arriving in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def with_watermark(stream: DataFrame, delay: str = "10 minutes", time: str = TIME) -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def stream_resample(stream: DataFrame, freq: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean glucose and basal rate and summed doses per participant and bin."""
    return (
        with_watermark(stream, delay)
        .groupBy(KEY, F.window(TIME, freq).alias("_w"))
        .agg(
            F.avg(TARGET).alias(TARGET),
            F.avg("Basal").alias("Basal"),
            F.sum(F.coalesce("TotalBolusInsulinDelivered", F.lit(0.0))).alias("TotalBolusInsulinDelivered"),
            F.sum(F.coalesce("FoodDelivered", F.lit(0.0))).alias("FoodDelivered"),
            F.count(F.lit(1)).alias("readings"),
        )
        .select(KEY, F.col("_w.start").alias(TIME), TARGET, "Basal", "TotalBolusInsulinDelivered", "FoodDelivered", "readings")
    )


def stream_latest_metrics(
    stream: DataFrame,
    window: str = "60 minutes",
    slide: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Mean, range share and sensor share over sliding windows."""
    c = F.col(TARGET)
    return (
        with_watermark(stream, delay)
        .groupBy(KEY, F.window(TIME, window, slide).alias("_w"))
        .agg(
            F.avg(c).alias("avg_bg"),
            (F.avg(E.in_range(c).cast("double")) * 100).alias("time_in_range_pct"),
            (F.count(c) * 100.0 / F.count(F.lit(1))).alias("sensor_on_pct"),
        )
        .select(KEY, F.col("_w.end").alias("window_end"), "avg_bg", "time_in_range_pct", "sensor_on_pct")
    )


def stream_dedupe(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First reading per participant and time within the watermark."""
    return with_watermark(stream, delay).dropDuplicatesWithinWatermark([KEY, TIME])


# Severity per alert.
SEVERITY = {"hypo": "critical", "hyper": "warning", "uptime": "info"}
UPTIME_MESSAGE = "sensor readings missing"


def alerts(readings: DataFrame, low: float = E.HYPO, high: float = E.HYPER) -> DataFrame:
    """``subject_id, at, value, message, severity`` for readings outside the limits; batch or stream."""
    c = F.col(TARGET)
    kind = F.when(c < low, "hypo").when(c > high, "hyper")
    found = readings.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    text = F.when(F.col("_kind") == "hypo", f"glucose below {low:g} mg/dL").otherwise(f"glucose above {high:g} mg/dL")
    severity = F.when(F.col("_kind") == "hypo", SEVERITY["hypo"]).otherwise(SEVERITY["hyper"])
    return found.select(F.col(KEY).alias("subject_id"), F.col(TIME).alias("at"), c.alias("value"), text.alias("message"), severity.alias("severity"))


def uptime_alerts(readings: DataFrame, window: str = "24 hours", cadence: str = "5 minutes", alert_above: float = 20.0) -> DataFrame:
    """``subject_id, at, value, message, severity`` where more than ``alert_above`` % of a window's readings are missing.

    Batch or stream (with a watermark). ``value`` is the share received. A window without any row is not
    seen; ``operators.explore.sensor_uptime`` looks back from a given end instead.
    """
    expected = duration_us(window) / duration_us(cadence)
    uptime = F.least(F.count(TARGET) / F.lit(expected), F.lit(1.0)) * 100.0
    spans = readings.groupBy(KEY, F.window(TIME, window).alias("_w")).agg(uptime.alias("value"))
    return spans.filter(100.0 - F.col("value") > alert_above).select(
        F.col(KEY).alias("subject_id"), F.col("_w.end").alias("at"), "value", F.lit(UPTIME_MESSAGE).alias("message"), F.lit(SEVERITY["uptime"]).alias("severity")
    )


def stream_alerts(
    stream: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None], **limits: float
) -> StreamingQuery:
    """Hand the alerts of every micro-batch to ``send(table, batch_id)``.

    ``foreachBatch`` may repeat a batch after a failure; ``send`` should write by batch id.
    """
    return (
        alerts(stream, **limits)
        .writeStream.foreachBatch(send)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sessions(stream: DataFrame, gap: str = "24 hours", delay: str = "10 minutes") -> DataFrame:
    """Sessions of readings per participant, closed after ``gap`` without a reading."""
    return (
        with_watermark(stream, delay)
        .groupBy(KEY, F.session_window(TIME, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("readings"))
        .select(KEY, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "readings")
    )


# --- state per participant -------------------------------------------------------------

STATE = (
    "last_meal bigint, last_bolus bigint, last_change bigint, basal double, has_basal boolean, "
    "seen bigint, times array<bigint>, doses array<double>, places array<bigint>"
)
STATE_OUT = (
    "participant_id {kind}, EventDateTime timestamp, time_since_last_meal double, "
    "time_since_last_bolus double, time_since_last_basal double, insulin_on_board double"
)
BEGUN = {"last_meal": None, "last_bolus": None, "last_change": None, "basal": 0.0, "has_basal": False, "seen": 0, "times": [], "doses": [], "places": []}


def _hours_since(times: np.ndarray, happened: np.ndarray, last: int | None, default: float) -> tuple[np.ndarray, int | None]:
    """Hours since the last event at every reading (the reading itself counts), and the last event."""
    none = np.iinfo(np.int64).min
    latest = np.maximum.accumulate(np.where(happened, times, none))
    latest = np.maximum(latest, none if last is None else last)
    hours = np.where(latest == none, default, (times - latest) / 3_600_000_000.0)
    return hours, None if latest[-1] == none else int(latest[-1])


def _on_board(times: np.ndarray, places: np.ndarray, given: np.ndarray, doses: np.ndarray, at: np.ndarray, duration: float, rows: int | None) -> np.ndarray:
    """Units still on board at every reading, from the doses in order (their times, units and row numbers).

    One binary search gives each reading its first and last acting dose, one running sum of decayed doses what
    lies between. Sums start anew every few durations, so that neither they nor the exponentials grow.
    """
    width = int(duration * 60_000_000)
    rate = E.DECAY_CONSTANT / duration / 60.0 / 60_000_000.0
    first = np.searchsorted(given, times - width, "right")
    if rows is None:
        end = np.searchsorted(given, times, "left")  # a dose of the same time does not count yet
    else:
        # In rows, those before it count even at the same time; after a late reading both orders must agree.
        first = np.maximum(first, np.searchsorted(at, places - rows, "left"))
        end = np.minimum(np.searchsorted(given, times, "right"), np.searchsorted(at, places, "left"))
    out = np.zeros(len(times))
    for block in np.unique(times // (8 * width)):
        here = np.flatnonzero((times // (8 * width) == block) & (end > first))
        if len(here):
            low, high = first[here].min(), end[here].max()
            base = given[low]
            sums = np.concatenate([[0.0], np.cumsum(doses[low:high] * np.exp(rate * (given[low:high] - base)))])
            out[here] = (sums[end[here] - low] - sums[first[here] - low]) * np.exp(-rate * (times[here] - base))
    return out


def _advance(state: dict, times: np.ndarray, food: np.ndarray, bolus: np.ndarray, basal: np.ndarray, duration: float, rows: int | None, delay_us: int) -> list[np.ndarray]:
    """The outputs of readings in time order; ``state`` is moved past them."""
    meal, state["last_meal"] = _hours_since(times, food > 0, state["last_meal"], 24.0)
    dose, state["last_bolus"] = _hours_since(times, bolus > 0, state["last_bolus"], 12.0)
    # A missing rate on either side is no change.
    before = np.concatenate([[state["basal"] if state["has_basal"] else np.nan], basal[:-1]])
    change, state["last_change"] = _hours_since(times, np.abs(basal - before) > 0.01, state["last_change"], 6.0)
    state["has_basal"], state["basal"] = not np.isnan(basal[-1]), float(np.nan_to_num(basal[-1]))
    places = state["seen"] + np.arange(len(times))
    acts = (bolus > 0) & np.isfinite(bolus)
    given = np.concatenate([np.array(state["times"], np.int64), times[acts]])
    units = np.concatenate([np.array(state["doses"], np.float64), bolus[acts]])
    at = np.concatenate([np.array(state["places"], np.int64), places[acts]])
    # A late reading may have brought doses between those that were kept.
    order = np.argsort(given, kind="stable")
    given, units, at = given[order], units[order], at[order]
    iob = _on_board(times, places, given, units, np.maximum.accumulate(at), duration, rows)
    state["seen"] += len(times)
    # Readings up to ``delay`` late may still look back from there.
    keep = given > max(int(given.max(initial=0)), int(times[-1])) - int(duration * 60_000_000) - delay_us
    if rows is not None:
        keep &= at >= state["seen"] - rows
    state["times"], state["doses"], state["places"] = given[keep].tolist(), units[keep].tolist(), at[keep].tolist()
    return [meal, dose, change, iob]


def stream_time_since_event(
    stream: DataFrame,
    delay: str = "10 minutes",
    duration: float = E.INSULIN_DURATION,
    forget_after_hours: int = 24 * 30,
    rows: int | None = IOB_ROWS,
) -> DataFrame:
    """Hours since meal, bolus and basal change, and insulin on board, per arriving reading.

    ``rows`` limits insulin on board to the doses of as many earlier readings; ``rows=None`` takes all within
    ``duration``. The state of a participant is three times, one rate and the doses that can still act, which time
    bounds. A key's part of a micro-batch is held as four numeric arrays and taken in time order; size micro-batches
    with the source's ``maxFilesPerTrigger``. A silent participant is forgotten after a while. A dose
    that is no finite positive number does not act.
    """
    kind = stream.schema[KEY].dataType.simpleString()
    fields = [f.split()[0] for f in STATE.split(", ")]
    out_names = [f.split()[0] for f in STATE_OUT.split(", ")]
    delay_us = duration_us(delay)
    measures = ["FoodDelivered", "TotalBolusInsulinDelivered", "Basal"]

    def step(key, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state = dict(zip(fields, group.get)) if group.exists else {k: list(v) if isinstance(v, list) else v for k, v in BEGUN.items()}
        times, values = [], []
        for batch in batches:
            times.append(batch[TIME].astype("datetime64[us]").astype("int64").to_numpy())
            values.append(batch[measures].to_numpy(dtype=float))
        times, values = np.concatenate(times), np.concatenate(values)
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
        made = _advance(state, times, *values.T, duration, rows, delay_us)
        group.update(tuple(state[f] for f in fields))
        expiry = int(times[-1] // 1000) + forget_after_hours * 3_600_000
        group.setTimeoutTimestamp(max(expiry, group.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(dict(zip(out_names[2:], made)))
        out.insert(0, TIME, times.astype("datetime64[us]"))
        out.insert(0, KEY, key[0])
        yield out

    slim = with_watermark(stream, delay).select(KEY, TIME, *measures)
    return slim.groupBy(KEY).applyInPandasWithState(
        step, STATE_OUT.format(kind=kind), STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available and stop; results land in ``path``."""
    return (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
