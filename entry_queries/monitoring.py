"""Exploration, monitoring, conversations, requests, registries and user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyco.functions import expressions as X
from glyco.operators import asof as A
from glyco.operators import conversations as C
from glyco.operators import distinct as D
from glyco.operators import explore as E
from glyco.operators import forecast as M
from glyco.operators import registry as G
from glyco.operators import requests as Q
from glyco.operators import udf as U
from glyco.operators.sequences import sliding_sequences
from glyco.session import checkpoint_dir, prepare
from glyco.sources import files as S
from glyco.sources import sinks as K
from glyco.sources.events import load_cgm, load_pairs

from .base import CGM, PAIRS, cgm_sql, pairs_sql, query, r, rounded
from .evaluation import ALL as CLINICAL

W = "PARTITION BY participant_id ORDER BY EventDateTime"
IN = "(CGM BETWEEN 70 AND 180)::INT::DOUBLE"


@query(
    "gap_histogram",
    cgm_sql(
        f"""SELECT gap_seconds, count(*) AS n FROM (SELECT ((epoch_us(EventDateTime) - lag(epoch_us(EventDateTime)) OVER ({W})) // 1000000)::BIGINT AS gap_seconds FROM cgm)
            WHERE gap_seconds IS NOT NULL GROUP BY gap_seconds"""
    ),
)
def gap_histogram(spark, d):
    return E.gap_histogram(load_cgm(spark, d))


@query(
    "value_histogram",
    cgm_sql(
        f"""SELECT bin, count(*) AS n, {r('any_value(lo) + bin * any_value(width)', 'bin_start')} FROM (
            SELECT least(floor((CGM - lo) / width), 59)::INT AS bin, lo, width FROM cgm, (SELECT min(CGM) AS lo, (max(CGM) - min(CGM)) / 60 AS width FROM cgm)
            WHERE CGM IS NOT NULL) GROUP BY bin"""
    ),
)
def value_histogram(spark, d):
    return rounded(E.value_histogram(load_cgm(spark, d)))


BOX = """box AS (SELECT participant_id, quantile_cont(CGM, 0.25) AS q25, quantile_cont(CGM, 0.5) AS median, quantile_cont(CGM, 0.75) AS q75 FROM cgm GROUP BY participant_id)"""


@query(
    "box_stats",
    cgm_sql(
        f"""SELECT participant_id, {r('q25')}, {r('median')}, {r('q75')},
        {r('min(CGM) FILTER (WHERE CGM BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))', 'whisker_low')},
        {r('max(CGM) FILTER (WHERE CGM BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))', 'whisker_high')},
        count(*) FILTER (WHERE CGM NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS n_fliers
        FROM cgm JOIN box USING (participant_id) GROUP BY participant_id, q25, median, q75""",
        BOX,
    ),
)
def box_stats(spark, d):
    return rounded(E.box_stats(load_cgm(spark, d)))


@query("tir_by_participant", cgm_sql(f"SELECT participant_id, round(avg({IN}) * 100, 1) AS tir_percent FROM cgm GROUP BY participant_id ORDER BY 2, 1"))
def tir_by_participant(spark, d):
    return E.tir_by_participant(load_cgm(spark, d))


@query("daily_missing", cgm_sql(f"SELECT participant_id, EventDateTime::DATE::VARCHAR AS \"day\", {r('avg((CGM IS NULL)::INT::DOUBLE)', 'missing_fraction')} FROM cgm GROUP BY ALL"))
def daily_missing(spark, d):
    return rounded(E.daily_missing(load_cgm(spark, d)))


@query(
    "daily_missing_matrix",
    cgm_sql(
        """SELECT participant_id, string_agg("day" || '=' || fraction, ',' ORDER BY "day") AS days FROM (
           SELECT participant_id, EventDateTime::DATE::VARCHAR AS "day", CAST(round(avg((CGM IS NULL)::INT::DOUBLE) * 1000000) AS BIGINT) AS fraction FROM cgm GROUP BY ALL)
           GROUP BY participant_id"""
    ),
)
def daily_missing_matrix(spark, d):
    wide = E.daily_missing_matrix(load_cgm(spark, d))
    # The day columns depend on the table, so the check sees them as one text in millionths.
    cells = [F.concat(F.lit(f"{c}="), F.round(F.col(f"`{c}`") * 1_000_000).cast("bigint").cast("string")) for c in wide.columns if c != "participant_id"]
    return wide.select("participant_id", F.concat_ws(",", *cells).alias("days"))


@query("variability_flag", cgm_sql(f"SELECT participant_id, {r('stddev_samp(CGM)', 'sd')}, stddev_samp(CGM) > 60 AS high_variability FROM cgm GROUP BY participant_id"))
def variability_flag(spark, d):
    return rounded(E.variability_flag(load_cgm(spark, d)))


@query(
    "overnight_rise",
    cgm_sql(
        f"""SELECT participant_id, EventDateTime::DATE::VARCHAR AS night, {r('arg_max(CGM, EventDateTime) - arg_min(CGM, EventDateTime)', 'rise')}, count(*) AS readings
            FROM cgm WHERE CGM IS NOT NULL AND EventDateTime::TIME BETWEEN TIME '03:00:00' AND TIME '06:00:00' GROUP BY participant_id, EventDateTime::DATE"""
    ),
)
def overnight_rise(spark, d):
    return rounded(E.overnight_rise(load_cgm(spark, d)))


@query(
    "basal_bg_correlation",
    cgm_sql(
        f"""SELECT participant_id, count(*) AS n, {r('corr(Basal, CGM)', 'correlation')} FROM (
            SELECT participant_id, CGM, last_value(Basal IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Basal FROM cgm)
            WHERE Basal IS NOT NULL AND CGM IS NOT NULL GROUP BY participant_id"""
    ),
)
def basal_bg_correlation(spark, d):
    return rounded(E.basal_bg_correlation(load_cgm(spark, d)))


DAILY = """daily AS (SELECT participant_id, EventDateTime::DATE AS "day", count(*) AS n_rows, count(CGM) AS n, sum(CGM) AS total, sum(CGM * CGM) AS squares,
  count(*) FILTER (WHERE CGM BETWEEN 70 AND 180) AS in_range, count(*) FILTER (WHERE CGM > 250) AS hyper FROM cgm GROUP BY ALL)"""
F14 = """(PARTITION BY participant_id ORDER BY "day" RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)"""


@query(
    "rolling_14d_dashboard",
    cgm_sql(
        f"""SELECT participant_id, "day"::VARCHAR AS "day", {r('in_range * 100.0::DOUBLE / nullif(n, 0)', 'tir_percent')}, {r('total / nullif(n, 0)', 'avg_glucose')},
        {r('sqrt(greatest((squares - total * total / nullif(n, 0)) / nullif(n - 1, 0), 0) + CASE WHEN n > 1 THEN 0 END)', 'sd_glucose')}, hyper AS n_hyper, {r('n * 100.0::DOUBLE / n_rows', 'sensor_on_percent')}
        FROM (SELECT participant_id, "day", sum(in_range) OVER w AS in_range, sum(n)::BIGINT OVER w AS n, sum(n_rows) OVER w AS n_rows, sum(total) OVER w AS total,
          sum(squares) OVER w AS squares, (sum(hyper) OVER w)::BIGINT AS hyper FROM daily WINDOW w AS {F14})""".replace("sum(n)::BIGINT OVER w", "sum(n) OVER w"),
        DAILY,
    ),
)
def rolling_14d_dashboard(spark, d):
    return rounded(E.rolling_14d_dashboard(load_cgm(spark, d)))


def recent(us):
    return f"""recent AS (SELECT cgm.* FROM cgm JOIN (SELECT participant_id, max(epoch_us(EventDateTime)) AS z FROM cgm GROUP BY participant_id) USING (participant_id)
      WHERE epoch_us(EventDateTime) > z - {us})"""


UP = "least(count(CGM) / 8.0::DOUBLE, 1) * 100"


@query(
    "sensor_uptime",
    cgm_sql(
        f"SELECT participant_id, count(CGM) AS readings, {r(UP, 'uptime_percent')}, 100 - {UP} > 20 AS alert FROM recent GROUP BY participant_id",
        recent(48 * 3_600_000_000),
    ),
)
def sensor_uptime(spark, d):
    return rounded(E.sensor_uptime(load_cgm(spark, d), "48 hours", "6 hours"))


@query(
    "latest_metrics",
    cgm_sql(
        f"SELECT participant_id, {r('avg(CGM)', 'avg_bg')}, {r(f'avg({IN}) * 100', 'time_in_range_pct')}, {r('count(CGM) * 100.0::DOUBLE / count(*)', 'sensor_on_pct')} FROM recent GROUP BY participant_id",
        recent(48 * 3_600_000_000),
    ),
)
def latest_metrics(spark, d):
    return rounded(E.latest_metrics(load_cgm(spark, d), "48 hours"))


@query(
    "worst_days",
    cgm_sql(
        f"""SELECT participant_id, "day"::VARCHAR AS "day", {r('tir', 'tir_percent')}, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY tir, "day")::INT AS rank FROM (
          SELECT participant_id, "day", in_range * 100.0::DOUBLE / n AS tir FROM daily WHERE n > 0)) WHERE rank <= 3""",
        DAILY,
    ),
)
def worst_days(spark, d):
    return rounded(E.worst_days(load_cgm(spark, d)))


def snapshot_sql():
    from .features import acting

    return cgm_sql(
        f"""SELECT participant_id, {r('latest_bg')}, CASE WHEN previous IS NULL THEN 'stable' WHEN latest_bg > previous THEN 'rising' ELSE 'falling' END AS trend,
        {r('avg_bg')}, {r('iob', 'insulin_on_board')}, {r('(z - known) / 60000000.0::DOUBLE', 'minutes_since_reading')}, {r('(z - meal) / 60000000.0::DOUBLE', 'minutes_since_meal')},
        CASE WHEN latest_bg < 70 THEN 'LOW' WHEN latest_bg <= 180 THEN 'NORMAL' ELSE 'HIGH' END AS status
        FROM (SELECT participant_id, arg_max(CGM, t) FILTER (WHERE CGM IS NOT NULL) AS latest_bg, avg(CGM) AS avg_bg, arg_max(insulin_on_board, t) AS iob, max(t) AS z,
          max(t) FILTER (WHERE CGM IS NOT NULL) AS known, max(t) FILTER (WHERE FoodDelivered > 0) AS meal FROM joined GROUP BY participant_id)
        LEFT JOIN (SELECT participant_id, CGM AS previous FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY EventDateTime DESC) AS k FROM cgm WHERE CGM IS NOT NULL) WHERE k = 2) USING (participant_id)""",
        acting("360.0::DOUBLE", "75.0::DOUBLE"),
        "joined AS (SELECT cgm.*, insulin_on_board, epoch_us(EventDateTime) AS t FROM cgm JOIN acting USING (event_id))",
    )


@query("patient_snapshot", snapshot_sql())
def patient_snapshot(spark, d):
    return rounded(E.patient_snapshot(load_cgm(spark, d)))


ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STATUS_ADVICE.items())


@query(
    "glucose_status",
    cgm_sql(
        f"""SELECT event_id, status, trend, CASE status {ADVICE} END AS advice FROM (SELECT event_id,
        CASE WHEN CGM < 70 THEN 'LOW' WHEN CGM <= 180 THEN 'NORMAL' ELSE 'HIGH' END AS status,
        CASE WHEN lag(CGM) OVER ({W}) IS NULL THEN 'stable' WHEN CGM > lag(CGM) OVER ({W}) THEN 'rising' ELSE 'falling' END AS trend FROM cgm WHERE CGM IS NOT NULL)"""
    ),
)
def glucose_status(spark, d):
    return E.status_of_readings(load_cgm(spark, d)).select("event_id", "status", "trend", "advice")


# --- requests ------------------------------------------------------------------------

TIMELINE = """timeline AS (SELECT user_id AS subject_id, ts, CASE event_type WHEN 'click' THEN 'carbohydrate' WHEN 'purchase' THEN 'insulin' ELSE 'glucose' END AS type,
  value, epoch_us(ts) // 432000000000 AS span FROM events)"""


def requests(spark, d):
    prepare(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "carbohydrate").when(F.col("event_type") == "purchase", "insulin").otherwise("glucose")
    timeline = events.select(F.col("user_id").alias("subject_id"), "ts", kind.alias("type"), "value")
    return Q.timeline_to_request(timeline, "10 hours")


def listed(kind):
    return f"coalesce(string_agg(round(value, 2)::VARCHAR, ',' ORDER BY ts) FILTER (WHERE type = '{kind}'), '')"


@query(
    "timeline_to_request",
    f"""WITH {TIMELINE} SELECT subject_id, make_timestamp(span * 432000000000) AS span_start, {listed('glucose')} AS readings,
        {listed('carbohydrate')} AS carbs, {listed('insulin')} AS insulin FROM timeline GROUP BY subject_id, span""",
)
def timeline_to_request(spark, d):
    def text(column, field=None):
        values = F.transform(column, lambda x: F.round(x[field] if field else x, 2).cast("string"))
        return F.concat_ws(",", values)

    return requests(spark, d).select(
        "subject_id",
        "span_start",
        text("readings").alias("readings"),
        text("carbs", "amount").alias("carbs"),
        text("insulin", "units").alias("insulin"),
    )


@query("validate_request", f"""WITH {TIMELINE} SELECT subject_id, make_timestamp(span * 432000000000) AS span_start,
    count(*) FILTER (WHERE type = 'glucose') = 12 AND coalesce(bool_and(value BETWEEN 0 AND 600) FILTER (WHERE type = 'glucose'), TRUE) AS is_valid FROM timeline GROUP BY subject_id, span""")
def validate_request(spark, d):
    return Q.validate_request(requests(spark, d)).select("subject_id", "span_start", "is_valid")


@query(
    "request_features",
    f"""WITH {TIMELINE} SELECT subject_id, make_timestamp(span * 432000000000) AS span_start, {r("avg(value) FILTER (WHERE type = 'glucose')", "mean_glucose")},
    {r("stddev_pop(value) FILTER (WHERE type = 'glucose')", "std_glucose")}, {r("coalesce(sum(value) FILTER (WHERE type = 'carbohydrate'), 0)", "total_carbs")},
    {r("coalesce(sum(value) FILTER (WHERE type = 'insulin'), 0)", "total_insulin")},
    {r("(span * 432000000000 % 86400000000) / 3600000000.0::DOUBLE", "first_hour")}, {r("(span * 432000000000 % 86400000000) / 3600000000.0::DOUBLE + 55 / 60.0::DOUBLE", "last_hour")}
    FROM timeline GROUP BY subject_id, span""",
)
def request_features(spark, d):
    out = Q.request_features(requests(spark, d)).withColumns({"first_hour": F.element_at("hours", 1), "last_hour": F.element_at("hours", -1)})
    return rounded(out.select("subject_id", "span_start", "mean_glucose", "std_glucose", "total_carbs", "total_insulin", "first_hour", "last_hour"))


# --- conversations -------------------------------------------------------------------

# Conversations belong to one of 50 subjects; a message's time follows from its place.
MSG = """msg AS (SELECT conv_id, (conv_id % 50)::BIGINT AS subject_id, turn, role, text,
  TIMESTAMP '2024-01-01' + INTERVAL (conv_id * 3600 + turn * 60) SECOND AS ts FROM conversations)"""
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM msg) WHERE k <= {n}"


def messages(spark, d):
    prepare(spark)
    raw = spark.read.parquet(f"{d}/conversations.parquet")
    start = F.lit("2024-01-01").cast("timestamp")
    seconds = F.col("conv_id") * 3600 + F.col("turn") * 60
    return raw.select(
        "conv_id",
        (F.col("conv_id") % 50).alias("subject_id"),
        "turn",
        "role",
        "text",
        F.timestamp_seconds(F.unix_seconds(start) + seconds).cast("timestamp_ntz").alias("ts"),
    )


def conv_sql(body, *ctes):
    return "WITH " + ", ".join([MSG, *ctes]) + " " + body


@query("conversation_history", conv_sql(f"SELECT conv_id, turn, role, text FROM ({LATEST.format(n=3)})"))
def conversation_history(spark, d):
    return C.conversation_history(messages(spark, d), 3).select("conv_id", "turn", "role", "text")


@query(
    "conversation_context",
    conv_sql(
        f"""SELECT conv_id, 'Previous conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn, role, text) AS context
            FROM ({LATEST.format(n=10)}) GROUP BY conv_id"""
    ),
)
def conversation_context(spark, d):
    return C.conversation_context(messages(spark, d))


@query("conversation_get", conv_sql("SELECT conv_id, turn, role, text FROM msg WHERE conv_id = 7 AND subject_id = 7"))
def conversation_get(spark, d):
    return C.conversation_get(messages(spark, d), 7, 7).select("conv_id", "turn", "role", "text")


@query("conversation_delete", conv_sql("SELECT conv_id, turn, role FROM msg WHERE conv_id <> 7"))
def conversation_delete(spark, d):
    return C.conversation_delete(messages(spark, d), 7).select("conv_id", "turn", "role")


CONV = "conv AS (SELECT subject_id, conv_id, count(*) AS messages, min(ts) AS created_at, max(ts) AS last_activity FROM msg GROUP BY subject_id, conv_id)"


@query("conversation_list", conv_sql("SELECT * FROM conv", CONV))
def conversation_list(spark, d):
    return C.conversation_list(messages(spark, d))


@query(
    "conversation_retention",
    conv_sql("SELECT subject_id, conv_id, messages FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY last_activity DESC, conv_id) AS k FROM conv) WHERE k <= 1", CONV),
)
def conversation_retention(spark, d):
    kept = C.conversation_retention(C.conversation_list(messages(spark, d)), 1)
    return kept.select("subject_id", "conv_id", "messages")


@query("conversation_expiry", conv_sql("SELECT conv_id, last_activity FROM conv WHERE last_activity >= TIMESTAMP '2024-01-04' - INTERVAL 24 HOUR", CONV))
def conversation_expiry(spark, d):
    now = F.lit("2024-01-04").cast("timestamp_ntz")
    return C.conversation_expiry(C.conversation_list(messages(spark, d)), now).select("conv_id", "last_activity")


@query(
    "conversation_stats",
    conv_sql("SELECT coalesce(conv.subject_id::VARCHAR, 'all') AS subject_id, count(*) AS conversations, sum(messages)::BIGINT AS messages, grouping(conv.subject_id)::INT AS is_total FROM conv GROUP BY ROLLUP (conv.subject_id)", CONV),
)
def conversation_stats(spark, d):
    stats = C.conversation_stats(messages(spark, d))
    return stats.withColumn("subject_id", F.coalesce(F.col("subject_id").cast("string"), F.lit("all")))


@query(
    "strip_prediction_marker",
    conv_sql("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN trim(text, ' ') ELSE text END AS text, CASE WHEN turn % 2 = 1 THEN 'assistant' ELSE role END AS role FROM msg"),
)
def strip_prediction_marker(spark, d):
    # Replies are given the marker first.
    marked = F.when(F.col("turn") % 2 == 1, F.concat(F.lit(X.PREDICTION_MARKER + " "), "text")).otherwise(F.col("text"))
    return C.strip_markers(messages(spark, d).withColumn("text", marked)).select("conv_id", "turn", "text", "role")


# --- run logs and registries ---------------------------------------------------------

# Each user is a training run, each day an epoch, and the day's values its losses.
LOGS = """logs AS (SELECT user_id AS run_id, day(ts)::INT AS epoch, 'loss' AS metric, avg(value) AS value, min(ts) AS ts FROM events GROUP BY ALL
  UNION ALL SELECT user_id, day(ts)::INT, 'val_loss', max(value), min(ts) FROM events GROUP BY ALL
  UNION ALL SELECT user_id, day(ts)::INT, 'mae', min(value), min(ts) FROM events GROUP BY ALL)"""


def logs(spark, d):
    prepare(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    daily = events.groupBy(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(
        F.avg("value").alias("loss"), F.max("value").alias("val_loss"), F.min("value").alias("mae"), F.min("ts").alias("ts")
    )
    entries = F.create_map(*[x for m in ("loss", "val_loss", "mae") for x in (F.lit(m), F.col(m))])
    return daily.select("run_id", "epoch", "ts", F.explode(entries).alias("metric", "value"))


def log_sql(body, *ctes):
    return "WITH " + ", ".join([LOGS, *ctes]) + " " + body


@query(
    "run_statistics",
    log_sql(
        f"""SELECT run_id, metric, {r('arg_max(value, epoch)', 'final')}, {r("CASE WHEN metric LIKE '%loss%' THEN min(value) ELSE max(value) END", 'best')},
            {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')} FROM logs GROUP BY run_id, metric"""
    ),
)
def run_statistics(spark, d):
    return rounded(G.run_statistics(logs(spark, d)))


@query(
    "run_durations",
    log_sql(
        f"""SELECT run_id, n AS epochs_completed, {r('s', 'duration_seconds')}, {r('s / n', 'avg_epoch_time')} FROM (
            SELECT run_id, count(*) AS n, (epoch_us(arg_max(ts, epoch)) - epoch_us(arg_min(ts, epoch))) / 1000000.0::DOUBLE AS s FROM logs WHERE metric = 'loss' GROUP BY run_id) WHERE n > 1"""
    ),
)
def run_durations(spark, d):
    return rounded(G.run_durations(logs(spark, d)))


@query(
    "training_summary",
    log_sql(
        f"""SELECT t.run_id, total_epochs, {r('final_train_loss')}, {r('final_val_loss')}, {r('best_val_loss')}, best_epoch,
        {r('CASE WHEN total_epochs > 10 THEN slope END', 'loss_trend')}, CASE WHEN total_epochs > 10 THEN abs(slope) < 0.5 END AS converged FROM (
          SELECT run_id, count(*) FILTER (WHERE metric = 'loss') AS total_epochs, arg_max(value, epoch) FILTER (WHERE metric = 'loss') AS final_train_loss,
            arg_max(value, epoch) FILTER (WHERE metric = 'val_loss') AS final_val_loss, min(value) FILTER (WHERE metric = 'val_loss') AS best_val_loss FROM logs GROUP BY run_id) t
        JOIN (SELECT run_id, regr_slope(value, -k) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS k FROM logs WHERE metric = 'loss') WHERE k <= 10 GROUP BY run_id) USING (run_id)
        JOIN (SELECT run_id, epoch AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, epoch) AS k FROM logs WHERE metric = 'val_loss') WHERE k = 1) USING (run_id)"""
    ),
)
def training_summary(spark, d):
    return rounded(G.training_summary(logs(spark, d), 0.5))


@query(
    "training_progress",
    log_sql(
        f"""SELECT run_id, current_epoch, {r('total_seconds')}, {r('recent', 'avg_epoch_time')}, {r('current_epoch * 100.0::DOUBLE / 30', 'progress_pct')},
        {r('recent * (30 - current_epoch)', 'eta_seconds')}, {r('1000 / nullif(mean, 0)', 'samples_per_second')}, CASE WHEN current_epoch >= 30 THEN 'completed' ELSE 'running' END AS status
        FROM (SELECT run_id, max(epoch) AS current_epoch, sum(value) AS total_seconds, avg(value) AS mean FROM logs WHERE metric = 'loss' GROUP BY run_id)
        JOIN (SELECT run_id, avg(value) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS k FROM logs WHERE metric = 'loss') WHERE k <= 10 GROUP BY run_id) USING (run_id)"""
    ),
)
def training_progress(spark, d):
    epochs = logs(spark, d).filter("metric = 'loss'").select("run_id", "epoch", F.col("value").alias("seconds"))
    return rounded(G.training_progress(epochs, 30, 1000))


def losses(spark, d):
    return logs(spark, d).filter("metric = 'loss'").select("run_id", "epoch", "value")


# Without a minimum step an improvement is a new strict minimum of the run so far.
@query(
    "early_stop_epoch",
    log_sql(
        f"""SELECT run_id, coalesce(min(epoch) FILTER (WHERE stop), -1)::BIGINT AS stopped_epoch, arg_max(epoch, k) FILTER (WHERE better AND NOT after)::BIGINT AS best_epoch,
        {r('arg_max(value, k) FILTER (WHERE better AND NOT after)', 'best_value')} FROM (
          SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS after FROM (
            SELECT *, k - max(CASE WHEN better THEN k END) OVER (PARTITION BY run_id ORDER BY k) >= 5 AS stop FROM (
              SELECT *, coalesce(value < min(value) OVER (PARTITION BY run_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better FROM (
                SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM logs WHERE metric = 'loss')))) GROUP BY run_id"""
    ),
)
def early_stop_epoch(spark, d):
    out = G.early_stop_epoch(losses(spark, d), patience=5)
    return rounded(out.withColumn("stopped_epoch", F.coalesce("stopped_epoch", F.lit(-1).cast("bigint"))))


@query(
    "best_checkpoint",
    log_sql(f"SELECT run_id, epoch AS best_epoch, {r('value', 'best_value')} FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, epoch) AS k FROM logs WHERE metric = 'loss') WHERE k = 1"),
)
def best_checkpoint(spark, d):
    return rounded(G.best_checkpoint(losses(spark, d)))


@query(
    "retain_latest",
    log_sql(f"SELECT run_id, epoch, {r('value')} FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS k FROM logs WHERE metric = 'loss') WHERE k <= 3"),
)
def retain_latest(spark, d):
    return rounded(G.retain_latest(losses(spark, d), 3))


@query(
    "checkpoint_inventory",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'best' WHEN 'click' THEN 'resume' ELSE 'periodic' END AS type, 'r' || user_id AS run_id,
       CASE WHEN event_type NOT IN ('view', 'click') THEN day(ts)::INT ELSE -1 END AS epoch FROM events WHERE event_type <> 'error'""",
)
def checkpoint_inventory(spark, d):
    prepare(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    run, kind = F.concat(F.lit("r"), F.col("user_id").cast("string")), F.col("event_type")
    path = (
        F.when(kind == "view", F.concat(F.lit("/c/best/best_model_"), run, F.lit(".keras")))
        .when(kind == "click", F.concat(F.lit("/c/resume/resume_"), run, F.lit(".keras")))
        .when(kind == "error", F.lit("/c/notes.txt"))
        .otherwise(F.concat(F.lit("/c/periodic/model_"), run, F.lit("_epoch_"), F.dayofmonth("ts").cast("string"), F.lit(".keras")))
    )
    return G.checkpoint_inventory(events.select("event_id", path.alias("path"))).select(
        "event_id", "type", "run_id", F.coalesce("epoch", F.lit(-1)).alias("epoch")
    )


# Each user is a model and each of its purchases a version of it.
VERSIONS = """versions AS (SELECT 'm' || user_id AS model, '1.' || day(ts) || '.' || row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts) AS version,
  day(ts) AS major, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts) AS minor, ts AS created_at, value AS loss FROM events WHERE event_type = 'purchase')"""


def versions(spark, d):
    from pyspark.sql import Window

    prepare(spark)
    bought = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'purchase'")
    day = F.dayofmonth("ts").cast("string")
    n = F.row_number().over(Window.partitionBy("user_id", F.dayofmonth("ts")).orderBy("ts")).cast("string")
    return bought.select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"),
        F.concat_ws(".", F.lit("1"), day, n).alias("version"),
        F.col("ts").alias("created_at"),
        F.create_map(F.lit("loss"), F.col("value")).alias("performance"),
    )


@query(
    "registry_versions",
    f"WITH {VERSIONS} SELECT model, version, created_at, row_number() OVER (PARTITION BY model ORDER BY created_at DESC)::INT AS age, row_number() OVER (PARTITION BY model ORDER BY created_at DESC) = 1 AS is_latest FROM versions",
)
def registry_versions(spark, d):
    return G.registry_versions(versions(spark, d)).select("model", "version", "created_at", "age", "is_latest")


@query("registry_latest", f"WITH {VERSIONS} SELECT model, version, created_at FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at DESC) AS k FROM versions) WHERE k = 1")
def registry_latest(spark, d):
    return G.latest_versions(versions(spark, d)).select("model", "version", "created_at")


@query("registry_retention", f"WITH {VERSIONS} SELECT model, version FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created_at DESC) AS k FROM versions) WHERE k > 10")
def registry_retention(spark, d):
    return G.surplus_versions(versions(spark, d), 10).select("model", "version")


@query(
    "next_version",
    f"""WITH {VERSIONS}, candidates AS (SELECT 'm' || user_id AS model, avg(value) AS loss FROM events GROUP BY user_id),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY major DESC, minor DESC) AS k FROM versions) WHERE k = 1)
    SELECT c.model, n.version AS latest_version, CASE WHEN n.model IS NULL THEN '1.0.0' WHEN coalesce((n.loss - c.loss) / nullif(n.loss, 0) > 0.01, TRUE) THEN '1.' || (major + 1) || '.0'
      ELSE '1.' || major || '.' || (minor + 1) END AS next_version FROM candidates c LEFT JOIN newest n ON c.model = n.model""",
)
def next_version(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    candidates = events.groupBy(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model")).agg(F.avg("value").alias("loss"))
    return G.next_version(versions(spark, d), candidates)


@query(
    "compare_models",
    log_sql(
        f"""SELECT metric, {r('a.value', 'model1')}, {r('b.value', 'model2')}, {r('(b.value - a.value) / a.value * 100', 'improvement_percent')}
            FROM (SELECT metric, avg(value) AS value FROM logs WHERE run_id = 1 GROUP BY metric) a FULL JOIN (SELECT metric, avg(value) AS value FROM logs WHERE run_id = 2 GROUP BY metric) b USING (metric)"""
    ),
)
def compare_models(spark, d):
    metrics = logs(spark, d).groupBy(F.col("run_id").alias("version"), "metric").agg(F.avg("value").alias("value"))
    return rounded(G.compare_models(metrics, 1, 2))


@query(
    "compare_model_info",
    f"""WITH m AS (SELECT user_id AS version, count(*) AS total_parameters, count(DISTINCT event_type) AS trainable_parameters, count(DISTINCT ts::DATE) AS epochs_trained,
          epoch(max(ts)) - epoch(min(ts)) AS training_duration_seconds FROM events WHERE user_id IN (1, 2) GROUP BY user_id)
        SELECT * FROM (VALUES {", ".join(f"""('{s}', '{i}', {', '.join(f"round(coalesce((SELECT {i} FROM m WHERE version = {v}), 0)::DOUBLE, 6)" for v in (1, 2))})""" for s, i in (("architecture", "total_parameters"), ("architecture", "trainable_parameters"), ("training", "epochs_trained"), ("training", "training_duration_seconds")))}) t(section, item, model1, model2)""",
)
def compare_model_info(spark, d):
    prepare(spark)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    models = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("version")).agg(
        F.count(F.lit(1)).alias("total_parameters"),
        F.count_distinct("event_type").alias("trainable_parameters"),
        F.count_distinct(F.to_date("ts")).alias("epochs_trained"),
        (F.max(seconds) - F.min(seconds)).alias("training_duration_seconds"),
    )
    return rounded(G.compare_model_info(models, 1, 2))


@query(
    "comprehensive_metrics_training",
    "WITH " + CGM + ", " + PAIRS + ", " + LOGS + f""", runs AS (SELECT run_id, count(*) FILTER (WHERE metric = 'loss') AS training_total_epochs,
        min(value) FILTER (WHERE metric = 'val_loss') AS training_best_val_loss FROM logs GROUP BY run_id)
        SELECT participant_id, {r('avg(abs(y_true - y_pred))', 'regression_mae')}, any_value(training_total_epochs) AS training_total_epochs, {r('any_value(training_best_val_loss)', 'training_best_val_loss')}
        FROM pairs LEFT JOIN runs ON participant_id = run_id GROUP BY participant_id""",
)
def comprehensive_metrics_training(spark, d):
    from glyco.operators.evaluate import comprehensive_metrics

    out = comprehensive_metrics(load_pairs(spark, d), by=["participant_id"], training=G.training_summary(logs(spark, d)))
    return rounded(out.select("participant_id", "regression_mae", "training_total_epochs", "training_best_val_loss"))


PER_FILE = 500  # models or runs in a file, on average


def dealt(spark, d):
    """The events with the number ``file`` that their user's record is written to."""
    events = spark.read.parquet(f"{d}/events.parquet")
    files = events.select(F.greatest(F.ceil(F.approx_count_distinct("user_id") / PER_FILE), F.lit(1)).alias("files"))
    return events.crossJoin(F.broadcast(files)).withColumn("file", F.pmod(F.xxhash64("user_id"), "files"))


def registry_folder(spark, d):
    """Users as models, their days as versions with the day's mean value as loss: registry files of many models, in the shared folder."""
    daily = dealt(spark, d).groupBy("file", "user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("loss"), F.min("ts").alias("ts"))
    info = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.create_map(F.lit("loss"), F.col("loss")).alias("performance"),
        F.lit("").alias("description"),
        F.array(F.lit("daily")).alias("tags"),
    )
    version = F.concat(F.lit("1."), F.col("day").cast("string"), F.lit(".0"))
    models = daily.groupBy("file", "user_id").agg(F.map_from_entries(F.collect_list(F.struct(version, info))).alias("v"))
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    text = models.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(name, "v")))).alias("value"))
    path = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4()}"
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(
    "read_registry",
    f"""SELECT 'user_' || user_id AS model, '1.' || day(ts) || '.0' AS version, {r('avg(value)', 'loss')} FROM events GROUP BY user_id, day(ts)""",
)
def read_registry(spark, d):
    prepare(spark)
    versions = G.read_registry(spark, registry_folder(spark, d))
    return rounded(versions.select("model", "version", F.try_element_at("performance", F.lit("loss")).alias("loss")))


@query("read_run_logs", f"""SELECT 'run_' || user_id AS run_id, day(ts)::BIGINT AS epoch, {r('avg(value)', 'value')} FROM events GROUP BY user_id, day(ts)""")
def read_run_logs(spark, d):
    prepare(spark)
    daily = dealt(spark, d).groupBy("file", "user_id", F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("loss"), F.min("ts").alias("ts"))
    entry = F.struct(F.col("epoch"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("loss"))
    runs = daily.groupBy("file", "user_id").agg(F.sort_array(F.collect_list(entry)).alias("history"))
    run = F.struct(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.lit("completed").alias("status"), "history")
    text = runs.groupBy("file").agg(F.to_json(F.collect_list(run)).alias("value"))
    path = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4()}"
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    logs_ = G.read_run_logs(spark, path).filter("metric = 'loss'")
    return rounded(logs_.select("run_id", F.col("epoch").cast("bigint").alias("epoch"), "value"))


# --- files: the tables are first exported, then read back by the source under test ----


def export(spark, d):
    """The readings as CSV in folders per subject, in the shared folder."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4()}"
    df = load_cgm(spark, d).withColumn("BolusType", F.lit(None).cast("string"))
    text = df.withColumn("EventDateTime", F.date_format("EventDateTime", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    subject = F.concat(F.lit("Subject "), (F.col("participant_id") % 5).cast("string"))
    text = text.withColumn("folder", subject).drop("participant_id")
    text.write.option("header", True).option("nullValue", "NA").partitionBy("folder").csv(path)
    return path


CSV_ROWS = f"""SELECT 'subject_' || (participant_id % 5) AS participant_id, EventDateTime, DeviceMode, {r('CGM')}, {r('Basal')}, {r('CarbSize')} FROM cgm"""


@query("read_cgm_csv", cgm_sql(CSV_ROWS))
def read_cgm_csv(spark, d):
    folder = export(spark, d)
    df = S.read_cgm_csv(spark, folder)
    return rounded(df.select("participant_id", "EventDateTime", "DeviceMode", "CGM", "Basal", "CarbSize"))


@query(
    "probe_headers",
    cgm_sql("SELECT DISTINCT 'subject_' || (participant_id % 5) AS participant_id, TRUE AS complete, 'event_id,EventDateTime,DeviceMode,CGM,Basal,TotalBolusInsulinDelivered,CorrectionDelivered,FoodDelivered,CarbSize,BolusType' AS header FROM cgm"),
)
def probe_headers(spark, d):
    found = S.probe_headers(spark, export(spark, d))
    # The folder names the subject; all its files have one header.
    return found.select(X.participant_from_path(F.col("path")).alias("participant_id"), "complete", "header").distinct()


@query("skip_bad_files", cgm_sql("SELECT 'subject_' || (participant_id % 5) AS participant_id, count(*) AS readings FROM cgm GROUP BY ALL"))
def skip_bad_files(spark, d):
    folder = export(spark, d)
    # A file with a foreign header among the exports gives no readings.
    spark.createDataFrame([("1", "2")], "foo string, bar string").write.option("header", True).csv(f"{folder}/foreign")
    readings = S.read_cgm_csv(spark, folder).groupBy("participant_id").agg(F.count("EventDateTime").alias("readings"))
    return readings.filter("readings > 0")


@query("file_integrity")
def file_integrity(spark, d):
    return S.file_integrity(spark, export(spark, d), "*.csv").select("length", "md5", "sha256")


@query("folder_hash")
def folder_hash(spark, d):
    return S.folder_hash(S.file_integrity(spark, d, "*.parquet"))


@query("dataset_inventory")
def dataset_inventory(spark, d):
    return S.dataset_inventory(spark, d, "*.parquet").select("path", "length")


@query(
    "write_report",
    pairs_sql("\nUNION ALL\n".join(f"SELECT 'clinical' AS section, '{name}' AS item, {r(expression, 'value')} FROM pairs" for name, expression in CLINICAL.items())),
)
def write_report(spark, d):
    from glyco.operators.evaluate import clinical_metrics_all

    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4()}"
    K.write_report(K.tidy(rounded(clinical_metrics_all(load_pairs(spark, d))), "clinical"), path)
    return spark.read.json(path).select("section", "item", F.col("value").cast("double").alias("value"))


# --- models and user functions ---------------------------------------------------------


def windows(spark, d):
    df = load_cgm(spark, d).filter(F.col("CGM").isNotNull())
    return sliding_sequences(df, ["CGM"], steps=6)


@query("forecast_fit_predict")
def forecast_fit_predict(spark, d):
    seqs = windows(spark, d)
    return rounded(M.forecast_predict(M.forecast_fit(seqs), seqs).select("participant_id", "seq_end", "y_true", "y_pred"))


@query("cross_validate")
def cross_validate(spark, d):
    return rounded(M.cross_validate(windows(spark, d)))


@query("walk_forward_evaluate")
def walk_forward_evaluate(spark, d):
    return rounded(M.walk_forward_evaluate(windows(spark, d), step=500, horizon=500))


def steps_of_one(spark, d):
    """Sequences of one reading and the next one as target."""
    df = load_cgm(spark, d).filter(F.col("CGM").isNotNull())
    return sliding_sequences(df, ["CGM"], steps=1)


ONE = """ones AS (
  SELECT *, row_number() OVER (ORDER BY seq_end, participant_id) - 1 AS rn, count(*) OVER () AS n FROM (
    SELECT participant_id, EventDateTime AS seq_end, CGM AS x, lead(CGM) OVER (PARTITION BY participant_id ORDER BY EventDateTime) AS y
    FROM cgm WHERE CGM IS NOT NULL) WHERE y BETWEEN 20 AND 600)"""
# The ridge fit of one standardised feature and label in closed form.
FIT = """SELECT {0}, count(*) AS n_train, covar_pop(y, x) / var_pop(x) / (1 + 0.01::DOUBLE / stddev_pop(y)) AS slope, avg(x) AS mx, avg(y) AS my FROM {1} GROUP BY {0}"""


def _scored_sql(rows: str) -> str:
    measures = {
        "mae": "avg(abs(y - p))",
        "mse": "avg((y - p) ** 2)",
        "rmse": "sqrt(avg((y - p) ** 2))",
        "mard": "avg(abs((y - p) / y)) * 100",
        "valid_predictions": "count(*)",
    }
    scored = f"(SELECT fold, n_train, y, my + slope * (x - mx) AS p FROM fits JOIN ({rows}) USING (fold))"
    return "\nUNION ALL\n".join(f"SELECT fold::INT AS fold, n_train, '{m}' AS metric, {r(e, 'value')} FROM {scored} GROUP BY fold, n_train" for m, e in measures.items())


@query(
    "walk_forward_one_feature",
    cgm_sql(
        f"""SELECT ((train_end - floor(n * 0.5::DOUBLE)::BIGINT) // 50 + 1)::INT AS step, train_end, {r('y', 'y_true')}, {r('my + slope * (x - mx)', 'y_pred')}
            FROM fits JOIN ones ON rn >= train_end AND rn < train_end + 70""",
        ONE,
        "ends AS (SELECT unnest(range(any_value(floor(n * 0.5::DOUBLE)::BIGINT), any_value(n), 50)) AS train_end FROM ones)",
        "fits AS (" + FIT.format("train_end", "(SELECT train_end, x, y FROM ends JOIN ones ON rn < train_end)") + ")",
    ),
)
def walk_forward_one_feature(spark, d):
    return rounded(M.walk_forward_evaluate(steps_of_one(spark, d), step=50, horizon=70))


@query(
    "cross_validate_one_feature",
    cgm_sql(
        _scored_sql("SELECT fold, x, y FROM folded"),
        ONE,
        """folded AS (SELECT x, y, least(k // greatest(people // 5, 1), least(people, 5) - 1) + 1 AS fold FROM ones JOIN (
             SELECT participant_id, row_number() OVER (ORDER BY participant_id) - 1 AS k, count(*) OVER () AS people FROM (SELECT DISTINCT participant_id FROM ones))
             USING (participant_id))""",
        "fits AS (" + FIT.format("fold", "(SELECT f.fold, x, y FROM (SELECT DISTINCT fold FROM folded) f JOIN folded t ON t.fold <> f.fold)") + ")",
    ),
)
def cross_validate_one_feature(spark, d):
    return rounded(M.cross_validate(steps_of_one(spark, d)))


@query(
    "cross_validate_by_time",
    cgm_sql(
        _scored_sql("SELECT fold, x, y FROM starts JOIN ones ON rn >= start AND rn < start + size"),
        ONE,
        "starts AS (SELECT fold, size, n - (6 - fold) * size AS start FROM (SELECT any_value(n) AS n, any_value(floor(n * 0.1::DOUBLE)::BIGINT) AS size FROM ones), (SELECT unnest(range(1, 6)) AS fold))",
        "fits AS (" + FIT.format("fold", "(SELECT fold, x, y FROM starts JOIN ones ON rn < start)") + ")",
    ),
)
def cross_validate_by_time(spark, d):
    return rounded(M.cross_validate(steps_of_one(spark, d), by="time"))


@query(
    "score_udf",
    cgm_sql(
        f"""SELECT participant_id, EventDateTime AS seq_end, {r('p', 'y_pred')} FROM (SELECT *, avg(CGM) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS p,
        row_number() OVER ({W}) AS k, lead(CGM) OVER ({W}) AS y FROM cgm WHERE CGM IS NOT NULL) WHERE k >= 6 AND y BETWEEN 20 AND 600"""
    ),
)
def score_udf(spark, d):
    def mean_of_window(batch):
        return batch["x"].map(lambda rows: float(sum(r_[0] for r_ in rows)) / len(rows))

    return rounded(M.score_with(windows(spark, d), mean_of_window).select("participant_id", "seq_end", "y_pred"))


@query("apply_partitions", cgm_sql(f"SELECT event_id, {r('CGM * 0.0555::DOUBLE', 'mmol')} FROM cgm"))
def apply_partitions(spark, d):
    df = load_cgm(spark, d).select("event_id", "CGM")
    out = U.apply_partitions(df, lambda b: b.assign(mmol=b["CGM"] * 0.0555)[["event_id", "mmol"]], "event_id bigint, mmol double")
    return rounded(out.withColumn("mmol", F.nanvl("mmol", F.lit(None).cast("double"))))


@query("apply_per_participant", cgm_sql("SELECT participant_id, week(EventDateTime)::INT AS week, count(*) AS n, count(CGM) AS known FROM cgm GROUP BY ALL"))
def apply_per_participant(spark, d):
    import pandas as pd

    df = load_cgm(spark, d).withColumn("week", F.weekofyear("EventDateTime")).select("participant_id", "week", "CGM")

    def count(pdf):
        row = [pdf["participant_id"].iat[0], pdf["week"].iat[0], len(pdf), pdf["CGM"].count()]
        return pd.DataFrame([row], columns=["participant_id", "week", "n", "known"])

    return U.apply_per_participant(df, count, "participant_id bigint, week int, n bigint, known bigint", ["participant_id", "week"])


@query("map_files", cgm_sql("SELECT 'subject_' || (participant_id % 5) AS participant_id, count(*) AS readings FROM cgm GROUP BY ALL"))
def map_files(spark, d):
    import pandas as pd

    def lines(path, content):
        return pd.DataFrame({"path": [path], "lines": [content.count(b"\n")]})

    files = U.map_files(spark, export(spark, d), lines, "path string, lines bigint", "*.csv")
    # Each file begins with a header line.
    readings = (F.sum("lines") - F.count(F.lit(1))).alias("readings")
    return files.groupBy(X.participant_from_path(F.col("path")).alias("participant_id")).agg(readings)


@query("map_reduce", f"SELECT {r('max(value * 2)', 'result')} FROM events")
def map_reduce(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("value")
    return rounded(U.map_reduce(events, lambda b: b["value"] * 2, max))


# --- tables that meet in time, and counts that roll up ----------------------------------

BOLUSES = "boluses AS (SELECT participant_id, EventDateTime AS given_at, event_id AS bolus_id, TotalBolusInsulinDelivered AS units FROM cgm WHERE TotalBolusInsulinDelivered > 0)"


def two_tables(spark, d):
    """The readings, and the boluses as a table of their own."""
    df = load_cgm(spark, d)
    boluses = df.filter("TotalBolusInsulinDelivered > 0")
    return df.select("event_id", "participant_id", "EventDateTime"), boluses.select(
        "participant_id", "EventDateTime", F.col("event_id").alias("bolus_id"), F.col("TotalBolusInsulinDelivered").alias("units")
    )


@query(
    "asof_join",
    cgm_sql(
        f"SELECT event_id, coalesce(bolus_id, -1) AS bolus_id, {r('units')} FROM cgm ASOF LEFT JOIN boluses ON cgm.participant_id = boluses.participant_id AND cgm.EventDateTime >= boluses.given_at",
        BOLUSES,
    ),
)
def asof_join(spark, d):
    readings, boluses = two_tables(spark, d)
    return rounded(A.asof_join(readings, boluses, ["bolus_id", "units"]).select("event_id", F.coalesce("bolus_id", F.lit(-1)).alias("bolus_id"), "units"))


@query(
    "asof_join_ahead",
    cgm_sql(
        """SELECT event_id, CASE WHEN given_at - EventDateTime <= INTERVAL 3 DAY THEN bolus_id ELSE -1 END AS next_bolus_id
        FROM cgm ASOF LEFT JOIN boluses ON cgm.participant_id = boluses.participant_id AND cgm.EventDateTime < boluses.given_at""",
        BOLUSES,
    ),
)
def asof_join_ahead(spark, d):
    readings, boluses = two_tables(spark, d)
    out = A.asof_join(readings, boluses, ["bolus_id"], "3 days", exact=False, direction="forward", prefix="next_")
    return out.select("event_id", F.coalesce("next_bolus_id", F.lit(-1)).alias("next_bolus_id"))


@query(
    "hours_since_events",
    cgm_sql(
        f"SELECT event_id, {r('coalesce((epoch_us(EventDateTime) - epoch_us(given_at)) / 3600000000.0::DOUBLE, 12)', 'time_since_last_bolus')} "
        "FROM cgm ASOF LEFT JOIN boluses ON cgm.participant_id = boluses.participant_id AND cgm.EventDateTime >= boluses.given_at",
        BOLUSES,
    ),
)
def hours_since_events(spark, d):
    readings, boluses = two_tables(spark, d)
    return rounded(A.hours_since_events(readings, boluses, "bolus", 12.0).select("event_id", "time_since_last_bolus"))


GRAINS = {"day": "date_trunc('day', ts)", "week": "date_trunc('week', ts)", "all": "NULL"}


@query(
    "distinct_rollup",
    "\nUNION ALL\n".join(f"SELECT '{g}' AS grain, CAST({e} AS VARCHAR)[:10] AS bucket, count(DISTINCT user_id) AS subjects FROM events GROUP BY ALL" for g, e in GRAINS.items()),
)
def distinct_rollup(spark, d):
    """Subjects per day from the rows; per week and in all from the sketches of the days."""
    from glyco.session import write_through

    events = spark.read.parquet(f"{d}/events.parquet")
    days = write_through(D.distinct_sketches(events, "user_id", {"bucket": F.date_trunc("day", "ts")}))
    weeks = D.roll_up(days, {"bucket": F.date_trunc("week", "bucket")})
    whole = D.roll_up(weeks).withColumn("bucket", F.lit(None).cast("timestamp_ntz"))
    out = None
    for grain, sketches in (("day", days), ("week", weeks), ("all", whole)):
        part = D.estimates(sketches, "subjects").select(F.lit(grain).alias("grain"), F.substring(F.col("bucket").cast("string"), 1, 10).alias("bucket"), "subjects")
        out = part if out is None else out.unionByName(part)
    return out
