"""Resampling, sequences, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyco.operators import resample as R
from glyco.operators import sequences as S
from glyco.operators import splits as P
from glyco.plans.pipelines import sequence_dataset as build
from glyco.session import prepare
from glyco.sources.events import cgm_from_events, load_cgm, load_pairs

from .base import cgm_sql, pairs_sql, query, r, rounded

W = "PARTITION BY participant_id ORDER BY EventDateTime"
STEP = 6 * 3_600_000_000
BINS = f"""binned AS (SELECT *, epoch_us(EventDateTime) // {STEP} AS b FROM cgm),
grid AS (SELECT participant_id, unnest(range(min(b), max(b) + 1)) AS b FROM binned GROUP BY participant_id)"""


def stamp(b="b", step=STEP):
    return f"make_timestamp({b} * {step}) AS EventDateTime"


SUMS = ["TotalBolusInsulinDelivered", "CorrectionDelivered", "FoodDelivered", "CarbSize"]
RESAMPLED = f"""resampled AS (SELECT g.participant_id, g.b, avg(CGM) AS CGM, avg(Basal) AS Basal,
  {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in SUMS)}, arg_min(DeviceMode, EventDateTime) AS DeviceMode
  FROM grid g LEFT JOIN binned USING (participant_id, b) GROUP BY g.participant_id, g.b)"""


@query(
    "resample",
    cgm_sql(
        f"SELECT participant_id, {stamp()}, DeviceMode, {', '.join(r(c) for c in ['CGM', 'Basal', *SUMS])} FROM resampled",
        BINS,
        RESAMPLED,
    ),
)
def resample(spark, d):
    return rounded(R.resample(load_cgm(spark, d).drop("event_id"), "6 hours"))


@query(
    "resample_means",
    cgm_sql(
        f"""SELECT participant_id, {stamp()}, {r('avg(CGM)', 'CGM')}, {r('avg(Basal)', 'Basal')} FROM binned
            GROUP BY participant_id, b HAVING avg(CGM) IS NOT NULL OR avg(Basal) IS NOT NULL""",
        BINS,
    ),
)
def resample_means(spark, d):
    # Without a summed column the empty bins disappear.
    df = load_cgm(spark, d).select("participant_id", "EventDateTime", "CGM", "Basal")
    return rounded(R.resample(df, "6 hours"))


@query(
    "resample_stats",
    cgm_sql(
        f"""SELECT original_rows, resampled_rows, {r("resampled_rows::DOUBLE / original_rows", "compression_ratio")}
            FROM (SELECT count(*) AS original_rows FROM cgm), (SELECT count(*) AS resampled_rows FROM resampled)""",
        BINS,
        RESAMPLED,
    ),
)
def resample_stats(spark, d):
    df = load_cgm(spark, d).drop("event_id")
    return rounded(R.resample_stats(df, R.resample(df, "6 hours")))


def around(column, source):
    """Neighbouring known values and their positions."""
    return f"""around_{column} AS (SELECT participant_id, b, {column} AS v, rn,
  last_value({column} IGNORE NULLS) OVER w1 AS lo, first_value({column} IGNORE NULLS) OVER w2 AS hi,
  max(CASE WHEN {column} IS NOT NULL THEN rn END) OVER w1 AS rlo, min(CASE WHEN {column} IS NOT NULL THEN rn END) OVER w2 AS rhi
  FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY b) AS rn FROM {source})
  WINDOW w1 AS (PARTITION BY participant_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY participant_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def linear(limit):
    return f"""coalesce(v, CASE WHEN rn - rlo <= {limit} THEN
      CASE WHEN hi IS NULL THEN lo ELSE lo + (hi - lo) * (rn - rlo)::DOUBLE / nullif(rhi - rlo, 0) END END)"""


FEATS = "feats AS (SELECT participant_id, EventDateTime, CGM, TotalBolusInsulinDelivered, (FoodDelivered > 0)::INT AS is_meal, CarbSize AS other, DeviceMode FROM cgm)"
NAMED = f"""binned AS (SELECT *, epoch_us(EventDateTime) // {STEP} AS b FROM feats),
grid AS (SELECT participant_id, unnest(range(min(b), max(b) + 1)) AS b FROM binned GROUP BY participant_id),
named AS (SELECT g.participant_id, g.b, avg(CGM) AS CGM, coalesce(sum(TotalBolusInsulinDelivered), 0) AS bolus,
  max(is_meal)::DOUBLE AS is_meal, arg_min(other, EventDateTime) FILTER (WHERE other IS NOT NULL) AS other,
  arg_min(DeviceMode, EventDateTime) AS DeviceMode
  FROM grid g LEFT JOIN binned USING (participant_id, b) GROUP BY g.participant_id, g.b)"""
LIMITED = f"(SELECT participant_id, b, {linear(4)} AS filled FROM around_{{c}})"


@query(
    "resample_by_name",
    cgm_sql(
        f"""SELECT n.participant_id, {stamp('n.b')}, {r('c.filled', 'CGM')}, {r('n.bolus', 'TotalBolusInsulinDelivered')},
            {r('m.filled', 'is_meal')}, {r('o.filled', 'other')}, n.DeviceMode
            FROM named n JOIN {LIMITED.format(c='CGM')} c USING (participant_id, b)
            JOIN {LIMITED.format(c='is_meal')} m USING (participant_id, b) JOIN {LIMITED.format(c='other')} o USING (participant_id, b)""",
        FEATS,
        NAMED,
        around("CGM", "named"),
        around("is_meal", "named"),
        around("other", "named"),
    ),
)
def resample_by_name(spark, d):
    df = load_cgm(spark, d).select(
        "participant_id",
        "EventDateTime",
        "CGM",
        "TotalBolusInsulinDelivered",
        (F.col("FoodDelivered") > 0).cast("int").alias("is_meal"),
        F.col("CarbSize").alias("other"),
        "DeviceMode",
    )
    out = R.resample_by_name(df, "6 hours", "24 hours")
    return rounded(out.withColumn("is_meal", F.col("is_meal").cast("double")))


CGM_BINS = """cgm_bins AS (SELECT g.participant_id, g.b, avg(CGM) AS CGM
  FROM grid g LEFT JOIN binned USING (participant_id, b) GROUP BY g.participant_id, g.b)"""


def limited_fill(method, value):
    def run(spark, d):
        df = load_cgm(spark, d).select("participant_id", "EventDateTime", "CGM")
        binned = R._resampled(df, "6 hours", {"CGM": "mean"}, True, "participant_id", "EventDateTime")
        return rounded(R.fill_limited(binned, ["CGM"], "6 hours", "12 hours", method))

    sql = cgm_sql(f"SELECT participant_id, {stamp()}, {r(value, 'CGM')} FROM around_CGM", BINS, CGM_BINS, around("CGM", "cgm_bins"))
    query(f"fill_limited_{method}", sql)(run)


limited_fill("linear", linear(2))
limited_fill("ffill", "CASE WHEN rn - rlo <= 2 THEN lo END")
limited_fill("bfill", "CASE WHEN rhi - rn <= 2 THEN hi END")


# --- sequences -----------------------------------------------------------------------

SEQ_COLS = ["CGM", "value", "hour"]
DENSE = "dense AS (SELECT event_id, ts AS EventDateTime, user_id AS participant_id, CASE WHEN event_type <> 'error' THEN value + 40 END AS CGM, value, hour(ts)::DOUBLE AS hour FROM events)"


def dense(spark, d):
    prepare(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    readings = cgm_from_events(events, ["value"])
    return readings.select("event_id", "EventDateTime", "participant_id", "CGM", "value", F.hour("EventDateTime").cast("double").alias("hour"))


STEPS = 4
NUMBERED = f"numbered AS (SELECT *, row_number() OVER ({W}) AS rn, lead(CGM) OVER ({W}) AS y, lead(rn0) OVER ({W}) AS has_next FROM (SELECT *, 1 AS rn0 FROM dense))"


def windows(valid=True):
    test = "bool_and(f.CGM IS NOT NULL) AND e.y BETWEEN 20 AND 600" if valid else "TRUE"
    return f"""ends AS (SELECT e.participant_id, e.rn, e.EventDateTime AS seq_end, e.y FROM numbered e
      JOIN numbered f ON e.participant_id = f.participant_id AND f.rn BETWEEN e.rn - {STEPS - 1} AND e.rn
      WHERE e.has_next IS NOT NULL GROUP BY ALL HAVING count(*) = {STEPS} AND {test})"""


@query(
    "sliding_sequences",
    f"""WITH {DENSE}, {NUMBERED}, {windows()}
    SELECT e.participant_id, min(f.EventDateTime) OVER s AS seq_start, e.seq_end, (f.rn - e.rn + {STEPS - 1})::INT AS step,
           {r('f.CGM', 'CGM')}, {r('f.value', 'value')}, {r('f.hour', 'hour')}, {r('e.y', 'y')}
    FROM ends e JOIN numbered f ON e.participant_id = f.participant_id AND f.rn BETWEEN e.rn - {STEPS - 1} AND e.rn
    WINDOW s AS (PARTITION BY e.participant_id, e.rn)""",
)
def sliding_sequences(spark, d):
    seqs = S.sliding_sequences(dense(spark, d), SEQ_COLS, steps=STEPS)
    cells = seqs.select("participant_id", "seq_start", "seq_end", "y", F.posexplode("x").alias("step", "row"))
    return rounded(
        cells.select(
            "participant_id", "seq_start", "seq_end", "step", *[F.col("row")[i].alias(c) for i, c in enumerate(SEQ_COLS)], "y"
        )
    )


@query(
    "valid_sequence",
    f"""WITH {DENSE}, {NUMBERED}
    SELECT e.participant_id, e.EventDateTime AS seq_end,
      bool_and(f.CGM IS NOT NULL) AND coalesce(e.y BETWEEN 20 AND 600, FALSE) AS valid
    FROM numbered e JOIN numbered f ON e.participant_id = f.participant_id AND f.rn BETWEEN e.rn - {STEPS - 1} AND e.rn
    WHERE e.has_next IS NOT NULL GROUP BY e.participant_id, e.rn, e.EventDateTime, e.y HAVING count(*) = {STEPS}""",
)
def valid_sequence(spark, d):
    seqs = S.sliding_sequences(dense(spark, d), SEQ_COLS, steps=STEPS, only_valid=False)
    return S.valid_sequence(seqs).select("participant_id", "seq_end", "valid")


@query(
    "sequence_info",
    f"""WITH {DENSE}, {NUMBERED}, {windows()} SELECT {STEPS}::INT AS steps, 1::INT AS horizon, 'CGM' AS target, {len(SEQ_COLS)}::INT AS n_features,
    '{",".join(SEQ_COLS)}' AS features, count(*) AS n_sequences FROM ends""",
)
def sequence_info(spark, d):
    from glyco.schema import numeric_columns

    df = dense(spark, d)
    seqs = S.sliding_sequences(df, SEQ_COLS, steps=STEPS)
    info = S.sequence_info(spark, numeric_columns(df.select(*SEQ_COLS)), steps=STEPS)
    counted = seqs.agg(F.count(F.lit(1)).alias("n_sequences"))
    return counted.select(*[F.lit(v).alias(c) for c, v in info.withColumn("features", F.array_join("features", ",")).first().asDict().items()], "n_sequences")


CELLS = f"""cells AS (SELECT e.participant_id, e.rn, f.CGM, f.value, f.hour FROM ends e
  JOIN numbered f ON e.participant_id = f.participant_id AND f.rn BETWEEN e.rn - {STEPS - 1} AND e.rn)"""


@query(
    "sequence_quality",
    f"""WITH {DENSE}, {NUMBERED}, {windows(False)}, {CELLS}
    SELECT n_sequences, sequences_with_missing, missing_targets, impossible_targets,
      {', '.join(r(c) for c in ['target_mean', 'target_std', 'target_min', 'target_max', 'target_completeness', 'mean_feature_variability', 'feature_completeness'])}
    FROM (SELECT count(*) AS n_sequences, count(*) - count(y) AS missing_targets,
        count(*) FILTER (WHERE y NOT BETWEEN 20 AND 600) AS impossible_targets, avg(y) AS target_mean, stddev_pop(y) AS target_std,
        min(y) AS target_min, max(y) AS target_max, count(y)::DOUBLE / count(*) AS target_completeness FROM ends),
      (SELECT count(*) AS sequences_with_missing FROM (SELECT participant_id, rn FROM cells GROUP BY ALL HAVING count(CGM) < {STEPS})),
      (SELECT (stddev_pop(CGM) + stddev_pop(value) + stddev_pop(hour)) / 3 AS mean_feature_variability,
        (count(CGM) + count(value) + count(hour))::DOUBLE / (3 * count(*)) AS feature_completeness FROM cells)""",
)
def sequence_quality(spark, d):
    return rounded(S.sequence_quality(S.sliding_sequences(dense(spark, d), SEQ_COLS, steps=STEPS, only_valid=False)))


@query(
    "check_time_order",
    """WITH arrived AS (SELECT user_id AS participant_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY (value * 1000)::BIGINT * 1000000 + event_id) AS previous FROM events)
    SELECT participant_id, count(*) FILTER (WHERE previous > ts) AS steps_back FROM arrived GROUP BY participant_id HAVING count(*) FILTER (WHERE previous > ts) > 0""",
)
def check_time_order(spark, d):
    # Events are taken to arrive in order of their value.
    events = spark.read.parquet(f"{d}/events.parquet")
    arrival = F.round(F.col("value") * 1000).cast("bigint") * 1_000_000 + F.col("event_id")
    df = events.select(F.col("user_id").alias("participant_id"), F.col("ts").alias("EventDateTime"), arrival.alias("arrival"))
    return S.check_time_order(df, "arrival")


GAPS = f"gaps AS (SELECT participant_id, epoch_us(EventDateTime) - lag(epoch_us(EventDateTime)) OVER ({W}) AS gap FROM cgm)"
LIMIT = 12 * 3_600_000_000


@query(
    "check_gaps",
    cgm_sql(
        f"""SELECT participant_id, count(*) FILTER (WHERE gap > {LIMIT}) AS n_gaps, {r('max(gap) / 1000000.0::DOUBLE', 'max_gap_seconds')}
            FROM gaps GROUP BY participant_id HAVING count(*) FILTER (WHERE gap > {LIMIT}) > 0""",
        GAPS,
    ),
)
def check_gaps(spark, d):
    return rounded(S.check_gaps(load_cgm(spark, d), "12 hours"))


TQ = f"""SELECT (count(*) - count(CGM))::BIGINT AS missing_targets, {r("(count(*) - count(CGM)) * 100.0::DOUBLE / count(*)", "missing_percentage")},
  (SELECT count(*) FROM (SELECT 1 FROM cgm GROUP BY participant_id HAVING count(*) < 60)) AS short_participants FROM cgm"""


@query("check_target_quality", cgm_sql(TQ))
def check_target_quality(spark, d):
    return rounded(S.check_target_quality(load_cgm(spark, d), min_rows=60))


@query(
    "series_statistics",
    cgm_sql(
        f"""SELECT sum(n)::BIGINT AS n_records, count(*) AS n_participants, min(a) AS start_time, max(z) AS end_time,
            ((epoch_us(max(z)) - epoch_us(min(a))) // 86400000000)::BIGINT AS duration_days, {r('avg(n)', 'mean_records')},
            {r('stddev_samp(n)', 'std_records')}, min(n) AS min_records, max(n) AS max_records
            FROM (SELECT count(*) AS n, min(EventDateTime) AS a, max(EventDateTime) AS z FROM cgm GROUP BY participant_id)"""
    ),
)
def series_statistics(spark, d):
    return rounded(S.series_statistics(load_cgm(spark, d)))


ISSUES = f"""SELECT 'gaps' AS "check", participant_id::VARCHAR AS participant_id, 'gaps over the limit' AS issue, count(*) FILTER (WHERE gap > {LIMIT})::DOUBLE AS value
  FROM gaps GROUP BY participant_id HAVING count(*) FILTER (WHERE gap > {LIMIT}) > 0
UNION ALL SELECT 'target', NULL, 'missing target values', missing_targets::DOUBLE FROM ({TQ}) WHERE missing_targets > 0
UNION ALL SELECT 'length', NULL, 'participants with too few rows', short_participants::DOUBLE FROM ({TQ}) WHERE short_participants > 0"""


@query("validate_for_sequences", cgm_sql(ISSUES, GAPS))
def validate_for_sequences(spark, d):
    return S.validate_for_sequences(load_cgm(spark, d), max_gap="12 hours", min_rows=60)


@query(
    "sequence_recommendations",
    cgm_sql(
        f"""SELECT "check", count(*) AS n_issues, CASE "check" WHEN 'gaps' THEN '{S.ADVICE["gaps"]}' WHEN 'target' THEN '{S.ADVICE["target"]}'
            ELSE '{S.ADVICE["length"]}' END AS recommendation FROM ({ISSUES}) GROUP BY "check"
            UNION ALL SELECT 'records', 1::BIGINT, '{S.ADVICE["records"]}' FROM (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM cgm GROUP BY participant_id)) WHERE m < 50""",
        GAPS,
    ),
)
def sequence_recommendations(spark, d):
    df = load_cgm(spark, d)
    return S.sequence_recommendations(S.validate_for_sequences(df, max_gap="12 hours", min_rows=60), S.series_statistics(df))


# --- splits --------------------------------------------------------------------------

RANKS = """ranks AS (SELECT participant_id, row_number() OVER (ORDER BY md5('42:' || participant_id)) - 1 AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT participant_id FROM cgm)),
sides AS (SELECT participant_id, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranks)"""


@query("split_by_participant", cgm_sql("SELECT event_id, participant_id, split FROM cgm JOIN sides USING (participant_id)", RANKS))
def split_by_participant(spark, d):
    return P.split_by_participant(load_cgm(spark, d)).select("event_id", "participant_id", "split")


TIMED = "timed AS (SELECT *, row_number() OVER (ORDER BY EventDateTime, participant_id) - 1 AS rn, count(*) OVER () AS n FROM cgm)"
BY_TIME = "CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END"
ORDER = {"time": "EventDateTime", "order": ["EventDateTime", "participant_id"]}


@query("split_by_time", cgm_sql(f"SELECT event_id, {BY_TIME} AS split FROM timed", TIMED))
def split_by_time(spark, d):
    return P.split_by_time(load_cgm(spark, d), **ORDER).select("event_id", "split")


@query(
    "split_info",
    pairs_sql(
        f"""SELECT s.split, count(y) AS n_sequences, {', '.join(r(f'coalesce({e}(y), 0)', f'target_{n}') for e, n in [('avg', 'mean'), ('stddev_pop', 'std'), ('min', 'min'), ('max', 'max')])}
            FROM (VALUES ('train'), ('val'), ('test')) AS s(split) LEFT JOIN
            (SELECT split, y_true AS y FROM pairs JOIN sides USING (participant_id)) p ON s.split = p.split GROUP BY s.split""",
        RANKS,
    ),
)
def split_info(spark, d):
    return rounded(P.split_info(P.split_by_participant(load_pairs(spark, d)), "y_true"))


@query("split", cgm_sql(f"SELECT split, count(*) AS n FROM (SELECT {BY_TIME} AS split FROM timed) GROUP BY split", TIMED))
def split(spark, d):
    return P.split(load_cgm(spark, d), "temporal", **ORDER).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("train_val_split_rows", cgm_sql("SELECT event_id, CASE WHEN rn < n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM timed", TIMED))
def train_val_split_rows(spark, d):
    return P.train_val_split_rows(load_cgm(spark, d), **ORDER).select("event_id", "split")


PEOPLE = "people AS (SELECT participant_id, row_number() OVER (ORDER BY participant_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT participant_id FROM cgm))"


@query(
    "train_val_split_participants",
    cgm_sql("SELECT event_id, CASE WHEN k < n - greatest(1, floor(n * 0.2::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM cgm JOIN people USING (participant_id)", PEOPLE),
)
def train_val_split_participants(spark, d):
    return P.train_val_split_participants(load_cgm(spark, d)).select("event_id", "split")


@query(
    "timeseries_cv_folds",
    cgm_sql(
        """SELECT event_id, fold, CASE WHEN rn < n - (5 - fold + 1) * size - 10 THEN 'train' ELSE 'test' END AS role
        FROM (SELECT *, floor(n * 0.15::DOUBLE)::BIGINT AS size FROM timed), (SELECT unnest(range(1, 6))::INT AS fold)
        WHERE rn < n - (5 - fold + 1) * size - 10 OR (rn >= n - (5 - fold + 1) * size AND rn < n - (5 - fold) * size)""",
        TIMED,
    ),
)
def timeseries_cv_folds(spark, d):
    df = P.timeseries_cv_folds(load_cgm(spark, d), **ORDER, splits=5, test_size=0.15, gap=10)
    return df.select("event_id", "fold", "role")


@query("participant_cv_folds", cgm_sql("SELECT event_id, (least(k // (n // 5), 4) + 1)::INT AS fold FROM cgm JOIN people USING (participant_id)", PEOPLE))
def participant_cv_folds(spark, d):
    return P.participant_cv_folds(load_cgm(spark, d)).select("event_id", "fold")


@query(
    "walk_forward_folds",
    cgm_sql(
        """SELECT event_id, step, train_end FROM (
          SELECT event_id, n, s + 1 AS step, start + s * 20 AS train_end FROM (
            SELECT event_id, n, start, unnest(range(greatest(0, (rn - start - 29 + 19) // 20), (rn - start) // 20 + 1)) AS s
            FROM (SELECT *, floor(n * 0.5::DOUBLE)::BIGINT AS start FROM timed) WHERE rn >= start))
        WHERE train_end + 30 < n""",
        TIMED,
    ),
)
def walk_forward_folds(spark, d):
    df = P.walk_forward_folds(load_cgm(spark, d), **ORDER, step=20, horizon=30)
    return df.select("event_id", "step", "train_end")


FOLD_METRICS = """fold_metrics AS (SELECT least(k // (n // 5), 4) + 1 AS fold, avg(abs(y_true - y_pred)) AS mae, avg((y_true - y_pred) ** 2) AS mse,
  avg(abs((y_true - y_pred) / y_true)) * 100 AS mard FROM pairs JOIN people USING (participant_id) GROUP BY 1)"""


@query(
    "cv_summary",
    pairs_sql(
        "\nUNION ALL\n".join(f"SELECT '{m}' AS metric, {r(f'avg({m})', 'mean')}, {r(f'stddev_pop({m})', 'std')}, count(*) AS n_folds FROM fold_metrics" for m in ("mae", "mse", "mard")),
        PEOPLE,
        FOLD_METRICS,
    ),
)
def cv_summary(spark, d):
    from glyco.operators.evaluate import mard, regression_metrics

    folded = P.participant_cv_folds(load_pairs(spark, d))
    metrics = regression_metrics(folded, ["fold"]).join(mard(folded, ["fold"]), "fold")
    long = metrics.withColumn("n_train", F.lit(0)).select(
        "fold", "n_train", F.explode(F.create_map(*[x for m in ("mae", "mse", "mard") for x in (F.lit(m), F.col(m))])).alias("metric", "value")
    )
    return rounded(P.cv_summary(long))


@query("sequence_dataset")
def sequence_dataset(spark, d):
    df = load_cgm(spark, d)
    out = build(df, ["CGM", "FoodDelivered"], "6 hours", "3 days", steps=6)
    return rounded(P.split_info(out))


@query("write_sequences")
def write_sequences(spark, d):
    import uuid

    from glyco.session import checkpoint_dir
    from glyco.sources.sinks import read_sequences
    from glyco.sources.sinks import write_sequences as write

    path = f"{checkpoint_dir(spark)}/sequences-{uuid.uuid4()}"
    out = build(load_cgm(spark, d), ["CGM", "FoodDelivered"], "6 hours", "3 days", steps=6)
    write(out, path, S.sequence_info(spark, ["CGM", "FoodDelivered"], steps=6))
    return read_sequences(spark, path).select("split", "participant_id", "seq_end", F.round("y", 6).alias("y"))
