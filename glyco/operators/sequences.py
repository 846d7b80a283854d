"""Sliding-window sequences and the checks around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.series import COPY, SLICE, T_US, Layout, Series
from ..schema import KEY, TARGET, TIME, duration_us, numeric_columns

TARGET_LOW, TARGET_HIGH = 20.0, 600.0
BLOCK_ROWS = 256


def steps_of(length_minutes: int, cadence_minutes: int) -> int:
    """Window length in rows."""
    return length_minutes // cadence_minutes


def _missing(columns: list[str]) -> Column:
    tests = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns]
    return reduce(lambda a, b: a | b, tests).cast("int")


def sliding_sequences(
    df: DataFrame,
    features: list[str] | None = None,
    target: str = TARGET,
    steps: int = 12,
    horizon: int = 1,
    only_valid: bool = True,
    *,
    layout: Layout | None = None,
) -> DataFrame:
    """``participant_id, seq_start, seq_end, x array<array<double>>, y`` per full window.

    The checks run over numbers only. Then the rows are gathered once into blocks of ``BLOCK_ROWS`` that overlap by a
    window, and the arrays of the windows that passed are cut from their block. Blocks follow the exchange
    of the checks, and those without a window that passed are not gathered.
    """
    features = features or numeric_columns(df)
    slim = df.select(KEY, TIME, *dict.fromkeys([*features, target]))
    s = Series(slim.withColumn("_bad", _missing(features)), layout, back_rows=steps - 1, ahead_rows=horizon)
    w = s.window
    frame = w.rowsBetween(-(steps - 1), 0)
    keep = (F.count(F.lit(1)).over(frame) == steps) & F.lead(F.lit(1), horizon).over(w).isNotNull()
    y = F.lead(F.col(target).cast("double"), horizon).over(w)
    if only_valid:
        keep = keep & (F.sum("_bad").over(frame) == 0) & F.coalesce(valid_target(y, target), F.lit(False))
    marked = s.df.withColumns(
        {"_at": F.row_number().over(w), "_keep": keep, "y": y, "seq_start": F.first(TIME).over(frame)}
    )
    # Copies of neighbouring slices complete windows, but theirs are cut in their own slice.
    marked = marked.withColumn("_keep", F.col("_keep") & ~F.col(COPY)) if COPY in marked.columns else marked
    own = F.floor((F.col("_at") - 1) / BLOCK_ROWS)
    blocks = F.sequence(own, F.floor((F.col("_at") - 1 + steps - 1) / BLOCK_ROWS))
    slot = [c for c in (KEY, SLICE) if c in marked.columns]
    row = F.struct("_at", (F.col("_keep") & (own == F.col("_block"))).alias("keep"), "seq_start", F.col(TIME).alias("seq_end"), F.array(*[F.col(c).cast("double") for c in features]).alias("f"), "y")
    dealt = marked.select(*marked.columns, F.explode(blocks).alias("_block"))
    packed = dealt.groupBy(*slot, "_block").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max(row["keep"]).alias("_any"))
    first = F.get("_rows", F.lit(0))["_at"]

    def window(r: Column) -> Column:
        rows = F.slice("_rows", r["_at"] - first - (steps - 2), F.lit(steps))
        return F.struct(r["seq_start"].alias("seq_start"), r["seq_end"].alias("seq_end"), F.transform(rows, lambda x: x["f"]).alias("x"), r["y"].alias("y"))

    kept = F.transform(F.filter("_rows", lambda r: r["keep"]), window)
    return packed.filter("_any").select(KEY, F.inline(kept))


def valid_target(y: Column, target: str = TARGET) -> Column:
    """A target must be present and, for glucose, possible."""
    present = y.isNotNull() & ~F.isnan(y)
    return present & y.between(TARGET_LOW, TARGET_HIGH) if target == TARGET else present


def valid_sequence(sequences: DataFrame, target: str = TARGET) -> DataFrame:
    """Flag ``valid`` on already packed sequences."""
    whole = F.forall("x", lambda row: F.forall(row, lambda v: v.isNotNull() & ~F.isnan(v)))
    return sequences.withColumn("valid", whole & F.coalesce(valid_target(F.col("y"), target), F.lit(False)))


def sequence_info(spark, features: list[str], target: str = TARGET, steps: int = 12, horizon: int = 1) -> DataFrame:
    """Settings of a sequence set."""
    return spark.createDataFrame(
        [(steps, horizon, target, len(features), features)],
        "steps int, horizon int, target string, n_features int, features array<string>",
    )


def check_time_order(df: DataFrame, arrival: str, *, key: str = KEY, time: str = TIME) -> DataFrame:
    """Participants whose times go back in arrival order, with the number of steps back.

    A step back is a reading earlier than the one that arrived just before it;
    ``arrival`` is a whole-number arrival position.
    """
    layout = Layout.fit(df.withColumn("_at", F.timestamp_micros(F.col(arrival))), key, "_at")
    s = Series(df.withColumn("_at", F.timestamp_micros(F.col(arrival))), layout, back_rows=1)
    marked = s.close(s.df.withColumn("_back", F.lag(time).over(s.window) > F.col(time)), "_at")
    return (
        marked.groupBy(key)
        .agg(F.count_if("_back").alias("steps_back"))
        .filter(F.col("steps_back") > 0)
    )


def check_gaps(df: DataFrame, max_gap: str | int = "15 minutes", *, layout: Layout | None = None) -> DataFrame:
    """Per participant with gaps longer than ``max_gap``: their number and the longest, in seconds."""
    s = Series(df.select(KEY, TIME), layout, back_rows=1)
    gaps = s.df.withColumn("_gap", F.col(T_US) - F.lag(T_US).over(s.window))
    return (
        s.close(gaps)
        .groupBy(KEY)
        .agg(
            F.count_if(F.col("_gap") > duration_us(max_gap)).alias("n_gaps"),
            (F.max("_gap") / 1e6).alias("max_gap_seconds"),
        )
        .filter(F.col("n_gaps") > 0)
    )


def check_target_quality(df: DataFrame, target: str = TARGET, min_rows: int = 10) -> DataFrame:
    """Missing targets and participants with too few rows."""
    per = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("have"))
    return per.agg(
        (F.sum("n") - F.sum("have")).alias("missing_targets"),
        F.try_divide((F.sum("n") - F.sum("have")) * 100.0, F.sum("n")).alias("missing_percentage"),
        F.count_if(F.col("n") < min_rows).alias("short_participants"),
    )


def series_statistics(df: DataFrame) -> DataFrame:
    """Rows, participants, date range, rows per participant."""
    per = df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first"), F.max(TIME).alias("last")
    )
    return per.agg(
        F.sum("n").alias("n_records"),
        F.count(KEY).alias("n_participants"),
        F.min("first").alias("start_time"),
        F.max("last").alias("end_time"),
        F.floor((F.unix_micros(F.max("last").cast("timestamp")) - F.unix_micros(F.min("first").cast("timestamp"))) / 86_400_000_000).alias("duration_days"),
        F.avg("n").alias("mean_records"),
        F.stddev_samp("n").alias("std_records"),
        F.min("n").alias("min_records"),
        F.max("n").alias("max_records"),
    )


def sequence_quality(sequences: DataFrame, target: str = TARGET) -> DataFrame:
    """Completeness, impossible targets, target statistics and the mean feature deviation.

    Feature deviations come from sums per feature position, which combine map-side.
    """
    y = F.col("y")
    totals = sequences.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.count_if(F.exists("x", lambda r: F.exists(r, lambda v: v.isNull()))).alias("sequences_with_missing"),
        F.count_if(y.isNull()).alias("missing_targets"),
        (F.count_if(~y.between(TARGET_LOW, TARGET_HIGH)) if target == TARGET else F.lit(0).cast("bigint")).alias("impossible_targets"),
        F.avg("y").alias("target_mean"),
        F.stddev_pop("y").alias("target_std"),
        F.min("y").alias("target_min"),
        F.max("y").alias("target_max"),
        F.try_divide(F.count("y").cast("double"), F.count(F.lit(1))).alias("target_completeness"),
    )
    cells = sequences.select(F.explode("x").alias("row")).select(F.posexplode("row").alias("feature", "value"))
    per_feature = cells.groupBy("feature").agg(
        F.stddev_pop("value").alias("sd"), F.count("value").alias("have"), F.count(F.lit(1)).alias("n")
    )
    spread = per_feature.agg(
        F.avg("sd").alias("mean_feature_variability"),
        F.try_divide(F.sum("have").cast("double"), F.sum("n")).alias("feature_completeness"),
    )
    return totals.join(spread)


def validate_for_sequences(
    df: DataFrame,
    target: str = TARGET,
    max_gap: str | int = "15 minutes",
    min_rows: int = 10,
    arrival: str | None = None,
    *,
    layout: Layout | None = None,
) -> DataFrame:
    """``(check, participant_id, issue, value)`` rows of every failed check."""
    missing = [c for c in (TIME, KEY, target) if c not in df.columns]
    if missing:
        rows = [("columns", None, f"missing required column {c}", None) for c in missing]
        return df.sparkSession.createDataFrame(
            rows, "check string, participant_id string, issue string, value double"
        )
    pid = F.col(KEY).cast("string").alias("participant_id")
    nobody = F.lit(None).cast("string").alias("participant_id")

    def issue(check: str, who: Column, text: str, value: Column) -> list[Column]:
        return [F.lit(check).alias("check"), who, F.lit(text).alias("issue"), value.cast("double").alias("value")]

    gaps = check_gaps(df, max_gap, layout=layout).select(*issue("gaps", pid, "gaps over the limit", F.col("n_gaps")))
    quality = check_target_quality(df, target, min_rows)
    out = gaps.unionByName(
        quality.filter("missing_targets > 0").select(
            *issue("target", nobody, "missing target values", F.col("missing_targets"))
        )
    ).unionByName(
        quality.filter("short_participants > 0").select(
            *issue("length", nobody, "participants with too few rows", F.col("short_participants"))
        )
    )
    if arrival:
        out = out.unionByName(
            check_time_order(df, arrival).select(*issue("order", pid, "times go back", F.col("steps_back")))
        )
    return out


# Advice per failed check, and the rows below which a participant counts as small.
ADVICE = {
    "target": "Consider imputing missing target values or filtering out incomplete records",
    "gaps": "Consider interpolating data to fill time gaps or adjusting max_time_gap_minutes",
    "length": "Consider removing participants with insufficient data or reducing min_sequence_length",
    "records": "Some participants have very few records, consider data quality filtering",
}
FEW_RECORDS = 50


def sequence_recommendations(issues: DataFrame, statistics: DataFrame | None = None, few: int = FEW_RECORDS) -> DataFrame:
    """Advice for the checks that failed, and for a smallest participant below ``few`` rows (``series_statistics``)."""
    failed = issues.groupBy("check").agg(F.count(F.lit(1)).alias("n_issues"))
    if statistics is not None:
        small = statistics.filter(F.col("min_records") < few)
        failed = failed.unionByName(small.select(F.lit("records").alias("check"), F.lit(1).cast("bigint").alias("n_issues")))
    lookup = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return failed.withColumn("recommendation", F.try_element_at(lookup, F.col("check"))).filter(
        F.col("recommendation").isNotNull()
    )
