"""Small inputs with known answers, invariants and error cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glyco.functions import expressions as E
from glyco.functions.zones import clarke_zone, clarke_zone_simple, parkes_zone
from glyco.operators import clean as C
from glyco.operators import evaluate as V
from glyco.operators import features as X
from glyco.operators import impute as I
from glyco.operators import outliers as O
from glyco.operators import quality as Q
from glyco.operators import registry as G
from glyco.operators import requests as R
from glyco.operators import resample as RS
from glyco.operators import sequences as S
from glyco.operators import splits as P
from glyco.operators.scaling import Scaler

T0 = dt.datetime(2024, 1, 1, 10)


def pairs(spark, true, pred):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(true, pred)], "y_true double, y_pred double")


def series(spark, rows, schema="CGM double", pid="a"):
    full = [(pid, T0 + dt.timedelta(minutes=m), *v) for m, *v in rows]
    return spark.createDataFrame(full, f"participant_id string, EventDateTime timestamp_ntz, {schema}")


def column(df, name):
    return [r[name] for r in df.orderBy("participant_id", "EventDateTime").collect()]


@pytest.mark.parametrize(
    "true, pred, expected",
    [
        ([100, 150, 200], [110, 135, 180], 10.0),
        ([0, 100, 150], [10, 110, 135], 10.0),
        ([100, 150, 200, 80, 120], [110, 140, 190, 85, 125], (10 / 100 + 10 / 150 + 10 / 200 + 5 / 80 + 5 / 120) / 5 * 100),
    ],
)
def test_mard(spark, true, pred, expected):
    assert V.mard(pairs(spark, true, pred)).first()[0] == pytest.approx(expected)


def test_mard_without_positive_reference_fails(spark):
    with pytest.raises(Exception, match="no positive reference"):
        V.mard(pairs(spark, [0], [1])).collect()


def test_hypo_and_hyper(spark):
    hypo = V.hypo_detection(pairs(spark, [65, 120, 50, 150, 45, 180, 60, 90], [70, 115, 55, 145, 50, 175, 65, 95])).first()
    assert hypo["hypoglycemia_sensitivity"] == pytest.approx(75.0)
    hyper = V.hyper_detection(pairs(spark, [300, 120, 280, 150, 350, 180, 260, 90], [295, 115, 275, 145, 340, 175, 255, 95]), 250.0).first()
    assert hyper["hyperglycemia_sensitivity"] == 100.0 and hyper["hyperglycemia_accuracy"] == 100.0


def test_tir_accuracy(spark):
    row = V.tir_accuracy(pairs(spark, [100, 150, 200, 60], [110, 200, 190, 65])).first()
    assert row["tir_prediction_accuracy"] == 75.0


def test_zones_sum_to_hundred(spark):
    p = pairs(spark, [100, 120, 80, 150, 200, 60, 180, 90, 110, 140], [105, 115, 85, 145, 195, 65, 175, 95, 115, 135])
    for grid in ("clarke", "parkes_type1", "parkes_type2"):
        row = V.zone_summary(p, grid).first().asDict()
        assert sum(v for k, v in row.items() if "_zone_" in k) == pytest.approx(100.0)
    clarke = V.zone_summary(p, "clarke").first()["clarke_clinically_acceptable_percent"]
    parkes = V.zone_summary(p, "parkes_type1").first()["parkes_clinically_acceptable_percent"]
    assert parkes <= clarke


def test_zone_reachability(spark):
    grid = spark.range(1, 500, 7).crossJoin(spark.range(1, 500, 7).withColumnRenamed("id", "p"))
    r, p = F.col("id").cast("double"), F.col("p").cast("double")
    seen = grid.agg(
        F.sort_array(F.collect_set(clarke_zone(r, p))).alias("c"),
        F.sort_array(F.collect_set(clarke_zone_simple(r, p))).alias("s"),
        F.sort_array(F.collect_set(parkes_zone(r, p))).alias("k"),
    ).first()
    assert seen["c"] == ["A", "B", "C", "D"] and "E" in seen["s"] and seen["k"] == ["A", "B", "C", "D", "E"]
    with pytest.raises(ValueError):
        parkes_zone(r, p, "type3")


def test_insulin_curves(spark):
    m = F.col("m").cast("double")
    df = spark.createDataFrame([(0,), (75,), (360,)], "m int").select(E.decay_fraction(m).alias("d"), E.effect_fraction(m).alias("e"))
    rows = df.collect()
    assert (rows[0]["d"], rows[2]["d"]) == (1.0, 0.0)
    assert [r["e"] for r in rows] == [0.0, 1.0, 0.0]


def test_longest_null_run(spark):
    values = [1, 2, None, None, None, 6, 7, None, 9, 10]
    df = series(spark, [(5 * i, None if v is None else float(v)) for i, v in enumerate(values)], "v double")
    assert Q.longest_null_run(df, ["v"]).first()["longest_run"] == 3


def test_clip_to_limits(spark):
    df = spark.createDataFrame([(float(v),) for v in [20, 500] + [100 + i % 7 for i in range(60)]], "CGM double")
    out = O.treat_outliers(df, ["CGM"])
    assert out.agg(F.min("CGM"), F.max("CGM")).first() == (40.0, 400.0)


def test_near_duplicates(spark):
    rows = [(0, 100.0, 1.0), (0.5, 101.0, 1.0), (1, 102.0, 1.0), (1, 102.0, 1.0), (2, 103.0, 1.0)]
    df = series(spark, rows, "CGM double, Basal double")
    assert C.dedupe_exact(df).count() == 4
    assert column(C.clean(df, "last"), "CGM") == [103.0]
    assert column(C.clean(df, "first"), "CGM") == [100.0]
    once = C.clean(df, "last")
    assert C.clean(once, "last").count() == once.count()


def test_interpolation(spark):
    df = series(spark, [(0, 100.0), (5, None), (45, None), (50, 140.0), (55, None)])
    by_row = column(I.impute_interpolate(df, ["CGM"]), "CGM")
    assert by_row == pytest.approx([100.0, 100 + 40 / 3, 100 + 80 / 3, 140.0, 140.0])
    by_time = column(I.impute_interpolate(df, ["CGM"], mode="time"), "CGM")
    assert by_time == pytest.approx([100.0, 104.0, 136.0, 140.0, 140.0])
    short = column(I.impute_interpolate(df, ["CGM"], max_gap="30 minutes"), "CGM")
    assert short[1:3] == [None, None]
    with pytest.raises(ValueError):
        I.impute(df, {"CGM": "guess"})


def test_resample_bins(spark):
    df = series(spark, [(0, 100.0, 1.0), (1, 110.0, 2.0), (2, 120.0, 3.0), (5, 130.0, 4.0), (16, 150.0, 5.0)], "CGM double, TotalBolusInsulinDelivered double")
    out = RS.resample(df, "5 minutes")
    assert column(out, "CGM") == [110.0, 130.0, None, 150.0]
    # The sum of an empty bin is 0.
    assert column(out, "TotalBolusInsulinDelivered") == [6.0, 4.0, 0.0, 5.0]
    assert [RS.aggregate_for(c) for c in ("glucose_x", "cumulative_insulin_1h", "avg_basal", "is_meal", "hour_sin", "time_since_meal", "DeviceMode")] == [
        "mean", "sum", "mean", "max", "first", "mean", "first"]


def test_lags_and_time_in_range(spark):
    df = series(spark, [(5 * i, 100.0 + i) for i in range(30)])
    lagged = X.lag_features(df)
    assert column(lagged, "CGM_lag_30min")[6:] == [100.0 + i for i in range(24)]
    share = X.rolling_time_in_range(df)
    parts = share.select((F.col("time_in_range_3h") + F.col("time_below_range_3h") + F.col("time_above_range_3h")).alias("s"))
    assert {round(r["s"], 9) for r in parts.collect()} == {1.0}


def test_participants_do_not_mix(spark):
    both = series(spark, [(0, 100.0), (5, 110.0)]).unionByName(series(spark, [(1, 300.0), (6, 320.0)], pid="b"))
    assert column(X.glucose_trends(both).withColumn("d", F.col("glucose_trend_15min")), "d") == [0.0] * 4
    rate = column(X.rate_of_change(both), "glucose_rate_of_change")
    assert rate == pytest.approx([0.0, 2.0, 0.0, 4.0])


def test_scaler_round_trip(spark):
    df = spark.createDataFrame([(float(i), 10.0 * i, 5.0) for i in range(1, 11)], "a double, b double, c double")
    for kind in ("standard", "minmax", "robust"):
        s = Scaler.fit(df, ["a", "b", "c"], kind)
        back = s.inverse(s.transform(df)).collect()
        assert [r["b"] for r in back] == pytest.approx([10.0 * i for i in range(1, 11)])
        assert {round(r["c"], 9) for r in s.transform(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        Scaler.fit(df, kind="other")


def test_splits(spark, readings):
    out = P.split_by_participant(readings)
    assert out.count() == readings.count()
    assert out.groupBy("participant_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        P.split_by_participant(readings, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        P.split(readings, "other")
    with pytest.raises(ValueError):
        P.timeseries_cv_bounds(100, 5, 0.2)


def test_sequences_skip_missing(spark):
    df = series(spark, [(5 * i, None if i == 6 else 100.0 + i) for i in range(20)])
    out = S.sliding_sequences(df, ["CGM"], steps=4)
    # 16 full windows; the missing reading is in 4 of them and the target of one more.
    assert out.count() == 11
    assert out.filter(~F.col("y").between(20, 600)).count() == 0


def test_early_stop(spark):
    logs = spark.createDataFrame([("r", i, v) for i, v in enumerate([5.0, 4.0, 3.95, 3.9, 3.85, 3.0])], "run_id string, epoch int, value double")
    row = G.early_stop_epoch(logs, patience=3, min_delta=0.2).first()
    assert (row["stopped_epoch"], row["best_epoch"], row["best_value"]) == (4, 1, 4.0)
    assert G.early_stop_epoch(logs, patience=4, min_delta=0.2).first()["stopped_epoch"] is None


def test_request_validation(spark):
    schema = "readings array<double>, carbs array<struct<amount double, timestamp string>>, insulin array<struct<units double, timestamp string>>"
    good, bad = ([100.0] * 12, [(1.0, "t")], []), ([700.0, -1.0], [(-1.0, "t")], [(-2.0, "t")])
    rows = R.validate_request(spark.createDataFrame([good, bad], schema)).collect()
    assert rows[0]["is_valid"] and rows[0]["errors"] == []
    assert len(rows[1]["errors"]) == 4


def test_isolation_forest_finds_far_values(spark):
    values = [100 + (i * 37 % 41) / 2 for i in range(95)] + [200.0, 300.0, -50.0, 400.0, 500.0]
    df = spark.createDataFrame([(float(v),) for v in values], "CGM double")
    flagged = O.IsolationForest.fit(df, ["CGM"]).flag(df, contamination=0.05)
    assert {r["CGM"] for r in flagged.filter("is_outlier").collect()} == {200.0, 300.0, -50.0, 400.0, 500.0}


def test_overall_score_skips_missing_parts(spark):
    row = spark.range(1).select(V.overall_score(F.lit(15.0), F.lit(50.0), F.lit(None).cast("double")).alias("s")).first()
    assert row["s"] == pytest.approx((50.0 + 15.0) / 2)


def test_isolation_forest_does_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("CGM"))
    found = []
    for n in (3, 7, 50):
        flagged = O.IsolationForest.fit(df.repartition(n), ["CGM"], trees=20, key=["id"]).flag(df.repartition(n))
        found.append(sorted(r.id for r in flagged.filter("is_outlier").collect()))
    assert found[0] == found[1] == found[2] and found[0]


def test_active_insulin_can_look_back_by_time_alone(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, start + datetime.timedelta(minutes=k), 1.0) for k in range(300)]
    df = spark.createDataFrame(rows, "participant_id long, EventDateTime timestamp_ntz, TotalBolusInsulinDelivered double")
    last = lambda n: X.insulin_on_board(df, rows=n).orderBy("EventDateTime").collect()[-1].insulin_on_board
    assert last(None) == pytest.approx(last(300)) and last(None) > last(100)


def test_correlation_of_constant_measures_is_null(spark):
    from glyco.operators.explore import basal_bg_correlation

    rows = {"steady": [(1.0, 100.0), (None, 110.0)], "flat": [(1.0, 100.0), (2.0, 100.0)], "one": [(1.0, 100.0)], "rising": [(1.0, 100.0), (2.0, 110.0)]}
    parts = [series(spark, [(5 * k, *v) for k, v in enumerate(vs)], "Basal double, CGM double", pid) for pid, vs in rows.items()]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r["participant_id"]: (r["n"], r["correlation"]) for r in basal_bg_correlation(df).collect()}
    assert got.pop("rising") == (2, pytest.approx(1.0))
    assert got == {"steady": (2, None), "flat": (2, None), "one": (1, None)}
