"""Active insulin without lists: equal to a loop over the earlier rows, for batch and stream."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from glyco.operators import features as X
from glyco.plans.series import Layout

BOLUS = "TotalBolusInsulinDelivered"


def series(seed: int, n: int, step: int, ties: bool = False):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000
    for k in range(n):
        t += 0 if ties and rng.random() < 0.2 else rng.choice([1, 1, 2]) * step
        dose = rng.choice([None, 0.0, float("nan"), rng.random() * 5, rng.random()])
        rows.append((k, "a" if k % 7 else "b", t, dose))
    return rows


def readings(spark, rows):
    df = spark.createDataFrame(rows, f"event_id int, participant_id string, s long, {BOLUS} double")
    return df.select("event_id", "participant_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("EventDateTime"), BOLUS)


def brute(rows, limit, duration, peak):
    """The loop over earlier rows; rows of one time are peers without a limit of rows."""
    out = {}
    for key in ("a", "b"):
        mine = [r for r in rows if r[1] == key]
        for i, (k, _, t, _) in enumerate(mine):
            iob = effect = 0.0
            for _, _, u_t, u in mine[:i] if limit is None else mine[max(0, i - limit) : i]:
                m = (t - u_t) / 60
                if u is None or not u > 0 or m > duration or (limit is None and m == 0):
                    continue
                iob += u * (1.0 if m <= 0 else 0.0 if m >= duration else math.exp(-4 / duration / 60 * m))
                effect += u * (0.0 if m <= 0 or m >= duration else m / peak if m <= peak else (duration - m) / (duration - peak))
            out[k] = (iob, effect)
    return out


@pytest.mark.parametrize("limit", [None, 5, 100])
@pytest.mark.parametrize("duration, peak", [(360.0, 75.0), (30.0, 7.5)])
def test_equals_the_loop(spark, limit, duration, peak):
    rows = series(4, 700, 60)
    df, want = readings(spark, rows), brute(rows, limit, duration, peak)
    for layout in (Layout(), Layout.fit(df, max_rows=60)):
        iob = X.insulin_on_board(df, duration, rows=limit, layout=layout)
        both = X.active_insulin_effect(iob, duration, peak, rows=limit, layout=layout)
        assert both.columns == [*df.columns, "insulin_on_board", "active_insulin_effect"]
        got = both.collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.insulin_on_board == pytest.approx(want[r.event_id][0], abs=1e-11, rel=1e-11)
            assert r.active_insulin_effect == pytest.approx(want[r.event_id][1], abs=1e-9, rel=1e-11)
            assert (want[r.event_id][0] > 0) == (r.insulin_on_board > 0)


def test_peers_do_not_count_without_a_limit(spark):
    rows = series(9, 300, 60, ties=True)
    want = brute(rows, None, 45.0, 10.0)
    for r in X.insulin_on_board(readings(spark, rows), 45.0, rows=None).collect():
        assert r.insulin_on_board == pytest.approx(want[r.event_id][0], abs=1e-11, rel=1e-11)


def test_no_list_in_the_plan(readings_plan):
    assert "collect_list" not in readings_plan and "BatchEval" not in readings_plan


@pytest.fixture
def readings_plan(spark):
    df = readings(spark, series(1, 20, 60))
    plans = [X.insulin_on_board(df, rows=n) for n in (None, 100)] + [X.active_insulin_effect(df, rows=n) for n in (None, 100)]
    return " ".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_times_decades_apart_stay_exact(spark):
    """Nothing in the sums grows with the length of the series."""
    rows = [(k, "a", k * 86_400 * 365, 3.0) for k in range(60)]
    rows += [(100 + k, "a", 59 * 86_400 * 365 + 60 + k, 0.5) for k in range(10)]
    rows.sort(key=lambda r: r[2])
    want = brute(rows, None, 360.0, 75.0)
    for r in X.insulin_on_board(readings(spark, rows), rows=None).collect():
        assert r.insulin_on_board == pytest.approx(want[r.event_id][0], abs=1e-12, rel=1e-12)


def streamed(spark, df, folder, **options):
    """The rows as files that arrive one by one, in time order."""
    from glyco.streaming import live as L

    rows = df.withColumns({"FoodDelivered": F.when(F.col("event_id") % 50 == 0, 1.0), "Basal": F.lit(None).cast("double")})
    bounds = df.approxQuantile("event_id", [0.2, 0.4, 0.6, 0.8], 0.0)
    for part, (low, high) in enumerate(zip([-1.0, *bounds], [*bounds, 1e9])):
        rows.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(f"{folder}/in{part}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/in")
    for part in range(5):
        [file] = glob.glob(f"{folder}/in{part}/*.parquet")
        shutil.copy(file, f"{folder}/in/{part}.parquet")
        os.utime(f"{folder}/in/{part}.parquet", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = L.read_readings(spark, f"{folder}/in", rows.schema, max_files=1)
    out = L.stream_time_since_event(stream, **options)
    query = L.run_to_parquet(out, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    assert len(query.recentProgress) >= 5
    return {(r[0], r[1]): r for r in spark.read.parquet(f"{folder}/out").collect()}


@pytest.mark.parametrize("limit", [None, 40])
def test_stream_equals_batch(spark, tmp_path, limit):
    rng = random.Random(6)
    rows = [(k, "a" if k % 9 else "b", 1_700_000_000 + 60 * k, rng.random()) for k in range(1500)]  # a dose every minute
    df = readings(spark, rows)
    got = streamed(spark, df, str(tmp_path), rows=limit)
    want = X.insulin_on_board(df, rows=limit).collect()
    assert len(got) == len(want) == 1500
    for r in want:
        assert got[r.participant_id, r.EventDateTime].insulin_on_board == pytest.approx(r.insulin_on_board, rel=1e-9)
    if limit is None:
        assert max(r.insulin_on_board for r in want) > 140  # well over a hundred doses act at once


def test_late_readings_see_the_doses_before_them():
    from glyco.streaming import live as L

    import numpy as np

    minute = 60_000_000
    state = {k: list(v) if isinstance(v, list) else v for k, v in L.BEGUN.items()}
    none = np.full(3, np.nan)
    L._advance(state, np.array([0, 10, 30]) * minute, none, np.array([1.0, np.nan, 2.0]), none, 60.0, None, 20 * minute)
    assert state["times"] == [0, 30 * minute] and state["seen"] == 3
    [_, _, _, iob] = L._advance(state, np.array([20, 65]) * minute, none[:2], np.array([np.nan, np.inf]), none[:2], 60.0, None, 20 * minute)
    share = lambda m: math.exp(-4 / 60 / 60 * m)
    assert iob.tolist() == pytest.approx([share(20), 2 * share(35)])
    assert state["times"] == [0, 30 * minute]  # the first dose still acts for readings up to the delay late
    L._advance(state, np.array([200]) * minute, none[:1], none[:1], none[:1], 60.0, None, 20 * minute)
    assert state["times"] == []
