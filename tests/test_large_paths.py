"""Sliced series, binned positions and bracketed quantiles give the same results as the plain plans."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyco.operators import clean as C
from glyco.operators import features as X
from glyco.operators import forecast as M
from glyco.operators import impute as I
from glyco.operators import sequences as S
from glyco.plans.quantiles import group_quantiles, quantiles
from glyco.plans.ranking import rows_at, sorted_index
from glyco.plans.series import Layout, row_index

IDS = ["event_id"]
UNCACHED = "/root/testdata/sf0.01"  # the smallest table is cached by a fixture


def frames_equal(a, b, keys=None):
    def tidy(df):
        pdf = df.toPandas()
        return pdf[sorted(pdf.columns)].sort_values(keys or IDS).reset_index(drop=True)

    pd.testing.assert_frame_equal(tidy(a), tidy(b), check_exact=False, rtol=1e-9)


@pytest.fixture(scope="module")
def sliced(readings):
    layout = Layout.fit(readings, max_rows=15)
    assert len(layout.hot) == 15
    return layout


OPERATORS = {
    "row_index": lambda df, lay: row_index(df, lay),
    "dedupe_near": lambda df, lay: C.dedupe_near(df, "most_complete", "4 hours", layout=lay),
    "impute_ffill": lambda df, lay: I.impute_ffill(df, ["CGM", "Basal"], layout=lay),
    "impute_interpolate": lambda df, lay: I.impute_interpolate(df, ["CGM"], layout=lay),
    "impute_limited": lambda df, lay: I.impute_limited(df, ["CGM"], "bfill", 2, layout=lay),
    "time_since_event": lambda df, lay: X.time_since_event(df, layout=lay),
    "rolling_insulin": lambda df, lay: X.rolling_insulin(df, (("1d", "1 day"), ("3d", "3 days"), ("7d", "7 days")), layout=lay),
    "insulin_on_board": lambda df, lay: X.insulin_on_board(df, 4320.0, layout=lay),
    "lag_features": lambda df, lay: X.lag_features(df, layout=lay),
    "all_features": lambda df, lay: X.all_features(df, layout=lay),
    "forecast_trend": lambda df, lay: M.forecast_trend(df, layout=lay),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_sliced_equals_plain(readings, sliced, name):
    run = OPERATORS[name]
    frames_equal(run(readings, Layout()), run(readings, sliced))


@pytest.fixture(scope="module")
def repeated(readings):
    """Exact repeats and rows of equal time, next to each other and at slice edges."""
    third = readings.filter(F.col("event_id") % 3 == 0)
    fifth = readings.filter(F.col("event_id") % 5 == 0)
    return readings.unionByName(third).unionByName(fifth).unionByName(fifth).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_sliced_equals_plain_on_repeated_rows(repeated, name):
    layout = Layout.fit(repeated, max_rows=15)
    assert len(layout.hot) == 15
    run = OPERATORS[name]

    def tidy(df):
        pdf = df.toPandas()
        keys = pdf.select_dtypes("number").round(4)
        return pdf.loc[keys.sort_values(sorted(keys.columns)).index, sorted(pdf.columns)].reset_index(drop=True)

    pd.testing.assert_frame_equal(tidy(run(repeated, Layout())), tidy(run(repeated, layout)), check_exact=False, rtol=1e-9, atol=1e-6)


def test_sequences_of_repeated_rows(repeated):
    def rows(layout):
        seqs = S.sliding_sequences(repeated, ["CGM"], steps=3, only_valid=False, layout=layout)
        return sorted(map(str, seqs.withColumn("x", F.to_json("x")).collect()))

    assert rows(Layout()) == rows(Layout.fit(repeated, max_rows=15))


def test_sliced_sequences(readings, sliced):
    def flat(layout):
        seqs = S.sliding_sequences(readings, ["CGM"], steps=3, only_valid=False, layout=layout)
        return seqs.withColumn("x", F.to_json("x"))

    frames_equal(flat(Layout()), flat(sliced), ["participant_id", "seq_end"])


def test_one_series_holds_a_third(spark, readings):
    # One participant takes over a third of the rows; only that one is sliced.
    third = F.when(F.col("event_id") < 400, F.lit(-1)).otherwise(F.col("participant_id"))
    skewed = readings.withColumn("participant_id", third)
    layout = Layout.fit(skewed, max_rows=100)
    assert [k for k, _ in layout.hot] == [-1]
    frames_equal(X.all_features(skewed, layout=Layout()), X.all_features(skewed, layout=layout))


def test_quantiles_bracketed(readings):
    columns, probs = ["CGM", "Basal", "FoodDelivered"], [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    plain, narrow = quantiles(readings, columns, probs), quantiles(readings, columns, probs, most=10)
    for c in columns:
        assert narrow[c] == pytest.approx(plain[c], rel=1e-12)


def test_quantiles_with_ties(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("double").alias("v"))
    assert quantiles(df, ["v"], [0.1, 0.5, 0.9], most=10)["v"] == [0.0, 1.0, 2.0]


def test_group_quantiles_bracketed(readings):
    probs = [0.25, 0.5, 0.75]
    plain = {r[0]: r[1] for r in group_quantiles(readings, ["participant_id"], "CGM", probs).collect()}
    mixed = {r[0]: r[1] for r in group_quantiles(readings, ["participant_id"], "CGM", probs, most=52).collect()}
    assert plain.keys() == mixed.keys()
    for k in plain:
        assert mixed[k] == pytest.approx(plain[k], rel=1e-12)


def test_positions(readings):
    df = readings.select("event_id", "EventDateTime")
    order = ["EventDateTime", "event_id"]
    ordered = [tuple(r) for r in df.orderBy(*order).select(*order).collect()]
    ranked, n = sorted_index(df, order)
    assert n == 1000 and sorted((r.rn, r.EventDateTime, r.event_id) for r in ranked.collect()) == [(k, *r) for k, r in enumerate(ordered)]
    rows, n = rows_at(df, order, lambda n: [0, 17, n - 1, n])
    assert n == 1000 and rows == [ordered[0], ordered[17], ordered[999], None]


def test_wrong_clocks_and_ties_fill_no_partition(spark):
    """Two far times and many rows of one time must not gather in one task."""
    day = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.when(F.col("id") % 2 == 0, F.col("id") * 1000).otherwise(0))
    far = F.when(F.col("id") == 1, F.lit("1970-01-01").cast("timestamp")).when(F.col("id") == 3, F.lit("2099-01-01").cast("timestamp"))
    df = spark.range(200_000).select("id", F.coalesce(far, day).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = df.orderBy("t", "id").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in held) < 200_000 / 4
    rows, n = rows_at(df, ["t", "id"], lambda n: [0, n - 1])
    assert [r[1] for r in rows] == [1, 3]


def test_many_columns_share_the_cell_budget(readings):
    wide = readings.select(*[(F.col("CGM") + k).alias(f"c{k}") for k in range(54)])
    plain, narrow = quantiles(wide, wide.columns, [0.25, 0.75]), quantiles(wide, wide.columns, [0.25, 0.75], most=54 * 10)
    for c in wide.columns:
        assert narrow[c] == pytest.approx(plain[c], rel=1e-12)


def test_partition_count_does_not_matter(spark, readings):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    many = X.rolling_stats(readings, layout=Layout()).toPandas()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = X.rolling_stats(readings, layout=Layout()).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pd.testing.assert_frame_equal(
        many.sort_values("event_id").reset_index(drop=True), one.sort_values("event_id").reset_index(drop=True)
    )


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_features_use_one_exchange(spark, readings):
    from glyco.sources.events import load_cgm

    df = X.all_features(load_cgm(spark, UNCACHED), layout=Layout(), mean=100.0)
    _, physical = plan_of(df)
    assert physical.count("Exchange") == 1


def test_scan_reads_only_needed_columns(spark):
    from glyco.sources.events import load_cgm

    _, physical = plan_of(load_cgm(spark, UNCACHED).filter(F.col("DeviceMode") == "click").select("CarbSize"))
    assert "EqualTo(event_type,click)" in physical
    assert "props" not in physical and "user_id" not in physical


def test_selection_against_numpy(spark):
    """Signs, both zeros, infinities, ties, tiny and huge values, with every pass forced."""
    import math
    import random

    import numpy as np

    from glyco.plans import quantiles as Q

    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-300), rng.gauss(0, 1e300), 0.0, -0.0, 7.5, 5e-324, -5e-324]) for _ in range(4000)]
    values += [math.inf, -math.inf, None, None]
    df = spark.createDataFrame([(v, 1.0 if v else None, None) for v in values], "a double, b double, c double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.7501, 0.999, 1.0]
    known = sorted(v for v in values if v is not None)
    for most in (1, 3000, None):
        got = quantiles(df, ["a", "b", "c"], probs, most=most)
        assert got["b"] == [1.0] * len(probs) and got["c"] == [None] * len(probs)
        for p, q in zip(probs, got["a"]):
            at = p * (len(known) - 1)
            low, high = known[math.floor(at)], known[math.ceil(at)]
            assert q == low or math.isclose(q, (math.ceil(at) - at) * low + (at - math.floor(at)) * high, rel_tol=1e-12)
    numbers = Q.ordered(np.array(known))
    assert (np.diff(numbers) >= 0).all() and [Q.value_of(n) for n in numbers] == known
    assert Q.ordered(np.array([np.nan]))[0] > Q.ordered(np.array([np.inf]))[0]


def test_passes_do_not_grow_the_plan(spark, readings, monkeypatch):
    """Every pass scans the input once, whatever the number of rounds and probabilities."""
    from glyco.plans import quantiles as Q

    plans, counted = [], Q._counted

    def spy(*args):
        out = counted(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(Q, "_counted", spy)
    table = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    quantiles(table, ["value", "user_id"], [k / 20 for k in range(21)], most=1)
    assert 2 <= len(plans) <= 4 and {p.count("Relation") for p in plans} == {1}


def test_moments(spark):
    from glyco.plans.quantiles import moments

    df = spark.range(10_000).select((F.col("id") + 1e9).alias("a"), F.when(F.col("id") < 3, 2.0).alias("b"), F.lit(None).cast("double").alias("c"))
    got = moments(df.repartition(7), ["a", "b", "c"])
    assert got["a"] == pytest.approx((1e9 + 4999.5, (1e8 - 1) ** 0.5 / 12**0.5, 1e9, 1e9 + 9999), rel=1e-12)
    assert got["b"] == (2.0, 0.0, 2.0, 2.0) and "c" not in got


def test_sequences_follow_the_exchange_of_their_checks(readings):
    """One exchange; rows are gathered in an aggregation behind it, not by a window for every row."""
    import re

    plan = S.sliding_sequences(readings, ["CGM", "Basal"], steps=12, layout=Layout())._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("InMemoryTableScan")]
    assert plan.count("Exchange hashpartitioning") == 1
    assert not [line for line in plan.splitlines() if re.search(r"\bWindow \[", line) and "collect_list" in line]


@pytest.mark.parametrize("steps, horizon", [(1, 1), (3, 2), (300, 5)])
def test_sequences_against_a_loop(spark, steps, horizon):
    """Blocks shorter and longer than a window, for valid windows only."""
    import random

    rng = random.Random(steps)
    rows = [("a" if k % 3 else "b", k, rng.choice([None] + [100.0 + k] * 60), float(k)) for k in range(1500)]
    df = spark.createDataFrame(rows, "participant_id string, s int, CGM double, f double")
    df = df.select("participant_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("EventDateTime"), "CGM", "f")
    want = []
    for key in ("a", "b"):
        mine = [r for r in rows if r[0] == key]
        for i in range(steps - 1, len(mine) - horizon):
            part, y = mine[i - steps + 1 : i + 1], mine[i + horizon][2]
            if y is not None and y <= 600 and all(r[2] is not None for r in part):
                want.append((key, [[r[2], r[3]] for r in part], y))
    got = [(r.participant_id, r.x, r.y) for r in S.sliding_sequences(df, ["CGM", "f"], steps=steps, horizon=horizon).collect()]
    assert sorted(got) == sorted(want)
