from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from glyco.operators import forecast as M
from glyco.plans import gram as G

RIDGE = dict(featuresCol="inputs", labelCol="y", regParam=0.01)


@pytest.fixture(scope="module")
def sequences(spark):
    """Windows with features of very different size, one constant and one repeated."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        base = rng.normal(size=2)
        x = [[float(1e2 + base[0]), 7.0, float(base[1] * 1e-3)], [float(1e2 + base[0]), 7.0, float(rng.normal())]]
        y = float(120 + 9 * base[0] - 4 * base[1] + rng.normal())
        rows.append((f"p{k % 11}", k // 11, x, y))
    df = spark.createDataFrame(rows, "participant_id string, at int, x array<array<double>>, y double")
    return df.select("participant_id", F.timestamp_seconds(F.col("at") * 300).cast("timestamp_ntz").alias("seq_end"), "x", "y").cache()


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r[:3]))


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-6, (a, b)


@pytest.mark.parametrize("step, horizon, chunk", [(40, 40, 100), (50, 120, 60), (60, 7, 10_000)])
def test_walk_equals_the_fitted_loop(sequences, step, horizon, chunk):
    fast = M.walk_forward_evaluate(sequences, initial=0.7, step=step, horizon=horizon, chunk_rows=chunk)
    slow = M.walk_forward_evaluate(sequences, LinearRegression(**RIDGE), initial=0.7, step=step, horizon=horizon)
    close(table(fast), table(slow))


@pytest.mark.parametrize("by", ["participant", "time"])
def test_folds_equal_the_fitted_loop(sequences, by):
    close(table(M.cross_validate(sequences, by=by)), table(M.cross_validate(sequences, LinearRegression(**RIDGE), by=by)))


def test_rows_with_missing_values_do_not_train(spark, sequences):
    broken = spark.createDataFrame([("q", 500, [[None, 1.0, 2.0], [1.0, 1.0, 1.0]], 1e9), ("q", 501, [[1e2, 7.0, 0.0]] * 2, None)], "participant_id string, at int, x array<array<double>>, y double")
    broken = broken.select("participant_id", F.timestamp_seconds(F.col("at") * 300).cast("timestamp_ntz").alias("seq_end"), "x", "y")
    got = M.walk_forward_evaluate(sequences.unionByName(broken), initial=0.7, step=40, horizon=40)
    plain = M.walk_forward_evaluate(sequences, initial=630 / 900, step=40, horizon=40)
    missing = got.filter("y_pred is null or y_true is null").collect()
    assert len(missing) == 2 and sum(r.y_pred is None for r in missing) == 1
    assert got.filter("train_end < 880").count() >= plain.filter("train_end < 880").count()


def test_the_rows_are_read_twice(sequences, monkeypatch):
    """However many steps there are, the numbered table is scanned for the matrices and for the walk only."""
    plans = []
    for step in (10, 100):
        plan = M.walk_forward_evaluate(sequences, initial=0.5, step=step, horizon=step, chunk_rows=100)._jdf.queryExecution().optimizedPlan().toString()
        plans.append(plan.count("Relation"))
    assert plans == [2, 2]


def test_constant_label_and_no_rows():
    rows = np.array([[1.0, 2.0, 5.0], [1.0, 3.0, 5.0]])
    assert G.solve(G.product(rows)).tolist() == [5.0, 0.0]
    assert G.solve(np.zeros((3, 3))) is None


def test_too_few_rows(spark, sequences):
    with pytest.raises(ValueError):
        M.walk_forward_evaluate(sequences.limit(1), initial=1.0)
    with pytest.raises(ValueError):
        M.cross_validate(sequences, min_train=10_000)
    with pytest.raises(ValueError):
        M.cross_validate(sequences, by="week")
