"""As-of joins, sketches that roll up and the fold tree against brute force."""

from __future__ import annotations

import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyco.operators import asof as A
from glyco.operators import distinct as D
from glyco.operators import udf as U
from glyco.plans.series import Layout


def tables(spark, seed):
    """Two tables with equal times, repeated rows, a hot key, and null keys and times."""
    rng = random.Random(seed)

    def rows(n, first):
        return [(first + k, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([rng.randint(0, 120), rng.randint(0, 120), None])) for k in range(n)]

    left, right = rows(400, 0) + [(9, "only left", 5)], rows(120, 1000) + [(9, "only right", 5)]

    def table(rows, name):
        df = spark.createDataFrame(rows, f"{name} long, participant_id string, s long")
        return df.select(name, "participant_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("EventDateTime"))

    return left, right, table(left, "l"), table(right, "r")


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 7])
def test_nearest_row(spark, direction, exact, tolerance):
    left, right, l, r = tables(spark, 3)
    ahead = direction == "forward"

    def best(key, t):
        if key is None or t is None:
            return None
        ok = [(s, i) for i, k, s in right if k == key and s is not None and ((s > t if ahead else s < t) or (exact and s == t)) and (tolerance is None or abs(s - t) <= tolerance)]
        # Of one time the last by ``r`` looking back, the first looking ahead.
        return (min(ok) if ahead else max(ok))[1] if ok else None

    want = sorted((i, str(k), str(best(k, t))) for i, k, t in left)
    both = l.select("participant_id", "EventDateTime").unionByName(r.select("participant_id", "EventDateTime"))
    for layout in (Layout(), Layout.fit(both, max_rows=15)):
        options = {"tolerance": None if tolerance is None else tolerance * 1_000_000, "tie": ["r"], "layout": layout}
        got = A.asof_join(l, r, ["r"], exact=exact, direction=direction, **options)
        assert got.columns == ["l", "participant_id", "EventDateTime", "r"]
        assert sorted((x.l, str(x.participant_id), str(x.r)) for x in got.collect()) == want


def test_asof_without_rows(spark):
    _, _, l, r = tables(spark, 4)
    assert A.asof_join(l, r.limit(0), ["r"]).filter("r is not null").count() == 0
    assert A.asof_join(l.limit(0), r, ["r"]).count() == 0
    with pytest.raises(ValueError):
        A.asof_join(l, r, direction="sideways")


def test_one_exchange_and_no_join(spark):
    _, _, l, r = tables(spark, 5)
    plan = A.asof_join(l, r, ["r"], layout=Layout())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sketches_roll_up(spark):
    # Days overlap by half, so weeks and the whole are not sums of days.
    rows = spark.range(200_000).select((F.col("id") % 100).cast("int").alias("day"), (F.col("id") % 100 * 500 + F.floor(F.col("id") / 100) % 1000).alias("who"))
    days = D.distinct_sketches(rows, "who", {"day": F.col("day")})
    weeks = D.roll_up(days, {"week": F.floor(F.col("day") / 7)})
    exact = {r[0]: r[1] for r in rows.groupBy(F.floor(F.col("day") / 7)).agg(F.countDistinct("who")).collect()}
    for r in D.estimates(weeks, "n").collect():
        assert abs(r.n / exact[r.week] - 1) < 4 * D.relative_error()
    [total] = D.estimates(D.roll_up(weeks), "n").collect()
    assert abs(total.n / rows.select("who").distinct().count() - 1) < 4 * D.relative_error()
    few = D.estimates(D.distinct_sketches(rows.filter("who < 300"), "who", {"day": F.col("day")}), "n").collect()
    assert [r.n for r in few if r.day == 0] == [300]  # exact while the sketch lists its values
    assert D.estimates(D.roll_up(days.limit(0)), "n").collect()[0].n == 0


@pytest.mark.parametrize("fan_in", [2, 3, 256])
def test_fold_tree(spark, fan_in):
    df = spark.range(10_000).repartition(23).select(F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("v"))
    known = [float(k) for k in range(10_000) if k % 7]
    take = lambda b: b["v"]
    assert U.map_reduce(df, take, max, fan_in).first().result == max(known)
    assert U.map_reduce(df, take, operator.add, fan_in).first().result == sum(known)
    assert U.map_reduce(df, take, lambda a, b: np.hypot(a, b), fan_in).first().result == pytest.approx(sum(x * x for x in known) ** 0.5)
    assert U.map_reduce(df.limit(0), take, min, fan_in).count() == 0
