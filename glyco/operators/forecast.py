"""Forecast jobs on ``pyspark.ml`` and two closed-form baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import gram as G
from ..plans.ranking import before, rows_at, sorted_index
from ..plans.series import T_US, Layout, Series
from ..schema import KEY, TARGET
from ..session import checkpoint_path, write_through
from .evaluate import glucose_metrics, regression_metrics
from .splits import participant_cv_folds, timeseries_cv_bounds

METRICS = ("mae", "mse", "rmse", "mard", "valid_predictions")
CHUNK_ROWS = 32_768  # rows that one task of a walk steps through


def forecast_persistence(df: DataFrame, target: str = TARGET, *, layout: Layout | None = None) -> DataFrame:
    """``y_true`` and, as ``y_pred``, the last known value before it."""
    s = Series(df, layout, carry_back=[F.col(target).isNotNull()])
    previous = F.last(target, ignorenulls=True).over(s.window.rowsBetween(Window.unboundedPreceding, -1))
    pairs = s.close(s.df.withColumns({"y_true": F.col(target), "y_pred": previous}))
    return pairs.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def forecast_trend(df: DataFrame, steps: int = 12, target: str = TARGET, *, layout: Layout | None = None) -> DataFrame:
    """``y_pred`` by a least-squares line through the previous ``steps`` known readings."""
    known = df.filter(F.col(target).isNotNull())
    s = Series(known, layout, back_rows=steps)
    # Minutes before the current reading keep the sums small.
    frame = s.window.rowsBetween(-steps, -1)
    points = s.df.withColumn("_p", F.collect_list(F.struct(F.col(T_US).alias("t"), F.col(target).alias("v"))).over(frame))

    def total(value):
        return F.aggregate("_p", F.lit(0.0), lambda a, x: a + value((x["t"] - F.col(T_US)) / 60_000_000.0, x["v"]))

    n = F.size("_p")
    sums = points.withColumns(
        {
            "_sx": total(lambda x, v: x),
            "_sy": total(lambda x, v: v),
            "_sxx": total(lambda x, v: x * x),
            "_sxy": total(lambda x, v: x * v),
        }
    )
    bottom = n * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.try_divide(n * F.col("_sxy") - F.col("_sx") * F.col("_sy"), bottom)
    at_now = F.try_divide(F.col("_sy") - slope * F.col("_sx"), n)
    out = sums.withColumns({"y_true": F.col(target), "y_pred": F.when(n >= 2, at_now), "_n": n})
    return s.close(out.filter(F.col("_n") == steps), "_p", "_sx", "_sy", "_sxx", "_sxy", "_n")


def as_vectors(sequences: DataFrame) -> DataFrame:
    """Flatten ``x`` into the vector column ``features``."""
    return sequences.withColumn("features", array_to_vector(F.flatten("x")))


def forecast_fit(sequences: DataFrame, estimator: Estimator | None = None) -> PipelineModel:
    """Fit a regression of ``y`` on the flattened windows."""
    stages = [
        VectorAssembler(inputCols=["features"], outputCol="inputs"),
        estimator or LinearRegression(featuresCol="inputs", labelCol="y", regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(as_vectors(sequences))


def forecast_predict(model: PipelineModel, sequences: DataFrame) -> DataFrame:
    """Add ``y_true`` and ``y_pred``."""
    scored = model.transform(as_vectors(sequences))
    return scored.withColumns({"y_true": F.col("y"), "y_pred": F.col("prediction")}).drop(
        "features", "inputs", "prediction"
    )


def _scored(rows: DataFrame, models: dict[int, np.ndarray], frame: G.Frame) -> DataFrame:
    """``fold, y_true, y_pred`` of every row whose fold has a model, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, z = batch["fold"].to_numpy(zero_copy_only=False), frame.rows(batch)
            out = np.full(len(folds), np.nan)
            for fold, weights in models.items():
                out[folds == fold] = G.predicted(weights, z[folds == fold], frame)
            yield pa.RecordBatch.from_arrays([batch["fold"], batch["y"], G.nullable(out)], ["fold", "y_true", "y_pred"])

    slim = rows.filter(F.col("fold").isin(list(models))).select(F.col("fold").cast("int").alias("fold"), "x", "y")
    return slim.mapInArrow(run, "fold int, y_true double, y_pred double")


def _fold_metrics(pairs: DataFrame, trained: dict[int, int]) -> DataFrame:
    both = regression_metrics(pairs.filter("y_true > 0"), ["fold"]).join(glucose_metrics(pairs, by=["fold"]).select("fold", "mard"), "fold")
    n_train = F.create_map(*[F.lit(v) for fold, n in trained.items() for v in (fold, n)])
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS]
    return both.select("fold", n_train[F.col("fold")].cast("bigint").alias("n_train"), F.explode(F.array(*entries)).alias("_e")).select(
        "fold", "n_train", "_e.*"
    )


def _ridge_folds(rows: DataFrame, part: str, trains: dict[int, list[int]], reg: float, min_train: int) -> DataFrame:
    """Fit every fold from the Gram matrices of its training parts and score all test rows in one pass."""
    frame = G.Frame.of(rows)
    parts = G.collected(G.grams(rows, part, frame), part, frame)
    models, trained = {}, {}
    for fold, members in trains.items():
        have = [parts[m] for m in members if m in parts]
        gram = sum(have) if have else np.zeros((frame.width, frame.width))
        if gram[0, 0] >= max(min_train, 1):
            models[fold], trained[fold] = G.solve(gram, reg), int(round(gram[0, 0]))
    if not models:
        raise ValueError("no fold had enough training rows")
    return _fold_metrics(_scored(rows, models, frame), trained)


def cross_validate(
    sequences: DataFrame,
    estimator: Estimator | None = None,
    splits: int = 5,
    by: str = "participant",
    min_train: int = 0,
    test_size: int | float = 0.1,
    reg: float = G.REG,
) -> DataFrame:
    """``fold, n_train, metric, value`` of a ridge regression, or of any other ``estimator``.

    The ridge fits come from one Gram matrix per fold or time interval: two passes over the rows, whatever
    the number of folds. Other estimators are fitted fold after fold. Rows with a missing value do not
    train the ridge and are not scored. The sequences are written through the checkpoint folder.
    """
    if by not in ("participant", "time"):
        raise ValueError("by must be participant or time")
    if by == "participant":
        folded = write_through(participant_cv_folds(sequences, splits))
        folds = sorted(r[0] for r in folded.select("fold").distinct().collect())
        if estimator is None:
            return _ridge_folds(folded, "fold", {f: [g for g in folds if g != f] for f in folds}, reg, min_train)
        parts = [(f, folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)) for f in folds]
        return _fitted_folds(parts, estimator, min_train)
    sequences = write_through(sequences)
    order = ["seq_end", KEY]

    def edges_of(n: int) -> list[int]:
        return sorted({p for _, *edges in timeseries_cv_bounds(n, splits, test_size) for p in edges})

    found, n = rows_at(sequences, order, edges_of)
    bounds, edges = timeseries_cv_bounds(n, splits, test_size), edges_of(n)
    if estimator is not None:
        cuts = dict(zip(edges, found))

        def within(a: int, b: int) -> DataFrame:
            left = ~before(sequences, order, cuts[a]) if a else F.lit(True)
            return sequences.filter(left & before(sequences, order, cuts[b]))

        return _fitted_folds([(fold, within(lo, hi), within(start, end)) for fold, lo, hi, start, end in bounds], estimator, min_train)
    # Interval i lies between the edges i - 1 and i; every interval is tested in one fold at most.
    passed = [(~before(sequences, order, row)).cast("int") for row in found]
    at = F.lit(0)
    for c in passed:
        at = at + c
    tested = {i + 1: fold for fold, _, _, start, end in bounds for i in range(edges.index(start), edges.index(end))}
    lookup = F.create_map(*[F.lit(v) for pair in tested.items() for v in pair])
    rows = sequences.withColumn("part", at).withColumn("fold", lookup[F.col("part")])
    trains = {fold: list(range(edges.index(lo) + 1, edges.index(hi) + 1)) for fold, lo, hi, _, _ in bounds}
    return _ridge_folds(rows, "part", trains, reg, min_train)


def _fitted_folds(parts: list[tuple[int, DataFrame, DataFrame]], estimator: Estimator | None, min_train: int) -> DataFrame:
    out = None
    for fold, train, test in parts:
        n_train = train.count()
        if n_train < max(min_train, 1):
            continue
        scored = forecast_predict(forecast_fit(train, estimator), test).select(F.lit(fold).alias("fold"), "y_true", "y_pred")
        rows = _fold_metrics(scored, {fold: n_train})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no fold had enough training rows")
    return out


def walk_forward_evaluate(
    sequences: DataFrame,
    estimator: Estimator | None = None,
    initial: float = 0.5,
    step: int = 100,
    horizon: int = 1,
    reg: float = G.REG,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Refit at every step on all earlier rows and predict the next ``horizon`` rows.

    Output: ``step, train_end, y_true, y_pred``; with ``horizon=step`` every row after the start is
    predicted, the last step with what is left. The ridge regression walks in chunks of whole steps: the Gram matrix
    of all rows before a chunk is a running sum, inside it the matrix grows step by step. The rows
    are read twice, whatever the number of steps. Another ``estimator`` is fitted once per step, each
    time on all earlier rows; choose its step with the table's size. Rows with a missing value do
    not train the ridge and have no prediction. The numbered sequences are written through the checkpoint folder.
    """
    ranked, n = sorted_index(sequences, ["seq_end", KEY], "_rn")
    start = max(1, int(n * initial))
    if start >= n:
        raise ValueError("too few rows for one step")
    if estimator is not None:
        return _fitted_steps(write_through(ranked), estimator, range(start, n, step), horizon)
    span = step * max(1, chunk_rows // step)  # rows of a chunk; chunk 0 is what comes before the start
    since = F.col("_rn") - start
    ranked = write_through(ranked.select("_rn", "x", "y").withColumn("chunk", F.floor(since / span) + 1).withColumn("chunk", F.greatest("chunk", F.lit(0))))
    frame = G.Frame.of(ranked)
    before_it = G.running(G.grams(ranked, "chunk", frame), "chunk")
    # A row is dealt to its own chunk, and to earlier ones whose last steps still predict it.
    first_step = F.greatest(F.ceil((since - horizon + 1) / step), F.lit(0))
    earliest = F.least(F.floor(first_step * step / span) + 1, F.col("chunk"))
    dealt = ranked.filter("chunk > 0").select(F.explode(F.sequence(earliest, "chunk")).alias("chunk"), "_rn", "x", "y")

    def walk(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("_rn")
        at, z, truth = rows["_rn"].to_numpy(), frame.rows(rows), rows["y"].combine_chunks()
        gram = frame.unpacked(np.array(known["g"].to_pylist()[0]))
        low = start + (rows["chunk"][0].as_py() - 1) * span
        parts = []
        for end in range(low, min(low + span, n), step):
            a, b, c = np.searchsorted(at, [end, end + step, end + horizon])
            weights = G.solve(gram, reg)
            guess = np.full(c - a, np.nan) if weights is None else G.predicted(weights, z[a:c], frame)
            count = pa.array(np.full(c - a, (end - start) // step + 1), pa.int32())
            parts.append(pa.table({"step": count, "train_end": np.full(c - a, end, np.int64), "y_true": truth[a:c], "y_pred": G.nullable(guess)}))
            gram = gram + G.product(z[a:b])
        return pa.concat_tables(parts)

    schema = "step int, train_end long, y_true double, y_pred double"
    return dealt.groupBy("chunk").cogroup(before_it.filter("chunk > 0").groupBy("chunk")).applyInArrow(walk, schema)


def _fitted_steps(ranked: DataFrame, estimator: Estimator, starts: range, horizon: int) -> DataFrame:
    path = checkpoint_path(ranked.sparkSession, "walk")
    for number, end in enumerate(starts, start=1):
        model = forecast_fit(ranked.filter(F.col("_rn") < end), estimator)
        test = ranked.filter((F.col("_rn") >= end) & (F.col("_rn") < end + horizon))
        rows = forecast_predict(model, test).select(
            F.lit(number).alias("step"), F.lit(end).cast("bigint").alias("train_end"), "y_true", "y_pred"
        )
        rows.write.mode("append").parquet(path)
    return ranked.sparkSession.read.parquet(path)


def score_with(
    sequences: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], name: str = "y_pred"
) -> DataFrame:
    """Score Arrow batches with any user model; ``predict`` is shipped to the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: predict(batch)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.schema.fields)
    return sequences.mapInPandas(run, f"{fields}, `{name}` double")
