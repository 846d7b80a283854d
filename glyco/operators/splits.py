"""Train, validation and test assignment; cross-validation folds.

Positions over the whole table come from :mod:`glyco.plans.ranking`, so no split
sorts the table in one task. Time splits only look up the rows at the cuts; ``order`` must start with the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import before, rows_at, sorted_index
from ..schema import KEY

SPLITS = ("train", "val", "test")


def _check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("train, val and test ratios must sum to 1")


def _named(position: Column, first: int, second: int) -> Column:
    return F.when(position < first, "train").when(position < second, "val").otherwise("test")


def participant_ranks(df: DataFrame, seed: int = 42, key: str = KEY) -> tuple[DataFrame, int]:
    """Participants in a seeded random order that any engine reproduces (md5 of seed and id)."""
    people = df.select(key).distinct()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = people.withColumn("_h", digest)
    ranked, n = sorted_index(hashed, ["_h", key], "_rank")
    return ranked.drop("_h"), n


def split_by_participant(
    df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42, key: str = KEY
) -> DataFrame:
    """Column ``split``; all rows of a participant go to one split."""
    _check_ratios(train, val, test)
    ranked, n = participant_ranks(df, seed, key)
    n_train, n_val = int(n * train), int(n * val)
    assigned = ranked.select(
        F.col(key).alias("_k"), _named(F.col("_rank"), n_train, n_train + n_val).alias("split")
    )
    # Spark broadcasts the assignment when it is small and shuffles it otherwise.
    return df.join(assigned, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def split_by_time(
    df: DataFrame, time: str, order: list[str], train: float = 0.7, val: float = 0.15, test: float = 0.15
) -> DataFrame:
    """Column ``split`` by position in time; ``order`` is the full, unique order (time first)."""
    _check_ratios(train, val, test)
    (first, second), _ = rows_at(df, order, lambda n: [int(n * train), int(n * (train + val))])
    name = F.when(before(df, order, first), "train").when(before(df, order, second), "val").otherwise("test")
    return df.withColumn("split", name)


def split(df: DataFrame, strategy: str = "participant", **options) -> DataFrame:
    """Split by ``participant`` or by ``temporal`` order."""
    if strategy == "participant":
        return split_by_participant(df, **options)
    if strategy == "temporal":
        return split_by_time(df, **options)
    raise ValueError(f"unknown split strategy {strategy}")


def split_info(df: DataFrame, target: str = "y") -> DataFrame:
    """Rows and target statistics of the three splits; empty splits show zeros."""
    names = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    stats = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.avg(target).alias("target_mean"),
        F.stddev_pop(target).alias("target_std"),
        F.min(target).alias("target_min"),
        F.max(target).alias("target_max"),
    )
    return names.join(stats, "split", "left").fillna(0)


def train_val_split_rows(df: DataFrame, time: str, order: list[str], validation: float = 0.2) -> DataFrame:
    """The last rows in time become validation rows."""
    (cut,), _ = rows_at(df, order, lambda n: [n - int(n * validation)])
    return df.withColumn("split", F.when(before(df, order, cut), "train").otherwise("val"))


def train_val_split_participants(df: DataFrame, validation: float = 0.2, key: str = KEY) -> DataFrame:
    """The last participants in id order become validation participants, at least one."""
    ranked, n = sorted_index(df.select(key).distinct(), [key], "_rank")
    cut = n - max(1, int(n * validation))
    side = ranked.select(
        F.col(key).alias("_k"), F.when(F.col("_rank") < cut, "train").otherwise("val").alias("split")
    )
    return df.join(side, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def timeseries_cv_bounds(
    n: int, splits: int = 5, test_size: int | float = 0.2, gap: int = 0, max_train_size: int | None = None
) -> list[tuple[int, int, int, int, int]]:
    """(fold, train start, train end, test start, test end), ends exclusive; windows expand."""
    size = int(n * test_size) if test_size < 1 else int(test_size)
    if splits < 2 or size < 1 or n - gap - size * splits <= 0:
        raise ValueError(f"{splits} test windows of {size} rows with gap {gap} do not fit into {n} rows")
    bounds = []
    for fold in range(splits):
        start = n - (splits - fold) * size
        end = start - gap
        low = max(0, end - max_train_size) if max_train_size else 0
        bounds.append((fold + 1, low, end, start, start + size))
    return bounds


def timeseries_cv_folds(
    df: DataFrame,
    time: str,
    order: list[str],
    splits: int = 5,
    test_size: int | float = 0.2,
    gap: int = 0,
    max_train_size: int | None = None,
) -> DataFrame:
    """One row per input row, fold and role (``train`` or ``test``)."""
    def edges_of(n: int) -> list[int]:
        return sorted({p for _, *edges in timeseries_cv_bounds(n, splits, test_size, gap, max_train_size) for p in edges})

    cuts, n = rows_at(df, order, edges_of)
    bounds, positions = timeseries_cv_bounds(n, splits, test_size, gap, max_train_size), edges_of(n)
    passed = {p: ~before(df, order, row) for p, row in zip(positions, cuts)}

    def between(start: int, end: int) -> Column:
        reached = passed[start] if start else F.lit(True)
        return reached & (~passed[end] if end < n else F.lit(True))

    roles = F.array_compact(
        F.array(
            *[
                F.when(between(lo, hi), F.struct(F.lit(fold).alias("fold"), F.lit("train").alias("role")))
                .when(between(start, end), F.struct(F.lit(fold).alias("fold"), F.lit("test").alias("role")))
                for fold, lo, hi, start, end in bounds
            ]
        )
    )
    return df.withColumn("_f", F.explode(roles)).select(*df.columns, "_f.*")


def participant_cv_folds(df: DataFrame, splits: int = 5, key: str = KEY) -> DataFrame:
    """Column ``fold``: the fold in which a participant is held out (contiguous id groups)."""
    ranked, n = sorted_index(df.select(key).distinct(), [key], "_rank")
    k = min(splits, n)
    fold = F.least(F.floor(F.col("_rank") / F.lit(max(1, n // max(k, 1)))), F.lit(k - 1)) + 1
    side = ranked.select(F.col(key).alias("_k"), fold.cast("int").alias("fold"))
    return df.join(side, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def walk_forward_folds(
    df: DataFrame, time: str, order: list[str], initial: float = 0.5, step: int = 100, horizon: int = 1
) -> DataFrame:
    """Rows predicted at each step, with ``step`` number and the training end before them.

    The step of a row follows from its position, so no fold table is joined.
    """
    ranked, n = sorted_index(df, order, "_rn")
    start = int(n * initial)
    since = F.col("_rn") - F.lit(start)
    span = F.explode(F.sequence(F.greatest(F.floor((since - (horizon - 1) + (step - 1)) / step), F.lit(0)), F.floor(since / step)))
    rows = (
        ranked.filter(since >= 0)
        .filter(F.floor((since - (horizon - 1) + (step - 1)) / step) <= F.floor(since / step))
        .withColumn("_s", span)
        .withColumn("train_end", F.col("_s") * step + start)
        .filter(F.col("train_end") + horizon < n)
    )
    return rows.withColumn("step", F.col("_s") + 1).drop("_s", "_rn")


def cv_summary(fold_metrics: DataFrame, min_train: int = 0) -> DataFrame:
    """Mean and population deviation of each metric over the folds with enough training rows.

    Input: ``fold, n_train, metric, value``.
    """
    return (
        fold_metrics.filter((F.col("n_train") >= min_train) & F.col("value").isNotNull())
        .groupBy("metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.countDistinct("fold").alias("n_folds"),
        )
    )
