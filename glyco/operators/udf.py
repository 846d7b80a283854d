"""User functions over partitions, participants and files, all on Arrow batches."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEY
from ..sources.handles import listing, stream_files


def apply_partitions(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``func`` over batches of rows; a failing batch fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield func(batch)

    return df.mapInPandas(run, schema)


def apply_per_participant(
    df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None
) -> DataFrame:
    """``func`` over each group, held in memory by one worker.

    Give ``by`` a finer grain than the participant (say participant and day) when a
    series may be large; the built-in operators of this library need no such care.

    Sorted rows reach Python in batches of many groups, so that a small group costs a slice
    of a batch and no exchange of its own.
    """
    keys = by or [KEY]
    # Whole numbers and booleans stay what they are in groups without missing values, so these travel apart.
    whole = [f for f in df.schema.fields if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    held = {f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(0).cast(f.dataType)) for f in whole}
    columns = [held.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    missing = [F.col(f"`{f.name}`").isNull().alias(f"_missing_{i}") for i, f in enumerate(whole)]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1
    names, gaps = df.columns, [(f"_missing_{i}", f.name, object if isinstance(f.dataType, T.BooleanType) else float) for i, f in enumerate(whole)]

    def applied(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """``func`` of the groups that begin at ``starts``; results of equal types leave together."""
        inner, gappy = rows[names], [(rows[m].to_numpy(), c, kind) for m, c, kind in gaps if rows[m].any()]
        kept, kinds = [], None
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            group = inner.iloc[a:b].reset_index(drop=True)
            for gap, c, kind in gappy:
                if gap[a:b].any():
                    group[c] = group[c].astype(kind).mask(gap[a:b], None if kind is object else np.nan)
            out = func(group)
            if not len(out):
                continue
            shape = [*zip(out.columns, out.dtypes)]
            if shape != kinds and kept:
                yield pd.concat(kept, ignore_index=True)
                kept = []
            kept.append(out)
            kinds = shape
        if kept:
            yield pd.concat(kept, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: list[pd.DataFrame] = []  # the last group may go on in the next batch
        for batch in batches:
            starts = np.flatnonzero(batch["_first"].to_numpy())
            if len(starts):
                cut = starts[-1]
                whole_groups = pd.concat([*open_group, batch.iloc[:cut]], ignore_index=True) if open_group else batch.iloc[:cut]
                if len(whole_groups):
                    yield from applied(whole_groups, np.flatnonzero(whole_groups["_first"].to_numpy()))
                open_group = [batch.iloc[cut:]]
            elif len(batch):
                open_group.append(batch)
        if open_group:
            yield from applied(pd.concat(open_group, ignore_index=True), np.zeros(1, int))

    # The window leaves the rows of a group next to each other.
    return df.select("*", *missing, first.alias("_first")).select(*columns, *[m for m, *_ in gaps], "_first").mapInPandas(run, schema)


def map_files(
    spark, path: str, func: Callable[[str, bytes], pd.DataFrame], schema: str, pattern: str = "*"
) -> DataFrame:
    """``func(path, content)`` per file below ``path``; the task that runs it reads the file.

    For files larger than a worker's memory use ``map_file_streams``.
    """
    return stream_files(listing(spark, path, pattern), lambda name, stream: iter([func(name, stream.read())]), schema)


def map_file_streams(
    spark, path: str, func: Callable[[str, BinaryIO], Iterator[pd.DataFrame]], schema: str, pattern: str = "*"
) -> DataFrame:
    """``func(path, stream)`` per file below ``path``, yielding tables while it reads."""
    return stream_files(listing(spark, path, pattern), func, schema)


# Python's own folds, by their vectorised forms.
VECTORISED = {max: np.maximum, min: np.minimum, operator.add: np.add, operator.mul: np.multiply}
Fold = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _fold(values: np.ndarray, reduce_func: Fold) -> float:
    """Fold an array: a ufunc reduces it, any other function of two arrays folds its halves upon each other."""
    if isinstance(reduce_func, np.ufunc):
        return float(reduce_func.reduce(values))
    while len(values) > 1:
        half = len(values) // 2
        rest = values[2 * half :]
        values = np.concatenate([np.asarray(reduce_func(values[:half], values[half : 2 * half]), float), rest])
    return float(values[0])


def map_reduce(
    df: DataFrame,
    map_func: Callable[[pd.DataFrame], pd.Series],
    reduce_func: Fold,
    fan_in: int = 256,
) -> DataFrame:
    """Map rows to numbers and fold them pairwise in a tree. Output: one row ``result``, none for an empty table.

    ``reduce_func`` is a NumPy ufunc or takes two arrays, element by element, and must be associative and
    commutative; ``max``, ``min`` and the operators for sum and product stand for their ufuncs. NULLs are left out. Each
    batch is folded as an array, each task leaves one number, and each of the next levels folds ``fan_in`` of
    them per group, so no task gets all of them.
    """
    fold = VECTORISED.get(reduce_func, reduce_func)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, kept = TaskContext.get().partitionId(), []
        for batch in batches:
            values = map_func(batch).astype(float).dropna().to_numpy()
            if len(values):
                kept.append(_fold(values, fold))
            if len(kept) == fan_in:
                kept = [_fold(np.array(kept), fold)]
        if kept:
            yield pd.DataFrame({"at": [task], "v": [_fold(np.array(kept), fold)]})

    def level(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "v": [_fold(group["v"].to_numpy(), fold)]})

    out = df.mapInPandas(mapped, "at long, v double")
    # Task numbers are whole and below 2**31: so many levels leave one group.
    for _ in range(math.ceil(31 / math.log2(fan_in))):
        out = out.groupBy(F.floor(F.col("at") / fan_in).alias("at")).applyInPandas(level, "at long, v double")
    return out.select(F.col("v").alias("result"))
