"""Exact, linearly interpolated quantiles by radix selection.

Doubles map to whole numbers of the same order. A pass counts, for every column at once, the leading 16 bits of
the values that are still wanted; the bucket of each wanted rank is entered by the next pass, and once few
values are left their exact counts end it. Every task adds up its counts before the shuffle, and buckets are
chosen by a window over at most 65,536 counts, so neither a large column nor a common value meets in one task. There
are four passes at most, each with one scan of the input, however many columns and probabilities there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import limit

GROUP_ROWS = "spark.glyco.quantiles.groupRows"
CELLS = "spark.glyco.quantiles.cells"
DIGIT = 16
LOW_BITS = np.int64(0x7FFFFFFFFFFFFFFF)
COUNTS = "col int, at long, n long, low long, high long"


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    test = F.lit(True)
    for a, b in zip(left, right):
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table with a row per group; Spark broadcasts it when it is small."""
    other = [f"_b{i}" for i in range(len(keys))]
    values = [c for c in table.columns if c not in keys]
    renamed = table.select(*[F.col(k).alias(o) for k, o in zip(keys, other)], *values)
    return rows.join(renamed, same(keys, other), how).drop(*other)


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one value and NaN is the largest."""
    plain = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = plain.view(np.int64)
    return np.where(bits >= 0, bits, bits ^ LOW_BITS)


def value_of(number: int) -> float:
    """The double of an ordered whole number."""
    bits = np.int64(number)
    return float((bits if bits >= 0 else bits ^ LOW_BITS).view(np.float64))


Cells = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def _wide(names: list[str]) -> Cells:
    """Cells of columns ``_0, _1, ...``, one per name."""

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(names)):
            yield i, batch[f"_{i}"].drop_null().to_numpy(zero_copy_only=False).astype(np.float64)

    return cells


def _long(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Cells of (``_g``, ``_v``) rows."""
    groups, values = batch["_g"].to_numpy(), batch["_v"].to_numpy(zero_copy_only=False)
    order = np.argsort(groups, kind="stable")
    groups, values = groups[order], values[order]
    for at in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(groups)) + 1):
        if len(at):
            yield int(groups[at[0]]), values[at]


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bits, values, least and largest of them


def _counted(rows: DataFrame, cells: Cells, open_at: dict[int, list[int]], shift: int, next_shift: int) -> DataFrame:
    """``col, at, n, low, high``: values by their bits above ``next_shift``, of those whose bits above ``shift`` are open.

    ``shift`` 64 opens everything.
    """
    opened = {c: np.array(sorted(prefixes), np.int64) for c, prefixes in open_at.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[Counts]] = {}
        for batch in batches:
            for c, values in cells(batch):
                if c not in opened or not len(values):
                    continue
                numbers = ordered(values)
                if shift < 64:
                    prefix, mine = numbers >> shift, opened[c]
                    numbers = numbers[mine[np.minimum(np.searchsorted(mine, prefix), len(mine) - 1)] == prefix]
                if len(numbers):
                    numbers = np.sort(numbers)
                    found.setdefault(c, []).append(_added(numbers >> next_shift, np.ones(len(numbers), np.int64), numbers, numbers))
                    if len(found[c]) == 64:
                        found[c] = [_joined(found[c])]
        for c, parts in found.items():
            at, n, low, high = _joined(parts)
            yield pa.RecordBatch.from_pydict({"col": pa.array(np.full(len(at), c, np.int32)), "at": at, "n": n, "low": low, "high": high})

    return rows.mapInArrow(count, COUNTS).groupBy("col", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _added(at: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> Counts:
    """Rows of equal bits, which follow each other, as one."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return at[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _joined(parts: list[Counts]) -> Counts:
    if len(parts) == 1:
        return parts[0]
    at, n, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    return _added(at[order], n[order], low[order], high[order])


def select(rows: DataFrame, cells: Cells, columns: int, probs: list[float], most: int) -> dict[int, list[float]]:
    """Quantiles of every column of cells that has values. The first pass also counts the values."""
    spark = rows.sparkSession
    counts = _counted(rows, cells, {c: [0] for c in range(columns)}, 64, 64 - DIGIT)
    whole = Window.partitionBy("col")
    seen = counts.withColumns({"end": F.sum("n").over(whole.orderBy("at")), "size": F.sum("n").over(whole)})
    each = F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probs)]))
    place = F.col("p") * (F.col("size") - 1)
    asked = seen.withColumn("p", each).withColumn("r", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    began = F.col("end") - F.col("n")
    first = asked.filter((F.col("r") < F.col("end")) & (F.col("r") >= began))
    picked = first.select(F.col("col").alias("c"), "r", "at", "n", "low", "high", (F.col("r") - began).alias("k"), "size").collect()
    sizes = {x["c"]: x["size"] for x in picked}
    done: dict[tuple[int, int], float] = {}
    shift = 64 - DIGIT
    while True:
        # A bucket of one value, however often it occurs, is settled.
        done |= {(x["c"], x["r"]): value_of(x["low"]) for x in picked if x["low"] == x["high"]}
        # Every other wanted rank: its open prefix and its rank among the values with that prefix.
        state = {(x["c"], x["r"]): (x["at"], x["k"]) for x in picked if x["low"] < x["high"]}
        if not state:
            return {c: _interpolated(done, c, n, probs) for c, n in sizes.items()}
        left = {(x["c"], x["at"]): x["n"] for x in picked if x["low"] < x["high"]}
        next_shift = 0 if sum(left.values()) <= most else shift - DIGIT
        open_at: dict[int, list[int]] = {}
        for c, prefix in left:
            open_at.setdefault(c, []).append(prefix)
        bucket = Window.partitionBy("col", "parent").orderBy("at")
        inner = _counted(rows, cells, open_at, shift, next_shift).withColumn("parent", F.shiftright("at", shift - next_shift))
        seen = inner.withColumn("end", F.sum("n").over(bucket))
        wanted = [(c, p, r, k) for (c, r), (p, k) in state.items()]
        asked = spark.createDataFrame(pa.table({name: pa.array(v, pa.int64()) for name, v in zip("cprk", zip(*wanted))}))
        hit = (F.col("col") == F.col("c")) & (F.col("parent") == F.col("p")) & (F.col("k") < F.col("end")) & (F.col("k") >= began)
        picked = seen.join(asked, hit).select("c", "r", "at", "n", "low", "high", (F.col("k") - began).alias("k")).collect()
        shift = next_shift


def _interpolated(found: dict[tuple[int, int], float], c: int, n: int, probs: list[float]) -> list[float]:
    out = []
    for p in probs:
        at = p * (n - 1)
        low, high = int(np.floor(at)), int(np.ceil(at))
        a, b = found[c, low], found[c, high]
        out.append(a if a == b or low == high else (high - at) * a + (at - low) * b)
    return out


def group_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], most: int | None = None
) -> DataFrame:
    """``by`` columns and ``quantiles array<double>`` in the order of ``probs``.

    Groups of up to ``most`` rows take Spark's exact percentile. There are at most rows / ``most`` larger groups; they
    are selected side by side.
    """
    most = most or limit(df.sparkSession, GROUP_ROWS)
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    exact = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("quantiles")
    sizes = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > most).collect()
    if not large:
        return data.groupBy(*by).agg(exact)
    fields = [df.schema[c] for c in by]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    named = df.sparkSession.createDataFrame([(*r[: len(by)], i) for i, r in enumerate(large)], f"{kinds}, _g int")
    marked = _lookup(data, named, by, "left")
    found = select(marked.filter("_g is not null").select("_g", "_v"), _long, len(large), probs, most)
    picked = [(*r[: len(by)], found[i]) for i, r in enumerate(large)]
    small = marked.filter("_g is null").groupBy(*by).agg(exact)
    return small.unionByName(df.sparkSession.createDataFrame(picked, f"{kinds}, quantiles array<double>"))


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], most: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns as plain numbers (a fit, like ``approxQuantile``).

    One pass counts the values; up to ``most`` values in all wanted buckets are then counted exactly, more are
    narrowed by 16 bits a pass first. ``df`` is scanned once per pass: write a table that is costly to compute.
    """
    most = most or limit(df.sparkSession, CELLS)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    found = select(rows, _wide(columns), len(columns), probs, most) if columns and probs else {}
    return {c: found.get(i, [None] * len(probs)) for i, c in enumerate(columns)}


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float, float]]:
    """Mean, population deviation, least and largest value of every column that has values, in one pass.

    Tasks keep a count, a mean and a sum of squared distances per column, which are merged pairwise.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[float]] = {}
        for batch in batches:
            for c, v in _wide(columns)(batch):
                if len(v):
                    part = [float(len(v)), v.mean(), ((v - v.mean()) ** 2).sum(), v.min(), v.max()]
                    kept[c] = merged(kept[c], part) if c in kept else part
        if kept:
            rows = list(zip(*[[c, *p] for c, p in kept.items()]))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "col" else pa.float64()) for k, v in zip(("col", "n", "mean", "m2", "low", "high"), rows)})

    def merged(a: list[float], b: list[float]) -> list[float]:
        n, d = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4])]

    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(measure, "col int, n double, mean double, m2 double, low double, high double")
    start = F.struct(*[F.lit(x).alias(k) for k, x in (("n", 0.0), ("mean", 0.0), ("m2", 0.0))])

    def join(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    # One entry per task and column.
    entries = F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))
    out = parts.groupBy("col").agg(F.aggregate(entries, start, join).alias("t"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {columns[r["col"]]: (r["t"]["mean"], (r["t"]["m2"] / r["t"]["n"]) ** 0.5, r["low"], r["high"]) for r in out.collect()}
