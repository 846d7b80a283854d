"""Row positions over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through


def sorted_index(df: DataFrame, order: list[str], name: str = "rn") -> tuple[DataFrame, int]:
    """Position (from 0) by ``order`` and the row count.

    The table is range-sorted by all columns of ``order``: Spark draws the range bounds from the rows, so
    neither a few wrong clocks nor many rows of equal time fill one task, as long as the order is unique.
    It is written before use, which pins the partitions; the count of each partition gives the next its
    first position.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.orderBy(*[F.col(c) for c in order])
    pinned = write_through(ordered.withColumns({"_p": F.spark_partition_id(), "_i": place}))
    before_it = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    firsts = pinned.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before_it), F.lit(0)).alias("_off"))
    ranked = pinned.join(firsts, "_p").withColumn(name, F.col("_i") + F.col("_off")).drop("_p", "_i", "_off")
    return ranked, pinned.count()


def rows_at(df: DataFrame, order: list[str], positions: Callable[[int], list[int]]) -> tuple[list, int]:
    """The ``order`` values of the rows at some positions (from 0), and the row count.

    ``positions`` gets the row count. Only the columns of ``order`` are sorted. A position at or past the
    end gives ``None``.
    """
    ranked, n = sorted_index(df.select(*order), order, "_rn")
    wanted = positions(n)
    inside = sorted({p for p in wanted if 0 <= p < n})
    found = ranked.filter(F.col("_rn").isin(inside)).collect() if inside else []
    at = {r["_rn"]: tuple(r[c] for c in order) for r in found}
    return [at.get(p) for p in wanted], n


def before(df: DataFrame, order: list[str], row: tuple | None) -> Column:
    """True for rows that come before ``row`` in ``order``; no row means the end of the table."""
    if row is None:
        return F.lit(True)
    bounds = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row)]
    return F.struct(*[F.col(c) for c in order]) < F.struct(*bounds)
