"""Distinct counts that roll up: one HyperLogLog sketch per group, merged without reading rows again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def relative_error(lg_k: int = LG_K) -> float:
    """One standard error of an estimate; counts that a sketch still lists one by one are exact."""
    return 1.04 / math.sqrt(2**lg_k)


def distinct_sketches(df: DataFrame, column: str, by: dict[str, Column], lg_k: int = LG_K) -> DataFrame:
    """One row per group with the ``sketch`` of the distinct non-null values of ``column``.

    Sketches of at most 2**lg_k bytes are built map-side; keep the table and merge it with ``roll_up``.
    """
    value = F.col(column)
    # The sketch takes whole numbers, text and bytes.
    kind = df.schema[column].dataType.typeName()
    plain = value if kind in ("byte", "short", "integer", "long", "string", "binary") else value.cast("string")
    return df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.hll_sketch_agg(plain, lg_k).alias("sketch"))


def roll_up(sketches: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """Merge sketches into coarser groups (all of them without ``by``)."""
    merged = F.hll_union_agg("sketch").alias("sketch")
    return sketches.groupBy(*[c.alias(n) for n, c in by.items()]).agg(merged) if by else sketches.agg(merged)


def estimates(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    """Replace the sketch by its count."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
