"""Seeded ranks inside groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyco.session import write_through

SHARD_ROWS = 500


def seeded_ranks(df: DataFrame, keys: list[str], ids: list[str], seed: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``rank``: the row's place (from 0) in its group, in the order of a seeded hash of ``ids``.

    A group is cut into hash ranges of about ``shard_rows`` rows. Ranges are counted first (map-side
    combined), a window over the counts gives each range its first rank, and only single ranges are
    sorted, so no task ever holds a group. Keys must not be null; rows with equal ``ids`` tie and may
    swap ranks. ``df`` is read three times: pass a written table.
    """
    # The upper 53 bits of the hash order the rows and, scaled, pick the range.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11)
    rows = df.withColumn("_place", place)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / shard_rows).alias("_shards"))
    rows = rows.join(sizes, keys).withColumn("_shard", F.floor(F.col("_place") / F.lit(float(1 << 53)) * F.col("_shards")))
    counts = rows.groupBy(*keys, "_shard").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = write_through(counts.select(*keys, "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy(*keys, "_shard").orderBy("_place", *ids)
    return (
        rows.join(firsts, [*keys, "_shard"])
        .withColumn("rank", F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_place", "_shards", "_shard", "_first")
    )


def sample_candidates(df: DataFrame, ids: list[str], n: int, seed: int) -> DataFrame:
    """The rows that may be among the ``n`` of lowest seeded hash of ``ids``, with the hash as ``place``.

    The rows are counted first; the bound on the hash all but surely leaves ``n`` rows or a few more, so what
    is sorted in the end does not grow with the table.
    """
    share = min(1.0, (n + 10 * math.sqrt(n) + 20) / max(df.count(), 1))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11)
    return df.withColumn("place", place).filter(F.col("place") <= int(share * (1 << 53)))
