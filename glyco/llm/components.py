"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyco.session import write_through


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node.

    ``links`` has the long columns ``u`` and ``v``. Large-star and small-star steps alternate until the
    links are stars. Every step is a map-side combined minimum and a join of two written tables, so a
    node with very many neighbours can be split between tasks.
    """
    ends = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = write_through(ends.distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen:
            break
        seen = mark
        both = write_through(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = write_through(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = write_through(large.distinct())
        least = write_through(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_through(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
