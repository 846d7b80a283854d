"""Writers for sequence sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sequences(sequences: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """Parquet partitioned by ``split``, and a one-row JSON beside it."""
    sequences.write.mode("overwrite").partitionBy("split").parquet(f"{path}/sequences")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def read_sequences(spark, path: str, split: str | None = None) -> DataFrame:
    """Read a sequence set back; a split is a partition, so others are not read."""
    table = spark.read.parquet(f"{path}/sequences")
    return table.filter(F.col("split") == split) if split else table


def tidy(report: DataFrame, section: str) -> DataFrame:
    """A one-row report as ``(section, item, value)`` text rows."""
    entries = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in report.columns]
    return report.select(F.lit(section).alias("section"), F.explode(F.array(*entries)).alias("_e")).select("section", "_e.*")


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON."""
    rows.write.mode("overwrite").json(path)


def render_report(rows: DataFrame, title: str) -> str:
    """Text of a report; report rows are a handful per section."""
    lines, current = [title, "=" * len(title)], None
    for r in rows.orderBy("section", "item").collect():
        if r["section"] != current:
            current = r["section"]
            lines += ["", current, "-" * len(current)]
        lines.append(f"{r['item']}: {r['value']}")
    return "\n".join(lines) + "\n"
