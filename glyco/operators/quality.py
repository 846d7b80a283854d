"""Profiles, schema checks and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.quantiles import quantiles
from ..plans.series import Layout, Series, row_index, settle
from ..schema import CORE, KEY, TIME, VALUE_RANGES, numeric_columns


def unpivot_stats(row: DataFrame, columns: list[str], stats: dict[str, str], name: str = "column") -> DataFrame:
    """One wide row -> one row per source column; ``stats`` maps output name to column prefix."""
    entries = [
        F.struct(F.lit(c).alias(name), *[F.col(f"{prefix}{c}").alias(out) for out, prefix in stats.items()])
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("_r")).select("_r.*")


def validate_schema(df: DataFrame, expected: T.StructType = CORE) -> DataFrame:
    """Missing, extra and mistyped columns as rows; looks at the schema only."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for f in expected.fields:
        if f.name not in actual:
            rows.append(("error", f.name, f"missing column, expected {f.dataType.simpleString()}"))
        else:
            have = actual[f.name]
            both_numeric = isinstance(have, T.NumericType) and isinstance(f.dataType, T.NumericType)
            if have != f.dataType and not both_numeric:
                rows.append(
                    ("warning", f.name, f"{have.simpleString()} instead of {f.dataType.simpleString()}")
                )
    known = set(expected.fieldNames())
    rows += [("warning", c, "extra column") for c in df.columns if c not in known]
    return df.sparkSession.createDataFrame(rows, "severity string, column string, message string")


def type_stats(df: DataFrame) -> DataFrame:
    """Column and type."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def range_check(df: DataFrame, ranges: dict[str, tuple[float, float]] = VALUE_RANGES) -> DataFrame:
    """Minimum, maximum and number of values outside the allowed range, per measure."""
    columns = [c for c in ranges if c in df.columns]
    aggs: list[Column] = []
    for c in columns:
        lo, hi = ranges[c]
        aggs += [
            F.min(c).alias(f"lo_{c}"),
            F.max(c).alias(f"hi_{c}"),
            F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"n_{c}"),
        ]
    out = unpivot_stats(
        df.agg(*aggs), columns, {"min_value": "lo_", "max_value": "hi_", "out_of_range": "n_"}
    )
    return out.withColumn("within_range", F.col("out_of_range") == 0)


def missing_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count and percentage of missing values per column, one pass."""
    columns = columns or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c_{c}") for c in columns])
    entries = [
        F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"c_{c}")).alias("missing")) for c in columns
    ]
    return row.select("_n", F.explode(F.array(*entries)).alias("_r")).select(
        "_r.*",
        F.coalesce(F.try_divide(F.col("_r.missing") * 100.0, F.col("_n")), F.lit(0.0)).alias("percentage"),
    )


def longest_null_run(
    df: DataFrame, columns: list[str] | None = None, *, layout: Layout | None = None
) -> DataFrame:
    """Longest run of consecutive missing values per column, within a series.

    A run is the distance between neighbouring present values, so no run is
    gathered: each missing row looks back to the last present row.
    """
    columns = columns or numeric_columns(df)
    layout = layout or Layout.fit(df)
    ranked = settle(row_index(df.select(KEY, TIME, *columns), layout), layout)
    s = Series(ranked, layout, carry_back=[F.col(c).isNotNull() for c in columns])
    before = s.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = s.df.withColumns(
        {
            f"run_{c}": F.when(
                F.col(c).isNull(),
                F.col("rn") - F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col("rn")), True).over(before), F.lit(0)),
            )
            for c in columns
        }
    )
    row = s.close(runs).agg(*[F.coalesce(F.max(f"run_{c}"), F.lit(0)).alias(f"m_{c}") for c in columns])
    return unpivot_stats(row, columns, {"longest_run": "m_"})


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean, sample deviation and quartiles per numeric column."""
    columns = columns or numeric_columns(df)
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs = []
    for c in columns:
        q25, q50, q75 = cuts[c]
        aggs += [
            F.min(F.col(c).cast("double")).alias(f"min_{c}"),
            F.max(F.col(c).cast("double")).alias(f"max_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            F.lit(q25).cast("double").alias(f"q25_{c}"),
            F.lit(q50).cast("double").alias(f"q50_{c}"),
            F.lit(q75).cast("double").alias(f"q75_{c}"),
        ]
    return unpivot_stats(
        df.agg(*aggs),
        columns,
        {"min": "min_", "max": "max_", "mean": "mean_", "std": "std_", "median": "q50_", "q25": "q25_", "q75": "q75_"},
    )


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row (NULL equals NULL)."""
    groups = df.groupBy(*(columns or df.columns)).count()
    return groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """100, less up to 50 for missing values and up to 20 for duplicates."""
    missing = missing_stats(df).agg(F.avg("percentage").alias("avg_missing"))
    # Two one-row tables side by side.
    both = missing.join(duplicate_count(df))
    penalty = F.least("avg_missing", F.lit(50.0)) + F.least(
        F.coalesce(F.try_divide(F.col("duplicates") * 200.0, F.col("records")), F.lit(0.0)), F.lit(20.0)
    )
    score = F.when(F.col("records") == 0, 0.0).otherwise(F.greatest(100.0 - penalty, F.lit(0.0)))
    return both.select("records", "duplicates", "avg_missing", score.alias("quality_score"))


def quality_recommendations(df: DataFrame) -> DataFrame:
    """Rule texts that apply to the table."""
    high = missing_stats(df).filter(F.col("percentage") > 20).select(
        F.lit("missing_values").alias("rule"),
        F.concat(F.lit("impute "), "column", F.lit(": more than 20% missing")).alias("message"),
    )
    score = quality_score(df)
    dups = score.filter(F.col("duplicates") > 0).select(
        F.lit("duplicates").alias("rule"),
        F.concat(F.lit("remove "), F.col("duplicates").cast("string"), F.lit(" duplicate records")).alias("message"),
    )
    low = score.filter(F.col("quality_score") < 70).select(
        F.lit("low_score").alias("rule"), F.lit("clean the data: quality score below 70").alias("message")
    )
    return high.unionByName(dups).unionByName(low)


def quality_report(df: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """All quality results as ``(section, item, value)`` rows."""
    numeric = numeric_columns(df)
    missing = missing_stats(df).select(
        F.lit("missing_percentage").alias("section"), F.col("column").alias("item"), F.col("percentage").alias("value")
    )
    runs = longest_null_run(df, numeric, layout=layout).select(
        F.lit("longest_null_run").alias("section"),
        F.col("column").alias("item"),
        F.col("longest_run").cast("double").alias("value"),
    )
    profile = numeric_profile(df, numeric)
    stats = ["min", "max", "mean", "std", "median", "q25", "q75"]
    values = profile.select(
        F.col("column"), F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in stats]), F.array(*stats))).alias("stat", "value")
    ).select(
        F.lit("profile").alias("section"), F.concat_ws(".", "column", "stat").alias("item"), "value"
    )
    score = quality_score(df)
    totals = score.select(
        F.explode(
            F.create_map(
                F.lit("records"), F.col("records").cast("double"),
                F.lit("duplicates"), F.col("duplicates").cast("double"),
                F.lit("quality_score"), F.col("quality_score"),
            )
        ).alias("item", "value")
    ).select(F.lit("total").alias("section"), "item", "value")
    return missing.unionByName(runs).unionByName(values).unionByName(totals)


def low_coverage_columns(df: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Columns filled in fewer than ``threshold`` percent of the rows."""
    return (
        missing_stats(df)
        .withColumn("coverage", 100.0 - F.col("percentage"))
        .filter(F.col("coverage") < threshold)
        .select("column", "coverage")
    )


def null_fraction(df: DataFrame) -> DataFrame:
    """Fraction missing per column, highest first."""
    return missing_stats(df).select("column", (F.col("percentage") / 100.0).alias("null_frac")).orderBy(
        F.desc("null_frac"), "column"
    )
