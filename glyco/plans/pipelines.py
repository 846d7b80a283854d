"""Compositions of operators: validation, preprocessing, feature and sequence sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.clean import clean
from ..operators.impute import impute
from ..operators.outliers import outlier_report, treat_outliers
from ..operators.quality import quality_report, validate_schema
from ..operators.resample import resample, resample_by_name
from ..operators.scaling import Scaler
from ..operators.sequences import sliding_sequences
from ..operators.splits import split
from ..schema import KEY, MEASURES, TARGET, TIME
from ..session import write_through
from .series import Layout, settle


def validate_dataset(df: DataFrame, method: str = "iqr", *, layout: Layout | None = None) -> DataFrame:
    """Schema, quality and outlier findings as ``(report, section, item, value)``."""
    numeric = [c for c in MEASURES if c in df.columns]
    schema = validate_schema(df).select(
        F.lit("schema").alias("report"), F.col("severity").alias("section"), F.col("column").alias("item"), F.lit(1.0).alias("value")
    )
    quality = quality_report(df, layout=layout).select(F.lit("quality").alias("report"), "section", "item", "value")
    outliers = outlier_report(df, numeric, method).select(
        F.lit("outliers").alias("report"), F.lit(method).alias("section"), F.col("column").alias("item"), F.col("outliers").cast("double").alias("value")
    )
    return schema.unionByName(quality).unionByName(outliers)


def preprocess(
    df: DataFrame,
    freq: str = "5 minutes",
    keep: str = "last",
    tolerance: str = "60 seconds",
    strategies: dict[str, str] | None = None,
    methods: tuple[str, ...] = ("iqr", "zscore"),
    treatment: str = "clip",
    settings: dict[str, dict] | None = None,
    *,
    layout: Layout | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """Clean, impute, treat outliers, resample.

    Fill values and outlier bounds are measured in several passes, so the cleaned and
    the filled tables are written through the checkpoint folder.
    """
    layout = layout or Layout.fit(df)
    cleaned = write_through(clean(df, keep, tolerance, layout=layout, tie=tie))
    filled = write_through(impute(cleaned, strategies, layout=layout))
    measures = [c for c in MEASURES if c in df.columns]
    treated = treat_outliers(filled, measures, methods, treatment, settings)
    return resample(treated, freq)


def engineer_features(
    df: DataFrame,
    kind: str = "standard",
    scaler: Scaler | None = None,
    *,
    layout: Layout | None = None,
) -> tuple[DataFrame, Scaler]:
    """The 54 features, scaled; give a fitted ``scaler`` to treat new data like the training data.

    Fitting reads the features several times, so they are written through the
    checkpoint folder instead of being computed for every pass.
    """
    layout = layout or Layout.fit(df)
    features = X.all_features(df.filter(F.col(TIME).isNotNull()), layout=layout)
    if scaler is None:
        features = write_through(features)
        scaler = Scaler.fit(features, X.ALL_FEATURES, kind)
    return scaler.transform(features), scaler


def sequence_dataset(
    df: DataFrame,
    features: list[str],
    freq: str = "5 minutes",
    max_gap: str = "30 minutes",
    steps: int = 12,
    horizon: int = 1,
    strategy: str = "participant",
    target: str = TARGET,
    layout: Layout | None = None,
    **options,
) -> DataFrame:
    """Resample by name, build valid sequences, assign splits; ``layout`` is that of the resampled series."""
    wanted = list(dict.fromkeys([KEY, TIME, *features, target]))
    regular = resample_by_name(df.select(*wanted), freq, max_gap)
    # The grid adds rows to sparse series, so its layout is measured on the grid.
    grid = layout or Layout.fit(regular)
    sequences = sliding_sequences(settle(regular, grid), features, target, steps, horizon, layout=grid)
    if strategy == "temporal":
        options = {"time": "seq_end", "order": ["seq_end", KEY], **options}
    return split(sequences, strategy, **options)
