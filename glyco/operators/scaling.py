"""Feature scaling with fitted, storable parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import moments, quantiles
from ..schema import numeric_columns

KINDS = ("standard", "minmax", "robust")
CLIP_IQR = 3.0


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


@dataclass(frozen=True)
class ColumnScale:
    """Clip bounds, fill value, and ``(x - centre) / width``."""

    low: float | None
    high: float | None
    fill: float | None
    centre: float
    width: float


@dataclass(frozen=True)
class Scaler:
    """A fitted scaler. Bounds come from the fitted data and are reused on other data."""

    kind: str
    columns: dict[str, ColumnScale]

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: list[str] | None = None,
        kind: str = "standard",
        clean: bool = True,
    ) -> "Scaler":
        """Measure the columns; each pass covers all of them."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        names = columns or numeric_columns(df)
        data = df.select(*[_finite(c).alias(c) for c in names])
        bounds: dict[str, tuple[float | None, float | None, float | None]] = {c: (None, None, None) for c in names}
        cuts = {}
        if clean or kind == "robust":
            cuts = quantiles(data, names, [0.25, 0.5, 0.75])
        if clean:
            for c, (q1, q2, q3) in cuts.items():
                if q1 is not None:
                    # The median lies inside the bounds, so clipping does not move it.
                    bounds[c] = (q1 - CLIP_IQR * (q3 - q1), q3 + CLIP_IQR * (q3 - q1), q2)
        cleaned = data.select(*[_cleaned(F.col(c), *bounds[c]).alias(c) for c in names])
        if kind in ("standard", "minmax"):
            stats = moments(cleaned, names)
            pairs = {
                c: (mean, deviation) if kind == "standard" else (low, high - low) for c, (mean, deviation, low, high) in stats.items()
            }
        else:
            after = quantiles(cleaned, names, [0.25, 0.5, 0.75]) if clean else cuts
            pairs = {c: (q[1], q[2] - q[0]) for c, q in after.items() if q[0] is not None}
        return cls(
            kind,
            {
                c: ColumnScale(*bounds[c], a, b if b else 1.0)
                for c, (a, b) in pairs.items()
                if a is not None and b is not None
            },
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Clean and scale the fitted columns present in ``df``."""
        return df.withColumns(
            {
                c: (_cleaned(_finite(c), s.low, s.high, s.fill) - s.centre) / s.width
                for c, s in self.columns.items()
                if c in df.columns
            }
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        """Back to the original scale."""
        return df.withColumns(
            {c: F.col(c) * s.width + s.centre for c, s in self.columns.items() if c in df.columns}
        )

    def params(self, spark) -> DataFrame:
        """Fitted parameters as a table."""
        rows = [(c, self.kind, s.low, s.high, s.fill, s.centre, s.width) for c, s in self.columns.items()]
        return spark.createDataFrame(
            rows,
            "column string, kind string, clip_low double, clip_high double, fill double, centre double, width double",
        )

    @classmethod
    def from_params(cls, table: DataFrame) -> "Scaler":
        """Rebuild a scaler from its stored parameter table (one row per feature)."""
        rows = table.collect()
        return cls(
            rows[0]["kind"],
            {
                r["column"]: ColumnScale(r["clip_low"], r["clip_high"], r["fill"], r["centre"], r["width"])
                for r in rows
            },
        )


def _cleaned(x: Column, low: float | None, high: float | None, fill: float | None) -> Column:
    if low is None:
        return x
    # The fill value lies within the bounds, so filling first changes nothing and reads ``x`` once.
    return F.greatest(F.least(F.coalesce(x, F.lit(fill)), F.lit(high)), F.lit(low))


def scale_clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite values to missing, clip to Q1 - 3 IQR .. Q3 + 3 IQR, fill with the median."""
    names = columns or numeric_columns(df)
    data = df.select(*[_finite(c).alias(c) for c in names])
    out = {}
    for c, (q1, q2, q3) in quantiles(data, names, [0.25, 0.5, 0.75]).items():
        if q1 is not None:
            spread = CLIP_IQR * (q3 - q1)
            out[c] = _cleaned(_finite(c), q1 - spread, q3 + spread, q2)
    return df.withColumns(out)
