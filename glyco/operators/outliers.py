"""Outlier detection and treatment.

Bounds are fitted once as numbers, so flags are plain comparisons that can be
pushed to the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.quantiles import quantiles
from ..schema import numeric_columns
from .quality import unpivot_stats

METHODS = ("iqr", "zscore", "domain_specific", "isolation_forest")
TREATMENTS = ("clip", "remove", "transform", "winsorize")

# Settings per measure when none are given.
DEFAULT_SETTINGS = {
    "CGM": {"min_value": 40, "max_value": 400, "detection_methods": ["iqr", "zscore"], "treatment_method": "clip"}
}


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Q1 - k IQR and Q3 + k IQR."""
    cuts = quantiles(df, columns, [0.25, 0.75])
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in cuts.items() if a is not None}


def zscore_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns if row[f"m_{c}"] is not None}


def _outside(c: str, low: float | None, high: float | None) -> Column:
    tests = []
    if low is not None:
        tests.append(F.col(c) < low)
    if high is not None:
        tests.append(F.col(c) > high)
    return _either(tests)


def outlier_mask(
    df: DataFrame,
    columns: list[str] | None = None,
    methods: tuple[str, ...] = ("iqr", "zscore"),
    settings: dict[str, dict] | None = None,
    k: float = 1.5,
    z: float = 3.0,
    cuts: dict[str, list] | None = None,
) -> DataFrame:
    """``outlier_<column>`` is true where any method flags the value.

    ``cuts`` may bring the first and third quartile of the columns when they are known.
    """
    columns = columns or numeric_columns(df)
    settings = settings or {}
    wanted = {c: tuple(settings.get(c, {}).get("detection_methods", methods)) for c in columns}
    unknown = {m for ms in wanted.values() for m in ms} - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    by_iqr = [c for c in columns if "iqr" in wanted[c]]
    by_z = [c for c in columns if "zscore" in wanted[c]]
    if cuts is None:
        cuts = quantiles(df, by_iqr, [0.25, 0.75]) if by_iqr else {}
    stats = zscore_stats(df, by_z) if by_z else {}
    out = {}
    for c in columns:
        own = settings.get(c, {})
        tests: list[Column] = []
        if c in by_iqr and cuts[c][0] is not None:
            a, b = cuts[c]
            width = own.get("iqr_multiplier", k) * (b - a)
            tests.append(_outside(c, a - width, b + width))
        if c in stats and stats[c][1]:
            mean, deviation = stats[c]
            tests.append(F.abs((F.col(c) - mean) / deviation) > own.get("zscore_threshold", z))
        if "domain_specific" in wanted[c]:
            tests.append(_outside(c, own.get("min_value"), own.get("max_value")))
        out[f"outlier_{c}"] = _either(tests)
    flagged = df.withColumns(out)
    for c in columns:
        if "isolation_forest" in wanted[c]:
            forest = IsolationForest.fit(df, [c])
            scored = forest.flag(flagged, "_iso", settings.get(c, {}).get("contamination", 0.1))
            flagged = scored.withColumn(f"outlier_{c}", F.col(f"outlier_{c}") | F.col("_iso")).drop("_iso")
    return flagged


def outliers_iqr(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Flags by quartile fences."""
    return outlier_mask(df, columns, ("iqr",), k=k)


def outliers_zscore(df: DataFrame, columns: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """Flags by distance from the mean in population deviations."""
    return outlier_mask(df, columns, ("zscore",), z=z)


def outliers_domain(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Flags by given limits."""
    settings = {c: {"min_value": lo, "max_value": hi} for c, (lo, hi) in limits.items()}
    return outlier_mask(df, list(limits), ("domain_specific",), settings)


def outlier_report(
    df: DataFrame, columns: list[str] | None = None, method: str = "iqr", k: float = 1.5, z: float = 3.0
) -> DataFrame:
    """Per column: flagged values, flagged rows with a value, percentages, mean, deviation, thresholds.

    ``row_outliers`` counts rows flagged by any column in which this column has a
    value; ``outliers`` counts the column's own flags.
    """
    columns = columns or numeric_columns(df)
    if method == "isolation_forest":
        flagged = IsolationForest.fit(df, columns).flag(df, "_any")
        flagged = flagged.withColumns({f"outlier_{c}": F.col("_any") for c in columns})
        fences: dict[str, tuple[float, float]] = {}
    elif method in ("iqr", "zscore"):
        flagged = outlier_mask(df, columns, (method,), k=k, z=z)
        flagged = flagged.withColumn("_any", _either([F.col(f"outlier_{c}") for c in columns]))
        fences = iqr_bounds(df, columns, k) if method == "iqr" else {}
    else:
        raise ValueError(f"unknown method {method}")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        mean, deviation = F.avg(c), F.stddev_samp(c)
        low, high = (
            tuple(F.lit(x) for x in fences[c])
            if c in fences
            else ((mean - z * deviation, mean + z * deviation) if method == "zscore" else (F.lit(None), F.lit(None)))
        )
        aggs += [
            F.count_if(F.col(f"outlier_{c}")).alias(f"own_{c}"),
            F.count_if(F.col("_any") & F.col(c).isNotNull()).alias(f"row_{c}"),
            mean.alias(f"mean_{c}"),
            deviation.alias(f"std_{c}"),
            low.cast("double").alias(f"low_{c}"),
            high.cast("double").alias(f"high_{c}"),
        ]
    row = flagged.agg(*aggs)
    row = row.withColumns(
        {f"pct_{c}": F.coalesce(F.try_divide(F.col(f"row_{c}") * 100.0, F.col("_n")), F.lit(0.0)) for c in columns}
    )
    return unpivot_stats(
        row,
        columns,
        {
            "outliers": "own_", "row_outliers": "row_", "row_percentage": "pct_", "mean": "mean_",
            "std": "std_", "threshold_low": "low_", "threshold_high": "high_",
        },
    )


def treat_outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    methods: tuple[str, ...] = ("iqr", "zscore"),
    treatment: str = "clip",
    settings: dict[str, dict] | None = None,
    keep_flags: bool = False,
) -> DataFrame:
    """Detect per column and treat the flagged values."""
    columns = columns or numeric_columns(df)
    settings = DEFAULT_SETTINGS if settings is None else settings
    wanted = {c: settings.get(c, {}).get("treatment_method", treatment) for c in columns}
    unknown = set(wanted.values()) - set(TREATMENTS)
    if unknown:
        raise ValueError(f"unknown treatments {sorted(unknown)}")
    # Quartiles for the detection and percentiles for the treatment in one pass.
    all_cuts = quantiles(df, columns, [0.25, 0.75, 0.01, 0.99])
    flagged = outlier_mask(df, columns, methods, settings, cuts={c: q[:2] for c, q in all_cuts.items()})
    tails = [c for c in columns if wanted[c] == "winsorize"]
    p = {c: q[2:] for c, q in all_cuts.items()}
    shares = {c: (settings.get(c, {}).get("lower_percentile", 0.05), settings.get(c, {}).get("upper_percentile", 0.95)) for c in tails}
    for pair in set(shares.values()):
        p.update(quantiles(df, [c for c in tails if shares[c] == pair], list(pair)))
    out = {}
    for c in columns:
        flag, own = F.col(f"outlier_{c}"), settings.get(c, {})
        if wanted[c] == "remove":
            new = F.lit(None)
        elif wanted[c] == "transform":
            new = log_or_boxcox(df, c, p[c])
        else:
            low, high = p[c]
            if wanted[c] == "clip":
                low = own.get("min_value", low)
                high = own.get("max_value", high)
            new = F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low)) if low is not None else F.col(c)
        out[c] = F.when(flag, new).otherwise(F.col(c)).cast("double")
    treated = flagged.withColumns(out)
    return treated if keep_flags else treated.drop(*[f"outlier_{c}" for c in columns])


def treatment_stats(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """Per column: flagged values, values the treatment changed, share of rows."""
    columns = columns or numeric_columns(df)
    kept = df.withColumns({f"_was_{c}": F.col(c).cast("double") for c in columns})
    treated = treat_outliers(kept, columns, keep_flags=True, **options)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        flag = F.col(f"outlier_{c}")
        aggs += [
            F.count_if(flag).alias(f"d_{c}"),
            F.count_if(flag & ~F.col(c).eqNullSafe(F.col(f"_was_{c}"))).alias(f"t_{c}"),
        ]
    row = treated.agg(*aggs)
    row = row.withColumns(
        {f"p_{c}": F.coalesce(F.try_divide(F.col(f"d_{c}") * 100.0, F.col("_n")), F.lit(0.0)) for c in columns}
    )
    return unpivot_stats(
        row, columns, {"outliers_detected": "d_", "outliers_treated": "t_", "outlier_percentage": "p_"}
    )


def boxcox_lambda(df: DataFrame, column: str, shift: float, grid: list[float] | None = None) -> float | None:
    """Lambda with the highest log-likelihood on a grid, in one aggregation pass."""
    grid = grid or [i / 20 for i in range(-40, 41)]
    x = F.col(column) + shift
    aggs = [F.count(column).alias("n"), F.sum(F.log(x)).alias("logs")]
    for i, lam in enumerate(grid):
        y = F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1.0) / lam
        aggs.append(F.var_pop(y).alias(f"v{i}"))
    row = df.filter(F.col(column).isNotNull()).agg(*aggs).first()
    best, best_fit = None, -math.inf
    for i, lam in enumerate(grid):
        v = row[f"v{i}"]
        if v:
            fit = -row["n"] / 2 * math.log(v) + (lam - 1) * row["logs"]
            if fit > best_fit:
                best, best_fit = lam, fit
    return best


def log_or_boxcox(df: DataFrame, column: str, fallback: list[float | None]) -> Column:
    """log(1 + x) of an all-positive column, else Box-Cox of x - min + 1, else a clip."""
    x = F.col(column)
    row = df.agg(
        F.min(column).alias("low"),
        F.count_if(x.isNull() | (x <= 0)).alias("bad"),
    ).first()
    if row["low"] is None:
        return x
    if row["bad"] == 0:
        return F.log1p(x)
    shift = 1.0 - row["low"]
    lam = boxcox_lambda(df, column, shift)
    if lam is None:
        low, high = fallback
        return F.greatest(F.least(x, F.lit(high)), F.lit(low))
    return F.log(x + shift) if lam == 0 else (F.pow(x + shift, F.lit(lam)) - 1.0) / lam


# --- isolation forest ----------------------------------------------------------------


def _harmonic_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, seed: int) -> list[tuple[int, int, float, int, float]]:
    """Nodes of one tree: (node, feature, cut, left child, path length at a leaf)."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[tuple[int, int, float, int, float]] = []
    open_nodes, next_id = [(0, points, 0)], 1
    while open_nodes:
        node, p, depth = open_nodes.pop()
        spread = np.flatnonzero(p.max(axis=0) > p.min(axis=0)) if len(p) > 1 else np.array([], int)
        if depth >= limit or not len(spread):
            nodes.append((node, -1, 0.0, -1, depth + _harmonic_path(len(p))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(p[:, f].min(), p[:, f].max()))
        left = p[:, f] < cut
        nodes.append((node, f, cut, next_id, 0.0))
        open_nodes += [(next_id, p[left], depth + 1), (next_id + 1, p[~left], depth + 1)]
        next_id += 2
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    """Trees grown in executors on seeded samples; the forest itself is small and broadcast."""

    columns: tuple[str, ...]
    trees: tuple[tuple[np.ndarray, ...], ...]
    sample: int

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: list[str],
        trees: int = 100,
        sample: int = 256,
        seed: int = 42,
        key: list[str] | None = None,
    ) -> "IsolationForest":
        """Grow each tree on ``sample`` complete rows of lowest hash (the method's own sampling).

        A row's hash covers the tree, the seed and ``key`` (all columns by default), so the draw does not
        depend on partitions. Only rows that a tree may take leave the scan: those whose hash is
        below a bound that all but surely leaves ``sample`` rows or more.
        """
        names = list(columns)
        ids = key or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]).alias("_row")).dropna(subset=names)
        total = rows.count()
        share = min(1.0, (sample + 10 * math.sqrt(sample) + 20) / max(total, 1))
        draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.shiftrightunsigned(F.xxhash64(t, F.col("_row")), 11).alias("rank")))
        taken = F.filter(draws, lambda x: x["rank"] <= F.lit(int(share * (1 << 53))))
        spread = rows.select(*names, F.explode(taken).alias("_d")).select("_d.*", *names)
        order = Window.partitionBy("tree").orderBy("rank", *names)
        drawn = spread.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample)

        def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(key[0])
            ordered = pdf.sort_values(names)[names].to_numpy()
            nodes = _grow(ordered, seed * 1000 + tree)
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "child", "path"])
            out.insert(0, "tree", tree)
            return out

        grown = (
            drawn.select("tree", *names)
            .groupBy("tree")
            .applyInPandas(grow, "tree int, node int, feature int, cut double, child int, path double")
            .toPandas()
        )
        packed = []
        for _, t in grown.sort_values(["tree", "node"]).groupby("tree"):
            packed.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "child", "path")))
        return cls(tuple(columns), tuple(packed), min(sample, total))

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """2 ** (-mean path / expected path) of complete rows; NULL for the others."""
        trees, expected = self.trees, _harmonic_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def isolation(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values])
            total = np.zeros(len(x))
            for feature, cut, child, path in trees:
                at = np.zeros(len(x), dtype=int)
                moving = feature[at] >= 0
                while moving.any():
                    i = np.flatnonzero(moving)
                    f = feature[at[i]]
                    right = x[i, f] >= cut[at[i]]
                    at[i] = child[at[i]] + right
                    moving[i] = feature[at[i]] >= 0
                total += path[at]
            return pd.Series(np.exp2(-(total / len(trees)) / expected))

        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.columns])
        value = isolation(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])
        return df.withColumn(name, F.when(complete, value))

    def flag(self, df: DataFrame, name: str = "is_outlier", contamination: float = 0.1) -> DataFrame:
        """True for the ``contamination`` share with the highest scores."""
        scored = self.score(df, "_score")
        cut = quantiles(scored, ["_score"], [1.0 - contamination])["_score"][0]
        return scored.withColumn(
            name, F.coalesce(F.col("_score") > F.lit(cut).cast("double"), F.lit(False))
        ).drop("_score")
