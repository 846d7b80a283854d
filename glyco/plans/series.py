"""Ordered computation per series that survives one series holding most rows.

A plain ``Window.partitionBy(key)`` puts a whole series into one task. That is
the best plan while every series is small: one exchange, one sort. When a series
is larger than ``max_rows`` it is *sliced* by time, so a window runs per
``(key, slice)``, and each slice first receives copies of exactly those
neighbouring rows its frames can reach:

* ``back_span``   rows within a time span before the slice,
* ``back_rows``   the last n rows before the slice,
* ``carry_back``  the last row before the slice for which a condition holds
                  (forward fill, time since event),
* ``ahead_rows`` / ``carry_ahead`` the same after the slice.

For every row the slices that need it are listed once, so a row has at most one
copy in a slice and equal rows stay as many as they are. Copies are marked, take
part in the frames and are dropped by ``close``. The result is the same as without
slices, whatever the size of a series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY, TIME, micros
from ..session import LIMITS, limit, write_through

T_US, SLICE, COPY, WIDTH = "_t_us", "_slice", "_copy", "_width_us"


@dataclass(frozen=True)
class Layout:
    """Slice width of every series longer than ``max_rows``.

    ``hot`` has one entry per long series. At most rows/max_rows series can be
    that long, so it stays small however large the table is.
    """

    key: str = KEY
    time: str = TIME
    max_rows: int = LIMITS["spark.glyco.series.maxRows"]
    hot: tuple[tuple[object, int], ...] = ()

    @classmethod
    def fit(cls, df: DataFrame, key: str = KEY, time: str = TIME, max_rows: int | None = None) -> "Layout":
        """Count rows per series (map-side combined, two columns read) and size the slices."""
        max_rows = max_rows or limit(df.sparkSession, "spark.glyco.series.maxRows")
        t = micros(time)
        long_series = (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
            .filter(F.col("n") > max_rows)
            .collect()
        )
        if not long_series:
            return cls(key, time, max_rows)
        # Second pass over the long series only: the densest of ~32 bins per
        # wanted slice sets the width, so bursts do not overfill a slice.
        bins = [
            (r[key], max(1, (r["hi"] - r["lo"] + 1) * max_rows // (32 * r["n"])))
            for r in long_series
        ]
        widths = _local(df, bins, key, "_bin_us")
        densest = (
            df.select(key, t.alias(T_US))
            .join(widths, F.col(key).eqNullSafe(F.col("_k")))
            .groupBy("_k", "_bin_us", F.floor(F.col(T_US) / F.col("_bin_us")).alias("b"))
            .count()
            .groupBy("_k", "_bin_us")
            .agg(F.max("count").alias("m"))
            .collect()
        )
        hot = tuple((r["_k"], max(1, r["_bin_us"] * max_rows // max(r["m"], 1))) for r in densest)
        return cls(key, time, max_rows, hot)


def _local(df: DataFrame, rows: list[tuple[object, int]], key: str, value: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(rows), f"_k {kind}, {value} bigint")


class Series:
    """A frame prepared for window functions over each series in time order.

    ``window`` runs forward in time. Look ahead with ``reversed`` and a frame that
    ends at the current row: Spark evaluates a growing frame in one pass, but starts
    a frame that reaches to the end of the series again for every row.
    """

    def __init__(
        self,
        df: DataFrame,
        layout: Layout | None = None,
        *,
        key: str = KEY,
        time: str = TIME,
        back_rows: int = 0,
        back_span: int = 0,
        carry_back: list[Column] | None = None,
        ahead_rows: int = 0,
        carry_ahead: list[Column] | None = None,
        tie: list[str] | None = None,
    ):
        layout = layout or Layout.fit(df, key, time)
        self.layout = layout
        key, time = layout.key, layout.time
        # A frame that already carries its time keeps it, so that chained steps sort once.
        self._timed = T_US in df.columns
        if not self._timed:
            df = df.withColumn(T_US, micros(time))
        order = [F.col(T_US)] + [F.col(c) for c in tie or []]
        if not layout.hot:
            self.df = df
            self.window: WindowSpec = Window.partitionBy(key).orderBy(*order)
            self.reversed: WindowSpec = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
            self._sliced = False
            return
        self._sliced = True
        self._key, self._order = key, order
        sized = [(k, max(w, back_span)) for k, w in layout.hot]
        rows = df.join(_local(df, sized, key, WIDTH), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
        rows = rows.withColumn(SLICE, F.coalesce(F.floor(F.col(T_US) / F.col(WIDTH)), F.lit(0).cast("bigint")))
        sides = [(n, c or [], ahead) for n, c, ahead in ((back_rows, carry_back, False), (ahead_rows, carry_ahead, True)) if n or c]
        names = df.columns
        cold = rows.filter(F.col(WIDTH).isNull()).select(*names, SLICE, F.lit(False).alias(COPY))
        hot = self._copied(rows.filter(F.col(WIDTH).isNotNull()), names, back_span, sides)
        self.df = cold.unionByName(hot)
        self.window = Window.partitionBy(key, SLICE).orderBy(*order)
        self.reversed = Window.partitionBy(key, SLICE).orderBy(*[c.desc() for c in order])

    def _copied(self, hot: DataFrame, names: list[str], back_span: int, sides: list[tuple[int, list[Column], bool]]) -> DataFrame:
        """Each row in its own slice, and once in every other slice that needs it."""
        key, none = self._key, F.array().cast("array<bigint>")
        needed = []
        if back_span:
            # A row reaches into the next slice when the slice starts inside its span.
            reach = F.floor((F.col(T_US) + F.lit(back_span)) / F.col(WIDTH))
            needed.append(F.when(reach > F.col(SLICE), F.sequence(F.col(SLICE) + 1, reach)).otherwise(none))
        rows = hot
        for side, (n, conditions, ahead) in enumerate(sides):
            nearest = [c.asc() if ahead else c.desc() for c in self._order]
            places = {}
            if n:
                places[f"_edge{side}"] = F.row_number().over(Window.partitionBy(key, SLICE).orderBy(*nearest))
                inside = F.filter(
                    F.coalesce(f"_near{side}", F.array().cast("array<struct<s:bigint,b:bigint>>")),
                    lambda r: r["b"] - F.col(f"_passed{side}") + F.col(f"_edge{side}") <= n,
                )
                needed.append(F.when(F.col(f"_edge{side}") <= n, F.transform(inside, lambda r: r["s"])).otherwise(none))
            for i, condition in enumerate(conditions):
                met = F.coalesce(condition, F.lit(False))
                places[f"_met{side}_{i}"] = met & (F.row_number().over(Window.partitionBy(key, SLICE, met).orderBy(*nearest)) == 1)
                needed.append(F.when(F.col(f"_met{side}_{i}"), F.coalesce(f"_to{side}_{i}", none)).otherwise(none))
            plan = self._plan(hot, side, n, conditions, ahead)
            same_slice = F.col(key).eqNullSafe(F.col("_k")) & (F.col(SLICE) == F.col("_s"))
            rows = rows.withColumns(places).join(plan, same_slice, "left").drop("_k", "_s")
        copies = F.array_distinct(F.concat(*needed)) if needed else none
        own = F.struct(F.col(SLICE).alias("s"), F.lit(False).alias("c"))
        every = F.concat(F.array(own), F.transform(copies, lambda s: F.struct(s.alias("s"), F.lit(True).alias("c"))))
        return rows.withColumn("_in", F.explode(every)).select(*names, F.col("_in.s").alias(SLICE), F.col("_in.c").alias(COPY))

    def _plan(self, hot: DataFrame, side: int, n: int, conditions: list[Column], ahead: bool) -> DataFrame:
        """One row per slice: which other slices read its edge rows and its last row of each condition.

        There are about rows / ``max_rows`` slices in all.
        """
        key = self._key
        # Slices in the order in which they are met when walking towards the reader.
        walk = Window.partitionBy("_k").orderBy(F.col("_s").desc() if ahead else F.col("_s").asc())
        before = walk.rowsBetween(Window.unboundedPreceding, -1)
        slices = hot.groupBy(F.col(key).alias("_k"), F.col(SLICE).alias("_s")).agg(
            F.least(F.count(F.lit(1)), F.lit(n)).alias("_size"),
            *[F.max(F.coalesce(c, F.lit(False))).alias(f"_holds{i}") for i, c in enumerate(conditions)],
        )
        sources = {f"_from{i}": F.last(F.when(F.col(f"_holds{i}"), F.col("_s")), ignorenulls=True).over(before) for i in range(len(conditions))}
        placed = slices.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), **sources})
        out = placed.select("_k", "_s")
        if n:
            # Rows (at most n counted per slice) passed before a slice is met. The slices met within
            # reach: one, unless a slice holds fewer than n rows.
            reach = Window.partitionBy("_k").orderBy("_before").rangeBetween(1, 2 * n - 1)
            out = placed.select(
                "_k",
                "_s",
                (F.col("_before") + F.col("_size")).alias(f"_passed{side}"),
                F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_before").alias("b"))).over(reach).alias(f"_near{side}"),
            )
        for i in range(len(conditions)):
            readers = (
                placed.filter(F.col(f"_from{i}").isNotNull())
                .groupBy(F.col("_k").alias("_rk"), F.col(f"_from{i}").alias("_rs"))
                .agg(F.collect_list("_s").alias(f"_to{side}_{i}"))
            )
            out = out.join(readers, F.col("_k").eqNullSafe(F.col("_rk")) & (F.col("_s") == F.col("_rs")), "left").drop("_rk", "_rs")
        return out

    def close(self, df: DataFrame, *drop: str) -> DataFrame:
        """Drop the copies and the helper columns."""
        if self._sliced:
            df = df.filter(~F.col(COPY))
        return df.drop(SLICE, COPY, *([] if self._timed else [T_US]), *drop)


def settle(df: DataFrame, layout: Layout) -> DataFrame:
    """Write an intermediate table to the checkpoint folder when series are sliced.

    A sliced step reads its input several times, so a chain of them would repeat the
    earlier steps over and over. Without slices nothing is written.
    """
    return write_through(df) if layout.hot else df


def row_index(df: DataFrame, layout: Layout | None = None, name: str = "rn", **names: str) -> DataFrame:
    """Position (from 1) of every row in its series."""
    s = Series(df, layout, **names)
    local = F.row_number().over(s.window).cast("bigint")
    if not s._sliced:
        return s.close(s.df.withColumn(name, local))
    key = s.layout.key
    offsets = (
        s.df.groupBy(F.col(key).alias("_k"), F.col(SLICE).alias("_s"))
        .count()
        .withColumn(
            "_off",
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("count")
    )
    out = (
        s.df.withColumn(name, local)
        .join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col(SLICE) == F.col("_s")))
        .withColumn(name, F.col(name) + F.col("_off"))
    )
    return s.close(out, "_k", "_s", "_off")
