"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyco.llm.exact import solid
from glyco.llm.ranks import seeded_ranks
from glyco.llm.text import word_count
from glyco.session import write_through

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a document may be taken
SEED = 42
WINDOW = 1 << 16  # words that the dynamic programme fits exactly


def fit_lengths(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take so that the words come closest to ``budget`` from below.

    Every length first gives its proportional share, rounded down; lengths then give one more each,
    the longest first, until the rest is at most ``window``. A bounded knapsack over the documents still
    left (powers of two per length, reachable sums as the bits of one integer) fits that rest.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    budget = min(budget, total)
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if rest <= window:
            break
        if 0 < lengths[i] <= rest and take[i] < counts[i]:
            take[i] += 1
            rest -= lengths[i]
    # reach[k]: sums that the first k bundles can make.
    mask, reach, bundles = (1 << (rest + 1)) - 1, [1], []
    for i in order:
        left, size = min(counts[i] - take[i], rest // lengths[i] if lengths[i] else 0), 1
        while left > 0 and not reach[-1] >> rest & 1:
            size = min(size, left)
            reach.append((reach[-1] | reach[-1] << (size * lengths[i])) & mask)
            bundles.append((i, size))
            left, size = left - size, size * 2
    at = reach[-1].bit_length() - 1
    for (i, size), before in zip(reversed(bundles), reversed(reach[:-1])):
        if not before >> at & 1:
            take[i] += size
            at -= size * lengths[i]
    return take


def targets(histogram: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target words of each source: (source, place, source_size, target).

    Sources in code-point order, null last, get the weights in turn. A target stops at ``most`` times the
    source; what is above is shared again by weight. In order of cap / weight the capped sources come
    first, so running sums find the level. One row per source passes through these windows.
    """
    every = Window.partitionBy(F.lit(0))
    # The level is sought in order of cap / weight.
    by_ratio = every.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sources.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("place") % len(weights) + 1)
    caps = named.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    goal = F.sum("source_size").over(every) * float(share)
    capped_before = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    levels = caps.withColumn("level", (goal - capped_before) / weight_left)
    free = F.col("ratio") > F.col("level")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.struct("ratio", "place"))).over(every)
    return levels.select("source", "place", "source_size", F.when(free, level * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Documents are counted by source and exact length; per source (one small table of lengths) the budget
    is fitted, and inside each length the documents of lowest seeded rank are taken. If a target exceeds
    its source, every document is taken once and the budget is for second copies. Null text has size 0;
    a null source is a source of its own; repeated rows are separate documents; an empty table gives
    no rows. Other columns are ignored.
    """
    sizes = write_through(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    histogram = write_through(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = write_through(targets(histogram, weights, share, most))
    lengths = histogram.join(goal, histogram["source"].eqNullSafe(goal["source"])).drop(goal["source"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows["source_size"].iloc[0]), round(float(rows["target"].iloc[0]))
        whole = target // size if size else 0
        more = fit_lengths(rows["size"].tolist(), rows["n"].tolist(), target - whole * size)
        return rows.assign(whole=whole, more=more)

    fields = "source string, size long, n long, place int, source_size long, target double, whole long, more long"
    plan = write_through(lengths.groupBy("place").applyInPandas(fit, fields))
    same = sizes["source"].eqNullSafe(plan["source"]) & (sizes["size"] == plan["size"])
    planned = write_through(sizes.join(plan, same).drop(plan["source"], plan["size"]))
    # A length taken wholly or not at all needs no ranks.
    cut = F.col("more").between(1, F.col("n") - 1)
    ranked = seeded_ranks(planned.filter(cut), ["place", "size"], ["doc_id"], seed)
    rows = ranked.unionByName(planned.filter(~cut).withColumn("rank", F.lit(0).cast("long")))
    taken = F.col("size") * (F.col("whole") + (F.col("rank") < F.col("more")).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with their columns.

    A document without words is taken once if any word of its source is taken. Rows that share a doc_id,
    source and size are told apart by their order, so each is drawn by a decision of its own.
    """
    told = mix(docs, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.greatest(F.col("size"), F.lit(1))).otherwise((F.col("target") > 0).cast("int")).cast("int")
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    # Repeated rows of a key are drawn together, their copies summed and dealt in turn.
    key = ["_id", "_source", "_size"]
    named = told.select(solid(F.col("doc_id")).alias("_id"), source.alias("_source"), F.col("size").alias("_size"), times.alias("times"))
    drawn = write_through(named.groupBy(*key).agg(F.sum("times").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"))
    marked = docs.withColumns({"_id": solid(F.col("doc_id")), "_source": source, "_size": word_count(F.col("text"))})
    # Merged at any size: the window needs the same partitions, so the texts move once.
    joined = marked.join(drawn.hint("merge"), key)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("text")) - 1
    own = F.floor(F.col("_copies") / F.col("_rows")) + (place < F.col("_copies") % F.col("_rows")).cast("int")
    dealt = joined.withColumn("_own", own.cast("int")).filter("_own > 0")
    return dealt.withColumn("_take", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(*docs.columns)
