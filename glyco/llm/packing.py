"""Packing into length buckets whose boundaries minimise padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyco.llm.ranks import seeded_ranks
from glyco.llm.text import word_count
from glyco.session import write_through

MAX_LENGTH = 2048  # tokens of a sequence; also bounds the histogram and the dynamic programme
BUCKETS = 16
BATCH_TOKENS = 65_536
SEED = 42


def best_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` boundaries, the last the longest length, with the least total padding.

    cost(i, j) pads lengths i to j to length j; best[j] is the least padding of the first j lengths with
    the buckets used so far, and one more bucket is tried from every i at once.
    """
    if not lengths:
        return []
    size = np.array(lengths, dtype=object if max(lengths) * sum(counts) >= 1 << 62 else np.int64)
    n = np.concatenate(([0], np.cumsum(np.array(counts, dtype=size.dtype))))
    words = np.concatenate(([0], np.cumsum(size * np.array(counts, dtype=size.dtype))))
    cost = size[None, :] * (n[None, 1:] - n[:-1, None]) - (words[None, 1:] - words[:-1, None])  # [i, j]
    never = int(cost[0, -1]) + 1
    cost[np.tril_indices(len(lengths), -1)] = never
    best, came = cost[0].copy(), []
    for _ in range(min(buckets, len(lengths)) - 1):
        total = np.concatenate((cost[:1], cost[1:] + best[:-1, None]))
        choice = np.argmin(total, axis=0)
        best = total[choice, np.arange(len(lengths))]
        came.append(choice)
    bounds, j = [], len(lengths) - 1
    for choice in reversed(came):
        bounds.append(lengths[j])
        if choice[j] == 0:
            return bounds[::-1]
        j = int(choice[j]) - 1
    return [*bounds, lengths[j]][::-1]


def pieces(docs: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, piece, start, length): the words of each document cut into sequences."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / max_length) - 1).cast("long")
    cut = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_length).cast("long"), F.col("size") - start).alias("length"))


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per sequence: doc_id, piece, start, length, bucket, bucket_length, batch, slot.

    A text of n words is cut into pieces of ``max_length`` words and a rest, so nothing is dropped. The
    histogram of all piece lengths (at most ``max_length`` + 1 rows) goes to the driver, where the bucket
    boundaries are found. A bucket's pieces, in seeded order, fill batches of floor(batch_tokens /
    bucket_length) sequences; ``slot`` is the place in the batch. Null and empty texts give one piece of
    length 0; repeated rows are packed one by one; an empty table gives no rows; other columns are ignored.
    """
    rows = write_through(pieces(docs, max_length))
    histogram = sorted(map(tuple, rows.groupBy("length").count().collect()))
    bounds = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    below = [(F.col("length") > b).cast("int") for b in bounds]
    bucket = sum(below[1:], below[0]) if bounds else F.lit(0)
    at = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), F.col("bucket") + 1)
    placed = write_through(rows.withColumn("bucket", bucket).withColumn("bucket_length", at))
    ranked = seeded_ranks(placed, ["bucket"], ["doc_id", "piece"], seed)
    capacity = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("bucket_length"))))
    columns = ["doc_id", "piece", "start", "length", "bucket", "bucket_length"]
    return ranked.select(*columns, F.floor(F.col("rank") / capacity).alias("batch"), (F.col("rank") % capacity).alias("slot"))
