"""A Merkle manifest of a table: one leaf per row, 8-ary trees per language, one tree over their roots.

Leaves are sorted once over all languages and cut into leaf partitions of consecutive leaves. A partition
may hold the end of one language, several whole ones and the start of another; the node coordinates it
cannot derive itself (``missing``) are the minimal union for all its proofs. They are fetched once per
partition, the interiors are derived from them and the partition's own leaves, and the single proofs are
expanded there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyco.llm.text import ascii_lower
from glyco.plans.ranking import sorted_index
from glyco.session import write_through

ARITY = 8
PARTITION_LEAVES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # number of the tree over the subroots
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, a colon and the value."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[told(fields[name]) for name in FIELDS]), 256)


def level_sizes(n: int) -> list[int]:
    """Nodes per level of a tree with ``n`` leaves, from the leaves to the root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def missing(n: int, positions: list[int]) -> list[tuple[int, int]]:
    """The fewest ``(level, index)`` nodes that prove all ``positions`` of a tree with ``n`` leaves.

    Level by level the runs of all known nodes are united; what is not known in them has to be fetched,
    and the parents are then known without a fetch.
    """
    known, wanted = sorted(set(positions)), []
    for level, size in enumerate(level_sizes(n)[:-1]):
        have = set(known)
        runs = sorted({k // ARITY for k in known})
        for run in runs:
            wanted += [(level, i) for i in range(run * ARITY, min(run * ARITY + ARITY, size)) if i not in have]
        known = runs
    return wanted


def missing_of_range(n: int, first: int, last: int) -> list[tuple[int, int]]:
    """``missing`` for the consecutive leaves ``first`` to ``last``, without listing them."""
    wanted = []
    for level, size in enumerate(level_sizes(n)[:-1]):
        left, right = first // ARITY, last // ARITY
        wanted += [(level, i) for i in range(left * ARITY, first)]
        wanted += [(level, i) for i in range(last + 1, min(right * ARITY + ARITY, size))]
        first, last = left, right
    return wanted


class Forest:
    """Nodes known to one partition, and the proofs they give."""

    def __init__(self, nodes: dict[tuple[int, int, int], str]):
        self.nodes = nodes  # (tree, level, index) to digest
        self._beside: dict[tuple[int, int, int], tuple[str, str]] = {}
        self._above: dict[tuple[int, int, int], str] = {}

    def derive(self, tree: int, n: int, first: int, last: int) -> str:
        """Compute the interiors over leaves ``first`` to ``last`` and return the tree's root."""
        for level, size in enumerate(level_sizes(n)[:-1]):
            first, last = first // ARITY, last // ARITY
            for index in range(first, last + 1):
                run = range(index * ARITY, min(index * ARITY + ARITY, size))
                self.nodes[tree, level + 1, index] = digest("".join(self.nodes[tree, level, i] for i in run))
        return self.nodes[tree, len(level_sizes(n)) - 1, 0]

    def beside(self, tree: int, level: int, index: int, size: int) -> tuple[str, str]:
        """Digests before and after a node in its run."""
        at = (tree, level, index)
        if at not in self._beside:
            start = index // ARITY * ARITY
            run = [self.nodes[tree, level, i] for i in range(start, min(start + ARITY, size))]
            self._beside[at] = "".join(run[: index - start]), "".join(run[index - start + 1 :])
        return self._beside[at]

    def siblings(self, tree: int, sizes: list[int], index: int, level: int = 0) -> str:
        """All siblings from a node to its tree's root, level by level; interiors keep theirs for all leaves below."""
        if level == len(sizes) - 1:
            return ""
        at = (tree, level, index)
        if at in self._above:
            return self._above[at]
        before, after = self.beside(tree, level, index, sizes[level])
        told = before + after + self.siblings(tree, sizes, index // ARITY, level + 1)
        if level:
            self._above[at] = told
        return told

    def fold(self, tree: int, sizes: list[int], index: int, value: str) -> str:
        """The root that a leaf value gives with the siblings as they are."""
        for level, size in enumerate(sizes[:-1]):
            before, after = self.beside(tree, level, index, size)
            value, index = digest(before + value + after), index // ARITY
        return value


def expand(leaves: pa.Table, fetched: pa.Table, trees: int) -> pa.Table:
    """Proofs of one leaf partition from its leaves and the nodes fetched for it."""
    nodes = dict(zip(zip(*[fetched[c].to_pylist() for c in ("tree", "level", "index")]), fetched["digest"].to_pylist()))
    tree, pos, size, leaf, forged = [leaves[c].to_pylist() for c in ("tree", "pos", "n", "leaf", "forged")]
    spans: dict[int, list[int]] = {}
    for t, p, n, h in zip(tree, pos, size, leaf):
        nodes[t, 0, p] = h
        span = spans.setdefault(t, [n, p, p])
        span[1], span[2] = min(span[1], p), max(span[2], p)
    forest = Forest(nodes)
    subroots = {t: forest.derive(t, *span) for t, span in spans.items()}
    for t, subroot in subroots.items():
        nodes[TOP, 0, t] = subroot
    root = forest.derive(TOP, trees, min(spans), max(spans))
    top, sizes = level_sizes(trees), {t: level_sizes(span[0]) for t, span in spans.items()}
    proofs, folded = [], []
    for t, p, h, f in zip(tree, pos, leaf, forged):
        proofs.append(digest(forest.siblings(t, sizes[t], p) + forest.siblings(TOP, top, t)))
        folded.append(forest.fold(TOP, top, t, forest.fold(t, sizes[t], p, f or h)))
    return pa.table(
        {
            "doc_id": leaves["doc_id"],
            "leaf": leaves["leaf"],
            "subroot": [subroots[t] for t in tree],
            "root": [root] * len(tree),
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
    )


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, forged`` of every row; ``forged`` is null where nothing is tampered with."""
    plain = {f: F.col(f) for f in FIELDS}
    lowered = {**plain, "text": F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))}
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_digest(plain).alias("leaf"), F.when(tampered, leaf_digest(lowered)).alias("forged"))


def placed(rows: DataFrame, tree_of: str, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Rows with ``tree``, ``pos``, ``n`` and ``at`` (place over all), one row per tree, and the number of trees.

    Places come from one range sort, so a language that holds most rows fills no task.
    """
    ranked, _ = sorted_index(rows, [tree_of, *order], "at")
    sizes = write_through(ranked.groupBy(tree_of).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("_first")))
    numbered, trees = sorted_index(sizes, [tree_of], "tree")
    numbered = write_through(numbered)
    meet = numbered.withColumnRenamed(tree_of, "_of")
    joined = ranked.join(meet, F.col(tree_of).eqNullSafe(F.col("_of"))).withColumn("pos", F.col("at") - F.col("_first"))
    return joined.drop("_of", "_first"), numbered, trees


def all_nodes(leaves: DataFrame, largest: int) -> DataFrame:
    """``tree, level, index, digest`` of every node above ``leaves`` (``tree, pos, n, leaf``), and the leaves.

    Each level is one grouped aggregation over an eighth of the rows of the level below.
    """
    now = leaves.select("tree", F.col("pos").alias("index"), F.col("n").alias("_size"), F.col("leaf").alias("digest"))
    parts = [now.withColumn("level", F.lit(0))]
    for level in range(1, len(level_sizes(largest))):
        run = F.array_sort(F.collect_list(F.struct("index", "digest")))
        up = (
            now.filter("_size > 1")
            .groupBy("tree", F.floor(F.col("index") / ARITY).alias("_up"), F.ceil(F.col("_size") / ARITY).alias("_up_size"))
            .agg(F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))
        )
        now = write_through(up.select("tree", F.col("_up").alias("index"), F.col("_up_size").alias("_size"), "digest"))
        parts.append(now.withColumn("level", F.lit(level)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def wanted_nodes(leaves: DataFrame, trees: int) -> DataFrame:
    """``part, tree, level, index`` of the nodes that each leaf partition has to fetch."""
    spans = leaves.groupBy("part", "tree").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"))
    over = spans.groupBy("part").agg(F.min("tree").alias("first"), F.max("tree").alias("last"))
    spans = spans.unionByName(over.select("part", F.lit(TOP).cast("long").alias("tree"), "first", "last", F.lit(trees).cast("long").alias("n")))

    def list_them(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (row.part, row.tree, level, index)
                for row in batch.itertuples(index=False)
                for level, index in missing_of_range(row.n, row.first, row.last)
            ]
            yield pd.DataFrame(out, columns=["part", "tree", "level", "index"])

    return spans.mapInPandas(list_them, "part long, tree long, level int, index long")


def manifest(docs: DataFrame, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per document row.

    A language's leaves ascend by doc_id, null first; rows of one doc_id follow each other by their digest, so
    repeated rows have equal leaves and neighbouring places. A null lang is a language of its own, and the
    first. Rows without a doc_id are never tampered with. Null and empty texts differ (``-`` and ``0:``).
    Columns other than the five fields are ignored. An empty table has no root and gives no rows.
    """
    rows = write_through(leaf_rows(docs))
    leaves, sizes, trees = placed(rows, "lang", ["doc_id", "leaf"])
    leaves = write_through(leaves.drop("lang").withColumn("part", F.floor(F.col("at") / partition_leaves)).drop("at"))
    nodes = all_nodes(leaves, sizes.agg(F.max("n")).first()[0] or 1)
    subroots = write_through(
        nodes.filter("_size = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), F.col("digest").alias("leaf"))
    )
    nodes = nodes.unionByName(all_nodes(subroots, max(trees, 1))).drop("_size")
    fetched = wanted_nodes(leaves, trees).hint("merge").join(nodes, ["tree", "level", "index"])
    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(lambda a, b: expand(a, b, trees), PROOFS)
