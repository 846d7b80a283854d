"""A prefix trie of conversations, one balanced-parentheses shard per range of sorted turn sequences.

Conversations are sorted by their turns, so a depth-first walk of the trie meets them in order. The order is
cut into shards; each writes its part of the trie as parentheses. Blocks of excess minima and maxima find the
closing parenthesis of every node, which delimits its subtree; leaves are ranks of ``()`` pairs, savings and
members are differences of cumulative arrays. Only nodes on the path that a shard shares with its
neighbours lie in several shards; these spines are merged by adding what the shards found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyco.llm.text import whole
from glyco.session import write_through

SHARD_TURNS = 100_000
HEAD_TURNS = 5
BASE = 100
DIGEST = 32  # hex digits of a turn's digest
BLOCK = 64
FAR = np.int32(2**31 - 1)
EMPTY = hashlib.sha256(b"").hexdigest()
PARTS = (
    "shared boolean, node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ends array<long>"
)


class Parentheses:
    """A balanced sequence of +1 and -1 with minima and maxima of the excess per block, and a tree over them."""

    def __init__(self, signs: np.ndarray):
        self.signs = signs.astype(np.int8)
        self.excess = np.cumsum(signs, dtype=np.int32)
        blocks = 1 << max(0, int(np.ceil(np.log2(max(1, -(-len(signs) // BLOCK))))))
        self.rows = np.full(blocks * BLOCK, FAR, np.int32)
        self.rows[: len(signs)] = self.excess
        self.rows = self.rows.reshape(blocks, BLOCK)
        least, most = self.rows.min(1), np.where(self.rows == FAR, -1, self.rows).max(1)
        self.least, self.most = [least], [most]
        while len(least) > 1:
            least, most = least.reshape(-1, 2).min(1), most.reshape(-1, 2).max(1)
            self.least.append(least)
            self.most.append(most)

    def _holds(self, level: int, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        # The excess moves in single steps, so a block between whose extremes the target lies holds it.
        return (self.least[level][node] <= target) & (self.most[level][node] >= target)

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place after ``after`` in each block where the excess is the target, or -1."""
        out = np.empty(len(block), np.int64)
        for a in range(0, len(block), 16_384):
            part = slice(a, a + 16_384)
            hit = (self.rows[block[part]] == target[part, None]) & (np.arange(BLOCK) > after[part, None])
            out[part] = np.where(hit.any(1), block[part] * BLOCK + hit.argmax(1), -1)
        return out

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of every opening place: in its block, else over the tree of blocks."""
        target, block = self.excess[opens] - 1, opens // BLOCK
        close = self._in_block(block, opens % BLOCK, target)
        rest = np.flatnonzero(close < 0)
        node, aim = block[rest], target[rest]
        level = np.full(len(rest), -1)
        for at in range(len(self.least) - 1):
            climbing = level < 0
            found = climbing & (node % 2 == 0)
            found[found] = self._holds(at, node[found] + 1, aim[found])
            level[found] = at
            node = np.where(found, node + 1, np.where(climbing, node // 2, node))
        for at in range(len(self.least) - 1, 0, -1):
            down = level == at
            left = node[down] * 2
            node[down] = np.where(self._holds(at - 1, left, aim[down]), left, left + 1)
            level[down] = at - 1
        close[rest] = self._in_block(node, np.full(len(rest), -1), aim)
        return close

    def leaf_ranks(self, left_out: np.ndarray) -> np.ndarray:
        """Number of ``()`` pairs before each place; pairs that open at ``left_out`` do not count."""
        pair = np.zeros(len(self.signs) + 1, np.int64)
        pair[1:-1] = (self.signs[:-1] == 1) & (self.signs[1:] == -1)
        pair[left_out + 1] = 0
        return np.cumsum(pair)


def range_minima(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of each range [first, end), none empty, from a sparse table."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    power = np.floor(np.log2(end - first)).astype(np.int64)
    out = np.empty(len(first), values.dtype)
    for p in np.unique(power):
        at = power == p
        out[at] = np.minimum(rows[p][first[at]], rows[p][end[at] - (1 << p)])
    return out


def common_turns(a: str, b: str) -> int:
    """Turns that two sequences of digests share from the start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def chain(key: str, depth: int) -> list[str]:
    """Names of the nodes on a path, from the root down to ``depth``."""
    names = [hashlib.sha256(b"").hexdigest()[:DIGEST]]
    for d in range(depth):
        names.append(hashlib.sha256((names[-1] + key[d * DIGEST : d * DIGEST + DIGEST]).encode()).hexdigest()[:DIGEST])
    return names


def shard_trie(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """The nodes of one shard (``conv_id, key, chars``), given the last key before it and the first after it."""
    rows = rows.sort_by([("key", "ascending"), ("conv_id", "ascending")])
    keys, ids = rows["key"].to_pylist(), np.array(rows["conv_id"].to_pylist(), np.int64)
    before, after = edges["before"].to_pylist()[0], edges["after"].to_pylist()[0]
    lens = np.array([len(k) // DIGEST for k in keys], np.int64)
    shared = np.array([0] + [common_turns(a, b) for a, b in zip(keys, keys[1:])], np.int64)
    new = lens - shared
    inward = -1 if before is None else common_turns(before, keys[0])
    outward = -1 if after is None else common_turns(keys[-1], after)

    # The root, then for every row the closed and the opened nodes, at last what is still open.
    runs = np.empty(2 * len(keys) + 2, np.int64)
    runs[0], runs[1], runs[-1] = 1, 0, lens[-1] + 1
    runs[2:-1:2], runs[3:-1:2] = new, lens[:-1] - shared[1:]
    signs = np.repeat(np.where(np.arange(len(runs)) % 2 == 0, 1, -1), runs)
    paren = Parentheses(signs)
    opens = np.flatnonzero(signs == 1)
    closes = paren.find_close(opens)
    count = len(opens)
    node = np.arange(count)
    after_it = node + (closes - opens + 1) // 2  # first node after the subtree
    depth = paren.excess[opens].astype(np.int64) - 1
    born = np.concatenate([[0], np.repeat(np.arange(len(keys)), new)])
    flat = np.concatenate([np.asarray(c, np.int64) for c in rows["chars"].to_pylist()] + [np.zeros(1, np.int64)])
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    chars = np.where(depth > 0, flat[np.minimum(starts[born] + np.maximum(depth - 1, 0), len(flat) - 1)], 0)

    # Where each row ends; a row that opens nothing repeats the one before it.
    ender = np.cumsum(new)
    first, end = np.searchsorted(ender, node, "left"), np.searchsorted(ender, after_it, "left")
    parent, path = np.empty(count, np.int64), [0]
    parent[1:], parent[0] = node[:-1], -1
    for opened, keep, last in zip(new.tolist(), shared.tolist(), ender.tolist()):
        del path[keep + 1 :]
        if opened:
            parent[last - opened + 1] = path[-1]
            path.extend(range(last - opened + 1, last + 1))

    spine_in = np.arange(inward + 1)  # nodes of the first row are numbered by their depth
    spine_out = np.array(path[: outward + 1], np.int64)
    owned = np.ones(count, np.int64)
    owned[spine_in] = 0
    is_shared = np.zeros(count, bool)
    is_shared[spine_in] = is_shared[spine_out] = True
    names = dict(zip(spine_in.tolist(), chain(keys[0], max(inward, 0)))) | dict(zip(spine_out.tolist(), chain(keys[-1], max(outward, 0))))

    members = end - first
    total = np.concatenate([[0], np.cumsum(members * chars)])
    once = np.concatenate([[0], np.cumsum(owned * chars)])
    saved = (total[after_it] - total[node]) - (once[after_it] - once[node])
    children = np.bincount(parent[1:], weights=owned[1:], minlength=count).astype(np.int64)
    # A node that goes on in the next shard may still get children there: its last shard counts it.
    ranks = paren.leaf_ranks(opens[spine_out])
    leaves = ranks[closes] - ranks[opens]
    least = range_minima(ids, first, end)

    cut = ({int(ender[0])} if before == keys[0] else set()) | ({int(ender[-1])} if after == keys[-1] else set())
    hashes: list = [EMPTY] * count
    ends: list = [None] * count
    for k in np.flatnonzero(is_shared).tolist():
        hashes[k] = None
    distinct, at, many = np.unique(ender, return_index=True, return_counts=True)
    for k, a, n in zip(distinct.tolist(), at.tolist(), many.tolist()):
        if k in cut:
            ends[k] = ids[a : a + n].tolist()
        else:
            hashes[k] = hashlib.sha256(",".join(map(str, ids[a : a + n].tolist())).encode()).hexdigest()
    up = [names.get(p) for p in parent.tolist()]
    return pa.table(
        {
            "shared": is_shared,
            "node": pa.array([names.get(k) for k in range(count)], pa.string()),
            "parent": pa.array(up, pa.string()),
            "depth": depth,
            "conv_id": least,
            "parent_conv_id": pa.array([None if u or p < 0 else int(least[p]) for u, p in zip(up, parent.tolist())], pa.int64()),
            "n_convs": members,
            "n_children": children,
            "n_leaves": leaves,
            "saved_tokens": saved,
            "ends_sha256": pa.array(hashes, pa.string()),
            "ends": pa.array(ends, pa.list_(pa.int64())),
        }
    )


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, from rows sorted by node and id, without holding a list."""
    current, state = None, None

    def told():
        return pa.RecordBatch.from_pydict({"node": [current], "listed": [state.hexdigest()]})

    for batch in batches:
        names, ids = batch["node"].to_pylist(), batch["conv_id"].to_pylist()
        a = 0
        while a < len(names):
            b = a
            while b < len(names) and names[b] == names[a]:
                b += 1
            text = ",".join(map(str, ids[a:b]))
            if names[a] != current:
                if current is not None:
                    yield told()
                current, state = names[a], hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
            a = b
    if current is not None:
        yield told()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, chars``: digests (hex, joined) and code points of the turns of every rebuilt conversation.

    The texts are read once, shuffled once to put the turns in order, and left behind as digests.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    told = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = turns.select("conv_id", F.row_number().over(order).alias("pos"), told.alias("d"), F.char_length("text").cast("long").alias("n"))
    own = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "n"))).alias("own"))
    own = write_through(own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % (HEAD_TURNS + 1)).cast("int")))
    heads = own.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("_base"), F.slice("own", 1, HEAD_TURNS).alias("head"))
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % BASE == F.col("_base"), "left")
    none = F.slice("own", 1, 0)
    path = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))

    def each(name: str) -> Column:
        return F.transform("path", lambda t: t[name])

    return met.withColumn("path", path).select("conv_id", F.array_join(each("d"), "").alias("key"), each("n").alias("chars"))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per trie node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns of one conversation with equal ``turn`` follow each other by role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation and take no part;
    other columns are ignored. An empty table has no conversation, so no root, and gives no rows.

    A shard holds about ``shard_turns`` turns; groups of equal conversations are cut like any other range. One
    conversation is one row of 32 hex digits and 8 bytes a turn. The digest of an end list is one SHA-256 over
    all ids, so ids of a list that several shards share are streamed in order through one task, never held.
    """
    paths = write_through(rebuilt(conversations))
    turns = paths.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    ordered = paths.repartitionByRange(shards, "key", "conv_id").withColumn("shard", F.spark_partition_id())
    ordered = write_through(ordered)
    edges = ordered.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    walk = Window.orderBy("shard")  # one row per shard
    edges = edges.select("shard", F.lag("high").over(walk).alias("before"), F.lead("low").over(walk).alias("after"))
    nodes = write_through(ordered.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(shard_trie, PARTS))

    lists = nodes.filter("ends is not null").select("node", F.explode("ends").alias("conv_id"))
    listed = lists.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(list_digests, "node string, listed string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.filter("shared").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("one")
    )
    spine = spine.join(listed, "node", "left").withColumn("ends_sha256", F.coalesce("listed", "one", F.lit(EMPTY))).drop("listed", "one")
    spine = write_through(spine)
    inner = nodes.filter("not shared").drop("shared", "ends")
    above = spine.select(F.col("node").alias("_p"), F.col("conv_id").alias("_parent"))
    every = inner.unionByName(spine.withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = every.join(above, F.col("parent") == F.col("_p"), "left")
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
