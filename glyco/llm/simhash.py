"""Near-duplicate documents by SimHash and bit-sliced comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyco.llm.components import components
from glyco.llm.exact import solid, staying
from glyco.llm.text import whole
from glyco.session import write_through

WIDTH = 4  # words of a shingle
RADIUS = 4
BITS = 64
HASH_SEED = 42
SEGMENTS = 6  # at most RADIUS of them can differ, so two are equal in every linked pair
BLOCK_ROWS = 8192  # rows of one block; larger blocks are compared in pairs of chunks
SLICE = 1 << 16  # hash values, or pairs of a row and a 64-row word, worked on at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

# Texts near by word shingles: long fingerprints, blocks by min-hash bands.
SHINGLE = 5  # words
SIMILARITY = 0.8  # Jaccard of the sets of shingles
LONG_WORDS = 16  # 64-bit words of a long fingerprint
BANDS, BAND_ROWS = 10, 4  # two texts of similarity 0.8 share a band in 0.995 of all cases
PART = 1 << 12  # shingle hashes whose bits are unpacked at once
SLACK = 1.5  # standard deviations that the radius leaves above the distance expected at the similarity


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return
    body = b" ".join(words)
    last = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], last[:-1] + 1))
    span = min(width, len(words))
    starts, ends = first[: len(words) - span + 1].tolist(), last[span - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        yield np.array([hashed(body[s:e], HASH_SEED) for s, e in zip(starts[at : at + SLICE], ends[at : at + SLICE])], dtype="<u8")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned SimHash: a bit is set if more than half of the shingle hashes have it."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, width):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray, lanes: int, first: int) -> np.ndarray:
    """``lanes`` further hashes of each hash; ``first`` numbers the hash functions."""
    x = h[:, None] + np.arange(first, first + lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(text: str | None, width: int = SHINGLE) -> tuple[bytes, list[int]]:
    """SimHash of ``LONG_WORDS`` words over the distinct shingles, and a signed key for each min-hash band.

    A text without words has the fingerprint zero and zero keys.
    """
    found = list(shingle_hashes(text, width))
    if not found:
        return bytes(8 * LONG_WORDS), [0] * BANDS
    h = np.unique(np.concatenate(found))
    ones, least = np.zeros(BITS * LONG_WORDS, np.int64), np.full(BANDS * BAND_ROWS, ALL)
    for at in range(0, len(h), PART):
        part = h[at : at + PART]
        bits = np.unpackbits(_mixed(part, LONG_WORDS, 1).astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for k in range(0, len(part), 255):  # sums of so many bits fit a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
        least = np.minimum(least, _mixed(part, len(least), 1 + LONG_WORDS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes()) for band in least.astype("<u8").reshape(BANDS, BAND_ROWS)]
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), [k - (1 << 64) if k >> 63 else k for k in keys]


def radius_of(similarity: float, bits: int = BITS * LONG_WORDS) -> int:
    """Differing bits up to which long fingerprints count as of ``similarity`` or more.

    Texts of Jaccard J have a cosine of 2J / (1 + J), so each bit differs with the probability p = angle / pi.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints, 64 fingerprints in a word."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    words = -(-len(prints) // BITS)
    padded = np.zeros((bits.shape[1], words * BITS), np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def close_pairs(prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one block within ``radius``; ``ends[i]`` is where the block of row i ends.

    ``prints`` holds one 64-bit word a row, or several as columns.
    Each row is compared with whole words of 64 rows at once: two bit planes at a time enter a carry-save
    adder, whose carries run up a counter of bit slices. Every eight planes the words in which all 64
    distances exceed the radius are abandoned.
    """
    prints = prints.reshape(len(prints), -1)
    planes = bit_planes(prints)
    row = np.arange(len(prints))
    first, words = (row + 1) // BITS, np.maximum(0, -(-ends // BITS) - (row + 1) // BITS)
    words[row + 1 >= ends] = 0
    steps = radius.bit_length() + 1
    bounds = np.concatenate(([0], np.cumsum(words)))
    for at in range(0, int(bounds[-1]), SLICE):
        task = np.arange(at, min(at + SLICE, int(bounds[-1])))
        i = np.searchsorted(bounds, task, side="right") - 1
        word = first[i] + task - bounds[i]
        low = np.clip(i + 1 - word * BITS, 0, BITS - 1).astype(np.uint64)
        high = np.clip((word + 1) * BITS - ends[i], 0, BITS - 1).astype(np.uint64)
        lanes = (ALL << low) & (ALL >> high)
        counter = [np.zeros(len(task), np.uint64) for _ in range(steps)]
        over = ~lanes
        for b in range(0, len(planes), 2):
            own = prints[i, b // BITS]
            x, y = (planes[p][word] ^ (np.uint64(0) - ((own >> np.uint64(p % BITS)) & np.uint64(1))) for p in (b, b + 1))
            half = counter[0] ^ x
            carry = (counter[0] & x) | (half & y)
            counter[0] = half ^ y
            for s in range(1, steps):
                counter[s], carry = counter[s] ^ carry, counter[s] & carry
            over |= carry
            if b % 8 == 6:
                over |= _exceeds(counter, radius)
                alive = over != ALL
                if not alive.all():
                    i, word, over = i[alive], word[alive], over[alive]
                    counter = [c[alive] for c in counter]
                if not len(i):
                    break
        if len(i):
            hit, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield i[hit], word[hit] * BITS + lane


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for s in reversed(range(len(counter))):
        if radius >> s & 1:
            equal = equal & counter[s]
        else:
            above = above | (equal & counter[s])
            equal = equal & ~counter[s]
    return above


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: link every a with its b; roots are the smallest members."""
    while len(a):
        for side in (a, b):
            while True:
                up = parent[side]
                if (up == side).all():
                    break
                side[:] = up
        differ = a != b
        a, b = a[differ], b[differ]
        parent[np.maximum(a, b)] = np.minimum(a, b)


def block_links(nodes: np.ndarray, prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is close in each block: at most one for each row."""
    parent = np.arange(len(prints))
    for a, b in close_pairs(prints, ends, radius):
        join_sets(parent, a.copy(), b.copy())
    while (parent[parent] != parent).any():
        parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return nodes[child], nodes[parent[child]]


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (u, v) between ``node`` values with distinct ``fingerprint``s, enough to connect all within ``radius``.

    64 bits are cut into ``segments``; of a linked pair at most ``radius`` segments differ, so the pair
    agrees on some ``segments - radius`` of them. Each choice of segments makes one block per value. A
    block above ``block_rows`` is cut into chunks and every two chunks meet in a block of their own.
    """
    edges = [BITS * s // segments for s in range(segments + 1)]
    masks = [sum(((1 << (edges[s + 1] - edges[s])) - 1) << edges[s] for s in chosen) for chosen in combinations(range(segments), segments - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)]))
    banded = write_through(prints.select("node", "fingerprint", bands.alias("b")).select("node", "fingerprint", "b.*"))
    return banded_links(banded, radius, block_rows)


def band_links(prints: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (u, v) between ``node`` values that share one of their ``keys`` and are within ``radius``.

    ``fingerprint`` is binary. Nodes that share no key with another are left out before fingerprints move.
    """
    keyed = write_through(prints.select("node", F.posexplode("keys").alias("band", "key")))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    met = write_through(keyed.join(shared, ["band", "key"]))
    # One row a node leaves this aggregation, so the fingerprints move once.
    bands = met.groupBy("node").agg(F.collect_list(F.struct("band", "key")).alias("bands"))  # at most BANDS
    banded = bands.join(prints.select("node", "fingerprint").hint("merge"), "node").select("node", "fingerprint", F.inline("bands"))
    return banded_links(write_through(banded), radius, block_rows)


def banded_links(banded: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links inside the blocks of equal (``band``, ``key``), enough to connect all within ``radius`` there."""
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = write_through(sizes.select("band", "key", F.ceil(F.col("n") / block_rows).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = banded.join(sizes, ["band", "key"]).withColumn("chunk", chunk).withColumn("other", other)
    dealt = dealt.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    block = ["band", "key", "low", "high"]
    dealt = dealt.select(*block, "node", "fingerprint").repartition(*block).sortWithinPartitions(*block)

    long = banded.schema["fingerprint"].dataType.typeName() == "binary"
    wide = LONG_WORDS if long else 1

    def prints_of(column: pa.Array) -> np.ndarray:
        if long:
            return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, wide)
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5 + [np.zeros((0, wide), np.uint64)]

        def told(rows: list[np.ndarray]) -> pa.RecordBatch:
            starts = _starts(rows)
            ends = np.repeat(np.append(starts[1:], len(rows[0])), np.diff(np.append(starts, len(rows[0]))))
            u, v = block_links(rows[4], rows[5], ends, radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5]] + [prints_of(batch.column(5))]
            held = [np.concatenate(x) for x in zip(held, new)]
            cut = int(_starts(held)[-1]) if len(held[0]) else 0  # the last block may go on
            if cut >= SLICE:
                yield told([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield told(held)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _starts(rows: list[np.ndarray]) -> np.ndarray:
    """Where a new block begins in the sorted rows."""
    new = np.zeros(len(rows[0]), bool)
    new[:1] = True
    for x in rows[:4]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def near_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id reachable. Equal fingerprints are compared once. Null and empty texts have fingerprint zero and
    link like any other. Rows with the same doc_id are one document with several fingerprints, which link. A row
    without a doc_id keeps its place and links others, but never names a component: where no row has an id,
    component_id is null. Other columns are ignored; an empty table gives no rows.
    """
    prints = write_through(fingerprints(docs, width))
    nodes = write_through(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fingerprint")))
    # Every fingerprint of a document links to the smallest one it has.
    spread = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fingerprint").alias("v"), F.max("fingerprint").alias("w"))
    same = prints.join(spread.filter("v < w"), "doc_id").filter("fingerprint > v").select(F.col("fingerprint").alias("u"), "v").distinct()
    found = write_through(components(write_through(links(nodes.select("node", "fingerprint"), radius).unionByName(same))))
    grouped = write_through(nodes.join(found, "node", "left").select("fingerprint", "least", F.coalesce("component", "node").alias("group")))
    names = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = write_through(grouped.join(names, "group").select("fingerprint", "component_id"))
    out = prints.join(named, "fingerprint", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of near texts.

    The row of the smallest doc_id stays, a null one only where the group has no other. Groups are
    made of texts alone: rows without a doc_id, or with different texts under one, stay apart.
    """
    marked = docs.withColumn("_id", solid(F.col("doc_id"))).withColumn("_sha", F.sha2(F.encode(whole(F.col("text")), "UTF-8"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "_sha", "fingerprint"])

    prints = write_through(marked.select(F.col("doc_id").cast("long"), "_sha", "text").mapInArrow(run, "doc_id long, _sha string, fingerprint long"))
    # Of each fingerprint the row that would stay; fingerprints are the nodes.
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_sha")
    nodes = write_through(prints.groupBy("fingerprint").agg(F.min(row).alias("row")).withColumn("node", F.col("fingerprint")))
    found = write_through(components(links(nodes.select("node", "fingerprint"), radius)))
    best = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("row").alias("row"))
    kept = write_through(best.select(solid(F.col("row.doc_id")).alias("_id"), F.col("row._sha").alias("_sha")))
    return staying(marked, kept, ["_id", "_sha"])


def drop_similar(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of texts of ``similarity`` or more.

    Similarity is the Jaccard of the sets of ``width``-word shingles, ASCII letters lower-cased, estimated by the
    distance of long SimHash fingerprints; compared are the texts that share a min-hash band. Links are
    transitive. The row of the smallest doc_id stays, a null one only where the group has no other; equal texts
    under one doc_id leave one row, rows without a doc_id or with different texts under one stay apart. Null
    texts and texts without words are one group. Other columns may have any name; an empty table gives no rows.
    """
    own = [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]  # clashes with no added column
    marked = docs.toDF(*own).withColumn("_id", solid(F.col("doc_id"))).withColumn("_sha", F.sha2(F.encode(whole(F.col("text")), "UTF-8"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [long_fingerprint(t, width) for t in batch.column(2).to_pylist()]
            prints, keys = pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, keys], names=["doc_id", "_sha", "fingerprint", "keys"])

    schema = "doc_id long, _sha string, fingerprint binary, keys array<long>"
    prints = write_through(marked.select(F.col("doc_id").cast("long"), "_sha", "text").mapInArrow(run, schema))
    # Of each fingerprint the row that would stay; its number, written once, is the node.
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_sha")
    nodes = prints.groupBy("fingerprint", "keys").agg(F.min(row).alias("row"))
    nodes = write_through(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = write_through(components(band_links(nodes, radius_of(similarity))))
    best = nodes.select("node", "row").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("row").alias("row"))
    kept = write_through(best.select(solid(F.col("row.doc_id")).alias("_id"), F.col("row._sha").alias("_sha")))
    return staying(marked, kept, ["_id", "_sha"]).toDF(*docs.columns)
