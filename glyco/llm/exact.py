"""Exact de-duplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyco.llm.text import ascii_lower
from glyco.session import write_through

BLOCK_BYTES = 16_384


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of ``columns`` with an integer ``name`` that follows their sort order.

    Range partitioning and a sort inside each partition; the table is written before use, so the names
    stay fixed when tasks run again.
    """
    distinct = df.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return write_through(distinct.withColumn("name", F.monotonically_increasing_id()))


def _blocks(docs: DataFrame, block_bytes: int, block_hash) -> DataFrame:
    """(doc_id, text_sha256, parts, part, hash, block): fixed-size pieces of the lower-cased bytes."""
    whole = docs.select("doc_id", F.encode(ascii_lower(F.col("text")), "UTF-8").alias("body"))
    whole = whole.select("doc_id", "body", F.sha2("body", 256).alias("text_sha256"), F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int").alias("parts"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.substring("body", i * block_bytes + 1, F.lit(block_bytes)))
    cut = whole.select("doc_id", "text_sha256", "parts", F.posexplode(pieces).alias("part", "block"))
    return cut.withColumn("hash", block_hash(F.col("block")))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, copies, level, name): equal (level, name) exactly for equal texts.

    Blocks are named first: a block's name stands for its hash and its place among the sorted contents
    that share the hash, so no collision survives. Then names of adjacent blocks are named as pairs,
    level by level, until each document has one. A document of n blocks ends at level ceil(log2(n)).
    Rows with equal doc_id and text are one entry with ``copies`` above 1.
    """
    blocks = _blocks(docs, block_bytes, block_hash)
    keys = ["doc_id", "text_sha256"]
    slim = write_through(blocks.groupBy(*keys, "parts", "part", "hash").agg(F.count("*").alias("copies")))
    # Contents meet once, copies already merged in the map tasks; only the hashes go further.
    contents = blocks.select("hash", "block").distinct()
    clashes = write_through(contents.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    if clashes.isEmpty():
        variants = slim.withColumn("variant", F.lit(0))
    else:
        inside = blocks.join(clashes, "hash")
        order = Window.partitionBy("hash").orderBy("block")
        numbers = inside.select("hash", "block").distinct().withColumn("variant", F.row_number().over(order))
        told = inside.join(numbers, ["hash", "block"]).select(*keys, "part", "variant").distinct()
        told = told.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("part").alias("_part"), "variant")
        same = slim["doc_id"].eqNullSafe(told["_id"]) & (slim["text_sha256"] == told["_sha"]) & (slim["part"] == told["_part"])
        joined = slim.join(told, same, "left").drop("_id", "_sha", "_part")
        variants = write_through(joined.fillna(0, ["variant"]))
    names = named(variants, ["hash", "variant"])
    nodes = write_through(variants.join(names, ["hash", "variant"]).select(*keys, "copies", F.col("parts").alias("left"), "part", "name"))
    done, level = [], 0
    while True:
        done.append(nodes.filter("left = 1").select(*keys, "copies", F.lit(level).alias("level"), "name"))
        rest = nodes.filter("left > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy(*keys, "copies", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.floor(F.col("part") / 2).cast("int").alias("part")).agg(
            F.max(F.when(F.col("part") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("part") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
        pairs = write_through(pairs)
        names = named(pairs, ["first", "second"])
        nodes = write_through(pairs.join(names, ["first", "second"]).select(*keys, "copies", "left", "part", "name"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text equals empty text. The largest
    doc_id of a group stays. Rows repeated with the same doc_id and text count in group_size and only
    the first of them is kept. A null doc_id is lower than any other. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = write_through(identities(docs, block_bytes))
    groups = write_through(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    told = rows.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return told.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def solid(doc_id: Column) -> Column:
    """A doc_id that joins and partitions like any other when it is null."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def staying(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are in ``kept``, one for each: the first in the order of all columns.

    Both sides are merged on the keys at any size, and the window works inside the same partitions, so
    the texts move once.
    """
    columns = [c for c in docs.columns if c not in keys and docs.schema[c].dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in columns])
    met = docs.join(kept.hint("merge"), keys, "left_semi")
    return met.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row", *keys)


def drop_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    kept = exact_groups(docs, block_bytes).filter("kept").select(solid(F.col("doc_id")).alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumn("_id", solid(F.col("doc_id"))).withColumn("_sha", F.sha2(F.encode(ascii_lower(F.col("text")), "UTF-8"), 256))
    return staying(marked, write_through(kept), ["_id", "_sha"])
