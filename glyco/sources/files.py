"""Device exports, archives, integrity and inventory."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import parse_time, participant_from_path
from ..schema import CORE, KEY, NA_TOKENS, TIME
from ..plans.ranking import sorted_index
from ..session import write_through
from .handles import digests, heads, listing, range_digests

CSV = "*.csv"
# Columns every export must have; the participant comes from the path.
REQUIRED = [f.name for f in CORE.fields if f.name != KEY]


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )


def probe_headers(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Header, missing columns and completeness of every CSV file with a line; only the heads of the files are read."""
    header = heads(listing(spark, path, CSV)).filter("header is not null")
    names = F.transform(F.split("header", ","), _header_cell)
    wanted = F.array(*[F.lit(c) for c in (required or REQUIRED)])
    return (
        header.withColumn("columns", names)
        .withColumn("missing", F.array_except(wanted, F.col("columns")))
        .withColumn("complete", F.size("missing") == 0)
    )


def skipped_files(spark: SparkSession, path: str, required: list[str] | None = None, pattern: str = CSV) -> DataFrame:
    """``(path, reason)`` of the files that give no readings: without a line, or without a required column."""
    probed = probe_headers(spark, path, required).select("path", "missing")
    named = listing(spark, path, pattern).select("path").join(probed, "path", "left")
    reason = F.when(F.col("missing").isNull(), "no readable line").when(
        F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", "))
    )
    return named.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("path", "reason")


def read_cgm_csv(spark: SparkSession, path: str, schema: T.StructType = CORE) -> DataFrame:
    """All CSV files below ``path`` in the core schema, extra columns kept as text.

    The heads of the files are read first, then the files once, whatever their number and headers; the cells of a
    row are taken by the header of its own file. Only the column names reach the
    driver. Missing-value tokens and unparseable values become NULL. Unreadable files are skipped
    (:func:`skipped_files` names them); it is an error when no row can be read.
    """
    headers = write_through(probe_headers(spark, path, []).select("path", "columns"))
    columns = sorted(r["c"] for r in headers.select(F.explode("columns").alias("c")).distinct().collect())
    if not columns:
        raise FileNotFoundError(f"no CSV file below {path}")
    width = headers.agg(F.max(F.size("columns"))).first()[0]
    raw = (
        spark.read.schema(", ".join(f"_c{i} string" for i in range(width)))
        .option("mode", "PERMISSIVE")
        .option("ignoreCorruptFiles", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV)
        .csv(path)
    )
    cells = F.array(*[F.col(f"_c{i}") for i in range(width)])
    at = F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.array_position(F.col("columns"), c).cast("int") - 1)
    rows = raw.select(F.col("_metadata.file_path").alias("_path"), cells.alias("_cells"))
    rows = rows.join(headers.select(F.col("path").alias("_path"), "columns", at.alias("_at")), "_path")
    own = F.slice("_cells", F.lit(1), F.size("columns"))
    rows = rows.filter(F.transform(own, lambda c: _header_cell(F.coalesce(c, F.lit("")))) != F.col("columns"))
    table = rows.select("_path", *[F.when(F.get("_at", F.lit(k)) >= 0, F.get("_cells", F.get("_at", F.lit(k)))).alias(c) for k, c in enumerate(columns)])
    declared = {f.name: f.dataType for f in schema.fields}
    out = []
    for c in columns:
        text = F.when(~F.trim(F.col(f"`{c}`")).isin(NA_TOKENS), F.col(f"`{c}`"))
        kind = declared.get(c, T.StringType())
        if c == TIME:
            text = parse_time(text)
        elif not isinstance(kind, T.StringType):
            text = text.try_cast(kind)
            if isinstance(kind, T.DoubleType):
                text = F.nanvl(text, F.lit(None).cast("double"))
        out.append(text.alias(c))
    if KEY not in columns:
        out.append(participant_from_path(F.col("_path")).alias(KEY))
    if table.isEmpty():
        raise ValueError(f"no row could be read below {path}")
    return table.select(*out)


def _header_cell(cell: Column) -> Column:
    return F.trim(F.btrim(cell, F.lit('"\ufeff')))


def file_integrity(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Size, MD5 and SHA-256 of every file, each streamed inside a task.

    Spark lists no empty files; :func:`verify_files` reports an expected file that is
    empty or missing as not intact.
    """
    return digests(listing(spark, path, pattern))


def verify_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare ``file_integrity`` with ``path, expected_hash`` (MD5 or SHA-256)."""
    return files.join(expected, "path", "full_outer").withColumn(
        "intact",
        F.coalesce(
            F.col("md5").isNotNull()
            & (F.col("expected_hash").isNull() | F.col("expected_hash").isin(F.col("md5"), F.col("sha256"))),
            F.lit(False),
        ),
    )


def _tree(rows: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Fold ``keys, n, at, sha256`` (``n`` per key) to one hash per key: ``fan`` neighbours become the hash of their hashes."""
    in_order = F.array_sort(F.collect_list(F.struct("at", "sha256")))
    folded = F.sha2(F.concat_ws("", F.transform(in_order, lambda x: x["sha256"])), 256).alias("sha256")
    out = None
    while True:
        rows = write_through(rows.groupBy(*keys, F.ceil(F.col("n") / fan).alias("n"), F.floor(F.col("at") / fan).alias("at")).agg(folded))
        done, rows = rows.filter("n = 1").select(*keys, "sha256"), rows.filter("n > 1")
        out = done if out is None else out.unionByName(done)
        if rows.isEmpty():
            return out


def folder_hash(files: DataFrame, fan: int = 1024) -> DataFrame:
    """``folder_sha256, n_files``: one hash over the file hashes in path order.

    Up to ``fan`` files it is the hash of their joined hashes; more are folded in a tree of ``fan`` branches, a level at
    a time, so no task holds more than ``fan`` hashes.
    """
    ranked, n = sorted_index(files.select("path", "sha256"), ["path"], "at")
    return _tree(ranked.select(F.lit(n).alias("n"), "at", "sha256"), [], fan).select(F.col("sha256").alias("folder_sha256"), F.lit(n).cast("long").alias("n_files"))


def file_trees(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = 1 << 26, fan: int = 1024) -> DataFrame:
    """``path, tree_sha256``: a hash tree over ranges of every file, so that files of any size are hashed side by side.

    A file of one range has the hash of its hash; any change in a range changes the root.
    """
    ranges = range_digests(listing(spark, path, pattern), range_bytes).withColumnRenamed("part", "at")
    return _tree(ranges, ["path"], fan).withColumnRenamed("sha256", "tree_sha256")


def dataset_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and change time of every file; contents are not read."""
    return _files(spark, path, pattern).select("path", "length", F.col("modificationTime").alias("modified"))


ENTRY_SCHEMA = "archive string, entry string, size bigint, crc_ok boolean, text string"


def _entries(name: str, stream, pattern: str) -> Iterator[tuple]:
    """Entries of one archive and of archives inside it; bad ones are reported, not raised."""
    try:
        archive = zipfile.ZipFile(stream)
    except zipfile.BadZipFile:
        yield name, None, None, False, None
        return
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            try:
                content = archive.read(info)
            except (zipfile.BadZipFile, RuntimeError, OSError):
                yield name, info.filename, info.file_size, False, None
                continue
            if info.filename.lower().endswith(".zip"):
                yield name, info.filename, info.file_size, True, None
                yield from _entries(f"{name}!{info.filename}", io.BytesIO(content), pattern)
            else:
                wanted = info.filename.lower().endswith(pattern)
                text = content.decode("utf-8", "replace") if wanted else None
                yield name, info.filename, info.file_size, True, text


def archive_entries(spark: SparkSession, path: str, text_suffix: str = ".csv") -> DataFrame:
    """Entries of all ZIP files below ``path`` with a CRC check, nested archives included.

    ``text`` holds the content of entries with the given suffix.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["archive", "entry", "size", "crc_ok", "text"]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for row in _entries(name, io.BytesIO(content), text_suffix):
                    yield pd.DataFrame([row], columns=names).astype({"size": "Int64"})

    return _files(spark, path, "*.zip").select("path", "content").mapInPandas(run, ENTRY_SCHEMA)
