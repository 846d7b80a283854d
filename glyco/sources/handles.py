"""Files opened inside tasks: heads, ranges and whole files as streams, never as cells."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1 << 16
HEAD_LIMIT = 1 << 20  # bytes of a file that a probe reads at most


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path`` (as a URL) and ``length`` of every non-empty file; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def opened(url: str) -> BinaryIO:
    """A seekable stream of a file named by its URL; folders that are mounted need no further library."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    return system.open_input_file(path)


def first_line(stream: BinaryIO, most: int = HEAD_LIMIT) -> str | None:
    """The first line that is not empty, from as few steps of ``STEP`` bytes as hold it, ``most`` bytes at most."""
    text = b""
    while len(text) < most:
        more = stream.read(min(STEP, most - len(text)))
        text += more
        line, end, _ = text.lstrip(b"\r\n").replace(b"\r", b"\n").partition(b"\n")
        if end or not more:
            break
    else:
        line = text
    return line.decode("utf-8", "replace") or None


def heads(files: DataFrame) -> DataFrame:
    """``path, header``: the first line of every listed file; a file that cannot be read has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for path in batch["path"]:
                try:
                    with opened(path) as stream:
                        lines.append(first_line(stream))
                except OSError:
                    lines.append(None)
            yield pd.DataFrame({"path": batch["path"], "header": pd.Series(lines, dtype=object)})

    return files.select("path").mapInPandas(read, "path string, header string")


def digests(files: DataFrame) -> DataFrame:
    """``path, length, md5, sha256`` of every listed file, each read as a stream of ``STEP`` bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                md5, sha = hashlib.md5(usedforsecurity=False), hashlib.sha256()
                with opened(path) as stream:
                    while part := stream.read(STEP):
                        md5.update(part)
                        sha.update(part)
                found.append((md5.hexdigest(), sha.hexdigest()))
            yield batch.assign(md5=[m for m, _ in found], sha256=[s for _, s in found])

    return files.select("path", "length").mapInPandas(read, "path string, length long, md5 string, sha256 string")


def range_digests(files: DataFrame, range_bytes: int = 1 << 26) -> DataFrame:
    """``path, n, part, sha256`` of every range (``n`` per file) of ``range_bytes``, so that one large file is many rows of work."""
    parts = F.ceil(F.col("length") / range_bytes)
    ranges = files.select("path", parts.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, part in zip(batch["path"], batch["part"]):
                sha, left = hashlib.sha256(), range_bytes
                with opened(path) as stream:
                    stream.seek(int(part) * range_bytes)
                    while left and (piece := stream.read(min(STEP, left))):
                        sha.update(piece)
                        left -= len(piece)
                found.append(sha.hexdigest())
            yield batch.assign(sha256=found)

    # Ranges of one file are dealt to all tasks.
    return ranges.repartition(F.xxhash64("path", "part")).mapInPandas(read, "path string, n long, part long, sha256 string")


def stream_files(files: DataFrame, func: Callable[[str, BinaryIO], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``func(path, stream)`` of every listed file; it yields tables as it reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with opened(path) as stream:
                    yield from func(path, stream)

    return files.select("path").mapInPandas(run, schema)
