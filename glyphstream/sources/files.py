"""Files as rows (path, length, content), texts as rows, and line output."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.functions.lz4 import lz4_decode

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str | list[str], *, recursive: bool = False, include: str | None = None, exclude: str | None = None, ignore_missing: bool = False) -> DataFrame:
    """(path, length, content); .svn folders are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", ignore_missing)
    if include:
        reader = reader.option("pathGlobFilter", include)
    found = reader.load(path).where(~F.col("path").contains("/.svn/"))
    if exclude:
        like = exclude.replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        found = found.where(~F.element_at(F.split("path", "/"), -1).like(like))
    return found.select("path", "length", "content")


def read_lz4(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(path, content) with LZ4 frames decoded."""
    return read_files(spark, path, **options).select("path", lz4_decode(F.col("content")).alias("content"))


def with_text(files: DataFrame) -> DataFrame:
    """(path, text): invalid UTF-8 gives null, which nothing matches."""
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def read_stream(spark: SparkSession, path: str, *, include: str = "*") -> DataFrame:
    """A stream of whole files as they appear."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", include).load(path).select("path", "length", "content")


def from_texts(spark: SparkSession, texts: list[str], labels: list[str] | None = None) -> DataFrame:
    names = labels or [str(i) for i in range(len(texts))]
    return spark.createDataFrame(list(zip(names, texts)), "path string, text string")


def from_stdin(spark: SparkSession, label: str = "(standard input)") -> DataFrame:
    return from_texts(spark, [sys.stdin.buffer.read().decode("utf-8", "replace")], [label])


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a file, one a line; the list goes into a query's text, so it is meant to be short."""
    return [p for r in spark.read.text(path, wholetext=True).collect() for p in r[0].splitlines()]


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The column `line` as text files; only a finished write is seen."""
    df.select("line").write.mode(mode).text(path)
