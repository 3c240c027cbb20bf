"""What the operators of this subpackage share: tables, hashes, folders, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of so many rows to Python, where the session sets no other size: 10,000 whole texts take much memory on both sides."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the value written as text, modulo m; a null value counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % m, F.lit(0).cast("bigint"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.

    A temporary one is set only where there is none and all tasks run in this machine's process; on a
    cluster its executors could not see it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="glyph-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Frees the shuffle files and checkpoints of tables that nothing refers to: they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hash_bound(most: int, n: int) -> int:
    """The bound below which about `most` of n hashes of 63 bits lie, at any n; 2**63 - 1, that is all, where n isn't larger."""
    return (1 << 63) - 1 if n <= most else max(1, (most << 63) // n)


def hash_rank(*cols: str, salt: str = "sample") -> Column:
    """A hash of cols with 63 bits: the same at every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(salt)), 1)


def hash_sample(ids: DataFrame, most: int, n: int) -> DataFrame:
    """The `most` different rows of ids with the least hashes, n being about how many there are: none only if ids is empty."""
    # twice as many and 64 are looked at, so that fewer than `most` are not to be expected
    near = ids.withColumn("_rank", hash_rank(*ids.columns)).where(F.col("_rank") <= hash_bound(2 * most + 64, n)).distinct()
    return near.orderBy("_rank", *ids.columns).limit(most).drop("_rank")


def kept_names(keep: list[str], own: list[str]) -> list[str]:
    """Names for kept columns beside results named `own`: one that clashes gets `_of_docs` behind it, as often as needed."""
    out: list[str] = []
    for c in keep:
        while c in own or c in out:
            c += "_of_docs"
        out.append(c)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice's texts have about `most` bytes (or it has a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # a worker lives on beside those of other stages


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)
