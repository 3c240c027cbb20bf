"""Document fingerprints by SimHash, and the search for all fingerprints within a Hamming radius.

A term is a pair of neighbouring words (the only word of a text of one); its weight is its number
of letters, since long terms are rare.  Each term's 128 hash bits vote with that weight, and a
fingerprint has the bits that won.  A text without words has fingerprint zero.

Permuted block tables: a fingerprint is cut into blocks; two within radius r agree on all but r
blocks at least, so a table for each choice of agreeing blocks, keyed by them, finds every pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.common import cut, partitions, slices
from glyphstream.llm.hashing import bits_to_bytes, mix, signed_votes, stretches, words

BITS = 128
_SALT = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: str) -> bytes:
    """16 bytes; equal texts give equal ones."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts, ends = words(raw)
    if not len(starts):
        return bytes(BITS // 8)
    h, size = stretches(raw, starts, ends), (ends - starts).astype(np.float64)
    if len(h) > 1:
        h, size = mix(h[:-1] * np.uint64(3) + h[1:]), size[:-1] + size[1:]
    votes = np.concatenate([signed_votes(h, size), signed_votes(mix(h ^ _SALT), size)])
    return bits_to_bytes(votes > 0)


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of differing bits stands for, at least 0."""
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * apart / BITS))


def edited(text: str, other: str) -> str:
    """The last third of text replaced by as many signs from the start of other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc: int | None, text: str, own: bytes, other: str, next_own: bytes) -> tuple:
    """A row of RESULT."""
    changed = edited(text, other)
    f = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own.hex(), f.hex(), likeness(own, f), likeness(own, next_own)


def _result(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness to it and to the next's.

    The next document is the one with the next smaller doc_id, after the last the first; documents of equal
    doc_id follow one another by a hash of their text, and null doc_ids come last.  A null text counts as empty.  Equal rows
    have each other for next.  A table of one row has itself for next; an empty one gives no row.  Other columns are ignored.

    The texts are shuffled once, into ranges of (doc_id, text hash).  A range's first and last documents also
    go, with their texts, to a small table, where each last one is joined with the first of the next range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), F.xxhash64("text").alias("tie"))
    ranged = rows.repartitionByRange(partitions(spark), F.desc("at"), F.desc("tie")).sortWithinPartitions(F.desc("at"), F.desc("tie"), "text")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of RESULT (end 0), then the first and the last document (end 1 and 2) with their texts."""
        part, first, before = TaskContext.get().partitionId(), None, None  # documents as (doc_id, text, fingerprint)

        def batch_of(found: list[tuple], end: int, text: str | None) -> pa.RecordBatch:
            tail = [pa.array([end] * len(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([text] * len(found), pa.string())]
            return pa.RecordBatch.from_arrays([*_result(found), *tail], [*names, "end", "part", "text"])

        for batch in slices(batches, "text", 4 << 20):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = doc, text, fingerprint(text)
                if before:
                    out.append(_compared(*before, *now[1:]))
                first, before = first or now, now
            if out:
                yield batch_of(out, 0, None)
        if first:
            for end, (doc, text, _) in ((1, first), (2, before)):
                yield batch_of([(doc, *[None] * 6)], end, text)

    found = cut(ranged.select("doc_id", "text").mapInArrow(run, f"{RESULT}, end int, part int, text string"))
    used = sorted((r["part"] for r in found.where("end = 1").select("part").collect()))  # one of each range at most
    after = spark.createDataFrame([*zip(used, used[1:] + used[:1])], "part int, next int")
    firsts = found.where("end = 1").select(F.col("part").alias("next"), F.col("text").alias("other"))
    edges = found.where("end = 2").join(after, "part").join(firsts, "next").select("doc_id", "text", "other")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_compared(d, t, fingerprint(t), o, fingerprint(o)) for d, t, o in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(_result(out), names)

    return found.where("end = 0").select(*names).unionByName(edges.mapInArrow(join, RESULT))


def classes(docs: DataFrame) -> DataFrame:
    """(id, fingerprint, class) of rows (id, fingerprint): the class is the least id of equal fingerprints; null ones are left out."""
    own = docs.where("fingerprint is not null").select("id", "fingerprint")
    least = own.groupBy("fingerprint").agg(F.min("id").alias("class"))
    return own.join(least, "fingerprint").select("id", "fingerprint", "class")


def find_within(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (query_class, class, distance) whose fingerprints (hex, column `fingerprint`, beside `id`) lie within radius.

    Equal fingerprints are one class, named by its least id; classes() has its members, so a group of copies gives
    one row for each class near it.  One table for each choice of blocks - radius agreeing blocks; a pair that
    several tables find is kept by the first of them only, so no distinct is needed.  Null fingerprints match
    nothing; empty tables give no row.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be smaller than the number of blocks")
    tables = list(combinations(range(blocks), blocks - radius))
    digits = BITS // 4
    edges = [digits * k // blocks for k in range(blocks + 1)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        part = lambda k: F.substring("fingerprint", edges[k] + 1, edges[k + 1] - edges[k])
        keys = [F.struct(F.lit(i).alias("t"), F.concat(*[part(k) for k in t]).alias("key")) for i, t in enumerate(tables)]
        own = df.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias(name))
        return own.select(name, F.col("fingerprint").alias(f"{name}_fp"), F.explode(F.array(*keys)).alias("k")).select(name, f"{name}_fp", "k.t", "k.key")

    pairs = keyed(queries, "query_class").join(keyed(stored, "found"), ["t", "key"])
    half = lambda c, k: F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("bigint")
    apart = sum((F.bit_count(half("query_class_fp", k).bitwiseXOR(half("found_fp", k))) for k in range(2)), F.lit(0))
    same = [F.substring("query_class_fp", edges[k] + 1, edges[k + 1] - edges[k]) == F.substring("found_fp", edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
    first = F.array(*[F.when(s, F.lit(k)) for k, s in enumerate(same)])
    agreeing = F.slice(F.filter(first, lambda x: x.isNotNull()), 1, blocks - radius)
    chosen = F.element_at(F.array(*[F.array(*[F.lit(k) for k in t]) for t in tables]), F.col("t") + 1)
    return pairs.where(agreeing == chosen).withColumn("distance", apart).where(F.col("distance") <= radius).select("query_class", F.col("found").alias("class"), "distance")
