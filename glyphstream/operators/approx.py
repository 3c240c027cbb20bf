"""Approximate search: where a pattern ends in a text within k edits, and the windows of several hits.

The recurrence keeps a row of bits for each edit count over all pattern positions (Wu and Manber),
for all patterns and many texts at once as NumPy integers, and steps over the places in them.  Long texts
are cut into chunks that overlap by pattern length plus k, so they too are many rows of a step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHABET = "ACGT"


def ends_within(texts: list[bytes], patterns: list[str], k: int) -> list[tuple[int, int, int, int]]:
    """(text index, pattern index, position of the last byte, least edits) of all ends with at most k edits.

    Letters outside the alphabet, in texts as in patterns, equal nothing.  Patterns have at most 62 letters.
    """
    size = np.array([len(p) for p in patterns], np.uint64)
    masks = np.zeros((256, len(patterns)), np.uint64)
    for j, p in enumerate(patterns):
        for i, c in enumerate(p.upper()):
            if c in ALPHABET:
                for b in (ord(c), ord(c.lower())):
                    masks[b, j] |= np.uint64(1 << i)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # those not yet at their end come first
    lengths = np.array([len(texts[i]) for i in order])
    longest = int(lengths.max(initial=0))
    signs = np.zeros((longest, len(texts)), np.uint8)
    for row, i in enumerate(order):
        signs[: len(texts[i]), row] = np.frombuffer(texts[i], np.uint8)
    going = np.searchsorted(-lengths, -np.arange(longest), "left")
    one, goal = np.uint64(1), np.uint64(1) << (size - np.uint64(1))
    rows = [np.full((len(texts), len(patterns)), (1 << d) - 1, np.uint64) for d in range(k + 1)]
    out = []
    for pos in range(longest):
        n = going[pos]
        before, hit = [r[:n] for r in rows], masks[signs[pos, :n]]
        rows = [((before[0] << one) | one) & hit]
        for d in range(1, k + 1):
            moved = ((before[d] << one) | one) & hit
            rows.append(moved | before[d - 1] | ((before[d - 1] | rows[d - 1]) << one) | np.uint64((1 << d) - 1))
        if not (rows[k] & goal).any():  # what ends with fewer edits ends with k too
            continue
        done = np.zeros(rows[0].shape, bool)
        for d in range(k + 1):
            new = ((rows[d] & goal) != 0) & ~done
            out += [(order[i], j, pos, d) for i, j in zip(*(x.tolist() for x in np.nonzero(new)))]
            done |= new
    return out


def prefix_groups(patterns: list[str], size: int) -> dict[str, list[str]]:
    """The sorted patterns by their first `size` letters; each group may be searched as a pattern list of its own."""
    groups: dict[str, list[str]] = {}
    for p in sorted(patterns):
        groups.setdefault(p[:size], []).append(p)
    return groups


def approx_find(df: DataFrame, key: str, data: str, patterns: list[str], k: int, chunk: int = 1 << 12) -> DataFrame:
    """(key, pattern, pos, dist) over a binary or string column; pos counts bytes from 0. Null texts have no hit."""
    for p in patterns:
        if not k < len(p) <= 62:
            raise ValueError("patterns have more than k and at most 62 letters")
    overlap = max(map(len, patterns), default=1) + k
    whole = F.col(data).cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(whole) - 1, F.lit(0)), F.lit(chunk))

    def part(start):
        """A chunk begins `overlap` bytes before the place from which its hits count; only its own bytes become a row."""
        base = F.greatest(start - overlap, F.lit(0))
        return F.struct(start.alias("start"), base.alias("base"), whole.substr(base + 1, start - base + chunk).alias("part"))

    cut = df.where(F.col(data).isNotNull()).select(F.col(key).alias("key"), F.explode(F.transform(starts, part)).alias("x")).select("key", "x.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["part"].map(len)
            for _, own in f.groupby((size.cumsum() - size) // (1 << 20)):  # a step's table stays small
                keys, bases, firsts = own["key"].tolist(), own["base"].tolist(), own["start"].tolist()
                hits = ends_within([bytes(x) for x in own["part"]], patterns, k)
                out = [(keys[i], patterns[j], bases[i] + pos, d) for i, j, pos, d in hits if bases[i] + pos >= firsts[i]]
                yield pd.DataFrame(out, columns=["key", "pattern", "pos", "dist"]).astype({"pos": "int64", "dist": "int32"})

    kind = dict(cut.dtypes)["key"]
    return cut.mapInPandas(run, f"key {kind}, pattern string, pos bigint, dist int").withColumnRenamed("key", key)


def candidate_windows(found: DataFrame, key: str, segments: int, total_length: int, error_rate: float, k: int) -> DataFrame:
    """(key, n1, n2): distinct hits (pos, dist), and those whose window's sum of dist is above segments * (k + 1) - total_length * error_rate.

    A window starts at its hit and is shorter than total_length * (1 + error_rate); each hit counts once in it, hits
    at the start's own place included.
    """
    reach = math.ceil(np.float32(total_length) * (np.float32(error_rate) + np.float32(1))) - 1
    bound = int(segments * (k + 1) - np.float32(total_length) * np.float32(error_rate))
    w = Window.partitionBy(key).orderBy("pos").rangeBetween(0, reach)
    hits = found.select(key, "pos", "dist").distinct().withColumn("total", F.sum("dist").over(w))
    return hits.groupBy(key).agg(F.count("*").alias("n1"), F.count_if(F.col("total") > bound).alias("n2"))
