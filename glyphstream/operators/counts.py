"""Line, word, character and byte counts, with a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counters(text: Column) -> dict[str, Column]:
    """lines counts line feeds; words are runs without white space."""
    return {"lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), "words": F.regexp_count(text, F.lit(r"\S+")), "chars": F.length(text), "bytes": F.octet_length(text)}


def wc(df: DataFrame, key: str, text: str, *, columns: tuple[str, ...] = ("lines", "words", "chars", "bytes"), total: bool = False) -> DataFrame:
    """key and counts (0 for null texts); with total one more row, key 'total', from partial sums."""
    own = df.select(F.col(key).cast("string").alias(key) if total else F.col(key), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counters(F.col(text)).items() if n in columns])
    if not total:
        return own
    return own.unionByName(own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).select(F.lit("total").alias(key), *columns))


def observed(df: DataFrame, text: str, to: Observation) -> DataFrame:
    """df unchanged; when an action has run over it, `to.get` holds the rows, null texts and bytes that passed here."""
    return df.observe(to, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(text).isNull()).alias("nulls"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
