"""Line queries over streams of text pieces: state per key holds the line count, the hits and the open line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from glyphstream.functions.regex import compile_regex

_BREAK = re.compile("\r\n|[\n\x0b\f\r\x85\u2028\u2029]")


def number_lines(stream: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """(key, line_no, line) of complete lines; the last, unterminated one waits in the state.

    Pieces of a key are put together in the order of seq within a batch, batches in their order.
    A CR at a piece's end waits for the next piece, since an LF may follow.
    """
    kind = dict(stream.dtypes)[key]

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, tail = state.get if state.exists else (0, "")
        pieces = pd.concat(list(frames)).sort_values("seq")
        whole = tail + "".join(x for x in pieces["text"] if x is not None)
        held = "\r" if whole.endswith("\r") else ""
        *done, tail = _BREAK.split(whole[: len(whole) - len(held)])
        state.update((n + len(done), tail + held))
        yield pd.DataFrame({"key": [name[0]] * len(done), "line_no": range(n + 1, n + len(done) + 1), "line": done})

    own = stream.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(text).alias("text"))
    return own.groupBy("key").applyInPandasWithState(run, f"key {kind}, line_no bigint, line string", "n bigint, tail string", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)


def grep_stream(stream: DataFrame, key: str, seq: str, text: str, pattern: str | list[str], *, invert: bool = False, **options) -> DataFrame:
    """Matching lines of number_lines."""
    hit = compile_regex(pattern, **options).predicate(F.col("line"))
    return number_lines(stream, key, seq, text).where(~hit if invert else hit)


def first_matches(stream: DataFrame, key: str, seq: str, text: str, pattern: str, most: int, **options) -> DataFrame:
    """At most `most` rows (key, n, text) per key over the whole stream, of pieces that are whole lines."""
    kind = dict(stream.dtypes)[key]
    own = stream.where(compile_regex(pattern, **options).predicate(F.col(text))).select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(text).alias("text"))

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values("seq").head(most - n)
        state.update((n + len(rows),))
        yield pd.DataFrame({"key": [name[0]] * len(rows), "n": range(n + 1, n + len(rows) + 1), "text": rows["text"].tolist()})

    return own.groupBy("key").applyInPandasWithState(run, f"key {kind}, n bigint, text string", "n bigint", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)


def count_stream(stream: DataFrame, key: str, text: str) -> DataFrame:
    """Running totals per key, for update or complete output."""
    from glyphstream.operators.counts import counters

    return stream.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in counters(F.col(text)).items()])


def windowed_counts(stream: DataFrame, time: str, key: str, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per time window and key; rows later than `late` are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
