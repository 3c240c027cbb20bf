"""Marker streams: boolean columns over the ordered positions of a key, moved by window functions.

Frames are (key, pos, booleans).  A marker stands at a position; a missing neighbour is False.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, key: str, text: str, *, end_row: bool = False) -> DataFrame:
    """(key, pos from 0, ch), one row for each sign; with end_row one more behind the last, ch ''."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    if end_row:
        signs = F.concat(signs, F.array(F.lit("")))
    return df.select(key, F.posexplode(signs).alias("pos", "ch"))


def order(key: str, pos: str = "pos"):
    return Window.partitionBy(key).orderBy(pos)


def advance(x: Column, n: int, w) -> Column:
    return F.lag(x, n, False).over(w)


def lookahead(x: Column, n: int, w) -> Column:
    return F.lead(x, n, False).over(w)


def select(c: Column, a: Column, b: Column) -> Column:
    return F.when(c, a).otherwise(b)


def char_class(ch: Column, java_class: str) -> Column:
    return ch.rlike(f"^{java_class}$")


def in_file(pos: Column, n: Column) -> Column:
    return pos < n


def at_eof(pos: Column, n: Column) -> Column:
    return pos == n


def _island(df: DataFrame, key: str, stop: Column, pos: str) -> DataFrame:
    """Adds __island: a position that meets stop is the last of its island."""
    before = order(key, pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__island", F.coalesce(F.sum(stop.cast("int")).over(before), F.lit(0)))


def _marked(key: str, m: Column, pos: str) -> Column:
    return F.max(m).over(Window.partitionBy(key, "__island").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))


def match_star(df: DataFrame, key: str, m: Column, c: Column, name: str, pos: str = "pos") -> DataFrame:
    """All positions that a marker of m reaches through c, its own included."""
    return _island(df, key, ~c, pos).withColumn(name, _marked(key, m, pos)).drop("__island")


def scan_thru(df: DataFrame, key: str, m: Column, c: Column, name: str, pos: str = "pos") -> DataFrame:
    """Each marker moves to the first position, from its own on, that isn't in c."""
    return _island(df, key, ~c, pos).withColumn(name, ~c & _marked(key, m, pos)).drop("__island")


def scan_to(df: DataFrame, key: str, m: Column, t: Column, name: str, pos: str = "pos") -> DataFrame:
    """Each marker moves to the first position, from its own on, that is in t."""
    return _island(df, key, t, pos).withColumn(name, t & _marked(key, m, pos)).drop("__island")


def advance_then_scan_thru(df: DataFrame, key: str, m: Column, c: Column, name: str, pos: str = "pos") -> DataFrame:
    own = df.withColumn("__m", advance(m, 1, order(key, pos)))
    return scan_thru(own, key, F.col("__m"), c, name, pos).drop("__m")


def advance_then_scan_to(df: DataFrame, key: str, m: Column, t: Column, name: str, pos: str = "pos") -> DataFrame:
    own = df.withColumn("__m", advance(m, 1, order(key, pos)))
    return scan_to(own, key, F.col("__m"), t, name, pos).drop("__m")


def count(df: DataFrame, key: str, x: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(x).alias("n"))


def delete(df: DataFrame, key: str, mask: Column, pos: str = "pos") -> DataFrame:
    """Rows without those of the mask, with positions counted anew."""
    return df.where(~mask).withColumn(pos, (F.row_number().over(order(key, pos)) - 1).cast("int"))


def spread(df: DataFrame, key: str, mask: Column, values: DataFrame, value: str, name: str, pos: str = "pos") -> DataFrame:
    """The k-th position of the mask gets the k-th of values (key, pos, value); others null."""
    rank = F.when(mask, F.sum(mask.cast("int")).over(order(key, pos)) - 1)
    other = values.select(F.col(key).alias("__k"), F.col(pos).alias("__r"), F.col(value).alias(name))
    own = df.withColumn("__rank", rank)
    return own.join(other, (own[key] == F.col("__k")) & (own["__rank"] == F.col("__r")), "left").drop("__k", "__r", "__rank")


def render(df: DataFrame, key: str, x: Column, pos: str = "pos") -> DataFrame:
    """(key, bits): the stream as 1 and . in order."""
    own = F.sort_array(F.collect_list(F.struct(F.col(pos), F.when(x, "1").otherwise(".").alias("b"))))
    return df.groupBy(key).agg(F.array_join(F.transform(own, lambda r: r["b"]), "").alias("bits"))


def fixpoint(df: DataFrame, step, key: str, column: str, pos: str = "pos", rounds: int = 1000) -> DataFrame:
    """Applies step until the column no longer changes; each round is cut off by a checkpoint."""
    before = None
    for _ in range(rounds):
        now = df.agg(F.sum(F.when(F.col(column), F.xxhash64(key, pos)).cast("decimal(38,0)"))).first()[0]
        if before is not None and now == before[0]:
            break
        before = (now,)
        df = step(df).checkpoint()
    return df
