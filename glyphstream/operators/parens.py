"""Bracket matching by depth, with windows over the brackets alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brackets(df: DataFrame, key: str, text: str, opening: str = "(", closing: str = ")") -> DataFrame:
    """(key, pos, open): a row for each bracket, pos from 0 in signs."""
    signs = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("pos"), c.alias("ch")))
    own = F.filter(signs, lambda x: x["ch"].isin(opening, closing))
    return df.select(key, F.explode(own).alias("x")).select(key, "x.pos", (F.col("x.ch") == opening).alias("open"))


def depths(own: DataFrame, key: str) -> DataFrame:
    """Adds depth (of an opener, and of the opener that a closer ends) and valid; surplus closers count for nothing."""
    w = Window.partitionBy(key).orderBy("pos")
    step = own.withColumn("s", F.sum(F.when(F.col("open"), 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.min("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.least(F.lit(0), F.coalesce(F.min("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    deep = step.withColumn("low", low).withColumn("before", before)
    return deep.withColumn("valid", F.col("open") | (F.col("low") == F.col("before"))).withColumn("depth", F.col("s") - F.col("low") + F.when(F.col("open"), 0).otherwise(1)).drop("s", "low", "before")


def match_parens(df: DataFrame, key: str, text: str, opening: str = "(", closing: str = ")") -> DataFrame:
    """(key, open_pos, close_pos, depth) for each pair."""
    own = depths(brackets(df, key, text, opening, closing), key).where("valid")
    w = Window.partitionBy(key, "depth").orderBy("pos")
    pairs = own.withColumn("close_pos", F.when(~F.lead("open").over(w), F.lead("pos").over(w)))
    return pairs.where("open and close_pos is not null").select(key, F.col("pos").alias("open_pos"), "close_pos", "depth")


def paren_errors(df: DataFrame, key: str, text: str, opening: str = "(", closing: str = ")") -> DataFrame:
    """(key, pos, kind): closers without opener and openers never closed."""
    own = depths(brackets(df, key, text, opening, closing), key)
    w = Window.partitionBy(key, "valid", "depth").orderBy("pos")
    alone = own.withColumn("closed", ~F.coalesce(F.lead("open").over(w), F.lit(True)))
    return alone.where("not valid or (open and not closed)").select(key, "pos", F.when(F.col("open"), "unclosed").otherwise("surplus").alias("kind"))
