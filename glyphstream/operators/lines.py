"""Texts as lines: breaks are LF, VT, FF, CR, NEL, LS, PS, and CR LF as one.

An unterminated last line counts, a terminated one adds no empty line, an empty text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"
MODES = {"unicode": BREAK, "lf": r"\n", "nul": r"\x00"}


def line_array(text: Column, mode: str = "unicode") -> Column:
    """The lines of a text, without terminators; null for a null text."""
    # the parts are bound to a name, since an expression used several times is computed several times
    trimmed = F.transform(F.array(F.split(text, MODES[mode], -1)), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return F.get(trimmed, 0)


def break_array(text: Column, mode: str = "unicode") -> Column:
    """The terminators of a text in order; the last line may have none."""
    return F.regexp_extract_all(text, F.lit(f"({MODES[mode]})"), 1)


def lines(df: DataFrame, key: str, text: str, mode: str = "unicode") -> DataFrame:
    """(key, line_no from 1, line, eol): one row for each line; eol is '' where it has no terminator."""
    own = df.select(F.col(key), line_array(F.col(text), mode).alias("a"), break_array(F.col(text), mode).alias("b"))
    return own.select(key, "b", F.posexplode("a").alias("pos", "line")).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line", F.coalesce(F.get("b", F.col("pos")), F.lit("")).alias("eol"))
