"""Line search: which lines of which texts match, how many, and in which texts.

Counts, file lists and yes/no answers work on arrays of lines inside a row, so they need no
shuffle and no row per line; only output of lines explodes them.  Keys without a match keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions.regex import CompiledRegex, compile_regex
from glyphstream.operators.lines import line_array, lines


def _compiled(pattern: str | list[str] | CompiledRegex, **options) -> CompiledRegex:
    return pattern if isinstance(pattern, CompiledRegex) else compile_regex(pattern, **options)


def _test(pattern, invert: bool, options: dict):
    regex = _compiled(pattern, **options)
    return lambda x: ~regex.predicate(x) if invert else regex.predicate(x)


def _possible(text: Column, pattern, invert: bool, options: dict) -> Column:
    """False for texts that can't have a hit, told without splitting them."""
    plain = None if invert else _compiled(pattern, **options).plain
    return F.lit(True) if plain is None else text.contains(plain)


def hits(text: Column, pattern, *, invert: bool = False, mode: str = "unicode", **options) -> Column:
    """The matching lines of a text as an array."""
    return F.filter(line_array(text, mode), _test(pattern, invert, options))


def count(df: DataFrame, key: str, text: str, pattern, *, invert: bool = False, max_count: int | None = None, mode: str = "unicode", **options) -> DataFrame:
    """(key, n): matching lines of each text, also where n is 0; null texts have none."""
    n = F.size(hits(F.col(text), pattern, invert=invert, mode=mode, **options))
    n = F.coalesce(F.when(_possible(F.col(text), pattern, invert, options), n), F.lit(0))
    if max_count is not None:
        n = F.least(n, F.lit(max_count))
    return df.select(key, F.greatest(n, F.lit(0)).cast("bigint").alias("n"))


def has_match(text: Column, pattern, *, invert: bool = False, mode: str = "unicode", **options) -> Column:
    found = F.exists(line_array(text, mode), _test(pattern, invert, options))
    return F.coalesce(_possible(text, pattern, invert, options) & found, F.lit(False))


def files_with_match(df: DataFrame, key: str, text: str, pattern, **options) -> DataFrame:
    return df.where(has_match(F.col(text), pattern, **options)).select(key)


def files_without_match(df: DataFrame, key: str, text: str, pattern, **options) -> DataFrame:
    return df.where(~has_match(F.col(text), pattern, **options)).select(key)


def any_match(df: DataFrame, text: str, pattern, **options) -> bool:
    """Stops at the first text that has a match."""
    return not df.where(has_match(F.col(text), pattern, **options)).limit(1).isEmpty()


def match(df: DataFrame, key: str, text: str, pattern, *, invert: bool = False, max_count: int | None = None, mode: str = "unicode", before: int = 0, after: int = 0, **options) -> DataFrame:
    """(key, line_no, line): matching lines; with context also those around, and then `hit` tells them apart.

    max_count holds for each key.  Without limit and context this is a filter without a shuffle.
    """
    test = _test(pattern, invert, options)
    if not before and not after:
        # lines that can't match are dropped before they become rows
        numbered = F.transform(line_array(F.col(text), mode), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line")))
        found = F.filter(numbered, lambda x: test(x["line"]))
        if max_count is not None:
            found = F.slice(found, 1, max_count)
        return df.where(_possible(F.col(text), pattern, invert, options)).select(key, F.explode(found).alias("x")).select(key, "x.line_no", "x.line")
    own = lines(df, key, text, mode).withColumn("hit", test(F.col("line")))
    order = Window.partitionBy(key).orderBy("line_no")
    if max_count is not None:
        own = own.withColumn("hit", F.col("hit") & (F.sum(F.col("hit").cast("int")).over(order) <= max_count))
    near = F.max("hit").over(order.rowsBetween(-before, after)) if before == after else F.max("hit").over(order.rowsBetween(-after, before))
    return own.withColumn("near", near).where("near").select(key, "line_no", "line", "hit")


def which(df: DataFrame, key: str, text: str, patterns: list[str], *, mode: str = "unicode", **options) -> DataFrame:
    """(key, line_no, line, patterns): lines that any pattern matches, with the indices of all that do, in one pass.

    Each pattern is compiled once into the plan, so no join and no pattern column is needed.
    """
    tests = [_test(p, False, options) for p in patterns]

    def marked(x: Column, i: Column) -> Column:
        own = F.filter(F.array(*[F.when(t(x), F.lit(k)) for k, t in enumerate(tests)]), lambda k: k.isNotNull())
        return F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line"), own.alias("patterns"))

    found = F.filter(F.transform(line_array(F.col(text), mode), marked), lambda x: F.size(x["patterns"]) > 0)
    return df.select(key, F.explode(found).alias("x")).select(key, "x.line_no", "x.line", "x.patterns")


def only_matching(df: DataFrame, key: str, text: str, pattern, *, mode: str = "unicode", **options) -> DataFrame:
    """(key, line_no, match): each non-empty matched part of each line, in order."""
    regex = _compiled(pattern, **(options | {"select_only": False}))
    java = regex.java if regex.java.startswith("(?U)") else f"(?U){regex.java}"
    own = lines(df, key, text, mode)
    parts = F.regexp_extract_all("line", F.lit(java), 0)
    return own.select(key, "line_no", F.explode(F.filter(parts, lambda x: x != "")).alias("match"))


def byte_offsets(df: DataFrame, key: str, text: str, pattern, **options) -> DataFrame:
    """(key, offset, line): matching lines with the byte at which they start; LF lines."""
    own = lines(df, key, text, "lf")
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("line") + F.octet_length("eol")).over(order), F.lit(0))
    return own.withColumn("offset", at).where(_test(pattern, False, options)(F.col("line"))).select(key, "offset", "line")


def formatted(found: DataFrame, key: str, *, with_key: bool = True, line_numbers: bool = False, label: str | None = None, null_after_name: bool = False, initial_tab: bool = False) -> DataFrame:
    """One column `line` as a terminal would show it."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(label)) if label else F.col(key).cast("string")
    head = F.concat(name, F.lit("\0" if null_after_name else ":")) if with_key else F.lit("")
    number = F.concat(F.col("line_no").cast("string"), F.lit(":")) if line_numbers else F.lit("")
    tab = F.lit("\t" if initial_tab and (with_key or line_numbers) else "")
    return found.select(F.concat(head, number, tab, "line").alias("line"))
