"""A command line with the usual flags of line search: python -m glyphstream.plans.cli PATTERN PATH...

Exit code 0: a line matched; 1: none did; 2: bad usage or pattern; 3: files are missing.
"""

from __future__ import annotations

import argparse
import os
import stat
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphstream.functions.regex import UnsupportedRegex, compile_regex
from glyphstream.operators import grep
from glyphstream.sources.files import from_stdin, read_files, read_patterns, with_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphgrep", description=__doc__, add_help=False)
    p.add_argument("--help", action="help")
    p.add_argument("-e", action="append", default=[], metavar="PATTERN")
    p.add_argument("-f", action="append", default=[], metavar="FILE")
    for flag, dialect in (("-E", "ere"), ("-G", "bre"), ("-P", "pcre"), ("--PROSITE", "prosite"), ("-F", "fixed")):
        p.add_argument(flag, dest="dialect", action="store_const", const=dialect, default="pcre")
    for flag in "ivwxcqnhHrRTZslLob":
        p.add_argument(f"-{flag}", dest=f"flag_{flag}", action="store_true")
    p.add_argument("-m", type=int)
    p.add_argument("-A", type=int, default=0)
    p.add_argument("-B", type=int, default=0)
    p.add_argument("-C", type=int, metavar="LINES", help="as -A and -B")
    p.add_argument("-d", choices=("read", "recurse", "skip"), default="read", help="what to do with directories")
    p.add_argument("-D", choices=("read", "skip"), default="read", help="what to do with devices")
    p.add_argument("--label", default="(standard input)")
    p.add_argument("--include")
    p.add_argument("--exclude")
    p.add_argument("--lf", action="store_true", help="lines end at line feeds only")
    p.add_argument("rest", nargs="*")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        o = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("glyphgrep").getOrCreate()
    patterns = o.e + [p for f in o.f for p in read_patterns(spark, f)]
    rest = list(o.rest)
    if not patterns:
        if not rest:
            return 2
        patterns.append(rest.pop(0))
    try:
        regex = compile_regex(patterns, o.dialect, ignore_case=o.flag_i, word=o.flag_w, whole_line=o.flag_x, select_only=not o.flag_o)
    except UnsupportedRegex as e:
        print(e, file=sys.stderr)
        return 2
    if o.C is not None:
        o.A = o.B = o.C
    o.flag_r = o.flag_r or o.flag_R or o.d == "recurse"
    if o.d == "skip":
        rest = [x for x in rest if not os.path.isdir(x)]
    if o.D == "skip":
        rest = [x for x in rest if not os.path.exists(x) or stat.S_ISREG(os.stat(x).st_mode) or os.path.isdir(x)]
    if o.rest and not rest and (o.e or o.f or len(o.rest) > 1):
        return 1  # all that was named is skipped
    try:
        df = with_text(read_files(spark, rest, recursive=o.flag_r, include=o.include, exclude=o.exclude, ignore_missing=o.flag_s)) if rest else from_stdin(spark, o.label)
        mode, named = "lf" if o.lf else "unicode", o.flag_H or (not o.flag_h and (len(rest) > 1 or o.flag_r))
        if o.flag_q:
            return 0 if grep.any_match(df, "text", regex, invert=o.flag_v, mode=mode) else 1
        if o.flag_l or o.flag_L:
            own = (grep.files_with_match if o.flag_l else grep.files_without_match)(df, "path", "text", regex, invert=o.flag_v, mode=mode).orderBy("path")
            out = own.select(F.col("path").alias("line"))
        elif o.flag_c:
            own = grep.count(df, "path", "text", regex, invert=o.flag_v, max_count=o.m, mode=mode).orderBy("path")
            rows = own.toLocalIterator()
            total = 0
            for r in rows:
                total += r["n"]
                print(f"{r['path']}:{r['n']}" if named else r["n"])
            return 0 if total else 1
        elif o.flag_o:
            own = grep.only_matching(df, "path", "text", regex, mode=mode).withColumnRenamed("match", "line").orderBy("path", "line_no")
            out = grep.formatted(own, "path", with_key=named, line_numbers=o.flag_n, null_after_name=o.flag_Z, initial_tab=o.flag_T)
        elif o.flag_b:
            own = grep.byte_offsets(df, "path", "text", regex).orderBy("path", "offset")
            own = own.select("path", F.lit(0).alias("line_no"), F.concat(F.col("offset").cast("string"), F.lit(":"), "line").alias("line"))
            out = grep.formatted(own, "path", with_key=named, null_after_name=o.flag_Z, initial_tab=o.flag_T)
        else:
            own = grep.match(df, "path", "text", regex, invert=o.flag_v, max_count=o.m, before=o.B, after=o.A, mode=mode).orderBy("path", "line_no")
            out = grep.formatted(own, "path", with_key=named, line_numbers=o.flag_n, null_after_name=o.flag_Z, initial_tab=o.flag_T)
        found = False
        for r in out.toLocalIterator():
            found = True
            print(r["line"])
        return 0 if found else 1
    except AnalysisException as e:
        if not o.flag_s:
            print(str(e).splitlines()[0], file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
