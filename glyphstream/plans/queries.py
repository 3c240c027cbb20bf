"""Headline queries over the test tables, each with the SQL that gives the same rows where SQL can.

Keys of QUERIES name the operator; the comment before a group gives the rows of SURVEY section 2 it covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.functions import codecs
from glyphstream.functions.lz4 import lz4_decode, lz4_encode
from glyphstream.functions.regex import any_of, compile_regex
from glyphstream.operators import approx, bits, counts, grep, parens
from glyphstream.operators.lines import line_array, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_BREAK = r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"


def _lines_sql(table: str, key: str, text: str) -> str:
    """A WITH clause: l(key, a), the array of lines of each row of a table."""
    return f"WITH s AS (SELECT {key}, {text} AS text, string_split_regex({text}, '{_BREAK}') AS a FROM {table}), l AS (SELECT {key}, text, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM s)"


DOC_LINES = _lines_sql("documents", "doc_id", "text")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# S3, S13, section 2.4: lines


@query(f"{DOC_LINES} SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines FROM l")
def line_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(line_array(F.col("text"))).cast("bigint").alias("n_lines"))


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(length(line) AS BIGINT) AS size FROM e")
def line_rows(spark, d):
    return lines(docs(spark, d), "doc_id", "text").select("doc_id", "line_no", F.length("line").cast("bigint").alias("size"))


# Line search in its modes


def _count_sql(test: str, key: str = "doc_id", base: str = DOC_LINES) -> str:
    return f"{base} SELECT {key}, CAST(len(list_filter(a, lambda x: {test})) AS BIGINT) AS n FROM l"


@query(_count_sql("regexp_matches(x, 'th[ae]')"))
def grep_count(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", "th[ae]")


@query(_count_sql("contains(x, 'License')"))
def grep_fixed(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", "License", dialect="fixed")


@query(_count_sql("NOT regexp_matches(x, 'th[ae]')"))
def grep_invert(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", "th[ae]", invert=True)


@query(_count_sql("regexp_matches(x, '(?i)the (on|in)')"))
def grep_ignore_case(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", "the (on|in)", ignore_case=True)


@query(_count_sql(r"regexp_matches(x, '(^|[^\p{L}\p{N}_])(the|of)($|[^\p{L}\p{N}_])')"))
def grep_word(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", ["the", "of"], word=True)


@query(_count_sql(r"regexp_full_match(x, '[A-Z][a-z]+ .*\.')"))
def grep_whole_line(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"[A-Z][a-z]+ .*\.", whole_line=True)


@query(_count_sql(r"regexp_matches(x, 'ing\b') OR regexp_matches(x, '^The') OR contains(x, '@')"))
def grep_multi(spark, d):
    tests = [compile_regex(p) for p in (r"ing\b", "^The", "@")]
    own = F.filter(line_array(F.col("text")), lambda x: any_of(*[t.predicate(x) for t in tests]))
    return docs(spark, d).select("doc_id", F.size(own).cast("bigint").alias("n"))


@query(_count_sql(r"regexp_matches(x, '\p{Lu}\p{Ll}{3,}ung')"))
def grep_property(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\p{Uppercase_Letter}\p{gc=Ll}{3,}ung")


@query(_count_sql(r"regexp_matches(x, '[b-df-hj-np-tv-xz]{4}')"))
def grep_class_algebra(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"[[a-z]--[aeiouy]]{4}")


@query(_count_sql(r"regexp_matches(x, '(th|er){3,5}on*')"))
def grep_ere(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", "(th|er){3,5}on*", dialect="ere")


@query(_count_sql(r"regexp_matches(x, '(th|er){3,5}')"))
def grep_bre(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\(th\|er\)\{3,5\}", dialect="bre")


def _class_sql(chars: str) -> str:
    return _count_sql(f"regexp_matches(x, '{chars}')")


# In texts of ASCII and Latin letters these sets are the ranges in the SQL
@query(_class_sql(r"[\x22\x27\x{AB}\x{BB}\x{2018}-\x{201F}]\w"))
def grep_binary_property(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\p{QMark}[a-zA-Z0-9_]")


@query(_class_sql(r"[0-9][,.:;][0-9]"))
def grep_line_break(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\p{lb=NU}\p{lb=IS}\p{Line_Break=Numeric}")


@query(_class_sql(r"[\x2D\x{58A}\x{5BE}\x{2010}-\x{2015}\x{2212}]"))
def grep_dash(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\p{Dash}")


@query(_class_sql(r"[a-z][0-9]"))
def grep_word_break(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"[[a-z]&&\p{wb=/letter$/}]\p{WB=Numeric}")


# U2, U6, U9, U10, U13, R11
@query(_class_sql(r"\p{Latin}{14}"))
def grep_script(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\p{Script=Latn}{14}")


@query(_class_sql(r"[^\x00-\x7F]."))
def grep_not_ascii(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\P{ascii}\p{any}")


@query(_class_sql(r"[\p{Lu}\p{Lt}][\p{Lu}\p{Lt}]"))
def grep_value_pattern(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\p{gc=/^(upper|title)case_letter$/}{2}")


@query(_class_sql(r"\x{FC}[a-z]"))
def grep_named_sign(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\N{LATIN SMALL LETTER U WITH DIAERESIS}[a-z]")


@query(_class_sql(r"[h-m]{3}"))
def grep_intersection(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"[[a-m]&&[h-z]]{3}")


_WHICH = ["th[ae]", "License", r"\d{4}"]


# All patterns in one pass, with their identity
@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l), t AS (SELECT doc_id, line_no, " + " || ".join(f"CASE WHEN regexp_matches(line, '{p.replace(chr(92) + 'd', '[0-9]')}') THEN '{k},' ELSE '' END" for k, p in enumerate(_WHICH)) + " AS patterns FROM e) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, rtrim(patterns, ',') AS patterns FROM t WHERE patterns <> ''")
def grep_which(spark, d):
    own = grep.which(docs(spark, d), "doc_id", "text", _WHICH)
    return own.select("doc_id", "line_no", F.array_join(F.col("patterns").cast("array<string>"), ",").alias("patterns"))


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"SELECT doc_id, regexp_matches(replace(translate(text, '{_SMALL}', '{_LARGE}'), chr(10), ' '), 'N[^P][ST][^P]') AS hit FROM documents")
def grep_prosite(spark, d):
    motif = compile_regex("N-{P}-[ST]-{P}", "prosite")
    return docs(spark, d).select("doc_id", motif.predicate(F.translate("text", _SMALL + "\n", _LARGE + " ")).alias("hit"))


_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"


# words and what lies between them: a word of four letters or more, one blank, the same word
@query(f"{DOC_LINES}, w AS (SELECT doc_id, list_transform(a, lambda x: regexp_extract_all(x, '{_WORD}+|[^{_WORD[1:]}+')) AS ws FROM l) SELECT doc_id, CAST(len(list_filter(ws, lambda w: len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 2] AND w[i + 1] = ' ' AND length(w[i]) >= 4)) > 0)) AS BIGINT) AS n FROM w")
def grep_backreference(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"\b(\w{4,}) \1\b")


# what follows is a comma or a period, so it isn't " of"
@query(_count_sql(f"regexp_matches(x, 'the {_WORD}+[,.]')"))
def grep_lookaround(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"(?<=the )\w+(?! of)(?=[,.])")


@query()
def grep_grapheme(spark, d):
    return grep.count(docs(spark, d), "doc_id", "text", r"(?g)[üöäéè]\X{3}\b{g}")


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM e WHERE contains(line, 'License')")
def grep_match(spark, d):
    return grep.match(docs(spark, d), "doc_id", "text", "License")


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM e WHERE regexp_matches(line, 'tion')) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM h WHERE r <= 2")
def grep_max_count(spark, d):
    return grep.match(docs(spark, d), "doc_id", "text", "tion", max_count=2)


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l), h AS (SELECT *, contains(line, 'License') AS hit FROM e), w AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, hit FROM w WHERE near")
def grep_context(spark, d):
    return grep.match(docs(spark, d), "doc_id", "text", "License", before=1, after=2)


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l), m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Z][a-z]+tion')) AS match FROM e) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, match FROM m")
def grep_only_matching(spark, d):
    return grep.only_matching(docs(spark, d), "doc_id", "text", "[A-Z][a-z]+tion")


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents), w AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM e) SELECT doc_id, CAST(off AS BIGINT) AS \"offset\", line FROM w WHERE contains(line, 'License')")
def grep_byte_offset(spark, d):
    return grep.byte_offsets(docs(spark, d), "doc_id", "text", "License")


@query(f"{DOC_LINES} SELECT doc_id FROM l WHERE len(list_filter(a, lambda x: contains(x, 'License'))) > 0")
def grep_files_with(spark, d):
    return grep.files_with_match(docs(spark, d), "doc_id", "text", "License")


@query(f"{DOC_LINES} SELECT doc_id FROM l WHERE len(list_filter(a, lambda x: contains(x, 'License'))) = 0")
def grep_files_without(spark, d):
    return grep.files_without_match(docs(spark, d), "doc_id", "text", "License")


@query(f"{DOC_LINES} SELECT bool_or(len(list_filter(a, lambda x: contains(x, 'Apache'))) > 0) AS found FROM l")
def grep_quiet(spark, d):
    return docs(spark, d).agg(F.bool_or(grep.has_match(F.col("text"), "Apache")).alias("found"))


@query(f"{DOC_LINES}, e AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no FROM l) SELECT doc_id || ':' || line_no || ':' || line AS line FROM e WHERE contains(line, 'License')")
def grep_formatted(spark, d):
    return grep.formatted(grep.match(docs(spark, d), "doc_id", "text", "License"), "doc_id", line_numbers=True)


@query(_count_sql("regexp_matches(x, '<[a-z]+>')", "page_id", _lines_sql("pages", "page_id", "html")))
def grep_pages(spark, d):
    return grep.count(table(spark, d, "pages"), "page_id", "html", "<[[:lower:]]+>")


@query("WITH t AS (SELECT conv_id, regexp_matches(text, '[?!]') AS hit FROM conversations) SELECT conv_id, CAST(count(*) FILTER (hit) AS BIGINT) AS n FROM t GROUP BY conv_id")
def grep_conversations(spark, d):
    own = table(spark, d, "conversations").select("conv_id", grep.has_match(F.col("text"), "[?!]").alias("hit"))
    return own.groupBy("conv_id").agg(F.count_if("hit").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)[aeiou]{2}')")
def grep_parts(spark, d):
    return table(spark, d, "part").where(compile_regex("[aeiou]{2}", ignore_case=True).predicate(F.col("p_name"))).select("p_partkey", "p_name")


# counts


_WC = r"CAST(len(regexp_extract_all(text, '\n')) AS BIGINT) AS lines, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes"


@query(f"SELECT doc_id, {_WC} FROM documents")
def wc(spark, d):
    return counts.wc(docs(spark, d), "doc_id", "text")


@query(f"WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_WC} FROM documents) SELECT * FROM w UNION ALL SELECT 'total', CAST(sum(lines) AS BIGINT), CAST(sum(words) AS BIGINT), CAST(sum(chars) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM w")
def wc_total(spark, d):
    return counts.wc(docs(spark, d), "doc_id", "text", total=True)


# codecs


@query("SELECT doc_id, md5(to_base64(encode(text))) AS digest FROM documents")
def base64(spark, d):
    return docs(spark, d).select("doc_id", F.md5(codecs.to_base64(F.col("text").cast("binary"))).alias("digest"))


_UNITS = "list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN printf('%04x', unicode(c)) ELSE printf('%04x%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END)"


# an astral sign behind each text, so that pairs of surrogates occur
@query(f"WITH t AS (SELECT doc_id, text || chr(128512) AS text FROM documents), u AS (SELECT doc_id, array_to_string({_UNITS}, '') AS units FROM t) SELECT doc_id, CAST(length(units) // 2 AS BIGINT) AS n_bytes, md5(units) AS digest FROM u")
def utf16(spark, d):
    units = codecs.to_utf16(F.concat("text", F.lit(chr(128512))), "BE")
    return docs(spark, d).select("doc_id", F.octet_length(units).cast("bigint").alias("n_bytes"), F.md5(F.lower(F.hex(units)).cast("binary")).alias("digest"))


@query("SELECT doc_id, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS total FROM documents")
def codepoints(spark, d):
    return docs(spark, d).select("doc_id", F.aggregate(codecs.codepoints(F.col("text")), F.lit(0).cast("bigint"), lambda a, c: a + c).alias("total"))


# the bytes of half of a pair of surrogates stand behind every other text
@query("SELECT doc_id, doc_id % 2 <> 0 AS valid FROM documents")
def utf8_valid(spark, d):
    data = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 2 == 0, F.lit(b"\xed\xa0\x80")).otherwise(F.lit(b"")))
    return docs(spark, d).select("doc_id", codecs.valid_utf8(data).alias("valid"))


# a byte that starts nothing before each text and a cut sequence of two bytes behind it
@query("SELECT doc_id, CAST(3 AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS first_error, CAST(strlen(text) + 2 AS BIGINT) AS last_error FROM documents WHERE text IS NOT NULL")
def utf8_errors(spark, d):
    damaged = F.concat(F.lit(b"\xff"), F.col("text").cast("binary"), F.lit(b"\xe2\x82"))
    found = docs(spark, d).where("text is not null").select("doc_id", codecs.utf8_errors(damaged).alias("at"))
    return found.select("doc_id", *[c.cast("bigint").alias(n) for n, c in (("n_errors", F.size("at")), ("first_error", F.array_min("at")), ("last_error", F.array_max("at")))])


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def lz4_round_trip(spark, d):
    own = docs(spark, d).select("doc_id", lz4_encode(F.col("text").cast("binary")).alias("frame"))
    return own.select("doc_id", F.md5(lz4_decode(F.col("frame"))).alias("digest"))


# Marker streams over part names


def _signs(spark, d) -> DataFrame:
    return bits.positions(table(spark, d, "part"), "p_partkey", "p_name").select("p_partkey", "pos", F.col("ch").isin(*"aeiou").alias("m"), bits.char_class(F.col("ch"), "[a-z]").alias("c"), (F.col("ch") == "e").alias("t"))


_SIGNS = "WITH x AS (SELECT p_partkey, unnest(range(0, length(p_name))) AS pos, p_name FROM part), b AS (SELECT p_partkey, pos, p_name[pos + 1:pos + 1] IN ('a','e','i','o','u') AS m, regexp_matches(p_name[pos + 1:pos + 1], '[a-z]') AS c, p_name[pos + 1:pos + 1] = 'e' AS t FROM x)"
_ISLAND = lambda stop: f"{_SIGNS}, i AS (SELECT *, coalesce(sum(CAST({stop} AS INT)) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM b), r AS (SELECT *, max(m) OVER (PARTITION BY p_partkey, island ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM i)"


@query(f"{_SIGNS} SELECT p_partkey, CAST(pos AS INT) AS pos, coalesce(lag(m, 2) OVER w, false) AS adv, coalesce(lead(m, 1) OVER w, false) AS look, m AND NOT t AS sel FROM b WINDOW w AS (PARTITION BY p_partkey ORDER BY pos)")
def bits_shift(spark, d):
    w = bits.order("p_partkey")
    return _signs(spark, d).select("p_partkey", "pos", bits.advance(F.col("m"), 2, w).alias("adv"), bits.lookahead(F.col("m"), 1, w).alias("look"), bits.select(F.col("t"), F.lit(False), F.col("m")).alias("sel"))


@query(f"{_ISLAND('NOT c')} SELECT p_partkey, CAST(pos AS INT) AS pos, seen AS reached FROM r")
def bits_match_star(spark, d):
    return bits.match_star(_signs(spark, d), "p_partkey", F.col("m"), F.col("c"), "reached").select("p_partkey", "pos", "reached")


@query(f"{_ISLAND('NOT c')} SELECT p_partkey, CAST(pos AS INT) AS pos, NOT c AND seen AS reached FROM r")
def bits_scan_thru(spark, d):
    return bits.scan_thru(_signs(spark, d), "p_partkey", F.col("m"), F.col("c"), "reached").select("p_partkey", "pos", "reached")


@query(f"{_ISLAND('t')} SELECT p_partkey, CAST(pos AS INT) AS pos, t AND seen AS reached FROM r")
def bits_scan_to(spark, d):
    return bits.scan_to(_signs(spark, d), "p_partkey", F.col("m"), F.col("t"), "reached").select("p_partkey", "pos", "reached")


@query(f"{_SIGNS} SELECT p_partkey, CAST(count(*) FILTER (m) AS BIGINT) AS n FROM b GROUP BY p_partkey")
def bits_count(spark, d):
    return bits.count(_signs(spark, d), "p_partkey", F.col("m"))


@query(f"{_SIGNS} SELECT p_partkey, string_agg(CASE WHEN m THEN '1' ELSE '.' END, '' ORDER BY pos) AS bits FROM b GROUP BY p_partkey")
def bits_render(spark, d):
    return bits.render(_signs(spark, d), "p_partkey", F.col("m"))


@query(f"{_SIGNS} SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS INT) AS pos, c FROM b WHERE NOT m")
def bits_delete(spark, d):
    return bits.delete(_signs(spark, d), "p_partkey", F.col("m")).select("p_partkey", "pos", "c")


# Advance and scan fused
@query(f"{_ISLAND('NOT c').replace('b AS (', 'b0 AS (', 1).replace(', i AS (', ', b AS (SELECT p_partkey, pos, coalesce(lag(m) OVER (PARTITION BY p_partkey ORDER BY pos), false) AS m, c, t FROM b0), i AS (', 1)} SELECT p_partkey, CAST(pos AS INT) AS pos, NOT c AND seen AS reached FROM r")
def bits_advance_scan(spark, d):
    return bits.advance_then_scan_thru(_signs(spark, d), "p_partkey", F.col("m"), F.col("c"), "reached").select("p_partkey", "pos", "reached")


# a plane of bits; B9: the end of the text
@query("WITH x AS (SELECT p_partkey, unnest(range(0, length(p_name))) AS pos, p_name FROM part) SELECT p_partkey, CAST(pos AS INT) AS pos, (unicode(p_name[pos + 1:pos + 1]) >> 2) & 1 = 1 AS bit, pos = length(p_name) - 1 AS last FROM x")
def bits_plane(spark, d):
    own = bits.positions(table(spark, d, "part"), "p_partkey", "p_name").join(table(spark, d, "part").select("p_partkey", F.length("p_name").alias("n")), "p_partkey")
    return own.select("p_partkey", "pos", codecs.bit_of(F.col("ch"), 2).alias("bit"), bits.at_eof(F.col("pos"), F.col("n") - 1).alias("last"))


# The k-th mark gets the k-th value
@query(f"{_SIGNS} SELECT p_partkey, CAST(pos AS INT) AS pos, CASE WHEN m THEN t END AS value FROM b")
def bits_spread(spark, d):
    own = _signs(spark, d)
    return bits.spread(own, "p_partkey", F.col("m"), bits.delete(own, "p_partkey", ~F.col("m")), "t", "value").select("p_partkey", "pos", "value")


# brackets


_TAGS = "WITH x AS (SELECT page_id, html, unnest(range(1, length(html) + 1)) AS p FROM pages), k AS (SELECT page_id, p - 1 AS pos, html[p:p] = '<' AS o FROM x WHERE html[p:p] IN ('<', '>')), s AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM k), l AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id ORDER BY pos)) AS low, least(0, coalesce(min(s) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM s), d AS (SELECT page_id, pos, o, o OR low = before AS valid, s - low + CASE WHEN o THEN 0 ELSE 1 END AS depth FROM l)"


@query(f"{_TAGS}, n AS (SELECT *, lead(o) OVER w AS no, lead(pos) OVER w AS np FROM d WHERE valid WINDOW w AS (PARTITION BY page_id, depth ORDER BY pos)) SELECT page_id, CAST(pos AS INT) AS open_pos, CAST(np AS INT) AS close_pos, CAST(depth AS BIGINT) AS depth FROM n WHERE o AND NOT no")
def parens_match(spark, d):
    return parens.match_parens(table(spark, d, "pages"), "page_id", "html", "<", ">")


# a closer without opener before each page and an opener never closed behind it
_BROKEN = _TAGS.replace("FROM pages)", "FROM (SELECT page_id, '>' || html || '<a' AS html FROM pages))", 1)


@query(f"{_BROKEN}, n AS (SELECT *, coalesce(lead(o) OVER (PARTITION BY page_id, valid, depth ORDER BY pos), true) AS alone FROM d) SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN o THEN 'unclosed' ELSE 'surplus' END AS kind FROM n WHERE NOT valid OR (o AND alone)")
def parens_errors(spark, d):
    broken = table(spark, d, "pages").select("page_id", F.concat(F.lit(">"), "html", F.lit("<a")).alias("html"))
    return parens.paren_errors(broken, "page_id", "html", "<", ">")


# Approximate search


_MOTIFS = ["ACGTA", "GATTACA", "TTGCA"]
#: The usual table of edit distances, a row for each place in a name: d[j + 1] edits for the first j letters of p.
_HITS = f"""WITH RECURSIVE t AS (SELECT p_partkey, upper(p_name) AS name, p, 0 AS pos, range(0, length(p) + 1) AS d FROM part, (SELECT unnest({_MOTIFS}) AS p)
UNION ALL SELECT p_partkey, name, p, pos + 1, list_transform(range(0, length(p) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda i: base[i + 1] - i))) FROM
(SELECT *, list_transform(range(0, length(p) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE least(d[j + 1] + 1, d[j] + CASE WHEN name[pos + 1] = p[j] THEN 0 ELSE 1 END) END) AS base FROM t WHERE pos < length(name))),
h AS (SELECT p_partkey, p AS pattern, CAST(pos - 1 AS BIGINT) AS pos, CAST(d[-1] AS INT) AS dist FROM t WHERE pos > 0 AND d[-1] <= 2)"""


@query(f"{_HITS} SELECT * FROM h")
def approx_parts(spark, d):
    return approx.approx_find(table(spark, d, "part"), "p_partkey", "p_name", _MOTIFS, 2)


# a window reaches 9 places on; the bound is 3 * (2 + 1) - 8 * 0.25
@query(f"{_HITS}, u AS (SELECT DISTINCT p_partkey, pos, dist FROM h), w AS (SELECT p_partkey, sum(dist) OVER (PARTITION BY p_partkey ORDER BY pos RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS total FROM u) SELECT p_partkey, CAST(count(*) AS BIGINT) AS n1, CAST(count(*) FILTER (total > 7) AS BIGINT) AS n2 FROM w GROUP BY p_partkey")
def approx_windows(spark, d):
    return approx.candidate_windows(approx_parts(spark, d), "p_partkey", 3, 8, 0.25, 2)


# section 2.8, T1-T3: joins and set operations over lines


@query("SELECT d.doc_id FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) WHERE contains(d.text, 'of')")
def semi_labels(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return docs(spark, d).where(F.col("text").contains("of")).join(toxic, "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def anti_labels(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def _line_set(spark, d, pattern: str) -> DataFrame:
    return grep.match(docs(spark, d), "doc_id", "text", pattern).select("line")


_LINE_SET = lambda test: f"(SELECT line FROM e WHERE {test})"
_E = f"{DOC_LINES}, e AS (SELECT unnest(a) AS line FROM l)"


@query(f"{_E} SELECT line FROM {_LINE_SET(chr(39).join(['contains(line, ', 'License', ')']))} UNION SELECT line FROM {_LINE_SET(chr(39).join(['contains(line, ', 'Public', ')']))}")
def lines_union(spark, d):
    return _line_set(spark, d, "License").union(_line_set(spark, d, "Public")).distinct()


@query(f"{_E} SELECT line FROM {_LINE_SET(chr(39).join(['contains(line, ', 'the', ')']))} INTERSECT SELECT line FROM {_LINE_SET(chr(39).join(['contains(line, ', 'tion', ')']))}")
def lines_intersect(spark, d):
    return _line_set(spark, d, "the").intersect(_line_set(spark, d, "tion"))


@query(f"{_E} SELECT line FROM {_LINE_SET(chr(39).join(['contains(line, ', 'License', ')']))} EXCEPT SELECT line FROM {_LINE_SET(chr(39).join(['contains(line, ', 'Public', ')']))}")
def lines_except(spark, d):
    return _line_set(spark, d, "License").subtract(_line_set(spark, d, "Public"))


# section 2.14: event time, as an extension


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    own = table(spark, d, "events")
    return own.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


# L2, L5 and ranks: ordered limits


@query(f"{DOC_LINES}, n AS (SELECT d.source, doc_id, CAST(len(list_filter(a, lambda x: contains(x, 'the'))) AS BIGINT) AS n FROM l JOIN documents d USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS r FROM n) SELECT source, doc_id, n FROM r WHERE r <= 3")
def top_per_source(spark, d):
    own = table(spark, d, "documents").select("source", "doc_id", F.size(grep.hits(F.col("text"), "the")).cast("bigint").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "doc_id")
    return own.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
