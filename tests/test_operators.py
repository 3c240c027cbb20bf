"""Lines, search, counts, codecs, markers, brackets, approximate search, LZ4."""

import base64
import random
import struct

import pytest
from pyspark.sql import functions as F

from glyphstream.functions import codecs
from glyphstream.functions.lz4 import decode_frame, encode_frame, lz4_decode, lz4_encode
from glyphstream.operators import approx, bits, counts, grep, parens
from glyphstream.operators.lines import lines

BREAKS = [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\rb", ["a", "", "b"]), ("\n", [""]), ("a\x0bb\x0cc\x85d e f\rg", list("abcdefg")), ("\n\n", ["", ""])]


def test_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BREAKS)], "k int, t string")
    got = {}
    for r in lines(df, "k", "t").orderBy("k", "line_no").collect():
        got.setdefault(r["k"], []).append((r["line"], r["eol"]))
    for i, (text, want) in enumerate(BREAKS):
        assert [x for x, _ in got.get(i, [])] == want
        assert "".join(x + e for x, e in got.get(i, [])) == text


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("a", "the cat\nsat\nthe mat"), ("b", "no hit"), ("c", None), ("d", "")], "k string, t string")


def test_grep_modes(texts):
    n = lambda **o: {r["k"]: r["n"] for r in grep.count(texts, "k", "t", "the", **o).collect()}
    assert n() == {"a": 2, "b": 0, "c": 0, "d": 0} and n(invert=True) == {"a": 1, "b": 1, "c": 0, "d": 0} and n(max_count=1)["a"] == 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grep.match(texts, "k", "t", "at$", max_count=2)) == [("a", 1, "the cat"), ("a", 2, "sat")]
    assert rows(grep.files_with_match(texts, "k", "t", "sat")) == [("a",)]
    assert rows(grep.files_without_match(texts, "k", "t", "sat")) == [("b",), ("c",), ("d",)]
    assert rows(grep.only_matching(texts, "k", "t", "[a-z]at")) == [("a", 1, "cat"), ("a", 2, "sat"), ("a", 3, "mat")]
    assert rows(grep.match(texts, "k", "t", "sat", after=1)) == [("a", 2, "sat", True), ("a", 3, "the mat", False)]
    assert rows(grep.match(texts, "k", "t", "sat", before=1)) == [("a", 1, "the cat", False), ("a", 2, "sat", True)]
    assert rows(grep.byte_offsets(texts, "k", "t", "the")) == [("a", 0, "the cat"), ("a", 12, "the mat")]
    assert grep.any_match(texts, "t", "mat") and not grep.any_match(texts, "t", "dog")
    assert rows(grep.formatted(grep.match(texts, "k", "t", "sat"), "k", line_numbers=True)) == [("a:2:sat",)]


def test_blocks_of_long_lines(spark):
    """One line of many holds a*b...c, at lengths around powers of two."""
    for size in (63, 64, 65, 1023, 1024, 1025, 70_000):
        t = "\n".join(["_" * size + "ab" * 3, "_" * size + "a" + "b" * size + "c", "b" * size])
        df = spark.createDataFrame([(1, t)], "k int, t string")
        assert grep.match(df, "k", "t", "ab*c").collect()[0]["line_no"] == 2


def test_wc(texts):
    got = {r[0]: tuple(r)[1:] for r in counts.wc(texts, "k", "t", total=True).collect()}
    assert got["a"] == (2, 5, 19, 19) and got["c"] == (0, 0, 0, 0) and got["total"] == (2, 7, 25, 25)


@pytest.mark.parametrize("text", ["", "M", "Ma", "Man", "x" * 1390, "日本😀é"])
def test_codecs(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    r = df.select(codecs.to_base64(t.cast("binary")), codecs.to_utf16(t), codecs.to_utf16(t, "BE"), codecs.codepoints(t), codecs.from_utf16(codecs.to_utf16(t))).first()
    assert r[0] == base64.b64encode(text.encode()).decode() and bytes(r[1]) == text.encode("utf-16-le") and bytes(r[2]) == text.encode("utf-16-be")
    assert r[3] == [ord(c) for c in text] and r[4] == text


def test_invalid_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xff"),), (bytearray(b"ok"),)], "b binary")
    assert [tuple(r) for r in df.select(codecs.valid_utf8(F.col("b")), codecs.text_or_null(F.col("b")), codecs.latin1(F.col("b"))).collect()] == [(False, None, "abÿ"), (True, "ok", "ok")]


def test_markers_against_integers(spark):
    rng, n = random.Random(1), 24
    rows, want = [], {}
    for k in range(40):
        c, m = rng.getrandbits(n), 1 << rng.randrange(n)
        star = ((((m & c) + c) ^ c) | m) & ((1 << n) - 1)
        thru = (m + c) & ~c if m & c else m
        want[k] = (star, thru & ((1 << n) - 1))
        rows += [(k, i, bool(m >> i & 1), bool(c >> i & 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, pos int, m boolean, c boolean")
    star = bits.match_star(df, "k", F.col("m"), F.col("c"), "r").where("r").groupBy("k").agg(F.sum(F.expr("shiftleft(1L, pos)"))).collect()
    assert {r[0]: r[1] for r in star} == {k: v[0] for k, v in want.items() if v[0]}
    thru = bits.scan_thru(df, "k", F.col("m"), F.col("c"), "r").where("r").groupBy("k").agg(F.sum(F.expr("shiftleft(1L, pos)"))).collect()
    assert {r[0]: r[1] for r in thru} == {k: v[1] for k, v in want.items() if v[1]}


def test_markers_move(spark):
    df = bits.positions(spark.createDataFrame([(1, "ab=c;d")], "k int, t string"), "k", "t", end_row=True)
    m, eq, semi = F.col("pos") == 0, F.col("ch") == "=", F.col("ch") == ";"
    where = lambda d: [r["pos"] for r in d.where("r").orderBy("pos").collect()]
    assert where(bits.scan_to(df, "k", m, semi, "r")) == [4]
    assert where(bits.advance_then_scan_thru(df, "k", m, ~eq, "r")) == [2]
    assert where(bits.advance_then_scan_to(df, "k", eq, semi, "r")) == [4]
    assert df.where("ch = ''").first()["pos"] == 6
    assert bits.render(df, "k", semi).first()["bits"] == "....1.."
    assert [r["pos"] for r in bits.delete(df, "k", eq).orderBy("pos").collect()] == list(range(6))
    values = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k int, pos int, v string")
    got = bits.spread(df, "k", eq | semi, values, "v", "v").where("v is not null").orderBy("pos").collect()
    assert [(r["pos"], r["v"]) for r in got] == [(2, "x"), (4, "y")]


def test_fixpoint(spark):
    spark.sparkContext.setCheckpointDir("/tmp/glyph-test-checkpoint")
    df = spark.createDataFrame([(1, i, i == 0) for i in range(5)], "k int, pos int, m boolean")
    out = bits.fixpoint(df, lambda d: d.withColumn("m", F.col("m") | bits.advance(F.col("m"), 1, bits.order("k"))), "k", "m")
    assert out.where("m").count() == 5


def test_parens_against_stack(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("()x") for _ in range(rng.randrange(30)))) for k in range(150)]
    df = spark.createDataFrame(rows, "k int, t string")
    pairs, errors = set(), set()
    for k, t in rows:
        stack = []
        for i, c in enumerate(t):
            if c == "(":
                stack.append(i)
            elif c == ")" and stack:
                pairs.add((k, stack.pop(), i, len(stack) + 1))
            elif c == ")":
                errors.add((k, i, "surplus"))
        errors |= {(k, i, "unclosed") for i in stack}
    assert {tuple(r) for r in parens.match_parens(df, "k", "t").collect()} == pairs
    assert {tuple(r) for r in parens.paren_errors(df, "k", "t").collect()} == errors


def brute_ends(text: str, p: str, k: int) -> set:
    out, row = set(), list(range(len(p) + 1))
    for pos, c in enumerate(text):
        new = [0]
        for i, x in enumerate(p):
            new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (x != c)))
        row = new
        if row[-1] <= k:
            out.add((p, pos, row[-1]))
    return out


def test_approx_against_recurrence(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(700))
    patterns = ["ACGTACG", "TTGACA"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    want = {(1, *x) for p in patterns for x in brute_ends(text, p, 2)}
    for chunk in (1 << 16, 64):
        assert {tuple(r) for r in approx.approx_find(df, "k", "t", patterns, 2, chunk).collect()} == want


@pytest.mark.parametrize("data", [b"", b"a", b"abcd" * 500, bytes(range(256)) * 3, b"\0" * 100_000, random.Random(4).randbytes(5000)])
def test_lz4(spark, data):
    frame = encode_frame(data, 1 << 12)
    assert decode_frame(frame, verify=True) == data
    df = spark.createDataFrame([(bytearray(data),), (None,)], "b binary")
    assert [r[0] and bytes(r[0]) for r in df.select(lz4_decode(lz4_encode(F.col("b")))).collect()] == [data, None] or not data


def test_lz4_rejects():
    for bad in (b"", b"1234567", encode_frame(b"abc")[:-9]):
        with pytest.raises((ValueError, struct.error)):
            decode_frame(bad)


def test_utf8_errors_against_escaped_bytes(spark):
    rng = random.Random(8)
    fixed = [b"", b"ok", b"\xff", b"a\xc3", b"\xc3\xa9\xa9", b"\xe2\x82", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", "\u00e9\u20ac\U0001f600\n".encode(), b"\xf0\x9f\x98\n"]
    near = [0x41, 0x0A, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5]
    data = fixed + [bytes(rng.choice(near) for _ in range(rng.randrange(12))) for _ in range(1500)] + [b"\xc3\xa9" * 50_000 + b"\xc3"]

    def escaped(b: bytes) -> list[int]:
        out, at = [], 0
        for c in b.decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":
                out.append(at)
            at += len(c.encode("utf-8", "surrogateescape"))
        return out

    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(data)] + [(-1, None)], "k int, b binary")
    got = {r["k"]: r["e"] for r in df.select("k", codecs.utf8_errors(F.col("b")).alias("e")).collect()}
    assert got.pop(-1) is None
    assert got == {k: escaped(b) for k, b in enumerate(data)}
