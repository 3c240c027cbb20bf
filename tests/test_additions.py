"""Patterns with identity, counters, prefix groups, compiled LZ4 and further flags of the command line."""

import os
import random
import struct

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from glyphstream.functions import lz4
from glyphstream.operators import approx, counts, grep
from glyphstream.operators.lines import line_array
from glyphstream.plans import cli


def test_which_names_all_patterns_of_a_line(spark):
    df = spark.createDataFrame([(1, "ab\nb\r\nccc"), (2, None), (3, ""), (4, "a\n")], "id int, text string")
    got = sorted((r["id"], r["line_no"], r["line"], tuple(r["patterns"])) for r in grep.which(df, "id", "text", ["a", "b$", "x"]).collect())
    assert got == [(1, 1, "ab", (0, 1)), (1, 2, "b", (1,)), (4, 1, "a", (0,))]


def test_lines_are_split_once(spark):
    df = spark.createDataFrame([("",), ("\n",), ("a",), ("a\n",), ("a\r\n\nb",), (None,)], "t string").select(line_array(F.col("t")).alias("a"))
    assert [r["a"] for r in df.collect()] == [[], [""], ["a"], ["a"], ["a", "", "b"], None]
    assert df._jdf.queryExecution().executedPlan().toString().count("split(") == 1


def test_observed_counters(spark):
    to = Observation()
    counts.observed(spark.createDataFrame([("é",), (None,), ("abc",)], "t string"), "t", to).collect()
    assert to.get == {"rows": 3, "nulls": 1, "bytes": 5}


def test_prefix_groups():
    groups = approx.prefix_groups(["GATT", "ACGT", "ACTT", "AC"], 2)
    assert groups == {"AC": ["AC", "ACGT", "ACTT"], "GA": ["GATT"]}


def plain_edits(pattern, text, k):
    """Ends within k edits by Sellers' table."""
    row, out = list(range(len(pattern) + 1)), []
    for pos, c in enumerate(text.upper()):
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != c or c not in "ACGT"), row[j + 1] + 1, new[-1] + 1))
        row = new
        if row[-1] <= k:
            out.append((pos, row[-1]))
    return out


@pytest.mark.parametrize("chunk", [7, 64, 1 << 12])
def test_approximate_search_of_many_texts_at_once(spark, chunk):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTacgtN\n") for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(30)]
    patterns = ["ACGTA", "GATTACA", "TTG"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    got = sorted((r["id"], r["pattern"], r["pos"], r["dist"]) for r in approx.approx_find(df, "id", "t", patterns, 2, chunk=chunk).collect())
    assert got == sorted((i, p, pos, d) for i, t in enumerate(texts) for p in patterns for pos, d in plain_edits(p, t, 2))


def test_lz4_compiled_and_plain_agree(spark):
    rng = random.Random(4)
    datas = [b"", b"a", b"abc" * 4000, bytes(rng.randrange(256) for _ in range(5000)), bytes(rng.choice(b"ab") for _ in range(300_000))]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(datas)], "id int, d binary")
    got = df.select("id", "d", lz4.lz4_encode(F.col("d")).alias("f")).select("*", lz4.lz4_decode(F.col("f")).alias("back")).collect()
    for r in got:
        assert bytes(r["back"]) == bytes(r["d"]) == lz4.decode_frame(bytes(r["f"])) == lz4.decode(lz4.encode_frame(bytes(r["d"])) + b"rest")
    frame = bytearray(lz4.encode_frame(datas[2]))
    frame[-1] ^= 1
    assert lz4.decode(bytes(frame)) == datas[2]  # the content's checksum is skipped
    for bad in (b"", b"nonsense", bytes(frame[:40]), struct.pack("<I", lz4.MAGIC) + b"\0" * 20):
        with pytest.raises((ValueError, struct.error, IndexError)):
            lz4.decode(bad)


def test_further_flags(spark, tmp_path, capsys):
    one, sub = tmp_path / "one.txt", tmp_path / "sub"
    one.write_text("a\nhit\nb\nc\n")
    sub.mkdir()
    (sub / "two.txt").write_text("hit\n")

    def run(*argv):
        code = cli.main([*argv], spark)
        return code, capsys.readouterr().out.splitlines()

    assert run("-h", "-C", "1", "hit", str(one)) == (0, ["a", "hit", "b"])
    assert run("-h", "-b", "hit", str(one)) == (0, ["2:hit"])
    assert run("-h", "-d", "skip", "hit", str(one), str(sub)) == (0, ["hit"])
    assert run("-d", "skip", "hit", str(sub)) == (1, [])
    code, out = run("-R", "-c", "hit", str(tmp_path))
    assert code == 0 and sorted(os.path.basename(x) for x in out) == ["one.txt:1", "two.txt:1"]
