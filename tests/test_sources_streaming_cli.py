"""Files, streams and the command line."""

import pytest

from glyphstream.functions.lz4 import encode_frame
from glyphstream.plans.cli import main
from glyphstream.sources import files
from glyphstream.streaming.lines import first_matches, grep_stream


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub" / ".svn").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "sub" / "b.txt").write_text("two\nthree")
    (tmp_path / "sub" / ".svn" / "c.txt").write_text("two")
    (tmp_path / "bad.bin").write_bytes(b"two\xff")
    return tmp_path


def test_files(spark, folder):
    got = files.read_files(spark, str(folder), recursive=True, include="*.txt").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.txt", "b.txt"]
    assert files.with_text(files.read_files(spark, str(folder), include="*.bin")).first()["text"] is None
    (folder / "x.lz4").write_bytes(encode_frame(b"packed"))
    assert bytes(files.read_lz4(spark, str(folder), include="*.lz4").first()["content"]) == b"packed"


def test_cli(spark, folder, capsys):
    own = str(folder / "a.txt")
    assert main(["two", own], spark) == 0 and capsys.readouterr().out == "two\n"
    assert main(["-c", "-v", "two", own], spark) == 0 and capsys.readouterr().out == "1\n"
    assert main(["-n", "-H", "-e", "one", "-e", "two", own], spark) == 0
    assert [x.rsplit("a.txt:", 1)[1] for x in capsys.readouterr().out.split()] == ["1:one", "2:two"]
    assert main(["-q", "nine", own], spark) == 1 and main(["a(", own], spark) == 2 and main(["a", str(folder / "none")], spark) == 3
    assert main(["-l", "-r", "three", str(folder)], spark) == 0 and capsys.readouterr().out.strip().endswith("sub/b.txt")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("k", 1, "a the\nb\r"), ("k", 2, "\nthe c\nopen the"), ("j", 1, "the\n")], "k string, seq int, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, seq int, t string").parquet(str(tmp_path / "in"))
    for name, df, want in (("lines_out", grep_stream(stream, "k", "seq", "t", "the"), {("k", 1, "a the"), ("k", 3, "the c"), ("j", 1, "the")}), ("first_out", first_matches(stream, "k", "seq", "t", "the", 1), {("k", 1, "a the\nb\r"), ("j", 1, "the\n")})):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200 and set(entry.oracle_sql()) <= set(entry.queries())
