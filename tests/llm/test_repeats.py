"""The graph of words, dealing of runs, and removal with hot keys, clashing names and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.llm import debruijn, repeats, suffix_dedup


def test_word_classes():
    rng = random.Random(1)
    ids = np.array([rng.randrange(3) for _ in range(300)])
    for size in range(1, 25):
        starts = np.arange(len(ids) - size + 1)
        got = debruijn.word_classes(ids, starts, size)
        keys = [tuple(ids[i : i + size]) for i in starts]
        assert len({*zip(got.tolist(), keys)}) == len(set(keys)) == len(set(got.tolist()))


def plain_pieces(texts, copies, k):
    """Pieces by dictionaries of edges and nodes."""
    edges, first, out, into = {}, {}, {}, {}
    for x, (t, c) in enumerate(zip(texts, copies)):
        w = t.split()
        for i in range(len(w) - k + 1):
            e = tuple(w[i : i + k])
            edges[e] = edges.get(e, 0) + c
            first.setdefault(e, (x, i))
    for e, n in edges.items():
        if n > 1:
            out.setdefault(e[:-1], set()).add(e)
            into.setdefault(e[1:], set()).add(e)
    at = {v: e for e, v in first.items()}
    found = []
    for (x, i), e in sorted(at.items()):
        before = at.get((x, i - 1))
        alone = before and (edges[e] == 1 or len(out[e[:-1]]) == len(into.get(e[:-1], ())) == 1)
        if before and edges[before] == edges[e] and alone:
            found[-1][2] = i
        else:
            found.append([x, i, i, edges[e]])
    return [tuple(f) for f in found]


def test_pieces_against_plain_graph():
    rng = random.Random(2)
    for _ in range(200):
        k = rng.randrange(1, 6)
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(k, 30))).encode() for _ in range(rng.randrange(1, 5))]
        copies = [rng.choice((1, 1, 2)) for _ in texts]
        windows = np.array([len(t.split()) - k + 1 for t in texts])
        got = debruijn.pieces_of(texts, windows, np.array(copies), k)
        assert [g[:4] for g in got] == plain_pieces(texts, copies, k)


def test_repeated_spans_and_paths(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    a, b = ([word() for _ in range(n)] for n in (300, 90))
    own = lambda n: [word() for _ in range(n)]
    rows = [(1, own(40) + a + own(40) + b), (2, own(7) + a + own(60)), (3, a), (4, own(30) + b + own(5)), (5, b[:30]), (None, None)]
    df = spark.createDataFrame([(i, w and " ".join(w), "x") for i, w in rows], "doc_id bigint, text string, copies string")
    got = sorted((r["doc_id"], r["start"], r["n_words"], r["copies"], r["text"]) for r in debruijn.repeated_spans(df, least=20).collect())
    assert got == [(1, 40, 300, 3, " ".join(a)), (1, 380, 30, 3, " ".join(b[:30])), (1, 391, 79, 2, " ".join(b[11:]))]
    assert debruijn.repeated_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("remove", [suffix_dedup.remove_substrings, debruijn.remove_repeated_words])
def test_clashing_names_nulls_and_repeated_rows(spark, remove):
    t = " ".join(f"w{i * 7919 % 1009}" for i in range(120))
    df = spark.createDataFrame([(1, t, "k", 1, 2), (1, t, "k", 1, 2), (2, f"é {t}", "k", 1, 2), (2, "other", "k", 1, 2), (None, None, "k", 1, 2), (3, "", "k", 1, 2)], "doc_id bigint, text string, kept_text string, tie int, `a.b` int")
    got = remove(df)
    assert got.columns == ["doc_id", "text", "kept_text_of_docs", "tie", "a.b", "kept_text"]
    rows = sorted(((r["doc_id"] or 0, r["kept_text"]) for r in got.collect()))
    assert [x[0] for x in rows] == [0, 1, 1, 2, 2, 3] and rows[0][1] == rows[5][1] == "" and rows[1][1] == rows[2][1] == t
    assert sorted(x[1].strip() for x in rows[3:5]) == sorted(["other", "é"]) or remove is suffix_dedup.remove_substrings
    assert remove(df.limit(0)).collect() == []


def test_common_passage_is_no_hot_minimizer(spark):
    """300 documents share a passage among own words: its windows meet by rarer grams, and results stay the same."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(18))
    rows = [(i, " ".join([f"q{rng.randrange(10**9)}" for _ in range(25)] + [passage] + [f"q{rng.randrange(10**9)}" for _ in range(25)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    units, keyed = repeats.Units(20, 5, words=True), repeats.with_key(df)
    most = lambda common: repeats.find_runs(keyed, units, common).groupBy("key").agg(F.sum("copies").alias("n")).agg(F.max("n")).first()[0]
    common = repeats.common_grams(keyed, units)
    assert most(None) >= 300 and most(common) <= 10
    assert debruijn.removed_words_digest(df).where("n_removed > 0").count() == 0


def test_source_that_changed_is_noticed(spark):
    df = spark.createDataFrame([(1, "row", 0, [(1, 2, 1, 0)])], "id bigint, row string, tie bigint, runs array<struct<key: bigint, ctx: bigint, copies: bigint, at: bigint>>")
    df = df.withColumn("row", F.struct(F.lit("a b c d").alias("text")))
    with pytest.raises(Exception, match="another text"):
        repeats.extract(df, repeats.Units(2, 1, words=True), False).collect()


def test_very_long_text(spark):
    """One text of 2 MB repeats its first fifth at its end."""
    rng = random.Random(5)
    words = [f"{rng.randrange(10**6)}" for _ in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words + words[:60_000])), (2, "short")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in debruijn.removed_words_digest(df).collect()}
    assert (got[1]["n_words"], got[1]["n_removed"], got[2]["n_removed"]) == (360_000, 60_000, 0)
    size = len(" ".join(words[:60_000]))
    cut = suffix_dedup.removed_digest(df, keep_first=True).where("doc_id = 1").first()
    assert size <= cut["n_removed"] <= size + 1 and cut["n_spans"] == 1
