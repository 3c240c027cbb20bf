"""The near-duplicate stage: links at a similarity of 0.8 alone, and all of them."""

import random

import numpy as np
import pytest

from glyphstream.llm import simhash_neardup
from glyphstream.llm.components import connected_components


def components_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash_neardup.similar_documents(df, **options).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: r["component_id"] for r in got}


def test_repeated_line_links_nothing(spark):
    """A line repeated 30 times decides all 64 bits; texts of different shingles stay apart, equal sets join."""
    rng = random.Random(21)
    line = "please read the terms of use of this site"
    rows = [(i, " ".join([line] * 30 + [f"w{rng.randrange(10**6)}" for _ in range(104)])) for i in range(6)]
    rows += [(10, "a b c d e f " * 2), (11, "a b c d e f " * 9), (12, f"{line} " * 30), (13, f"{line} " * 50)]
    fps = [simhash_neardup.shingle_fingerprint(t, 5) for _, t in rows]
    assert max((fps[0] ^ f).bit_count() for f in fps[1:6]) <= 4
    of = components_of(spark, rows)
    assert all(of[i] == i for i in range(6)) and of[11] == of[10] == 10 and of[13] == of[12] == 12


def changed(words, rng, *runs):
    """A copy of words with new ones for runs of those lengths, far from each other."""
    own, step = list(words), len(words) // (len(runs) + 1)
    for k, size in enumerate(runs):
        at = k * step + rng.randrange(4, step - size - 4)
        own[at : at + size] = [f"x{rng.randrange(10**9)}" for _ in range(size)]
    return own


def test_links_of_each_member_of_close_copies(spark):
    """B has a close copy A (4 bits or less) and a text C at 0.82, which is at 0.76 to A."""
    rng, rows, triples = random.Random(22), [], []
    while len(triples) < 12:
        b = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        a, c = b[:190] + [f"x{rng.randrange(10**9)}" for _ in range(3)] + b[193:], changed(b, rng, 1, 1, 1, 1)
        if (simhash_neardup.shingle_fingerprint(" ".join(a), 5) ^ simhash_neardup.shingle_fingerprint(" ".join(b), 5)).bit_count() <= 4:
            triples.append(range(len(rows), len(rows) + 3))
            rows += [(i, " ".join(x)) for i, x in zip(triples[-1], (a, b, c))]
    of = components_of(spark, rows)
    assert all({of[i] for i in t} == {t[0]} for t in triples)


@pytest.mark.parametrize("most", [4096, 16])
def test_links_beside_rejected_ones(spark, most):
    """Groups whose pairs lie around 0.8: many links of a bucket's forest are not confirmed."""
    rng, rows = random.Random(23), []
    for _ in range(6):
        base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        rows += [(len(rows) + k, " ".join(changed(base, rng, *[1] * rng.choice((2, 2, 3, 3, 3))))) for k in range(30)]
    of = components_of(spark, rows, most=most)
    sets = [set(simhash_neardup.shingle_hashes(t, 5).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 500 and all(of[i] == of[j] for i, j in links)


@pytest.mark.parametrize("words, more", [(8, 1), (19, 3), (29, 5), (36, 7)])
def test_links_of_short_texts(spark, words, more):
    """A text and the same with more words, at a similarity of 0.8."""
    rng, rows = random.Random(24), []
    for i in range(60):
        own = [f"w{rng.randrange(10**9)}" for _ in range(words + more)]
        rows += [(2 * i, " ".join(own[:words])), (2 * i + 1, " ".join(own))]
    of = components_of(spark, rows)
    assert all(of[2 * i + 1] == 2 * i for i in range(60))


@pytest.mark.parametrize("most", [0, 1 << 17])
def test_components_in_one_task_and_in_rounds(spark, most):
    """A long path, a hub, a ring, repeated links, a node linked to itself; both ways give the smallest reachable node."""
    links = [(k, k + 1) for k in range(-40, 0)] + [(1000, k) for k in range(900, 960)] + [(50 + k, 50 + (k + 7) % 20) for k in range(20)] + [(7, 7), (5, 9), (5, 9), (9, 5)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), most).collect()
    want = {k: -40 for k in range(-40, 1)} | {k: 900 for k in [*range(900, 960), 1000]} | {k: 50 for k in range(50, 70)} | {5: 5, 9: 5}
    assert sorted((r["node"], r["root"]) for r in got) == sorted(want.items())
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), most).collect() == []


def test_further_links_take_each_pair_once():
    """All likely pairs of different roots, each in the first band where it meets and in one range of ranks."""
    rng = np.random.default_rng(3)
    sets = [rng.choice(1 << 40, 60, False).astype(np.uint64) for _ in range(5)]
    rows = [np.unique(np.concatenate([rng.permutation(s)[: 60 - k], rng.choice(1 << 40, k).astype(np.uint64)])) for s in sets for k in rng.integers(0, 9, 14)]
    made = [simhash_neardup.wide_sketch(r) for r in rows]
    wide = np.frombuffer(b"".join(w for w, _ in made), np.uint64).reshape(len(rows), -1)
    keys = np.array([k for _, k in made])
    root = rng.integers(0, 30, len(rows))
    want = {(u, v) for u in range(len(rows)) for v in range(u + 1, len(rows)) if root[u] != root[v] and (keys[u] == keys[v]).any() and simhash_neardup.estimates(wide, u)[v] >= 0.7}
    got = []
    for band in range(keys.shape[1]):
        for key in set(keys[:, band].tolist()):
            own, low, high, more = np.flatnonzero(keys[:, band] == key), 0, 2, len(rows) > 0
            while more and len(own) > 1:
                a, b, more = simhash_neardup.further_links(root[own], wide[own], keys[own, :band], 0.7, low, high)
                got += zip(own[a].tolist(), own[b].tolist())
                low, high = high, 2 * high
    assert len(want) > 100 and sorted(got) == sorted(want)
