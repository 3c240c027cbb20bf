"""License scans against an alignment of every template with every place of the text."""

import random
import textwrap

import pytest

from glyphstream.llm import licenses
from glyphstream.llm.licenses import TEMPLATES, Scanner


def words_of(text):
    return [m.group().lower() for m in licenses._WORD.finditer(text)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(text, templates):
    """Findings by plain dynamic programming over the whole text, without hints, blocks or compression."""
    spans, words = [m.span() for m in licenses._WORD.finditer(text)], words_of(text)
    every = []
    for name in templates:
        want = words_of(templates[name])
        most, ends = int(0.15 * len(want)), []
        row = [(i, 0) for i in range(len(want) + 1)]  # cost, words of the stretch
        for i, w in enumerate(words):
            new = [(0, 0)]
            for j, x in enumerate(want):
                put = (row[j][0] + (w != x), row[j][1] + 1)
                more = (row[j + 1][0] + 1, row[j + 1][1] + 1)
                less = (new[-1][0] + 1, new[-1][1])
                new.append(min(put, more, less))
            row = new
            if row[-1][0] <= most:
                ends.append((row[-1][0], i + 1 - row[-1][1], i + 1))
        taken = []
        for n, a, b in sorted(ends):
            if all(b <= t[0] or a >= t[1] for t in taken):
                taken.append((a, b, name, n))
        every += taken
    rank = {t: (t[3], -len(words_of(templates[t[2]])), t[2]) for t in every}
    chosen = [t for t in every if not any(c[0] <= t[0] and t[1] <= c[1] and rank[c] < rank[t] for c in every)]
    return [(spans[a][0], spans[b - 1][1] - spans[a][0], name, n) for a, b, name, n in sorted(chosen)]


def found(text, templates=TEMPLATES):
    return [(a, n, name, k) for a, n, name, _, k, _ in Scanner(templates).find(text)]


@pytest.mark.parametrize("name", TEMPLATES)
def test_wrapped_commented_and_changed_notices(name):
    text, filler = TEMPLATES[name], "some code or prose stands here\n" * 3
    lines = textwrap.wrap(text, 72)
    for changed in (text, "\n".join(lines), "\n".join(f" * {x}" for x in lines), "\n".join(f"# {x}" for x in lines), "\r\n".join(f"// {x}" for x in lines)):
        whole = filler + changed + "\n\n" + filler
        got = found(whole)
        assert got == brute(whole, TEMPLATES)
        assert name in {x[2] for x in got if x[3] == 0}
        (own,) = (x for x in got if x[2] == name)
        assert words_of(whole[own[0] : own[0] + own[1]]) == words_of(text)


def test_all_notices_in_one_line_and_repeated():
    line = " ".join(TEMPLATES.values())
    for text in (line, f"{line} {line}", "x " * 5000 + line + " y" * 5000, "\n\n".join(TEMPLATES.values())):
        got = found(text)
        assert got == brute(text, TEMPLATES) and len(got) >= 20
    mit = TEMPLATES["MIT"]
    assert [x[2] for x in found(f"{mit}\n{mit}\n{mit}")] == ["MIT"] * 3


def test_changed_wording_against_all_places():
    rng = random.Random(1)
    names = list(TEMPLATES)
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            own = TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randrange(0, 1 + len(own) // 5)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["word"], [own[k], "added"]])
            parts.append(" ".join(own))
            parts.append(" ".join(rng.choice(["plain", "words", "license", "in", "between"]) for _ in range(rng.randrange(0, 60))))
        text = rng.choice([" ", "\n"]).join(parts)
        assert found(text) == brute(text, TEMPLATES)


def test_alignment_distance():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 12))]
        want = [rng.choice("abc") for _ in range(rng.randrange(1, 5))]
        for a, b, n in licenses.alignments(words, want, 1):
            assert distance(words[a:b], want) == n == min(distance(words[i:b], want) for i in range(b + 1))


def test_own_templates_without_hint_words_and_plain_text():
    own = {"x": "three odd xylophones", "y": "nothing else"}
    assert [x[2] for x in found("we saw Three odd\nxylophones and nothing else", own)] == ["x", "y"]
    assert found("the licensed plumber came") == found("") == []
    with pytest.raises(ValueError):
        Scanner({"none": "..."})


def test_rows(spark):
    rows = [(1, "a\nReleased under the MIT License.\nb"), (1, "a\nReleased under the MIT License.\nb"), (None, "Licensed under CC BY-NC 4.0."), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id bigint, text string, license string, start int")
    got = sorted((r["doc_id"] or 0, r["start"], r["length"], r["license"], r["exact"]) for r in licenses.scan_documents(docs).collect())
    assert got == [(0, 0, 27, "CC-BY-NC-4.0", True), (1, 2, 30, "MIT", True), (1, 2, 30, "MIT", True)]
