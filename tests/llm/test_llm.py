"""The training-data operators against brute force, round trips and held-out rows."""

import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphstream.llm import components, debruijn, fingerprints, language_id, licenses, media, packing, sentencepiece, simhash_neardup, suffix_dedup, toxicity
from glyphstream.llm.common import checkpoint_dir
from glyphstream.llm.queries import tokenizer_path

BASE = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, d string, row int"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "x", 1) for i, t in rows], BASE)


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))
        if i % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + " " + shared[rng.randrange(40) :] + t[at:]
        rows.append((i, t))
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "aaaa" * 200), (n + 4, "w " * 60), (None, rows[5][1]), (n + 5, "x" * 199)]
    return rows


def brute(units, window, first):
    seen, where = {}, {}
    for k, u in enumerate(units):
        for i in range(len(u) - window + 1):
            w = u[i : i + window]
            seen[w] = seen.get(w, 0) + 1
            where.setdefault(w, (k, i))
    for k, u in enumerate(units):
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            w = u[i : i + window]
            if (where[w] != (k, i)) if first else seen[w] > 1:
                gone[i : i + window] = True
        yield gone


@pytest.mark.parametrize("most", [4096, 2])
@pytest.mark.parametrize("first", [False, True])
def test_suffix_dedup(spark, first, most):
    rows = sorted(corpus(), key=lambda r: -1 if r[0] is None else r[0])
    own = [(t or "").encode() for _, t in rows]
    want = set()
    for (i, _), u, gone in zip(rows, own, brute(own, 60, first)):
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        want.add((i, len(u), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()))
    got = suffix_dedup.removed_digest(frame(spark, rows), length=60, keep_first=first, most=most).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_suffix_dedup_repeated_rows_and_ids(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("abc") for _ in range(300))
    got = suffix_dedup.removed_digest(frame(spark, [(1, t), (1, t), (2, t), (2, "short")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 300), (1, 300), (2, 0), (2, 300)]
    kept = suffix_dedup.remove_substrings(frame(spark, [(1, "é" * 150 + t), (2, t)])).collect()
    texts = {r["doc_id"]: r["kept_text"] for r in kept}
    assert texts[2] == "" and texts[1].endswith(t) and set(texts[1].removesuffix(t)) == {"é"}


def naive_previous(text, starts, depth, later=False):
    """Longest previous (next) factors up to depth among the starts, by comparing all pairs."""
    def shared(a, b):
        n = 0
        while n < depth and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    return [max((shared(a, b) for b in starts if (b > a if later else b < a)), default=0) for a in starts]


def test_suffix_order_and_longest_previous_factors():
    rng = random.Random(6)
    for depth in (5, 8, 20, 60, 200):
        text = bytes(rng.choice(b"ab") for _ in range(200)) + b"ab" * 100 + bytes(rng.choice(b"abcdefgh") for _ in range(100))
        starts = np.arange(len(text) - depth + 1)
        raw = np.frombuffer(text, np.uint8)
        order, cls = suffix_dedup.suffix_classes(raw, starts, depth)
        keys = [text[i : i + depth] for i in starts[order]]
        assert keys == sorted(keys) and all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], cls, cls[1:]))
        lcp = suffix_dedup.common_prefixes(raw, starts[order], cls, depth)
        for got, want in ((suffix_dedup.previous_factors(order, lcp), naive_previous(text, starts, depth)), (suffix_dedup.previous_factors(-order, lcp), naive_previous(text, starts, depth, True))):
            assert got.tolist() == [want[i] for i in order]
    none = np.zeros(0, np.int64)
    assert len(suffix_dedup.previous_factors(none, none)) == 0


def test_windows_kept_by_factors():
    rng = random.Random(7)
    for _ in range(60):
        depth = rng.randrange(2, 12)
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(depth, depth + 30))) for _ in range(rng.randrange(1, 6))]
        texts = list(dict.fromkeys(texts))
        copies = np.array([rng.choice((1, 1, 3)) for _ in texts])
        windows = np.array([len(t) - depth + 1 for t in texts])
        seen = {}
        for t, c in zip(texts, copies):
            for i in range(len(t) - depth + 1):
                seen[t[i : i + depth]] = seen.get(t[i : i + depth], 0) + int(c)
        first, alone, met = [], [], set()
        for t in texts:
            for i in range(len(t) - depth + 1):
                w = t[i : i + depth]
                first.append(w not in met)
                alone.append(seen[w] == 1)
                met.add(w)
        assert suffix_dedup.windows_kept(texts, windows, copies, depth, True).tolist() == first
        assert suffix_dedup.windows_kept(texts, windows, copies, depth, False).tolist() == alone


@pytest.mark.parametrize("most", [4096, 2])
@pytest.mark.parametrize("first", [False, True])
def test_debruijn(spark, first, most):
    rows = sorted(corpus(1), key=lambda r: -1 if r[0] is None else r[0])
    own = [tuple((t or "").encode().split()) for _, t in rows]
    want = {(i, len(u), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(u, gone) if not g)).hexdigest()) for (i, _), u, gone in zip(rows, own, brute(own, 12, first))}
    got = debruijn.removed_words_digest(frame(spark, rows), k=12, keep_first=first, most=most).collect()
    assert {tuple(r) for r in got} == want


def test_simhash_links_and_components(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, *seeds} | {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(6)}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(simhash_neardup.signed(f))
    df = spark.createDataFrame([(simhash_neardup.signed(f),) for f in fps], "fp bigint")
    for most in (1024, 3):
        roots = components.connected_components(simhash_neardup.links_within(df, 2, 5, most)).collect()
        got = {}
        for r in roots:
            got.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_simhash_rows(spark):
    rows = [(5, "A b c D e"), (2, "a B c d E"), (9, ""), (3, None), (4, "é Z"), (None, "a b c d e"), (5, "other words here now")]
    got = simhash_neardup.near_duplicates(frame(spark, rows)).collect()
    own = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d", b"c d e")]
    f = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert own[2, f"{f:016x}"] == 2 and own[5, f"{f:016x}"] == 2 and own[None, f"{f:016x}"] == 2
    assert own[9, "0" * 16] == own[3, "0" * 16] == 3 and own[4, f"{xxhash.xxh64_intdigest('é z'.encode(), 42):016x}"] == 4 and len(got) == 7


@pytest.mark.parametrize("most", [4096, 8])
def test_similar_documents(spark, most):
    """Against all pairs: links only at 0.8 or more (or 4 of 64 bits), and nearly all of those."""
    rng = random.Random(3)
    rows = []
    for group in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 80, 300)))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, "one two"), (901, "ONE  two"), (902, ""), (903, None), (904, "x"), (None, rows[0][1]), (7, rows[7][1]), (905, " ".join(rows[0][1].split()[:-1]))]
    got = simhash_neardup.similar_documents(frame(spark, rows), most=most).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in got}
    sets = {i: set(simhash_neardup.shingle_hashes(t or "", 5).tolist()) for i, t in rows}
    fps = {i: simhash_neardup.shingle_fingerprint(t or "", 5) for i, t in rows}
    joined = {i: i for i in sets}
    linked = missed = 0
    for a in sets:
        for b in sets:
            alike = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            if alike >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= 4:
                linked, missed = linked + 1, missed + (of[a] != of[b])
                old, new = joined[a], joined[b]
                joined = {k: new if v == old else v for k, v in joined.items()}
    assert linked > 400 and missed <= 0.02 * linked
    assert all(joined[a] == joined[b] for a in of for b in of if of[a] == of[b])
    assert of[901] == of[900] == 900 and of[903] == of[902] == 902 and of[904] == 904 and of[None] == of[0] == of[905]


def plain_fingerprint(text):
    """The 128 bits by one vote after another."""
    words = (text or "").encode().split()
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    own = [mix(sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)) & mask) for w in words]
    terms = [(mix((a * 3 + b) & mask), len(v) + len(w)) for a, b, v, w in zip(own, own[1:], words, words[1:])] or [(h, len(w)) for h, w in zip(own, words)]
    bits = 0
    for part, salt in ((0, None), (1, 0xD6E8FEB86659FD93)):
        for bit in range(64):
            vote = sum(n if (h if salt is None else mix(h ^ salt)) >> bit & 1 else -n for h, n in terms)
            bits |= (vote > 0) << (64 * part + bit)
    return f"{bits:032x}"


def test_fingerprint_by_plain_votes():
    for _, t in corpus(5, 25):
        assert fingerprints.fingerprint(t or "").hex() == plain_fingerprint(t)
    assert fingerprints.fingerprint("") == fingerprints.fingerprint(" \t\n") == bytes(16)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_fingerprints(spark, parts):
    rows = [(i, t) for i, t in corpus(2) if i is not None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(frame(spark, rows)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        changed = t[: len(t) - cut] + other[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == plain_fingerprint(t) and got[i]["edited_fingerprint"] == plain_fingerprint(changed)
        assert got[i]["near_next"] == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(other))
    alone = fingerprints.fingerprint_with_next(frame(spark, [(None, "a b")])).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(None, "x y z"), (None, "x y z"), (None, None), (5, "a b c d e f"), (5, "other text here now"), (5, "a b c d e f"), (7, "top of all documents")]
    got = fingerprints.fingerprint_with_next(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    top = next(r for r in got if r["doc_id"] == 7)
    assert top["edited_sha256"] in {hashlib.sha256(f"top of all doc{t[:6]}".encode()).hexdigest() for t in ("a b c d e f", "other text here now")}
    texts, seconds = {t or "" for _, t in rows}, {r["edited_sha256"] for r in got}
    assert seconds <= {hashlib.sha256((t[: len(t) - len(t) // 3] + o[: len(t) // 3]).encode()).hexdigest() for t in texts for o in texts}


def test_find_within(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(128) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(6))) for f in fps for _ in range(3)]
    df = spark.createDataFrame([(i, f"{f:032x}") for i, f in enumerate(fps)] + [(999, None)], "id int, fingerprint string")
    least = {f: fps.index(f) for f in fps}
    want = {(least[a], least[b], (a ^ b).bit_count()) for a in fps for b in fps if (a ^ b).bit_count() <= 3}
    assert sorted(tuple(r) for r in fingerprints.find_within(df, df, 3, 6).collect()) == sorted(want)
    assert {(r["id"], r["class"]) for r in fingerprints.classes(df).collect()} == {(i, least[f]) for i, f in enumerate(fps)}
    copies = spark.createDataFrame([(i, "0" * 32) for i in range(300)], "id int, fingerprint string")
    assert [tuple(r) for r in fingerprints.find_within(copies, copies).collect()] == [(0, 0, 0)]
    assert fingerprints.find_within(df.limit(0), df).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["Straße", "it's", "3,5", "naïve", "<|endoftext|>", "漢字", "ΑΣ", "x\x1cy", "word.", "!!"]) for _ in range(rng.randrange(400)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "null id"), (3, rows[3][1])]
    got = packing.pack_documents(frame(spark, rows), path, window=256).collect()
    known = Tokenizer.from_file(path)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, known.encode(t or "", add_special_tokens=False).ids + [1])
    by_sequence, pieces = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    for i, own in pieces.items():
        assert sum(n for _, n in own) == len(ids[i]) * sum(1 for j, _ in rows if j == i)


def test_closest_fill():
    rng = random.Random(10)
    for _ in range(200):
        stock = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(1, 80)
        sums = {0}
        for s, c in stock.items():
            sums |= {x + s * k for x in sums for k in range(c + 1)}
        used = packing.closest_fill(sorted(stock.items(), reverse=True), room)
        assert sum(s * k for s, k in used) == max(x for x in sums if x <= room) and all(k <= stock[s] for s, k in used)


def test_sentencepiece(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece.Coder(path)
    texts = ["", "a", " lead", "two  blanks\n\nand lines ", "漢字かな 😀 Straße", "the theme themes then", "▁mark ▁▁x", *[t or "" for _, t in corpus(3)]]
    assert [memoryview(x).cast("I").tolist() for x in own.encode(texts)] == own.processor.encode(texts)
    got = sentencepiece.code_digest(frame(spark, [(1, "some text"), (2, None), (None, "x y")]), path).collect()
    assert sorted((r["n_tokens"] > 0, r["round_trip"]) for r in got) == [(False, True), (True, True), (True, True)]
    rows = sentencepiece.code_documents(frame(spark, [(1, "tea  time\n")]), path).first()
    assert rows["decoded"] == "tea  time\n" and rows["ids"] == own.processor.encode("tea  time\n")


def test_media(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(4)] + [(7, "dup"), (7, "dup")]
    got = media.media_columns(frame(spark, rows), str(tmp_path / "m")).collect()
    assert len(got) == len(rows)
    for i, t in {r for r in rows if r[0] is not None and r[0] != 7}:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = next(r for r in got if r["doc_id"] == i)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), None)
    assert len({r["media_sha256"] for r in got if r["doc_id"] == 7 and r["n_bytes"] == 3}) == 1


def stored(spark, root, **options):
    spark.dataSource.register(media.ArchiveSource)
    return media.describe(spark.read.format("glyph_archive").options(**options).load(str(root)))


def test_media_damage(spark, tmp_path):
    media.store(frame(spark, [(1, "one"), (2, "two")]).coalesce(1), str(tmp_path / "m"))
    (path,) = (tmp_path / "m").glob("*.zip")
    data = bytearray(path.read_bytes())
    data[data.find(b"IDAT") + 6] ^= 255
    path.write_bytes(bytes(data))
    got = {r["doc_id"]: r for r in stored(spark, tmp_path / "m", rangeBytes=100).collect()}
    assert got[1]["error"] and got[1]["n_bytes"] is None and got[2]["n_bytes"] == 3 and got[2]["error"] is None


def test_media_written_twice_or_lost(spark, tmp_path):
    """Attempts that run again in another order leave no second row; a lost or changed archive is an error."""
    root, rows = tmp_path / "m", [(i, f"text {i} " * 40) for i in range(60)]
    media.write_archives(frame(spark, rows).repartition(3), str(root), most=2000).collect()  # an attempt whose rows never reach the manifest
    for parts, most in ((2, 3000), (4, 1500)):
        media.store(frame(spark, rows).repartition(parts), str(root), most=most)
        for size in (500, 8 << 20):
            got = stored(spark, root, rangeBytes=size).collect()
            assert sorted(r["doc_id"] for r in got) == list(range(60)) and not any(r["error"] for r in got)
    media.store(frame(spark, []), str(tmp_path / "none"))
    assert stored(spark, tmp_path / "none").collect() == []
    one, other = sorted(root.glob("*.zip"))[:2]
    data = one.read_bytes()
    one.write_bytes(other.read_bytes())
    with pytest.raises(Exception, match="manifest"):
        stored(spark, root).collect()
    one.unlink()
    with pytest.raises(Exception, match="No such file|not exist"):
        stored(spark, root).collect()
    one.write_bytes(data)
    (root / "manifest").rename(root / "elsewhere")  # a folder of archives alone
    assert stored(spark, root).count() == 60


def test_directory_entries_beyond_32_bits():
    name, wide = b"0000000-5.png", (5_000_000_000, 6_000_000_000, 7_000_000_000)
    extra = struct.pack("<HH3Q", 1, 24, *wide)
    head = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 77, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    assert list(media.directory_entries(head + name + extra)) == [("0000000-5.png", wide[2], wide[1], 77, 0)]


def test_toxicity(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + ["zork" + word() for _ in range(3)] * bad)))
        labels.append((i, int(bad)))
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(frame(spark, rows + [(900, None), (901, "")]), model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == y for i, y in held) and 0 <= got[900]["score"] < 0.5 and got[900]["score"] == got[901]["score"]
    empty = toxicity.train(frame(spark, []), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score_documents(frame(spark, [(1, "x")]), empty).count() == 1


def test_language(spark):
    rng = random.Random(12)
    signs = {"aa": "abcde", "bb": "xyzuv", "cc": "äöüßk"}
    rows = [(i, " ".join("".join(rng.choice(signs[k]) for _ in range(5)) for _ in range(20)), k, "s", 0) for i, k in enumerate(list(signs) * 60)]
    df = spark.createDataFrame(rows + [(900, None, None, "s", 0), (901, "12 34", "aa", "s", 0), (902, "", "aa", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in language_id.predict_documents(df, language_id.train(df)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, *_ in rows) and all(got[i]["lang_pred"] == "und" for i in (900, 901, 902))
    assert language_id.predict_documents(df, language_id.train(df.where("false"))).where("lang_pred <> 'und'").isEmpty()


def test_empty_tables(spark):
    none = frame(spark, [])
    path = tokenizer_path("word_bpe_49k.json")
    for df in (suffix_dedup.removed_digest(none), debruijn.removed_words_digest(none), simhash_neardup.near_duplicates(none), simhash_neardup.similar_documents(none), fingerprints.fingerprint_with_next(none), packing.pack_documents(none, path), licenses.scan_documents(none), sentencepiece.code_digest(none, tokenizer_path("piece_bpe_32k.model"))):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("glyph-pipeline-*/*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert 100 < len({r["doc_id"] for r in rows}) <= 200 and len(corpus_pipeline.STAGES) == 5
    assert {x.name for x in set(folder.glob("glyph-pipeline-*/*")) - before if x.is_dir()} == {"3-suffix_dedup"}


def test_stages_keep_columns_of_clashing_names_and_clean_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = ["score", "predicted", "lang_pred", "kept_text", "row", "component_id", "fp", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert len(rows) > 100, name
        for r in rows:
            assert [r[n] for n in names] == [f"{n} {r['doc_id']}" for n in names], name
            assert name != "suffix_dedup" or r["n_chars"] == len(r["text"])
        assert out.where(F.lit(False)).count() == 0
        assert stage(spark, docs.limit(0), sf).collect() == [], name


def test_stages_on_nulls_and_repeated_rows(spark):
    import corpus_pipeline

    text = "the house was old and the garden was full of trees that nobody had seen for many years " * 3
    docs = spark.createDataFrame([(1, text, None, None, None), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "", None, "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, "/root/testdata/sf0.001").collect()
        ids = sorted((r["doc_id"] or 0) for r in rows)
        assert ids == {"toxicity": [0, 1, 1, 3, 4], "language_id": [0, 1, 1], "simhash_neardup": [0, 1, 1, 3], "suffix_dedup": [0, 3, 4]}[name], name
