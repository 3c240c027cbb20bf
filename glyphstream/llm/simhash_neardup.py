"""Near duplicates by SimHash: all links within a Hamming radius, by pigeonring filtering.

Fingerprints are cut into m segments on a ring.  If two differ in r bits or fewer, the ring has a
start from which every chain of l segments differs in l * r / m bits at most.  So a table for each start
is keyed by the segments whose budget is below one bit; candidates that meet there must keep the
budgets of the longer chains, and only then are all bits compared.

All this works on distinct fingerprints, 8 bytes each.  A bucket of more than `most` of them is dealt
out again by a further part of the remaining bits (r + 1 parts, one of which must agree), as often
as needed: a bucket whose members agree on all but b bits has 2**b members at most.  A bucket
gives a spanning forest of its links, not all pairs; components follow from Spark joins.

Texts whose shingle sets have a similarity (shared / all) of 0.8 differ in about 10 of 64 bits, and no
segments are selective at that radius.  similar_documents() therefore confirms the links found as above with the whole
shingle sets and looks for further ones between all different sets: those whose smallest mixed shingle
hashes agree in a band of three meet, sketches of 1024 bits estimate their similarity, and the links
of each bucket's maximum spanning forest are confirmed too.  Where one is not, the other pairs follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.common import cut, release, slices
from glyphstream.llm.components import connected_components
from glyphstream.llm.hashing import mix, signed_votes

BITS, SEED = 64, 42
WIDE, BANDS, BAND_ROWS = 1024, 9, 3
#: A table of two numbers with so many rows at most is broadcast (1.6 MB).
BROADCAST_ROWS = 100_000
_UNIT = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
#: Offsets that make independent hashes of one: that of the wide fingerprint, then those of the bands.
_LANES = np.arange(1, BANDS * BAND_ROWS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The number whose bit i is set if more than half of h have it set."""
    return int(_UNIT[signed_votes(h) > 0].sum()) if len(h) else 0


def shingle_fingerprint(text: str, width: int = 3) -> int:
    """Bit i is set if more than half of the shingles' XXH64 values have it set; 0 without words."""
    return majority(shingle_hashes(text, width))


def set_id(distinct: np.ndarray) -> int:
    """A signed 64-bit number for the set of the sorted distinct hashes."""
    return signed(xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED))


def wide_sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """4 bits for each of 256 parts of the distinct hashes h, mixed, and a key for each band of their smallest mixed values.

    A part's bits tell its smallest value, 1 to 15; 0 stands for an empty part.
    """
    m = np.sort(mix(h + _LANES[0]))
    part = (m >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    own = np.zeros(WIDE // 4, np.uint8)
    own[part[first]] = m[first] % np.uint64(15) + np.uint64(1)
    least = np.full(len(_LANES) - 1, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 1024):
        np.minimum(least, mix(h[a : a + 1024, None] + _LANES[1:]).min(0), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    key = mix(mix(mix(bands[:, 0]) + bands[:, 1]) + bands[:, 2])
    return (own[::2] | own[1::2] << 4).tobytes(), key.view(np.int64).tolist()


def filled(x: np.ndarray) -> np.ndarray:
    """For each row of x, how many groups of 4 bits aren't zero."""
    x = x | x >> np.uint64(2)
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            f = np.array([shingle_fingerprint(t or "", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class Ring:
    """Masks of the chains of m segments for radius r."""

    def __init__(self, radius: int, segments: int):
        edges = [BITS * k // segments for k in range(segments + 1)]
        own = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(segments)]
        exact = max(n for n in range(1, segments + 1) if n * radius < segments)
        chain = lambda i, n: sum(own[(i + j) % segments] for j in range(n))
        self.radius = radius
        self.keys = [chain(i, exact) for i in range(segments)]
        self.budgets = [[(chain(i, n), n * radius // segments) for n in range(exact + 1, segments + 1)] for i in range(segments)]

    def parts(self, mask: int) -> list[int]:
        """mask with each of radius + 1 parts of the bits that it lacks."""
        free = [b for b in range(BITS) if not mask >> b & 1]
        cut_at = [len(free) * k // (self.radius + 1) for k in range(self.radius + 2)]
        return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cut_at, cut_at[1:]) if y > x]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(start: int, fps: np.ndarray, ring: Ring) -> list[tuple[int, int]]:
    """A spanning forest of the links in one bucket."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    step = max(1, (1 << 20) // len(fps))
    for a in range(0, len(fps), step):
        apart = fps[a : a + step, None] ^ fps[None, :]
        i, j = np.nonzero(np.triu(np.ones(apart.shape, bool), a + 1))
        apart = apart[i, j]
        for mask, budget in ring.budgets[start]:
            keep = np.bitwise_count(apart & np.uint64(mask)) <= budget
            i, j, apart = i[keep], j[keep], apart[keep]
        for x, y in zip((i + a).tolist(), j.tolist()):
            if (p := find(x)) != (q := find(y)):
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
    signed_fps = fps.view(np.int64)
    return [(int(signed_fps[x]), int(signed_fps[y])) for x, y in links]


def links_within(distinct: DataFrame, radius: int = 2, segments: int = 5, most: int = 1024) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (column fp) that give their components' connections."""
    ring = Ring(radius, segments)
    key = lambda: F.col("mask").bitwiseAND(F.col("fp")).alias("key")
    tables = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(ring.keys)])
    rows = distinct.select("fp", F.explode(tables).alias("t")).select("t.start", "t.mask", "fp").select("start", "mask", "fp", key())
    masks, found = set(ring.keys), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets follow one another; only the last of a batch waits for the next batch."""
        kept = None
        for batch in batches:
            table = np.stack([np.asarray(batch.column(k), np.int64) for k in range(4)])
            kept = table if kept is None else np.concatenate([kept, table], axis=1)
            new = np.flatnonzero((kept[[0, 1, 3], 1:] != kept[[0, 1, 3], :-1]).any(0)) + 1
            if len(new):
                yield from buckets(kept[:, : new[-1]], new[:-1])
                kept = kept[:, new[-1] :]
        if kept is not None and kept.shape[1]:
            yield from buckets(kept, np.zeros(0, np.int64))

    def buckets(table: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges, links = [0, *new.tolist(), table.shape[1]], []
        for x, y in zip(edges, edges[1:]):
            if y - x > 1:
                links += bucket_links(int(table[0, x]), table[2, x:y].copy().view(np.uint64), ring)
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    while True:
        rows = cut(rows)
        sizes = rows.groupBy("start", "mask", "key").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > most).drop("n"))
        fine = rows
        if not (hot := large.isEmpty()):
            fine = rows.join(large, ["start", "mask", "key"], "left_anti")
        found.append(fine.select("start", "mask", "fp", "key").repartition("start", "mask", "key").sortWithinPartitions("start", "mask", "key").mapInArrow(run, "a bigint, b bigint"))
        if hot:
            break
        finer = {m: ring.parts(m) for m in masks}
        masks = {x for v in finer.values() for x in v}
        of = F.create_map(*[F.lit(signed(x)) if k == 0 else F.array(*[F.lit(signed(y)) for y in x]) for m, v in finer.items() for k, x in enumerate((m, v))])
        rows = rows.join(large, ["start", "mask", "key"], "left_semi").select("start", "fp", F.explode(of[F.col("mask")]).alias("mask")).select("start", "mask", "fp", key())
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 2, segments: int = 5, most: int = 1024, verify: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for each row of docs.

    Null and empty texts have fingerprint zero and are linked like others.  A null doc_id stays null and gives
    no component_id to others; equal rows are in one component.  An empty table gives no row.  Other columns
    are ignored.  `verify` may narrow the links (a, b) given the (doc_id, fp) rows.
    """
    own = cut(fingerprints(docs, width))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = links_within(distinct.select("fp"), radius, segments, most)
    if verify:
        links = verify(links, own)
    return named(own, links)


def named(own: DataFrame, links: DataFrame, node: str = "fp") -> DataFrame:
    """The rows (doc_id, fp) with their components by the links (a, b) between the values of node."""
    distinct = own.groupBy(node).agg(F.min("doc_id").alias("least"))
    roots = connected_components(links)
    rooted = distinct.join(roots, distinct[node] == roots.node, "left").select(node, "least", F.coalesce("root", node).alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select(node, "component_id")
    return own.join(found, node).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, sid, wide, keys) of docs (doc_id, text): sid names the set of distinct shingles; no keys without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t or "", width)
                own = np.unique(h)
                rows.append((signed(majority(h)), set_id(own), *(wide_sketch(own) if len(own) else (b"", []))))
            fp, sid, wide, keys = zip(*rows)
            columns = [batch.column(0), pa.array(fp, pa.int64()), pa.array(sid, pa.int64()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sid", "wide", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, sid bigint, wide binary, keys array<bigint>")


def likely_links(root: np.ndarray, wide: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The links between different roots of a maximum spanning forest of the pairs estimated at `least` or more (Prim's order).

    Rows of one root count as linked.
    """
    waits, best, via, links = np.ones(len(root), bool), np.full(len(root), -1.0), np.zeros(len(root), np.int64), []
    for _ in range(len(root)):
        u = int(np.argmax(np.where(waits, best, -2.0)))
        if best[u] >= least and root[via[u]] != root[u]:
            links.append((int(via[u]), u))
        waits[u] = False
        alike = np.where(root == root[u], 2.0, estimates(wide, u))
        via[alike > best] = u
        best = np.maximum(best, alike)
    return links


def further_links(root: np.ndarray, wide: np.ndarray, earlier: np.ndarray, least: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs estimated at `least` or more that join different roots and have a rank from `low` on below `high`.

    A pair's rank is the better of its places in its two rows' lists, the closest first.  Pairs that meet in an earlier
    band, by the rows' keys of the earlier bands, are left to that band, so each pair has one rank in one bucket.  Last, whether
    there are such pairs from `high` on.
    """
    size = len(root)
    none = np.uint32(size)
    rank = np.full((size, size), none, np.uint16 if size < 1 << 16 else np.uint32)
    for u in range(size):
        alike = estimates(wide, u)
        alike[(earlier == earlier[u]).any(1)] = -1
        alike[u] = -1
        near = np.flatnonzero(alike >= least)
        rank[u, near[np.argsort(-alike[near], kind="stable")]] = np.arange(len(near))
    rank = np.minimum(rank, rank.T)
    apart = np.triu((rank != none) & (root[:, None] != root), 1)
    a, b = np.nonzero(apart & (rank >= low) & (rank < high))
    return a, b, bool((apart & (rank >= high)).any())


def estimates(wide: np.ndarray, u: int) -> np.ndarray:
    """The estimated similarity of row u to each row: the share of equal parts among those not empty in both."""
    return 1 - filled(wide ^ wide[u]) / filled(wide | wide[u])


def similar_links(rows: DataFrame, threshold: float, slack: float, most: int, only: DataFrame | None = None, low: int = 0, high: int = 0) -> DataFrame:
    """Links (band, key, a, b) between the sid of rows (sid, root, wide, keys) of different roots, likely at `threshold` less `slack` or more.

    A forest of each bucket; with `only`, the further_links() of those buckets (band, key), and a row without
    a and b for each that has more.  A bucket of one root needs no link.  One of more than `most` rows is cut into blocks, and each pair of
    blocks is a bucket of its own.
    """
    keyed = rows.select("sid", "root", F.posexplode("keys").alias("band", "key"))
    forest = only is None
    if not forest:
        keyed = keyed.join(only, ["band", "key"], "left_semi")
    mixed = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = mixed.select("band", "key", F.when(F.col("size") > most, F.ceil(2 * F.col("size") / most).cast("int")).alias("blocks"))
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != mine)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, mine).alias("x"), F.greatest(k, mine).alias("y")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    dealt = keyed.join(mixed, ["band", "key"]).select("band", "key", "sid", "root", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("at"))
    dealt = dealt.join(rows.select("sid", "wide", *[] if forest else ["keys"]), "sid")
    dealt = dealt.select("band", "key", "at.x", "at.y", "sid", "root", "wide", *[] if forest else [F.slice("keys", 1, F.col("band")).alias("earlier")])

    def found(root: np.ndarray, wide: np.ndarray, earlier: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, bool]:
        if not forest:
            return further_links(root, wide, earlier, threshold - slack, low, high)
        links = np.array(likely_links(root, wide, threshold - slack), np.int64).reshape(-1, 2)
        return links[:, 0], links[:, 1], False

    def buckets(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        band, key, sid, root = (t.column(c).to_numpy() for c in ("band", "key", "sid", "root"))
        wide = t.column("wide")
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                bits = np.frombuffer(b"".join(wide[int(a) : int(b)].to_pylist()), np.uint64).reshape(b - a, -1)
                earlier = None if forest else np.array(t.column("earlier").slice(int(a), int(b - a)).to_pylist(), np.int64).reshape(b - a, band[a])
                x, y, more = found(root[a:b], bits, earlier)
                ends = [pa.array([*sid[a + z].tolist(), *[None] * more], pa.int64()) for z in (x, y)]
                if size := len(ends[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, band[a]), pa.int32()), pa.array(np.full(size, key[a]), pa.int64()), *ends], ["band", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets follow one another; only the last of a batch waits for the next batch."""
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            at = np.stack([kept.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "x", "y")])
            new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            if len(new):
                yield from buckets(kept.slice(0, int(new[-1])), np.array([0, *new]))
                kept = kept.slice(int(new[-1]))
        if kept is not None and kept.num_rows:
            yield from buckets(kept, np.array([0, kept.num_rows]))

    return dealt.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y", "sid").mapInArrow(run, "band int, key bigint, a bigint, b bigint")


def confirmed(links: DataFrame, docs: DataFrame, least: DataFrame, width: int, threshold: float) -> DataFrame:
    """The links (a, b) whose whole shingle sets have a similarity of `threshold` or more; least has (sid, least), a doc_id of each set."""
    nodes = links.select(F.col("a").alias("sid")).unionByName(links.select(F.col("b").alias("sid"))).distinct()
    wanted = cut(least.join(nodes, "sid").select("sid", F.col("least").alias("doc_id")))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = [(sid, own) for sid, t in rows if set_id(own := np.unique(shingle_hashes(t or "", width))) == sid]
            if found:
                hashes = pa.array([own.view(np.int64) for _, own in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([sid for sid, _ in found], pa.int64()), hashes], ["sid", "hashes"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id)).select("sid", "text").mapInArrow(run, "sid bigint, hashes array<bigint>")
    sets = cut(sets.groupBy("sid").agg(F.first("hashes").alias("hashes")))
    for c in ("a", "b"):
        links = links.join(sets.select(F.col("sid").alias(c), F.col("hashes").alias(f"of_{c}")), c)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return links.where(shared >= threshold * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def close_links(own: DataFrame, radius: int, segments: int) -> DataFrame:
    """Links (a, b) between the sets of equal fingerprints and of those within `radius` bits, one set for each fingerprint."""
    of = cut(own.groupBy("fp").agg(F.min("sid").alias("sid")))
    same = own.select("fp", F.col("sid").alias("a")).distinct().join(of.select("fp", F.col("sid").alias("b")), "fp").select("a", "b")
    near = links_within(of.select("fp"), radius, segments)
    for c in ("a", "b"):
        near = near.join(of.select(F.col("fp").alias(c), F.col("sid").alias(f"of_{c}")), c)
    return ordered(same.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))


def ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def similar_documents(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, slack: float = 0.1, radius: int = 4, segments: int = 9, most: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for each row of docs.

    Linked are texts whose sets of shingles have a similarity of `threshold` or more; every link is confirmed with the
    whole sets.  Candidates are texts within `radius` of 64 bits; then all different sets that meet in a band.
    Where a bucket's forest has a link that isn't confirmed, its other candidates between different components are
    tried too, each pair in the first band where it meets, the closest of each text first.  Two
    texts at a similarity of 0.8 meet in no band with a probability of 0.002, and `slack` is 4 standard
    deviations of the estimate there or more, from 5 shingles to 4500.  Nulls, empty texts, repeated rows and empty
    tables as in near_duplicates().
    """
    own = cut(sketches(docs, width))
    sets = cut(own.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct("wide", "keys")).alias("of")))
    least = sets.select("sid", "least")
    links = cut(confirmed(cut(close_links(own, radius, segments)), docs, least, width, threshold))
    only, low, high = None, 0, 0
    while True:
        roots = connected_components(links)
        rows = sets.join(roots, sets.sid == roots.node, "left").select("sid", F.coalesce("root", "sid").alias("root"), "of.wide", "of.keys")
        found = cut(similar_links(rows, threshold, slack, most, only, low, high).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}))
        new = cut(confirmed(cut(ordered(found)), docs, least, width, threshold))
        links = links.unionByName(new)
        open_links = found.join(new, ["a", "b"], "left_anti") if only is None else found.where("a is null")
        only = cut(open_links.select("band", "key").distinct())
        if not (n := only.count()):
            break
        if n <= BROADCAST_ROWS:
            only = F.broadcast(only)
        del found, new, open_links, rows, roots
        release(docs.sparkSession)
        low, high = high, max(8, 8 * high)
    return named(own.select("doc_id", "fp", "sid"), links, "sid")
