"""Windows (so many consecutive units of a document) that also occur elsewhere, over all documents.

Units are bytes or words.  Each window is dealt by its minimizer, the least hash among the
stretches of `gram` units in it, where stretches that a sample shows to be common come last; windows that
follow one another with the same minimizer form a run, kept as one row (two hashes and a place).
Equal windows have equal minimizers, so

1. a run whose minimizer occurs once has no repeat;
2. the texts of all other runs, one of each different kind with its number of copies, are read at their
   places, checked against the run's hash and meet by minimizer; what repeats there is decided by
   the operator (suffix order, or a graph of words);
3. where a minimizer has more kinds than a task should hold, its windows are dealt singly, by their hash.

Reports name the windows that stay, so that a passage in any number of documents sends nothing to
them: what isn't reported is repeated.  Two runs count as copies if 55 bits of their minimizer's hash and 64 bits
of the hash of their whole text agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm.common import hash_bound, hash_rank, kept_names
from glyphstream.llm.hashing import stretches
from glyphstream.llm.hashing import words as word_bounds

LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    window: int
    gram: int
    words: bool

    def split(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The document's bytes (words: joined by one space) and each unit's start and end in them."""
        data = text.encode("utf-8", "replace")
        if self.words:
            data = b" ".join(data.split())
            return data, *word_bounds(np.frombuffer(data, np.uint8))
        at = np.arange(len(data) + 1)
        return data, at[:-1], at[1:]

    def runs(self, data: bytes, starts: np.ndarray, ends: np.ndarray, common: Common | None = None) -> tuple[np.ndarray, ...]:
        """First and last window, minimizer, hash of the covered text, and if the minimizer occurs twice there."""
        n, k = len(starts), self.gram
        if n < self.window:
            return (np.zeros(0, np.int64),) * 5
        h = stretches(np.frombuffer(data, np.uint8), starts[: n - k + 1], ends[k - 1 :]) >> np.uint64(1)
        if common:
            h[common.at(h)] |= np.uint64(1 << 63)
        low = np.uint64(255)
        # the lowest byte tells the place, modulo 256, so a run keeps one place of its minimizer
        m = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
        width, size = self.window - k + 1, 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: size - width], m[width - size :])
        edge = np.flatnonzero(m[1:] != m[:-1])
        lo, hi = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(m) - 1]])
        least = m[lo]
        place = hi + (((least & low).astype(np.int64) - hi) & 255)
        a, b, p, q = (x.tolist() for x in (starts[lo], ends[hi + self.window - 1], starts[place], ends[place + k - 1]))
        digest = xxhash.xxh3_64_intdigest
        texts = np.array([digest(data[x:y]) for x, y in zip(a, b)], np.uint64).view(np.int64)
        twice = np.array([data.find(data[r:s], x, y) != r or data.find(data[r:s], r + 1, y) >= 0 for x, y, r, s in zip(a, b, p, q)], bool)
        return lo, hi, (least >> np.uint64(8)).astype(np.int64), texts, twice


class Common:
    """Gram hashes (63 bits) that are common, as far as their upper 55 bits tell."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.heads = np.zeros(1 << 22, bool)
        self.heads[(self.grams >> np.uint64(33)).astype(np.int64)] = True

    def at(self, h: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.heads[(h >> np.uint64(41)).view(np.int64)])
        own = h[near] >> np.uint64(8)
        found = np.searchsorted(self.grams, own)
        return near[self.grams[np.minimum(found, len(self.grams) - 1)] == own]


@dataclass(frozen=True)
class Keyed:
    """rows (id, tie, row): id and tie order and name the documents, row has all columns."""

    rows: DataFrame
    repeated: bool  # whether some doc_id has several rows

    def different(self) -> DataFrame:
        """One of each document's equal rows."""
        return self.rows.dropDuplicates(["id", "tie"]) if self.repeated else self.rows


def with_key(docs: DataFrame) -> Keyed:
    """id is the doc_id, null as the least value; tie is 0 or, where any doc_id repeats, the text's hash.

    So rows of equal doc_id follow one another by that hash, and equal rows are one document in the order.
    """
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    tie = F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("bigint")
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST))
    return Keyed(docs.select(own.alias("id"), tie.alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), repeated)


def common_grams(keyed: Keyed, units: Units, docs: int = 500, least: int = 4, most: int = 1 << 14) -> Common | None:
    """Grams that `least` of about `docs` sampled documents hold, the most common `most` of them.

    They only say by which minimizers windows are dealt, never what repeats: windows of a common passage meet
    by their rarer grams, so that no minimizer gathers all that surrounds it.
    """
    n = keyed.rows.count()
    if not n:
        return None
    text = F.col("row.text").cast("string")
    near = keyed.rows.where((hash_rank("id", "tie", salt="grams") <= hash_bound(docs, n)) & (F.octet_length(text) < 1 << 16))
    near = Keyed(near, keyed.repeated).different()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            found = [np.zeros(0, np.uint64)]
            for t in texts:
                data, starts, ends = units.split(t)
                if len(starts) >= units.gram:
                    found.append(np.unique(stretches(np.frombuffer(data, np.uint8), starts[: len(starts) - units.gram + 1], ends[units.gram - 1 :]) >> np.uint64(9)))
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], ["gram", "n"])

    counts = near.select("id", text.alias("text")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(most).collect()  # `most` bounds it
    return Common(np.array([r["gram"] for r in top])) if top else None


def _texts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        col = batch.column(1)
        if pa.types.is_struct(col.type):
            col = col.field(col.type.get_field_index("text"))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges, edges[1:]):
            if y > x:
                yield batch.slice(x, y - x), [t or "" for t in col.slice(x, y - x).to_pylist()]
    pa.default_memory_pool().release_unused()


def find_runs(keyed: Keyed, units: Units, common: Common | None) -> DataFrame:
    """(id, tie, key, ctx, at, twice, copies) of all documents; equal runs of a slice are one row with the first place.

    A place `at` holds the first window in its upper and the last one in its lower 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            found, counts = [], []
            for t in texts:
                found.append(units.runs(*units.split(t), common))
                counts.append(len(found[-1][0]))
            lo, hi, key, ctx, twice = (np.concatenate(x) for x in zip(*found))
            if not len(key):
                continue
            own, at = np.repeat(np.arange(len(texts)), counts), lo << 32 | hi
            ids, ties = (batch.column(k).to_numpy()[own] for k in (0, 2))
            order = np.lexsort((at, ties, ids, ctx, key))
            k, c = key[order], ctx[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
            first, copies = order[new], np.diff(np.append(new, len(order)))
            columns = [*(x[first] for x in (ids, ties, key, ctx, at)), twice[first].astype(bool), copies.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "tie", "key", "ctx", "at", "twice", "copies"])

    rows = keyed.rows.select("id", F.col("row.text").cast("string").alias("text"), "tie")
    return rows.mapInArrow(run, "id bigint, tie bigint, key bigint, ctx bigint, at bigint, twice boolean, copies bigint")


def extract(wanted: DataFrame, units: Units, single: bool) -> DataFrame:
    """Of (id, row, tie, runs array<struct<key, ctx, copies, at>>): each run's text, or its windows with their hash and ends.

    Rows (id, tie, key, copies, at, text) or (id, tie, key, copies, at, hash, left, right); left and right are
    hashes of a window without its last and its first unit.
    """
    names = ["id", "tie", "key", "copies", "at", *(["hash", "left", "right"] if single else ["text"])]
    kinds = [pa.int64()] * 8 if single else [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, w = xxhash.xxh3_64_intdigest, units.window
        for batch, texts in _texts(batches):
            out, size = [], 0
            for own, tie, text, runs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, batch.column(3).to_pylist()):
                data, starts, ends = units.split(text)
                for r in runs:
                    lo, hi = r["at"] >> 32, r["at"] & 0xFFFFFFFF
                    piece = data[starts[lo] : ends[hi + w - 1]]
                    if digest(piece) - (1 << 64) * (digest(piece) >> 63) != r["ctx"]:
                        raise RuntimeError(f"document {own} has another text at its place {lo} than when it was first read")
                    if single:
                        for s in range(lo, hi + 1):
                            inner = [(starts[s], ends[s + w - 1]), (starts[s], ends[s + w - 2]), (starts[s + 1], ends[s + w - 1])] if w > 1 else [(starts[s], ends[s])] * 3
                            out.append((own, tie, r["key"], r["copies"], s << 32 | s, *(digest(data[a:b]) - (1 << 63) for a, b in inner)))
                    else:
                        out.append((own, tie, r["key"], r["copies"], r["at"], piece))
                    size += len(piece)
                if len(out) > 20_000 or size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = ", ".join(f"{c} {'binary' if c == 'text' else 'bigint'}" for c in names)
    return wanted.select("id", "row", "tie", "runs").mapInArrow(run, schema)


def in_blocks(texts: DataFrame, each: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, block: int = 2 << 20) -> DataFrame:
    """What `each` gives for tables of whole minimizers, about `block` bytes of text at a time, in order of key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, last = [], 0, None
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            for x, y in zip(e := [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)], e[1:]):
                if y == x:
                    continue
                if size >= block and key[x] != last:
                    yield from each(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                waiting.append(batch.slice(x, y - x))
                size += waiting[-1].column(batch.schema.get_field_index("text")).nbytes
                last = key[x]
        if waiting:
            yield from each(pa.Table.from_batches(waiting))

    return texts.repartition("key").sortWithinPartitions("key", "id", "tie", "at").mapInArrow(run, schema)


def windows_that_stay(keyed: Keyed, units: Units, *, by_text: Callable[[DataFrame], DataFrame], by_window: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """(id, tie, stay array<bigint>): the places of the windows that occur nowhere else, or that by_text and by_window name.

    by_text gets the runs (key, copies, id, tie, at, text) of minimizers that occur more than once with at
    most `most` kinds of runs; by_window gets each different window (key, hash, left, right, copies, id, tie, at) of the others.
    """
    place = F.struct("id", "tie", "at")
    runs = find_runs(keyed, units, common_grams(keyed, units)).repartition("key")
    # That shuffle serves all three uses below, which read the same columns.
    kinds = runs.groupBy("key", "ctx").agg(F.sum("copies").alias("copies"), F.max("twice").alias("twice"), F.min(place).alias("f"))
    same = Window.partitionBy("key")
    kinds = kinds.select("*", F.sum("copies").over(same).alias("n"), F.count("*").over(same).alias("kinds"))
    alone = (F.col("n") == 1) & ~F.col("twice")
    wanted = kinds.where(~alone).select("f.id", "f.tie", "kinds", F.struct("key", "ctx", "copies", "f.at").alias("run"))

    def pick(rows: DataFrame, single: bool) -> DataFrame:
        own = rows.groupBy("id", "tie").agg(F.collect_list("run").alias("runs"))
        return extract(keyed.different().join(own, ["id", "tie"]), units, single)

    texts = by_text(pick(wanted.where(F.col("kinds") <= most), False))
    windows = pick(wanted.where(F.col("kinds") > most), True).groupBy("key", "hash").agg(F.sum("copies").alias("copies"), F.min(F.struct("id", "tie", "at", "left", "right")).alias("f"))
    found = kinds.where(alone).select("f.*").unionByName(texts).unionByName(by_window(windows.select("key", "hash", "copies", "f.*")))
    return found.groupBy("id", "tie").agg(F.collect_list("at").alias("stay"))


def covered(n: int, window: int, stay: np.ndarray) -> np.ndarray:
    """Which of n units lie in a window that doesn't stay."""
    count = n - window + 1
    if count <= 0:
        return np.zeros(n, bool)
    step = np.zeros(count + 1, np.int64)
    np.add.at(step, stay >> 32, 1)
    np.add.at(step, (stay & 0xFFFFFFFF) + 1, -1)
    gone = np.cumsum(step)[:count] == 0
    over = np.zeros(n + 1, np.int64)
    over[:count] += gone
    over[window:] -= gone
    return np.cumsum(over)[:n] > 0


def map_removed(keyed: Keyed, stay: DataFrame, units: Units, each: Callable, schema: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and what each(data, starts, ends, removed) returns for its document, by schema.

    A kept column named like one of the schema gets `_of_docs` behind its name.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    own = kept_names(keep, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            out, stays = [], batch.column(2)
            at, flat = stays.offsets.to_numpy(), stays.values.to_numpy()
            for k, text in enumerate(texts):
                data, starts, ends = units.split(text)
                out.append(each(data, starts, ends, covered(len(starts), units.window, flat[at[k] : at[k + 1]])))
            row = batch.column(1)
            cols = [row.field(row.type.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c) for c in zip(*out)]], [*own, *names])

    types = dict(keyed.rows.select("row.*").dtypes)
    joined = keyed.rows.join(stay, ["id", "tie"], "left").select("id", "row", F.coalesce("stay", F.array().cast("array<bigint>")).alias("stay"))
    return joined.mapInArrow(run, ", ".join([*[f"`{o}` {types[c]}" for c, o in zip(keep, own)], schema]))
