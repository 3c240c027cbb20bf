"""Substring removal by a compacted de Bruijn graph of words.

An edge is a k-mer of consecutive words; its nodes are its first and last k - 1 words.

1. Edges are dealt by minimizers, and those that follow one another in a document with the same minimizer
   travel as one run (repeats.windows_that_stay).  A run whose minimizer occurs once has no repeated edge.
2. The other runs are read at their sources and cut into edges again, one table for some minimizers:
   edges are told apart by their words, counted, and given their first source.  Inside the table a repeated edge and the next
   are one piece if their node has no other repeated edge in or out, both are as frequent, and their sources
   follow one another.
3. Pieces meet at their end nodes by a grouped Spark join.  Where a node has one piece in and one out, again as
   frequent and with sources that follow one another, the two are parts of one nonbranching path.  Linked pieces lie
   side by side in their source document, so a window over each source names all paths at once, in
   one shuffle instead of one for each doubling of their length.
4. The paths, each with its source (document and words), are the long repeated spans; all edges that are not
   in one at this source and not unique are removed.

A node inside a piece is looked at within its minimizers' table only; that can make a path longer than
a look at all its edges would, never change an edge's count or source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm.repeats import Keyed, Units, in_blocks, map_removed, windows_that_stay, with_key

PIECE = "id bigint, tie bigint, at bigint, n bigint, left bigint, right bigint"


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def word_classes(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A number for each start; equal ones have equal ids[start:start + size].  Ranks of doubled lengths, the last two overlapping."""
    if not size:
        return np.zeros(len(starts), np.int64)
    r, n, done = ids.astype(np.uint64), len(ids), 1
    while done * 2 <= size:
        after = np.zeros(n, np.uint64)
        after[: n - done] = r[done:] + np.uint64(1)
        r = _ranks(r << np.uint64(32) | after)
        done *= 2
    return _ranks(r[starts] << np.uint64(32) | r[starts + (size - done)]).astype(np.int64)


def pieces_of(texts: list[bytes], windows: np.ndarray, copies: np.ndarray, k: int) -> list[tuple[int, int, int, int, int, int]]:
    """(text, first edge, last edge, count, left node, right node) of the pieces in texts of words joined by one space.

    Texts come in order of their places, `copies` of each.  A piece of count 1 is an edge that occurs once, without nodes.
    """
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t.split(b" ")])
    data = b" ".join(texts)
    blank = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begins, ends = np.concatenate([[0], blank + 1]), np.append(blank, len(data))
    owner = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    sizes = windows + k - 1
    starts = (np.cumsum(sizes) - sizes)[owner] + inside
    _, first, edge = np.unique(word_classes(ids, starts, k), return_index=True, return_inverse=True)
    count = np.bincount(edge, copies[owner]).astype(np.int64)
    node = word_classes(ids, np.concatenate([starts, starts + 1 if k > 1 else starts]), k - 1)
    left, right = node[: len(starts)], node[len(starts) :]
    many = first[count > 1]
    ways_in, ways_out = (np.bincount(x[many], minlength=int(node.max()) + 1) for x in (right, left))
    is_first = np.zeros(len(starts), bool)
    is_first[first] = True
    own = count[edge]
    # whether the edge at p + 1 goes on with the piece of the one at p
    on = is_first[:-1] & is_first[1:] & (owner[:-1] == owner[1:]) & (own[:-1] == own[1:])
    on &= (own[:-1] == 1) | (ways_in[right[:-1]] == 1) & (ways_out[right[:-1]] == 1)
    at = np.flatnonzero(is_first)
    begin = at[~np.concatenate([[False], on])[at]]
    end = at[~np.append(on, False)[at]]
    out = []
    for a, b in zip(begin.tolist(), end.tolist()):
        n, p, q = int(own[a]), int(starts[a]), int(starts[b])
        nodes = [xxhash.xxh3_64_intdigest(data[begins[x] : ends[x + k - 2]] if k > 1 else b"") - (1 << 63) for x in (p, q + 1)] if n > 1 else [None, None]
        out.append((int(owner[a]), int(inside[a]), int(inside[b]), n, *nodes))
    return out


def pieces(texts: DataFrame, k: int, block: int = 1 << 20) -> DataFrame:
    """PIECE rows from runs (key, copies, id, tie, at, text), about `block` bytes at a time."""

    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        own, tie, at, copies = (t.column(c).to_numpy() for c in ("id", "tie", "at", "copies"))
        lo = at >> 32
        found = pieces_of(t.column("text").to_pylist(), (at & 0xFFFFFFFF) - lo + 1, copies, k)
        if found:
            text, a, b, n, left, right = zip(*found)
            text = np.array(text)
            places = lo[text] + np.array(a) << 32 | lo[text] + np.array(b)
            columns = [own[text], tie[text], places, pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in PIECE.split(", ")])

    return in_blocks(texts, each, PIECE, block)


def paths(found: DataFrame) -> DataFrame:
    """(id, tie, at, n): the pieces, those of nonbranching paths put together.

    The pieces that end and those that begin at a node are joined by an aggregation on the node, which is
    combined before its shuffle, so a node with very many pieces is no hot key.
    """
    lo, hi = F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFFFFFF)
    ends = F.array(F.struct(F.col("right").alias("node"), F.lit(True).alias("into")), F.struct(F.col("left").alias("node"), F.lit(False).alias("into")))
    at_node = found.select("id", "tie", lo.alias("lo"), hi.alias("hi"), "n", F.explode(ends).alias("e")).where("e.node is not null")
    before = F.when(F.col("e.into"), F.struct("id", "tie", (F.col("hi") + 1).alias("lo"), "n"))
    after = F.when(~F.col("e.into"), F.struct("id", "tie", "lo", "n"))
    nodes = at_node.groupBy("e.node").agg(F.count_if("e.into").alias("ways_in"), F.count_if(~F.col("e.into")).alias("ways_out"), F.max(before).alias("before"), F.max(after).alias("after"))
    links = nodes.where("ways_in = 1 and ways_out = 1 and before = after")
    links = links.select("after.id", "after.tie", "after.lo", F.lit(True).alias("link"), F.lit(None).cast("bigint").alias("hi"), F.lit(None).cast("bigint").alias("n"))
    own = found.select("id", "tie", lo.alias("lo"), F.lit(False).alias("link"), hi.alias("hi"), "n")
    w = Window.partitionBy("id", "tie").orderBy("lo", F.desc("link"))
    linked = F.coalesce(F.lag("link").over(w) & (F.lag("lo").over(w) == F.col("lo")), F.lit(False))
    rows = own.unionByName(links).withColumn("new", (~F.col("link") & ~linked).cast("int"))
    rows = rows.withColumn("path", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("not link")
    whole = rows.groupBy("id", "tie", "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"))
    return whole.select("id", "tie", F.shiftleft("lo", 32).bitwiseOR(F.col("hi")).alias("at"), "n")


def _units(k: int) -> Units:
    if k < 1:
        raise ValueError("k must be 1 at least")
    return Units(k, max(1, k // 4, k - 255), words=True)


def _graph(docs: DataFrame, k: int, keep_first: bool, most: int) -> tuple[Keyed, DataFrame]:
    """The documents and the places of all edges that stay; edges of minimizers with over `most` kinds of runs are pieces of their own."""
    keyed = with_key(docs)
    stays = lambda p: (paths(p) if keep_first else p.where("n = 1")).select("id", "tie", "at")
    single = lambda w: stays(w.select("id", "tie", "at", F.col("copies").alias("n"), "left", "right"))
    return keyed, windows_that_stay(keyed, _units(k), by_text=lambda t: stays(pieces(t, k)), by_window=single, most=most)


def repeated_spans(docs: DataFrame, *, k: int = 20, least: int = 50, most: int = 4096) -> DataFrame:
    """doc_id, start, n_words, copies, text of each nonbranching path of repeated edges with `least` words or more, at its first source.

    start counts words from 0.  Nulls, empty texts, repeated rows and empty tables as in removed_words_digest().
    """
    keyed, found = with_key(docs.select("doc_id", "text")), []
    keep = lambda rows: found.append(rows) or rows.select("id", "tie", "at")
    as_piece = lambda w: w.select("id", "tie", "at", F.col("copies").alias("n"), "left", "right")
    windows_that_stay(keyed, _units(k), by_text=lambda t: keep(pieces(t, k)), by_window=lambda w: keep(as_piece(w)), most=most)
    spans = paths(found[0].unionByName(found[1])).where((F.col("n") > 1) & (F.col("at").bitwiseAND(0xFFFFFFFF) - F.shiftright("at", 32) + k >= least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()[at >> 32 : (at & 0xFFFFFFFF) + k]
                out.append((at >> 32, len(words), b" ".join(words).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in list(zip(*out))[:2]], batch.column(3), pa.array([x[2] for x in out])] if out else [], ["doc_id", "start", "n_words", "copies", "text"] if out else [])

    rows = keyed.different().join(spans, ["id", "tie"]).select("row.doc_id", F.col("row.text").cast("string").alias("text"), "at", "n")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_words bigint, copies bigint, text string")


def removed_words_digest(docs: DataFrame, *, k: int = 20, keep_first: bool = True, most: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 after removing the words that repeated edges cover.

    An edge is repeated if its words also start earlier (smaller doc_id, or same document and
    earlier place), with keep_first=False if they start anywhere else.  A null text has no word.  Null
    doc_ids come first; rows of equal doc_id follow one another by a hash of their text, and
    equal rows count as one document.  An empty table gives no row; other columns are ignored.
    """
    keyed, stay = _graph(docs.select("doc_id", "text"), k, keep_first, most)

    def each(data, starts, ends, removed):
        kept = b" ".join([w for w, gone in zip(data.split(), removed.tolist()) if not gone])
        return len(starts), int(removed.sum()), hashlib.sha256(kept).hexdigest()

    return map_removed(keyed, stay, _units(k), each, "n_words bigint, n_removed bigint, kept_sha256 string", ["doc_id"])


def remove_repeated_words(docs: DataFrame, *, k: int = 20, keep_first: bool = True, most: int = 4096) -> DataFrame:
    """docs, all columns, with `kept_text`: the words that stay, joined by one space.

    Nulls, empty texts, repeated rows and empty tables as in removed_words_digest(); the kept text of a null text is empty.
    If docs have a column `kept_text`, that one is named `kept_text_of_docs`.
    """
    keyed, stay = _graph(docs, k, keep_first, most)

    def each(data, starts, ends, removed):
        return (b" ".join([w for w, gone in zip(data.split(), removed.tolist()) if not gone]).decode("utf-8", "replace"),)

    return map_removed(keyed, stay, _units(k), each, "kept_text string", docs.columns)
