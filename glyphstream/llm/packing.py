"""Packing by minimum bin slack.

Documents become token ids; each is cut into full windows and a remainder, and the remainders of
a block of documents fill further windows.  A window takes the longest remainder left, then the
multiset of remaining lengths whose sum comes closest to the window, found by subset sums kept
as the bits of an integer and traced back to counts.  What such a window still lacks is cut off
another remainder, so that no window has padding; the last, incomplete rest of a task becomes
sequences whose lengths are powers of two.

Only the scan's tasks work, without a shuffle: memory holds one block of remainders.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from glyphstream.llm.common import slices

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ODD = re.compile("[\x1c-\x1f]")  # white space for str.split, but not for the tokenizer
_LETTERS = re.compile("[a-zß-öø-ÿ]+")  # Latin-1 small letters: already composed and in lower case


def _byte_letters() -> dict[int, str]:
    """Code points of Latin-1 letters to the two characters that stand for their UTF-8 bytes.

    The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others
    get code points from 256 up, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


_BYTES = _byte_letters()
_CACHES: dict[str, WordIds] = {}


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, with the ids of recent words kept.

    The tokenizer drops white space before it splits, so the ids of a text are those of its
    space-separated chunks in a row.  `keep` bounds the number of chunks kept in a worker.
    """

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.marks: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [b"".join([i.to_bytes(4, "little") for i in x.ids]) for x in found]

    def _learn(self, chunks: set[str]) -> None:
        known = self.known
        if len(known) + len(chunks) > self.keep:
            known.clear()
        plain = self.tokenizer.model.tokenize  # for one run of letters, past the slow normalisation
        for c in chunks:
            mark = c[-1] if c[-1] in ".,!" else ""
            word = c.removesuffix(mark) if mark else c
            if _LETTERS.fullmatch(word):  # letters and marks never share a token
                ids = b"".join([x.id.to_bytes(4, "little") for x in plain(word.translate(_BYTES) if not word.isascii() else word)])
                if mark:
                    if mark not in self.marks:
                        self.marks[mark] = self._raw([mark])[0]
                    ids += self.marks[mark]
                known[c] = ids
        rest = list(chunks.difference(known))
        known.update(zip(rest, self._raw(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            if _ODD.search(t):
                split.append(None)
            elif "<|" in t or "Σ" in t:  # special tokens and final sigma depend on case
                split.append(t.split())
            else:
                split.append(t.lower().split())
        find = self.known.get
        found = [None if x is None else list(map(find, x)) for x in split]
        if new := {c for x, y in zip(split, found) if y and None in y for c, ids in zip(x, y) if ids is None}:
            self._learn(new)
            for k, (x, y) in enumerate(zip(split, found)):
                if y and None in y:
                    found[k] = [ids or find(c) for c, ids in zip(x, y)]
        return [self._raw([t])[0] if y is None else b"".join(y) for t, y in zip(texts, found)]


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def closest_fill(lengths: Iterable[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, count) pairs whose sum is the largest not above room, out of (length, count) in stock.

    Bit t of `reach` says that t is a sum of what was offered so far.  Counts are offered as
    1, 2, 4, ... copies, and the search ends once room itself is reached.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size, count in lengths:
        count, k = min(count, room // size), 1
        while count > 0:
            k = min(k, count)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            count, k = count - k, k * 2
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> left & 1:
            used[size] = used.get(size, 0) + k
            left -= size * k
    return list(used.items())


class Packer:
    """Windows of one task.  Pieces are (doc_id, start, ids, doc_tokens); emits rows of SCHEMA."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.stock: dict[int, list] = {}
        self.sizes: list[int] = []  # of the stock, ascending
        self.total, self.rows = 0, []

    def _sequence(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def _put(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        if size not in self.stock:
            self.stock[size] = []
            insort(self.sizes, size)
        self.stock[size].append(piece)
        self.total += size

    def _take(self, size: int) -> tuple:
        own = self.stock[size]
        piece = own.pop()
        if not own:
            del self.stock[size]
            del self.sizes[bisect_left(self.sizes, size)]
        self.total -= size
        return piece

    def add(self, doc, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        for start in range(0, n - n % w, w):
            self._sequence([(doc, start, ids[4 * start : 4 * (start + w)], n)])
        if n % w:
            self._put((doc, n - n % w, ids[4 * (n - n % w) :], n))

    def _fill(self, room: int) -> list:
        """Pieces of exactly `room` ids out of the stock, which has as many."""
        pieces = []
        if k := bisect_right(self.sizes, room):
            pieces.append(self._take(self.sizes[k - 1]))
            room -= len(pieces[0][2]) // 4
        if room:
            fitting = self.sizes[: bisect_right(self.sizes, room)]
            for size, count in closest_fill(((s, len(self.stock[s])) for s in reversed(fitting)), room):
                pieces += [self._take(size) for _ in range(count)]
                room -= size * count
        while room:  # the slack that no multiset fills
            size = self.sizes[min(bisect_right(self.sizes, room), len(self.sizes) - 1)]
            doc, start, ids, n = self._take(size)
            pieces.append((doc, start, ids[: 4 * room], n))
            if size > room:
                self._put((doc, start + room, ids[4 * room :], n))
            room -= min(size, room)
        return pieces

    def pack(self, last: bool) -> None:
        """Fills windows while there is stock for them; at the end, powers of two for the rest."""
        while self.total >= self.window:
            self._sequence(self._fill(self.window))
        while last and self.total:
            self._sequence(self._fill(1 << (self.total.bit_length() - 1)))

    def batch(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        cols = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, block: int = 4096) -> DataFrame:
    """Pieces of documents laid into windows of at most `window` ids (see SCHEMA).

    A document is the ids of its text and then end_id.  A null text counts as empty and gives the
    single end_id; a null doc_id stays null.  Equal rows are packed each for itself.  An empty table gives no row.
    Other columns are ignored.  `block` bounds the remainders that wait in a task.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, waiting = word_ids(tokenizer_path), Packer(window, TaskContext.get().partitionId() << 33), 0
        for batch in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, own in zip(batch.column(0).to_pylist(), ids.encode(texts)):
                packer.add(doc, own + end)
                waiting += 1
            if waiting >= block:
                packer.pack(False)
                waiting = 0
                yield packer.batch()
        packer.pack(True)
        if packer.rows:
            yield packer.batch()

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
