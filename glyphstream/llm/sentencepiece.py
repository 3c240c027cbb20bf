"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is normalised and cut where a piece can't reach across: before each run of word marks that
follows another sign, and between signs that no piece joins.  The distinct marked words of a batch are sorted, which lays them out as a trie
in depth-first order; the forward states (which piece ends here, and where it starts) of the
prefix shared with the word before are used again, and only the rest of a word is worked on.

The vocabulary file at hand holds merge ranks, not log probabilities, so the best path is the one
that merging by rank gives.  That has a forward form: a word's pieces are those of one of its prefixes plus one
piece, and of all candidates only one agrees with the prefix's last piece, i.e. merging the two
pieces' signs gives just these two.  So each position has one state, as in Viterbi's algorithm.
Signs outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.common import slices

MARK = "▁"
NEVER = float("-inf")
_OPEN: dict[str, Coder] = {}


class Coder:
    def __init__(self, path: str, keep: int = 400_000):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: p.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if p.is_byte(i)}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [b"" if p.is_control(i) else byte_of.get(i) or self.pieces[i].replace(MARK, " ").encode() for i in range(size)]
        found: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                found.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {tail: sorted(x, reverse=True) for tail, x in found.items()}  # of pieces with these last two signs
        self.words = self.cuts()
        self.agree: dict[str, dict[str, bool]] = {piece: {} for piece in self.ids}
        self.pairs = 0
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def cuts(self) -> re.Pattern:
        """A pattern of words that no piece reaches across: marks and what follows them, parted at other
        signs too where the vocabulary never joins them: letters from non-letters, signs that are in no longer piece."""
        pairs = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        joined = set("".join(pairs)) - {MARK}
        letters = {x for x in joined if x.isalpha()}
        mixed = any(MARK not in (a, b) and (a in letters) != (b in letters) for a, b in pairs)
        if any(b == MARK and a != MARK for a, b in pairs):
            return re.compile("(?s).+")
        kinds = [joined] if mixed else [letters, joined - letters]
        classes = ["[" + "".join(map(re.escape, sorted(x))) + "]+" for x in kinds if x]
        return re.compile("|".join([*[f"{MARK}*{x}" for x in classes], f"{MARK}+", f"[^{MARK}]"]))

    def merged(self, word: str) -> list[str]:
        """Merging by rank, the first of equals first: the definition that the forward pass must meet."""
        parts, score = list(word), self.score
        while len(parts) > 1:
            ranks = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = max(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, last: str, piece: str) -> bool:
        """Whether merging both pieces' signs gives just these two pieces; kept in self.agree."""
        if self.pairs > 2_000_000:
            for known in self.agree.values():
                known.clear()
            self.pairs = 0
        found = self.agree[last][piece] = self.merged(last + piece) == [last, piece]
        self.pairs += 1
        return found

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words; states of the shared prefix are kept from word to word."""
        start, last = [-1], [None]  # per prefix length: where its last piece starts; that piece
        before = ""
        ids, agree, lengths = self.ids, self.agree, self.lengths
        for word in words:
            n = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                n += 1
            del start[n + 1 :], last[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                for size in lengths.get(word[max(0, end - 2) : end], (1,)):
                    at = end - size
                    if at < 0 or start[at] is None or (piece := word[at:end]) not in ids:
                        continue
                    if (own := last[at]) is not None:
                        fits = agree[own].get(piece)
                        if not (self.fits(own, piece) if fits is None else fits):
                            continue
                    start.append(at)
                    last.append(piece)
                    break
                else:  # a sign without a piece: bytes, and nothing merges across
                    start.append(end - 1 if word[end - 1] not in ids else None)
                    last.append(None)
            before = word
            out, at = [], len(word)
            while at > 0 and start[at] is not None:
                piece = last[at]
                if piece is not None:
                    out.append(ids[piece])
                else:
                    out += [self.bytes[b] for b in reversed(word[start[at] : at].encode("utf-8", "replace"))]
                at = start[at]
            yield out[::-1] if at == 0 else [i for p in self.merged(word) for i in ([ids[p]] if p in ids else [self.bytes[b] for b in p.encode("utf-8", "replace")])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        split = [self.words.findall(self.processor.normalize(t)) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(self.known))
        if new:
            if len(self.known) + len(new) > self.keep:
                self.known.clear()
                new = sorted(set().union(*split))
            for w, ids in zip(new, self.encode_sorted(new)):
                self.known[w] = array("I", ids).tobytes()
        return [b"".join(map(self.known.__getitem__, x)) for x in split]

    def decode(self, ids: list[int]) -> str:
        """The text: marks become blanks, byte pieces UTF-8; the blank put before the text is taken off."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


def coder(path: str) -> Coder:
    if path not in _OPEN:
        _OPEN[path] = Coder(path)
    return _OPEN[path]


def code_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of docs (doc_id, text); a null or empty text has no ids and decodes to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, "text", 4 << 20):
            found = [memoryview(x).cast("I").tolist() for x in own.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([own.decode(x) for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def code_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and round_trip (decoding gives the text back) of each row.

    A null text counts as empty; equal rows are coded each for itself; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for text, ids in zip(texts, own.encode(texts)):
                back = own.decode(memoryview(ids).cast("I").tolist())
                out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == text))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")
