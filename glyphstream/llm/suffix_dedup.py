"""Substring removal by suffix order and longest-previous-factor arrays.

The texts around all byte windows that may repeat (repeats.windows_that_stay) are put one after another,
minimizer by minimizer, documents in order.  Their suffixes are sorted to the window's length and
neighbours compared byte by byte (common prefixes).  For each suffix the previous and the next
smaller position in that order give the earlier matches, and the longer of the two common prefixes is its longest
previous factor; mirrored, the larger positions give the longest next factor.  A window has an
earlier (later) copy just if that factor is as long as the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphstream.llm.repeats import Keyed, Units, in_blocks, map_removed, windows_that_stay, with_key


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def suffix_classes(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of starts in suffix order, class of each): equal classes have equal text[start:start + depth].

    Prefix doubling up to 32 bytes for all positions, then blocks of 32 for the suffixes that still
    share their class with another; the others get classes of their own, in order.
    """
    padded = np.concatenate([text, np.zeros(depth + 64, np.uint8)])
    n = len(text) + depth
    head = min(8, depth)
    r = np.zeros(n, np.uint64)
    for k in range(head):
        r = r << np.uint64(8) | padded[k : k + n]
    size = head
    r = _ranks(r)
    while size * 2 <= min(depth, 32):
        after = np.zeros(n, np.uint64)
        after[: n - size] = r[size:] + np.uint64(1)
        r = _ranks(r << np.uint64(32) | after)
        size *= 2
    place = np.argsort(r[starts], kind="stable")
    order, cls = place, r[starts][place].astype(np.int64)
    cls = np.cumsum(np.concatenate([[0], cls[1:] != cls[:-1]]).astype(np.int64)) if len(cls) else cls
    done = size
    while done < depth:
        shift = min(done, depth - size)
        many = np.bincount(cls)[cls] > 1
        if not many.any():
            break
        pair = cls[many].astype(np.uint64) << np.uint64(32) | r[starts[order[many]] + shift]
        inner = np.argsort(pair, kind="stable")
        order[many] = order[many][inner]
        pair = pair[inner]
        new = np.ones(len(cls), bool)
        new[1:] = cls[1:] != cls[:-1]
        at = np.flatnonzero(many)
        new[at[1:]] |= pair[1:] != pair[:-1]
        cls = np.cumsum(new) - 1
        done = shift + size
    return order, cls


def common_prefixes(text: np.ndarray, starts: np.ndarray, cls: np.ndarray, depth: int) -> np.ndarray:
    """For each of the sorted suffixes how many bytes, up to depth, it shares with the one before (the first: 0)."""
    lcp = np.zeros(len(starts), np.int64)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    same = np.flatnonzero(cls[1:] == cls[:-1]) + 1
    lcp[same] = depth
    at = np.flatnonzero(cls[1:] != cls[:-1]) + 1
    for done in range(0, depth, 8):
        if not len(at):
            break
        a, b = starts[at] + done, starts[at - 1] + done
        apart, equal = np.full(len(at), 8), np.ones(len(at), bool)
        for k in range(8):
            new = equal & (padded[a + k] != padded[b + k])
            apart[new] = k
            equal &= ~new
        lcp[at] = done + apart
        at = at[equal]
    return np.minimum(lcp, depth)


def _prefix_with_smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in order its common prefix with the nearest one before that has a smaller place; 0 without one."""
    before, own = np.arange(-1, len(place) - 1), lcp.copy()
    at = np.flatnonzero((before >= 0) & (place[before] > place))
    while len(at):  # all that lie between a suffix and its candidate have larger places
        via = before[at]
        own[at], before[at] = np.minimum(own[at], own[via]), before[via]
        at = at[(before[at] >= 0) & (place[before[at]] > place[at])]
    own[before < 0] = 0
    return own


def previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in order, given its place and its common prefix with the one before."""
    if not len(place):
        return lcp
    turned = np.concatenate([[0], lcp[:0:-1]])
    return np.maximum(_prefix_with_smaller(place, lcp), _prefix_with_smaller(place[::-1], turned)[::-1])


def windows_kept(texts: list[bytes], windows: np.ndarray, copies: np.ndarray, depth: int, first_stays: bool) -> np.ndarray:
    """Which of the texts' windows, one text after another, have no earlier copy (first_stays) or no other copy.

    windows has how many each text has; a text with several copies counts as if it followed once more at the end.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), windows)
    starts = (np.cumsum(sizes) - sizes)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    text = np.frombuffer(b"".join(texts), np.uint8)
    order, cls = suffix_classes(text, starts, depth)
    lcp = common_prefixes(text, starts[order], cls, depth)
    many = copies[owner[order]] > 1
    twin = np.cumsum(1 + many)[many] - 1  # the copy's suffix stands beside its own
    place, lcp, index = (np.repeat(x, 1 + many) for x in (starts[order], lcp, order))
    place[twin] += len(text)
    lcp[twin] = depth
    stays = previous_factors(place, lcp) < depth
    if not first_stays:
        stays &= previous_factors(-place, lcp) < depth
    stays[twin] = False
    kept = np.zeros(len(starts), bool)
    kept[index[stays]] = True
    return kept


def settle(texts: DataFrame, depth: int, first_stays: bool, block: int = 1 << 20) -> DataFrame:
    """(id, tie, at) of windows that stay, from runs (key, copies, id, tie, at, text); a task takes about `block` bytes at a time."""

    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at, copies = (t.column(k).to_numpy() for k in ("at", "copies"))
        lo = at >> 32
        count = (at & 0xFFFFFFFF) - lo + 1
        kept = np.flatnonzero(windows_kept(t.column("text").to_pylist(), count, copies, depth, first_stays))
        if not len(kept):
            return
        owner = np.repeat(np.arange(len(count)), count)
        window = lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        new = np.concatenate([[True], (np.diff(kept) != 1) | (np.diff(owner[kept]) != 0)])
        a = kept[new]
        b = kept[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(kept) - 1]])]
        own = [t.column(k).to_numpy()[owner[a]] for k in ("id", "tie")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(window[a] << 32 | window[b])], ["id", "tie", "at"])

    return in_blocks(texts, each, "id bigint, tie bigint, at bigint", block)


def _stay(docs: DataFrame, length: int, keep_first: bool, most: int) -> tuple[Keyed, DataFrame, Units]:
    units = Units(length, max(1, min(48, length // 3), length - 255), words=False)  # a minimizer's place is known modulo 256
    keyed = with_key(docs)
    by_window = lambda w: (w if keep_first else w.where("copies = 1")).select("id", "tie", "at")
    return keyed, windows_that_stay(keyed, units, by_text=lambda t: settle(t, length, keep_first), by_window=by_window, most=most), units


def removed_digest(docs: DataFrame, *, length: int = 200, keep_first: bool = False, most: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing what every repeated string of `length` bytes covers.

    keep_first=False removes all copies, True all but the first (by doc_id, then place).  A null text counts as
    empty; shorter texts lose nothing.  Equal rows are copies of one another (with keep_first: one document,
    kept in each).  Null doc_ids come first.  An empty table gives no row; other columns are ignored.
    """
    keyed, stay, units = _stay(docs.select("doc_id", "text"), length, keep_first, most)

    def each(data, starts, ends, removed):
        runs = int(np.count_nonzero(removed[1:] & ~removed[:-1]) + removed[:1].sum())
        kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
        return len(data), int(removed.sum()), runs, hashlib.sha256(kept).hexdigest()

    return map_removed(keyed, stay, units, each, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", ["doc_id"])


def remove_substrings(docs: DataFrame, *, length: int = 200, keep_first: bool = True, most: int = 4096) -> DataFrame:
    """docs, all columns, with `kept_text`: the text without the removed bytes; a sign goes only if all its bytes do.

    Nulls, empty texts, repeated rows and empty tables as in removed_digest(); the kept text of a null text is empty.  If docs
    have a column `kept_text`, that one is named `kept_text_of_docs`.
    """
    keyed, stay, units = _stay(docs, length, keep_first, most)

    def each(data, starts, ends, removed):
        if removed.any():
            raw = np.frombuffer(data, np.uint8)
            lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of signs
            gone = np.minimum.reduceat(removed, lead) if len(lead) else removed[:0]
            stays = np.repeat(~gone, np.diff(np.append(lead, len(raw))))
            data = raw[stays].tobytes()
        return (data.decode("utf-8", "replace"),)

    return map_removed(keyed, stay, units, each, "kept_text string", docs.columns)
