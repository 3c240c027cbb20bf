"""Sets of code points as sorted ranges, with set algebra, and sets found by property or name."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import regex
import regex._regex

TOP = 0x10FFFF
#: Alphabets by their last code point.
ALPHABETS = {"Unicode": TOP, "ASCII": 0x7F, "ISO_Latin1": 0xFF, "ExtendedASCII": 0xFF}


@dataclass(frozen=True)
class UnicodeSet:
    ranges: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def of(items: Iterable[int | str | tuple[int, int]]) -> UnicodeSet:
        """From code points, signs and (first, last) ranges, in any order."""
        spans = sorted((x, x) if isinstance(x, int) else (ord(x), ord(x)) if isinstance(x, str) else x for x in items)
        out: list[tuple[int, int]] = []
        for lo, hi in spans:
            if out and lo <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return UnicodeSet(tuple(out))

    @staticmethod
    def where(test: Callable[[str], bool]) -> UnicodeSet:
        """All code points but surrogates that meet a test."""
        return UnicodeSet.of(c for c in range(TOP + 1) if not 0xD800 <= c < 0xE000 and test(chr(c)))

    def __invert__(self) -> UnicodeSet:
        edges = [-1, *(x for r in self.ranges for x in r), TOP + 1]
        return UnicodeSet(tuple((a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2]) if a + 1 <= b - 1))

    def __or__(self, other: UnicodeSet) -> UnicodeSet:
        return UnicodeSet.of([*self.ranges, *other.ranges])

    def __and__(self, other: UnicodeSet) -> UnicodeSet:
        return ~(~self | ~other)

    def __sub__(self, other: UnicodeSet) -> UnicodeSet:
        return self & ~other

    def __xor__(self, other: UnicodeSet) -> UnicodeSet:
        return (self | other) - (self & other)

    def __contains__(self, c: int | str) -> bool:
        c = ord(c) if isinstance(c, str) else c
        return any(lo <= c <= hi for lo, hi in self.ranges)

    def __len__(self) -> int:
        return sum(hi - lo + 1 for lo, hi in self.ranges)

    def java(self) -> str:
        """A Java character class."""
        if not self.ranges:
            return "[^\\x{0}-\\x{10FFFF}]"
        return "[" + "".join(f"\\x{{{lo:X}}}" + (f"-\\x{{{hi:X}}}" if hi > lo else "") for lo, hi in self.ranges) + "]"


@lru_cache(64)
def by_category(prefix: str) -> UnicodeSet:
    return UnicodeSet.where(lambda c: unicodedata.category(c).startswith(prefix))


@lru_cache(256)
def by_name(pattern: str) -> UnicodeSet:
    """Code points whose character name has a match of the pattern (upper case; anchors allowed)."""
    test = re.compile(pattern)
    return UnicodeSet.where(lambda c: bool(test.search(unicodedata.name(c, ""))))


@lru_cache(1)
def _all_signs() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, TOP + 1)]))


@lru_cache(256)
def by_property(spec: str) -> UnicodeSet | None:
    """The set of `name` or `name=value` from the Unicode data of the regex module; None if it doesn't know them.

    These are binary, enumerated and numeric properties and script extensions, in the module's Unicode
    version; names and values compare loosely.
    """
    if not re.fullmatch(r"[\w .:=/-]+", spec):
        return None
    try:
        found = regex.compile(f"\\p{{{spec}}}+")
    except regex.error:
        return None
    spans = []
    for m in found.finditer(_all_signs()):
        lo, hi = m.start(), m.end() - 1
        if lo < 0xD800 <= hi:  # the run passes over the surrogates
            spans += [(lo, 0xD7FF), (0xE000, hi + 0x800)]
        else:
            gap = 0x800 * (lo >= 0xD800)
            spans.append((lo + gap, hi + gap))
    return UnicodeSet.of(spans)


def value_names(name: str) -> list[str] | None:
    """The names of a property's values; None if the property isn't known."""
    found = regex._regex.get_properties().get(re.sub(r"[\s_-]", "", name).upper())
    return sorted(v for v in found[1]) if found else None


def loose(name: str) -> str:
    """Property names compare without case, blanks, underscores and hyphens."""
    return re.sub(r"[\s_-]", "", name).lower()
