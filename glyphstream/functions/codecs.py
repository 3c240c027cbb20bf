"""Transcoding and binary codecs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utf16(text: Column, endian: str = "LE") -> Column:
    """Code units as binary, without a byte order mark."""
    return F.encode(text, f"UTF-16{endian.upper()}")


def to_utf32(text: Column) -> Column:
    return F.encode(text, "UTF-32")


def from_utf16(data: Column, endian: str = "LE") -> Column:
    return F.decode(data, f"UTF-16{endian.upper()}")


def to_base64(data: Column) -> Column:
    """Padded and without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def codepoints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def text_or_null(data: Column) -> Column:
    """The text of valid UTF-8; other bytes never match anything."""
    return F.try_validate_utf8(data.cast("string"))


# The well-formed sequences of two, three and four bytes (Unicode standard, table 3-7), bytes seen as signs.
WELL_FORMED = {
    2: r"[\xC2-\xDF][\x80-\xBF]",
    3: r"\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]",
    4: r"\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}",
}


def utf8_errors(data: Column) -> Column:
    """Places, from 0, of the bytes that belong to no well-formed sequence; null for null, empty for valid UTF-8.

    Well-formed sequences never overlap, so the order in which they are taken out doesn't matter.
    """
    left = latin1(data)
    for n, sequence in WELL_FORMED.items():
        left = F.regexp_replace(left, sequence, "-" * n)
    at = F.transform(F.split(left, ""), lambda c, i: F.when(F.ascii(c) >= 128, i))
    none = F.array().cast("array<int>")
    return F.when(data.isNull(), None).when(valid_utf8(data), none).otherwise(F.filter(at, lambda i: i.isNotNull()))


def latin1(data: Column) -> Column:
    """Bytes as signs, for patterns over bytes."""
    return F.decode(data, "ISO-8859-1")


def bit_of(sign: Column, k: int) -> Column:
    """Bit k of a sign's code point."""
    return F.shiftright(F.ascii(sign), k).bitwiseAND(1) == 1
