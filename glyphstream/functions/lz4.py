"""LZ4 frames: decoding of all block kinds and encoding.

Columns go through Arrow's compiled codec; a frame that it refuses (a wrong checksum that may be skipped, a dictionary
id) and damaged data go through the plain decoder, which also decides what is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = 0x184D2204
END = b"\0\0\0\0"


def decode_block(data: bytes, out: bytearray) -> None:
    """Appends a compressed block's bytes to out; matches may reach back before the block and overlap themselves."""
    i, n = 0, len(data)
    while i < n:
        token = data[i]
        i += 1
        size = token >> 4
        if size == 15:
            while True:
                size += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        if i + size > n:
            raise ValueError("literals beyond the block")
        out += data[i : i + size]
        i += size
        if i >= n:
            return
        back = data[i] | data[i + 1] << 8
        i += 2
        size = token & 15
        if size == 15:
            while True:
                size += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        size += 4
        if not 0 < back <= len(out):
            raise ValueError("match before the start")
        while size > 0:
            piece = out[-back:][:size] if back >= size else out[-back:]
            out += piece
            size -= len(piece)


def decode_frame(data: bytes, verify: bool = False) -> bytes:
    """The content of one frame; checksums are skipped unless asked for."""
    if len(data) < 7 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("not an LZ4 frame")
    flags = data[4]
    if flags >> 6 != 1:
        raise ValueError("unknown version")
    block_sums, has_size, content_sum, has_dict = flags >> 4 & 1, flags >> 3 & 1, flags >> 2 & 1, flags & 1
    i = 6 + 8 * has_size + 4 * has_dict
    if verify and xxhash.xxh32_intdigest(data[4:i]) >> 8 & 255 != data[i]:
        raise ValueError("header checksum")
    i += 1
    out = bytearray()
    while True:
        (size,) = struct.unpack_from("<I", data, i)
        i += 4
        if not size:
            break
        raw, size = size >> 31, size & 0x7FFFFFFF
        block = data[i : i + size]
        if len(block) < size:
            raise ValueError("cut off")
        i += size + 4 * block_sums
        if raw:
            out += block
        else:
            decode_block(block, out)
    if verify and content_sum and struct.unpack_from("<I", data, i)[0] != xxhash.xxh32_intdigest(bytes(out)):
        raise ValueError("content checksum")
    return bytes(out)


def encode_block(data: bytes) -> bytes:
    """Greedy matches of four bytes and more within 64 kB."""
    out, seen, start, i, n = bytearray(), {}, 0, 0, len(data)

    def put(literals: bytes, back: int = 0, size: int = 0) -> None:
        low = min(size - 4, 15) if back else 0
        out.append(min(len(literals), 15) << 4 | low)
        if len(literals) >= 15:
            out.extend(b"\xff" * ((len(literals) - 15) // 255) + bytes([(len(literals) - 15) % 255]))
        out.extend(literals)
        if back:
            out.extend(struct.pack("<H", back))
            if low == 15:
                out.extend(b"\xff" * ((size - 19) // 255) + bytes([(size - 19) % 255]))

    while i < n - 12:  # the last match starts 12 bytes before the end at the latest
        four = data[i : i + 4]
        at = seen.get(four)
        seen[four] = i
        if at is None or i - at > 65535:
            i += 1
            continue
        size = 4
        while i + size < n - 5 and data[at + size] == data[i + size]:
            size += 1
        put(data[start:i], i - at, size)
        i += size
        start = i
    put(data[start:])
    return bytes(out)


def encode_frame(data: bytes, block: int = 1 << 18) -> bytes:
    head = bytes([0b01100100, 0x60])  # version 1, independent blocks, content checksum
    parts = [struct.pack("<I", MAGIC), head, bytes([xxhash.xxh32_intdigest(head) >> 8 & 255])]
    for i in range(0, len(data), block):
        own = encode_block(data[i : i + block])
        raw = len(own) >= len(data[i : i + block])
        own = data[i : i + block] if raw else own
        parts += [struct.pack("<I", len(own) | raw << 31), own]
    return b"".join([*parts, END, struct.pack("<I", xxhash.xxh32_intdigest(data))])


def frame_end(data: bytes) -> int:
    """Where the first frame ends, told by its headers alone; beyond the data if it is cut off."""
    flags = data[4]
    i = 7 + 8 * (flags >> 3 & 1) + 4 * (flags & 1)
    while i + 4 <= len(data):
        size = struct.unpack_from("<I", data, i)[0] & 0x7FFFFFFF
        i += 4
        if not size:
            return i + 4 * (flags >> 2 & 1)
        i += size + 4 * (flags >> 4 & 1)
    return len(data) + 1


def decode(data: bytes) -> bytes:
    """decode_frame() by the compiled codec where that accepts the frame."""
    if len(data) >= 7 and (end := frame_end(data)) <= len(data):
        try:
            with pa.input_stream(pa.py_buffer(data[:end]), compression="lz4") as f:
                return f.read()
        except (OSError, pa.ArrowException):
            pass
    return decode_frame(data)


def lz4_decode(data: Column) -> Column:
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in columns:
            yield s.map(lambda x: None if x is None else decode(bytes(x)))

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(data)


def lz4_encode(data: Column) -> Column:
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = pa.Codec("lz4")
        for s in columns:
            yield s.map(lambda x: None if x is None else codec.compress(bytes(x), asbytes=True))

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(data)
