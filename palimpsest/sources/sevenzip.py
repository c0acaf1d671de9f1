"""7z archives of one LZMA-coded folder, by the standard library's decoder."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"7z\xbc\xaf\x27\x1c"
_END, _MAIN, _PACK, _FOLDERS, _FOLDER, _SIZES = 0x00, 0x04, 0x06, 0x07, 0x0B, 0x0C
_LZMA1 = b"\x03\x01\x01"


class _Header:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def byte(self) -> int:
        self.at += 1
        return self.raw[self.at - 1]

    def number(self) -> int:
        """The format's variable-length integer: leading ones of the first byte count further bytes."""
        first, more = self.byte(), 0
        while more < 8 and first & (0x80 >> more):
            more += 1
        low = int.from_bytes(self.raw[self.at : self.at + more], "little")
        self.at += more
        return low | (first & ((0x80 >> more) - 1)) << 8 * more if more < 8 else low

    def take(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def until(self, mark: int) -> None:
        while (kind := self.byte()) != mark:
            if kind == _END:
                raise ValueError("7z header without expected section")
            self.take(self.number())


def decoder(head: bytes) -> tuple[lzma.LZMADecompressor, int, int]:
    """(decoder, packed size, plain size) from an archive's bytes. Encoded headers and several coders raise."""
    if not head.startswith(MAGIC):
        raise ValueError("not a 7z archive")
    offset, size = struct.unpack("<QQ", head[12:28])
    h = _Header(head[32 + offset : 32 + offset + size])
    if h.byte() != 0x01:
        raise ValueError("encoded 7z headers are not supported")
    if h.byte() != _MAIN or h.byte() != _PACK:
        raise ValueError("7z archive without packed data")
    if h.number() != 0 or h.number() != 1 or h.byte() != 0x09:
        raise ValueError("one packed stream expected")
    packed = h.number()
    h.until(_END) if h.raw[h.at] != _END else h.byte()
    if h.byte() != _FOLDERS or h.byte() != _FOLDER or h.number() != 1 or h.byte() != 0 or h.number() != 1:
        raise ValueError("one folder with one coder expected")
    flags = h.byte()
    if h.take(flags & 0x0F) != _LZMA1 or not flags & 0x20:
        raise ValueError("LZMA coder expected")
    properties = h.take(h.number())
    if h.byte() != _SIZES:
        raise ValueError("unpacked size expected")
    plain = h.number()
    d, dictionary = properties[0], struct.unpack("<I", properties[1:5])[0]
    filters = [{"id": lzma.FILTER_LZMA1, "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45, "dict_size": max(dictionary, 4096)}]
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters), packed, plain


def unpack(raw: bytes) -> bytes:
    code, packed, plain = decoder(raw)
    return code.decompress(raw[32 : 32 + packed], plain)


def pack(data: bytes, dictionary: int = 1 << 20) -> bytes:
    """An archive of one file, in the form that unpack reads."""

    def number(n: int) -> bytes:
        more = next(k for k in range(9) if n < 1 << 7 * (k + 1) or k == 8)
        first = (0xFF << (8 - more) & 0xFF) | (n >> 8 * more if more < 8 else 0)
        return bytes([first]) + (n & (1 << 8 * more) - 1).to_bytes(more, "little")

    filters = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": dictionary}]
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=filters)
    properties = bytes([2 * 45 + 3]) + struct.pack("<I", dictionary)
    streams = bytes([_PACK]) + number(0) + number(1) + b"\x09" + number(len(packed)) + bytes([_END])
    folder = bytes([_FOLDERS, _FOLDER]) + number(1) + b"\0" + number(1) + b"\x23" + _LZMA1 + number(len(properties)) + properties
    header = bytes([0x01, _MAIN]) + streams + folder + bytes([_SIZES]) + number(len(data)) + bytes([_END] * 3)
    start = struct.pack("<QQI", len(packed), len(header), zlib.crc32(header))
    return MAGIC + b"\0\4" + struct.pack("<I", zlib.crc32(start)) + start + packed + header


def read_7z(spark: SparkSession, path: str) -> DataFrame:
    """path, line: the lines of each archive. An archive is one task; write the result as Parquet and go on from there."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                code, packed, plain = decoder(raw)
                rest, done = b"", 0
                for at in range(32, 32 + packed, 1 << 20):
                    piece = code.decompress(raw[at : min(at + (1 << 20), 32 + packed)])[: plain - done]
                    done += len(piece)
                    *lines, rest = (rest + piece).split(b"\n")
                    if lines:
                        yield pd.DataFrame({"path": name, "line": [x.decode() for x in lines]})
                if rest:
                    yield pd.DataFrame({"path": [name], "line": [rest.decode()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line string")
