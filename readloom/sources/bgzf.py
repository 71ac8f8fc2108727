"""Blocked gzip: headers, the search for a block in the middle of a file, inflated views, and a writer."""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from readloom.sources.files import RandomAccess

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08\x04"
TRAILER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAX_BLOCK = 1 << 16
MAX_PAYLOAD = 65280

BLOCKS_TO_CHECK = 5


class HeaderError(ValueError):
    """A byte of a block header isn't what the format asks for."""

    def __init__(self, index: int, actual: int, expected: int):
        super().__init__(f"byte {index} of a block header is {actual}, not {expected}")
        self.index, self.actual, self.expected = index, actual, expected


class NoBlockFound(ValueError):
    def __init__(self, path: str, start: int, attempts: int):
        super().__init__(f"no block starts within {attempts} bytes of {start} in {path}")


class Header(NamedTuple):
    """The size of a block's header and of the whole block."""

    size: int
    compressed_size: int


class BlockMeta(NamedTuple):
    start: int
    compressed_size: int
    uncompressed_size: int


def parse_header(data: bytes, at: int = 0) -> Header:
    if len(data) - at < 18:
        raise EOFError("the file ends within a block header")
    for index, expected in (*enumerate(MAGIC), (12, 66), (13, 67), (14, 2)):
        if data[at + index] != expected:
            raise HeaderError(index, data[at + index], expected)
    extra, block = struct.unpack_from("<H4xH", data, at + 10)
    return Header(12 + extra, block + 1)


def block_metadata(file: RandomAccess, start: int = 0, end: int | None = None) -> Iterator[BlockMeta]:
    """Blocks from ``start`` on that begin before ``end``, without inflating them; ends at the file's end or at an
    empty block."""
    end = file.size if end is None else end
    while start < end and start < file.size:
        header = parse_header(file.read(start, 18))
        if header.compressed_size - header.size - 8 <= 2:
            return
        (size,) = struct.unpack("<I", file.read(start + header.compressed_size - 4, 4))
        yield BlockMeta(start, header.compressed_size, size)
        start += header.compressed_size


def find_block_start(file: RandomAccess, start: int, blocks_to_check: int = BLOCKS_TO_CHECK) -> int:
    """The first offset from ``start`` on from which ``blocks_to_check`` headers follow one another, or all up to the
    file's end; an offset at the end itself counts."""
    window = file.read(start, MAX_BLOCK + 17)
    at = window.find(MAGIC)
    while 0 <= at < MAX_BLOCK:
        if _chain(file, start + at, blocks_to_check):
            return start + at
        at = window.find(MAGIC, at + 1)
    if len(window) < MAX_BLOCK:
        return file.size
    raise NoBlockFound(file.path, start, MAX_BLOCK)


def _chain(file: RandomAccess, at: int, n: int) -> bool:
    for _ in range(n):
        if at >= file.size:
            return at == file.size
        try:
            at += parse_header(file.read(at, 18)).compressed_size
        except (HeaderError, EOFError):
            return False
    return True


def inflate(block: bytes, header: Header, start: int = 0) -> bytes:
    data = zlib.decompress(block[header.size : header.compressed_size - 8], wbits=-15)
    (size,) = struct.unpack_from("<I", block, header.compressed_size - 4)
    if len(data) != size:
        raise OSError(f"block at {start}: {len(data)} bytes inflated, {size} expected")
    return data


class Inflated:
    """The bytes of successive blocks as one growing buffer, with the virtual position of each.

    ``stop_at_empty``: an empty block ends the stream, as at the end of a file; otherwise it is passed over.
    """

    READ = 1 << 20

    def __init__(self, file: RandomAccess, start: int, stop_at_empty: bool = True):
        self.file, self.next, self.stop_at_empty = file, start, stop_at_empty
        self.data = bytearray()
        self.starts: list[int] = []  # where each block begins in data
        self.blocks: list[int] = []  # and in the file
        self.ended = False
        self._raw, self._raw_at = b"", start

    def _more(self) -> bool:
        at = self.next
        if at >= self.file.size:
            self.ended = True
            return False
        if at + MAX_BLOCK > self._raw_at + len(self._raw) or at < self._raw_at:
            self._raw, self._raw_at = self.file.read(at, max(self.READ, MAX_BLOCK)), at
        offset = at - self._raw_at
        header = parse_header(self._raw, offset)
        block = self._raw[offset : offset + header.compressed_size]
        if len(block) < header.compressed_size:
            raise EOFError(f"the file ends within the block at {at}")
        self.next = at + header.compressed_size
        if header.compressed_size - header.size - 8 <= 2:
            if self.stop_at_empty:
                self.ended = True
            return not self.ended
        self.starts.append(len(self.data))
        self.blocks.append(at)
        self.data += inflate(block, header, at)
        return True

    def ensure(self, length: int) -> bool:
        """Whether the buffer has ``length`` bytes, after reading on as needed."""
        while len(self.data) < length and not self.ended:
            self._more()
        return len(self.data) >= length

    def position(self, offset: int) -> tuple[int, int]:
        """(block, offset within it) of a byte of the buffer; beyond its end, the start of the next block."""
        if offset >= len(self.data):
            return self.next, 0
        i = int(np.searchsorted(self.starts, offset, side="right")) - 1
        return self.blocks[i], offset - self.starts[i]

    def discard(self, n: int) -> None:
        """Drops the first ``n`` bytes; offsets count from there on."""
        del self.data[:n]
        self.starts = [s - n for s in self.starts]
        keep = max(0, int(np.searchsorted(self.starts, 0, side="right")) - 1)
        del self.starts[:keep], self.blocks[:keep]

    def positions(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.starts, offsets, side="right") - 1
        return np.array(self.blocks, np.int64)[i], (offsets - np.array(self.starts, np.int64)[i]).astype(np.int32)


class BlockCache:
    """Random access to inflated blocks; the blocks read first are given up first."""

    def __init__(self, file: RandomAccess, most: int = 100):
        self.file, self.most = file, most
        self.kept: OrderedDict[int, tuple[bytes, int]] = OrderedDict()

    def block(self, start: int) -> tuple[bytes, int]:
        """(bytes, start of the next block)"""
        if start not in self.kept:
            raw = self.file.read(start, MAX_BLOCK)
            header = parse_header(raw)
            self.kept[start] = inflate(raw, header, start), start + header.compressed_size
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[start]


def deflate(payload: bytes, level: int = 6) -> bytes:
    """One block; at level 0, or where that is smaller, its bytes are stored as they are."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(payload) + c.flush() if level else b""
    if not level or len(body) > len(payload) + 5:
        body = b"\1" + struct.pack("<HH", len(payload), len(payload) ^ 0xFFFF) + payload
    head = MAGIC + b"\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload))


class BlockWriter:
    """Collects bytes into blocks; ``tell`` is the virtual position (block, offset) of the next byte."""

    def __init__(self, payload: int = MAX_PAYLOAD, level: int = 6):
        self.payload, self.level = payload, level
        self.done: list[bytes] = []
        self.written = 0
        self.open = bytearray()

    def tell(self) -> tuple[int, int]:
        return self.written, len(self.open)

    def write(self, data: bytes) -> None:
        self.open += data
        while len(self.open) >= self.payload:
            self._block(self.payload)

    def end_block(self) -> None:
        """Ends the open block, if it has any byte."""
        if self.open:
            self._block(len(self.open))

    def _block(self, n: int) -> None:
        block = deflate(bytes(self.open[:n]), self.level)
        del self.open[:n]
        self.done.append(block)
        self.written += len(block)

    def take(self) -> bytes:
        out, self.done = b"".join(self.done), []
        return out
