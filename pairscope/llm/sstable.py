"""Sorted-string-table shards for token ids: one file holds documents in ascending key order.

Layout: data blocks, index block, Bloom filter, footer. A data block is zstd-compressed and holds
prefix-compressed entries ``varint shared | varint rest | varint value bytes | key rest | value`` with a
restart (a whole key) every RESTART entries; its tail lists the restart offsets. The sparse index has the
last key, place and size of every block. A key is a null flag and the identifier as a big-endian unsigned
number, so byte order is identifier order. A value is one width byte (2 or 4) and the little-endian ids.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs

MAGIC = b"PSSTABLE"
RESTART = 16
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")
_CODEC = pa.Codec("zstd")
_SIGN = 1 << 63


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def key_bytes(identifier: int | None) -> bytes:
    return b"\0" * 9 if identifier is None else b"\1" + (identifier + _SIGN).to_bytes(8, "big")


def key_value(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - _SIGN


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """keys: 64-bit hashes. Double hashing."""
    one, two = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    for i in range(BLOOM_HASHES):
        yield ((one + np.uint64(i) * two) % np.uint64(bits)).astype(np.int64)


def _key_hash(keys: list[bytes]) -> np.ndarray:
    from pairscope.llm.common import splitmix

    return splitmix(np.array([int.from_bytes(k[1:], "big") ^ k[0] for k in keys], dtype=np.uint64))


class Writer:
    """Writes one shard; keys must come in ascending order (equal keys may repeat)."""

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}-{uuid.uuid4().hex}.sst"
        self.temp = f"{self.path}.part"
        self.out = self.fs.open_output_stream(self.temp)
        self.at, self.tokens = 0, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self._start_block()

    def _start_block(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, identifier: int | None, ids: bytes, width: int) -> None:
        key = key_bytes(identifier)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) + 1) + key[shared:] + bytes([width]) + ids
        self.last = key
        self.n += 1
        self.keys.append(key)
        self.tokens += len(ids) // width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if not self.n:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = _CODEC.compress(raw, asbytes=True)
        self.out.write(packed)
        self.index.append((self.last, self.at, len(packed), len(raw)))
        self.at += len(packed)
        self._start_block()

    def close(self) -> str:
        """Ends the file and gives it its final name."""
        self._end_block()
        index = b"".join(k + struct.pack("<QQQ", *rest) for k, *rest in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        field = np.zeros(bits, dtype=bool)
        hashes = _key_hash(self.keys)
        for places in _bloom_places(hashes, bits):
            field[places] = True
        bloom = np.packbits(field).tobytes()
        self.out.write(index + bloom + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), bits, len(self.keys), self.tokens, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.path


class Reader:
    """Reads a shard: ``scan`` gives all entries, ``get`` one by binary search."""

    def __init__(self, folder: str, path: str):
        self.fs, _ = file_system(folder)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        footer = self._read(size - _FOOTER.size, _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.bits, self.n_docs, self.n_tokens, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        raw = self._read(index_at, index_len)
        self.index = [(raw[i : i + 9], *struct.unpack("<QQQ", raw[i + 9 : i + 33])) for i in range(0, len(raw), 33)]
        self.last_keys = [x[0] for x in self.index]
        self.bloom = self._read(bloom_at, bloom_len)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...], int]:
        _, at, packed, raw = self.index[i]
        data = _CODEC.decompress(self._read(at, packed), raw, asbytes=True)
        n = struct.unpack("<I", data[-4:])[0]
        end = len(data) - 4 - 4 * n
        return data, struct.unpack(f"<{n}I", data[end:-4]), end

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, at + 1, at + size, data[at]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            data, _, end = self._block(i)
            for key, first, last, width in self._entries(data, 0, end):
                yield key_value(key), np.frombuffer(data, dtype=f"<u{width}", count=(last - first) // width, offset=first)

    def may_hold(self, identifier: int | None) -> bool:
        hashes = _key_hash([key_bytes(identifier)])
        return all(self.bloom[int(p[0]) >> 3] >> (7 - (int(p[0]) & 7)) & 1 for p in _bloom_places(hashes, self.bits))

    def get(self, identifier: int | None) -> np.ndarray | None:
        """The ids of the first document of this key; None where there is none."""
        if not self.may_hold(identifier):
            return None
        key = key_bytes(identifier)
        block = bisect_left(self.last_keys, key)
        if block == len(self.index):
            return None
        data, restarts, end = self._block(block)
        heads = [next(self._entries(data, r, end))[0] for r in restarts]
        start = restarts[max(0, bisect_left(heads, key) - 1)]
        for found, first, last, width in self._entries(data, start, end):
            if found == key:
                return np.frombuffer(data, dtype=f"<u{width}", count=(last - first) // width, offset=first)
            if found > key:
                return None
        return None


def find(shards: list[tuple[bytes, str]], folder: str, identifier: int | None) -> np.ndarray | None:
    """Looks a document up among shards given as (smallest key, path) in ascending order."""
    key = key_bytes(identifier)
    lows = [low for low, _ in shards]
    for i in range(max(0, bisect_left(lows, key) - 1), bisect_right(lows, key)):
        reader = Reader(folder, shards[i][1])
        try:
            if (ids := reader.get(identifier)) is not None:
                return ids
        finally:
            reader.close()
    return None
