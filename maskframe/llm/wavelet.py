"""A wavelet matrix over token ids: one compressed file with access, rank, select and counts.

Plane k holds bit k (the highest first) of every id, in the order that the planes above leave: at each
plane the ids with a zero bit come first, stably. File: magic, header (little-endian 64-bit: tokens,
planes, documents, bytes of the document part), the lengths of each plane and of its directory of counts,
the document part, the planes and directories. Each part is compressed by itself and unpacked when it is
first needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"WVM2"
_ROW = 64  # bytes of a plane between two counts of its directory


def _narrow(planes: int) -> type:
    """The type that ids of so many bits are moved in."""
    return np.uint16 if planes <= 16 else np.uint32 if planes <= 32 else np.uint64


def _flags(packed: np.ndarray, n: int) -> pa.Array:
    """The first n bits as booleans."""
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(packed)])


def dump(ids: np.ndarray, docs: bytes = b"", n_docs: int = 0) -> bytes:
    """The file for ``ids`` (unsigned); ``docs`` describes the documents they belong to."""
    n, planes = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    order, out, directories = ids.astype(_narrow(planes)), [], []
    for k in range(planes - 1, -1, -1):
        raw = np.packbits((order & order.dtype.type(1 << k)) != 0, bitorder="little")
        out.append(squeeze(raw.tobytes()))
        counts = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), _ROW), dtype=np.uint16) if len(raw) else np.zeros(0, np.uint16)
        directories.append(squeeze(counts.astype("<u2").tobytes()))
        order = np.concatenate([pa.array(order).filter(_flags(some, n)).to_numpy() for some in (~raw, raw)])
    docs = squeeze(docs)
    head = np.array([n, planes, n_docs, len(docs), *map(len, out), *map(len, directories)], np.int64).tobytes()
    return b"".join((MAGIC, head, docs, *out, *directories))


class WaveletMatrix:
    """Reads a file made by dump()."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.planes, self.n_docs, size = (int(x) for x in np.frombuffer(data, np.int64, 4, 4))
        lengths = np.frombuffer(data, np.int64, 2 * self.planes, 36)
        at = 36 + 16 * self.planes
        ends = at + size + np.cumsum(lengths)
        self.data, self.parts = data, [(at, at + size), *zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        self._open: dict[int, np.ndarray] = {}

    def _part(self, number: int) -> bytes:
        a, b = self.parts[number]
        return zstandard.ZstdDecompressor().decompress(self.data[a:b])

    @property
    def docs(self) -> bytes:
        """What describes the documents."""
        return self._part(0)

    def _plane(self, plane: int) -> np.ndarray:
        """The bytes of a plane."""
        if plane + 1 not in self._open:
            self._open[plane + 1] = np.frombuffer(self._part(plane + 1), np.uint8)
        return self._open[plane + 1]

    def _directory(self, plane: int) -> np.ndarray:
        """Ones before each row of the plane, and in all."""
        number = 1 + self.planes + plane
        if number not in self._open:
            counts = np.frombuffer(self._part(number), "<u2")
            self._open[number] = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))
        return self._open[number]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of the plane."""
        raw, byte = self._plane(plane), i >> 3
        row = byte // _ROW
        part = int(np.bitwise_count(raw[row * _ROW : byte]).sum())
        rest = int(raw[byte] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return int(self._directory(plane)[row]) + part + rest

    def _zeros(self, plane: int) -> int:
        return self.n - int(self._directory(plane)[-1])

    def __getitem__(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.planes):
            bit = int(self._plane(plane)[i >> 3]) >> (i & 7) & 1
            ones = self._ones(plane, i)
            i = self._zeros(plane) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._ones(plane, start), self._ones(plane, stop)
            if token >> (self.planes - 1 - plane) & 1:
                start, stop = self._zeros(plane) + a, self._zeros(plane) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in [start, stop)."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def _places(self, plane: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Where the bits of these ranks (from 0) stand: the row by the directory, the place in it by its bits."""
        ones, raw = self._directory(plane), self._plane(plane)
        starts = ones if bit else np.minimum(np.arange(len(ones)) * _ROW * 8, self.n) - ones
        row = np.searchsorted(starts, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for at in range(0, len(ranks), 4096):
            some, which = np.unique(row[at : at + 4096], return_inverse=True)
            bits = np.zeros((len(some), _ROW), np.uint8)
            for k, r in enumerate(some.tolist()):
                part = raw[r * _ROW : (r + 1) * _ROW]
                bits[k, : len(part)] = part
            flags = np.unpackbits(bits, axis=1, bitorder="little") == bit
            order = np.argsort(~flags, axis=1, kind="stable")
            out[at : at + 4096] = some[which] * _ROW * 8 + order[which, ranks[at : at + 4096] - starts[row[at : at + 4096]]]
        return out

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """Positions of an id's occurrences from their places below the last plane."""
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self._places(plane, bit, at - self._zeros(plane) * bit)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k (from 0) of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return int(self._up(token, np.array([a + k]))[0])

    def find(self, token: int) -> np.ndarray:
        """All positions of an id, ascending."""
        return self._up(token, np.arange(*self._range(token, 0, self.n)))

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        out = np.zeros(self.n, _narrow(self.planes))
        for plane in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self._plane(plane), count=self.n, bitorder="little").view(bool)
            back, zeros = np.empty_like(out), self._zeros(plane)
            back[np.flatnonzero(~one)] = out[:zeros]
            back[np.flatnonzero(one)] = out[zeros:] | out.dtype.type(1 << (self.planes - 1 - plane))
            out = back
        return out.astype(np.uint32)
