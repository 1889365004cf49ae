"""Cut a scan into blocks: runs of documents of bounded size that one task can hold.

A block is the unit of pre-aggregation: what its documents have in common is gathered once before
anything is shuffled. Block ids are made of the scan's partition and a running number, so a task
that is run again makes the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

BLOCK_BYTES = 4 << 20


def block_base() -> int:
    """First block id of this task."""
    return TaskContext.get().partitionId() << 32


def grouped(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes) of consecutive rows, at least ``limit`` bytes each but for the last.

    The first column is the id, the second the text as binary; null texts count as empty.
    """
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or b""
            ids.append(key)
            texts.append(text)
            size += len(text) + 1
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    """What pack() was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings of any content, compressed."""
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + np.ascontiguousarray(sizes.view(np.uint8).reshape(-1, 4).T).tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    """What pack_words() was given."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, -1).T).view(np.uint32).ravel()
    ends = np.cumsum(sizes, dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
