"""Suffix-array dedup by a depth-limited radix sort.

Only the first ``threshold`` bytes of a suffix matter: suffixes that agree on them are repeats of one
window. The suffixes are ordered by most-significant-digit passes, and after each pass those that
stand alone are dropped:

1. The first digit of a window is the least of its ``digit``-byte substrings (by hash), which equal
   windows share. Neighbouring windows mostly share it too, so the windows fall into short runs and
   one key a run is sorted. Runs whose digit no other document has are finished.
2. The second digit is the identity of the whole run (first window, last window, length). Equal runs
   hold equal windows throughout, so the smallest document of a run decides about all others.
3. Runs that share their first digit with a different run may still share some windows (the edges of
   a repeated passage): for their first occurrence the windows themselves are sorted.

Each pass shuffles sorted, delta-coded keys by the leading digits, once for each key and block of
documents, however many documents of the block have it. What comes back to a block is one or two bits
a key, since all it must know is whether a smaller document elsewhere has the same. Blocks are a table
bucketed by block, so the texts themselves are written once and never shuffled.

Keys are compared as hashes of 104 (runs) and 64 bits plus bucket (windows).

Defined results: a null text counts as empty; texts shorter than the threshold lose nothing; a null id
sorts after all others, and equal ids (repeated rows) are no repeats of each other; windows never
cross documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame

from maskframe.llm import blocks, common

THRESHOLD, DIGIT = 50, 30
_DIGIT_BITS = 40
#: Windows that are hashed at once.
PIECE = 1 << 14
_LAST = np.iinfo(np.int64).max
_ODD = np.random.default_rng(50).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BYTES = np.random.default_rng(51).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)


def _mix(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    out = left * _ODD[which]
    out += right
    out ^= out >> np.uint64(29)
    out *= _ODD[7]
    return out


def pack(values: np.ndarray, sort_delta: bool = False) -> bytes:
    """64-bit values; sorted ones as differences."""
    values = values.view(np.uint64)
    return blocks.pack(np.diff(values, prepend=np.uint64(0)) if sort_delta else values)


def unpack(data: bytes, sort_delta: bool = False) -> np.ndarray:
    values = blocks.unpack(data, np.uint64)
    return np.cumsum(values, dtype=np.uint64) if sort_delta else values


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted columns."""
    out = np.zeros(len(sorted_keys[0]), bool)
    out[:1] = True
    for key in sorted_keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _cut(first: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs, cut from their first on into runs of ``most`` at most."""
    parts = (last - first) // most + 1
    of = np.repeat(np.arange(len(first)), parts)
    begin = first[of] + most * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    return begin, np.minimum(last[of], begin + most - 1)


def _hashed(text: np.ndarray, threshold: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """See Block._hashes(). Hashes double in length."""
    found, value, size, step = {}, _BYTES[text], 1, 0
    while True:
        for length in (threshold, digit):
            if size <= length < 2 * size:
                gap, n = length - size, len(text) - length + 1
                found[length] = _mix(value[:n], value[gap : gap + n], 5)
        if size * 2 > threshold:
            break
        value, size, step = _mix(value[:-size], value[size:], step), size * 2, step + 1
    least, width, size = found[digit], threshold - digit + 1, 1
    while size < width:
        grow = min(size, width - size)
        least, size = np.minimum(least[:-grow], least[grow:]), size + grow
    return found[threshold], least


class Block:
    """The windows of some documents, as runs with their digits."""

    def __init__(self, ids: list, sizes: list[int], text: bytes, threshold: int, digit: int, buckets: int):
        self.ids, self.text, self.threshold, self.digit_bytes, self.buckets = ids, np.frombuffer(text, np.uint8), threshold, digit, buckets
        self.ends = np.cumsum(np.asarray(sizes, np.int64))
        self.starts = self.ends - np.asarray(sizes, np.int64)
        rank = np.array([_LAST if i is None else i for i in ids], np.int64)
        count = max(len(self.text) - threshold + 1, 0)
        valid = np.zeros(count + 1, np.int8)
        whole = self.ends - self.starts >= threshold
        np.add.at(valid, self.starts[whole], 1)
        np.add.at(valid, self.ends[whole] - threshold + 1, -1)
        valid = np.cumsum(valid[:count], dtype=np.int8) > 0
        if not valid.any():
            empty = np.zeros(0, np.int64)
            self.window = self.digit = self.whole = empty.view(np.uint64)
            self.first = self.last = self.rank = empty
            return
        window, least = self._hashes(threshold, digit)
        self.window = window
        other = least[1:] != least[:-1]
        begins, ends = valid.copy(), valid.copy()
        begins[1:] &= other | ~valid[:-1]
        ends[:-1] &= other | ~valid[1:]
        self.first, self.last = _cut(np.flatnonzero(begins), np.flatnonzero(ends), threshold - digit + 1)
        self.digit = least[self.first] >> np.uint64(64 - _DIGIT_BITS)
        self.whole = _mix(window[self.first], window[self.last], 6) + (self.last - self.first).astype(np.uint64)
        self.rank = rank[np.searchsorted(self.starts, self.first, "right") - 1]

    def _hashes(self, threshold: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: its hash, and the least hash of its digits. Made piece by piece, so that the numbers on the
        way stay in a core's cache."""
        count = len(self.text) - threshold + 1
        window, least = np.empty(count, np.uint64), np.empty(count, np.uint64)
        for at in range(0, count, PIECE):
            end = min(at + PIECE, count)
            window[at:end], least[at:end] = _hashed(self.text[at : end + threshold - 1], threshold, digit)
        return window, least

    def bucket(self, digit: np.ndarray) -> np.ndarray:
        """Ascending with the digit. A digit is the least of many hashes, so small ones are frequent; their share is
        what is dealt out evenly."""
        share = -np.expm1((self.threshold - self.digit_bytes + 1) * np.log1p(-digit.astype(np.float64) / (1 << _DIGIT_BITS)))
        return np.minimum((share * self.buckets).astype(np.uint64), np.uint64(self.buckets - 1))

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First pass: order of the runs, heads, distinct digits, and whether two documents here share one. Runs of one
        digit are in no order."""
        order = np.argsort(self.digit)
        digit, rank = self.digit[order], self.rank[order]
        heads = np.flatnonzero(_heads(digit))
        many = np.minimum.reduceat(rank, heads) != np.maximum.reduceat(rank, heads) if len(heads) else np.zeros(0, bool)
        return order, heads, digit[heads], many

    def open_runs(self, elsewhere: np.ndarray) -> None:
        """Second pass: keeps the runs whose digit another document has, sorted, one key each."""
        order, heads, _, many = self.digits
        some = np.zeros(len(order), bool)
        some[order] = np.repeat(elsewhere | many, np.diff(np.append(heads, len(order))))
        keep = np.flatnonzero(some)  # in the order of the text, in which ranks mostly ascend
        self.run = keep[np.lexsort((self.rank[keep], self.whole[keep], self.digit[keep]))]
        heads = _heads(self.digit[self.run], self.whole[self.run])
        self.run_key = np.cumsum(heads) - 1
        self.run_head = self.run[heads]

    def open_windows(self, smaller: np.ndarray, unlike: np.ndarray) -> None:
        """Third pass: the runs that go, and the windows of first occurrences beside unlike runs."""
        later = self.rank[self.run] > self.rank[self.run_head][self.run_key]
        gone = smaller[self.run_key] | later
        self.gone = self.run[gone]
        left = self.run[~gone & unlike[self.run_key]]
        size = self.last[left] - self.first[left] + 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[left] - (ends - size), size)
        bucket = np.repeat(self.bucket(self.digit[left]), size)
        rank = np.repeat(self.rank[left], size)
        order = np.lexsort((rank, self.window[at], bucket))
        self.at, self.at_rank, bucket = at[order], rank[order], bucket[order]
        heads = _heads(bucket, self.window[self.at])
        self.at_key = np.cumsum(heads) - 1
        self.at_head = np.flatnonzero(heads)
        self.at_bucket = bucket[heads]

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        single = self.at[smaller[self.at_key] | (self.at_rank > self.at_rank[self.at_head][self.at_key])]
        n = len(self.text) + 1
        begin = np.concatenate((self.first[self.gone], single))
        stop = np.concatenate((self.last[self.gone], single)) + self.threshold
        return np.cumsum(np.bincount(begin, minlength=n) - np.bincount(stop, minlength=n))[:-1] > 0


_KEYS = "block long, bucket int, n int, key binary, more binary, rank binary"
_BITS = "block long, bucket int, bits binary"


def _rows(block: int, bucket: np.ndarray, columns: list[tuple[np.ndarray, bool]]) -> pa.RecordBatch:
    """A row for each bucket, of columns sorted by it."""
    heads = np.flatnonzero(_heads(bucket)) if len(bucket) else np.zeros(0, np.int64)
    cuts = np.append(heads, len(bucket))
    out = [[pack(values[a:b], delta) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for values, delta in columns]
    out += [[None] * len(heads)] * (3 - len(out))
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(heads), pa.int64()), pa.array(bucket[heads].astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), *(pa.array(x, pa.binary()) for x in out)],
        ["block", "bucket", "n", "key", "more", "rank"],
    )


def _split(flags: list[np.ndarray], table: pa.Table) -> pa.Table:
    cuts = np.cumsum(table.column("n").to_numpy())[:-1]
    parts = zip(*(np.split(f, cuts) for f in flags), strict=True)
    bits = [b"".join(np.packbits(f).tobytes() for f in part) for part in parts]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _column(table: pa.Table, name: str, delta: bool = False) -> np.ndarray:
    return np.concatenate([unpack(x, delta) for x in table.column(name).to_pylist()])


def _elsewhere(table: pa.Table) -> pa.Table:
    """Of each digit: does another block have it?"""
    key = _column(table, "key", True)
    order = np.argsort(key, kind="stable")
    heads = _heads(key[order])
    flags = np.zeros(len(key), bool)
    flags[order] = ~heads | ~np.append(heads[1:], True)
    return _split([flags], table)


def _smaller(table: pa.Table) -> pa.Table:
    """Of each run: does a smaller document have it, and do other runs have its digit?"""
    digit, whole, rank = _column(table, "key", True), _column(table, "more"), _column(table, "rank").view(np.int64)
    order = np.lexsort((rank, whole, digit))
    digit, whole, rank = digit[order], whole[order], rank[order]
    heads = _heads(digit, whole)
    group = np.cumsum(heads) - 1
    smaller = np.zeros(len(order), bool)
    smaller[order] = rank[heads][group] < rank
    outer = _heads(digit)
    runs = np.add.reduceat(heads, np.flatnonzero(outer), dtype=np.int64)
    unlike = np.zeros(len(order), bool)
    unlike[order] = (runs > 1)[np.cumsum(outer) - 1]
    return _split([smaller, unlike], table)


def _window(table: pa.Table) -> pa.Table:
    """Of each window: does a smaller document have it?"""
    key, rank = _column(table, "key", True), _column(table, "rank").view(np.int64)
    order = np.lexsort((rank, key))
    heads = _heads(key[order])
    smaller = np.zeros(len(order), bool)
    smaller[order] = rank[order][heads][np.cumsum(heads) - 1] < rank[order]
    return _split([smaller], table)


def _flags(rows: list[dict] | None, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """The answers of all buckets, in order; counts: keys of each bucket that has any."""
    out = [[] for _ in range(n)]
    for row, count in zip(sorted(rows or [], key=lambda r: r["bucket"]), counts, strict=True):
        bits, size = np.frombuffer(row["bits"], np.uint8), -(-int(count) // 8)
        for k in range(n):
            out[k].append(np.unpackbits(bits[k * size : (k + 1) * size], count=int(count)).view(bool))
    return [np.concatenate(x) if x else np.zeros(0, bool) for x in out]


def _counts(bucket: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(_heads(bucket)), len(bucket))) if len(bucket) else np.zeros(0, np.int64)


def repeated(
    docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = blocks.BLOCK_BYTES, buckets: int | None = None,
) -> DataFrame:
    """(id_col, n_bytes, spans array<struct<start,stop>>, kept binary) of each document.

    ``spans`` are the maximal runs of bytes covered by strings of ``threshold`` bytes that also start
    in a document with a smaller id; ``kept`` are the other bytes. ``buckets`` is the number of
    leading digits (three a shuffle partition by default); a bucket must fit in a task, so raise the
    session's shuffle partitions, and ``block_bytes`` with the executors' memory, as the input grows.
    """
    spark = docs.sparkSession
    kind = common.id_ddl(docs, id_col)
    buckets = buckets or 3 * common.partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.block_base()
        shrink = zstandard.ZstdCompressor(level=3).compress
        for ids, texts in blocks.grouped(batches, block_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([shrink(b"".join(texts))], pa.binary())],
                ["block", "ids", "sizes", "text"],
            )
            block += 1

    rows = common.texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    cuts, name = common.bucketed(rows.mapInArrow(cut, "block long, ids array<long>, sizes array<long>, text binary"), "block", "suffixes")

    def step(passes: int):
        """The work on each block once the answers of so many passes are there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            expand = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    b = Block(row["ids"], row["sizes"], expand(row["text"]), threshold, digit, buckets)
                    if not passes:
                        found = b.digits[2]
                        yield _rows(row["block"], b.bucket(found), [(found, True)])
                        continue
                    b.open_runs(_flags(row["bits1"], _counts(b.bucket(b.digits[2])), 1)[0])
                    bucket = b.bucket(b.digit[b.run_head])
                    if passes == 1:
                        yield _rows(row["block"], bucket, [(b.digit[b.run_head], True), (b.whole[b.run_head], False), (b.rank[b.run_head], False)])
                        continue
                    b.open_windows(*_flags(row["bits2"], _counts(bucket), 2))
                    if passes == 2:
                        key = b.window[b.at[b.at_head]]
                        keys = _rows(row["block"], b.at_bucket, [(key, True), (key[:0], False), (b.at_rank[b.at_head], False)])
                        yield keys
                        continue
                    yield _result(b, b.removed(_flags(row["bits3"], _counts(b.at_bucket), 1)[0]))

        return run

    def _result(b: Block, gone: np.ndarray) -> pa.RecordBatch:
        edge = np.zeros(len(gone) + 1, bool)
        edge[b.starts] = True
        edge[-1] = True
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | edge[1:-1]
        stop = gone.copy()
        stop[:-1] &= ~gone[1:] | edge[1:-1]
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        owner = np.searchsorted(b.starts, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - b.starts[owner]), pa.array(stop - b.starts[owner])], ["start", "stop"])
        cuts = np.append(np.searchsorted(begin, b.starts), len(begin)).astype(np.int32)
        left = np.concatenate(([0], np.cumsum(~gone)))
        offsets = np.append(left[b.starts], left[-1]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(b.ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b.text[~gone].tobytes())])
        return pa.RecordBatch.from_arrays(
            [pa.array(b.ids, pa.int64()), pa.array(b.ends - b.starts), pa.ListArray.from_arrays(pa.array(cuts), spans), kept], ["id", "n_bytes", "spans", "kept"]
        )

    out, state = "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary", cuts
    for passes, resolve in enumerate((_elsewhere, _smaller, _window)):
        keys = state.mapInArrow(step(passes), _KEYS)
        answers = common.materialize(keys.groupBy("bucket").applyInArrow(resolve, _BITS), f"suffixes-{passes + 1}")
        bits = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"bits{passes + 1}"))
        state = state.join(bits, "block", "left")
    return state.mapInArrow(step(3), out).select(F.col("id").cast(kind).alias(id_col), "n_bytes", "spans", "kept")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    return repeated(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
