"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding: every document is split into pre-tokens; a block of documents keeps its pre-tokens as
positions into the block's list of distinct words. Only the (block, word) pairs are shuffled, packed
by hash bucket of the word: in its bucket each distinct word of the whole corpus is encoded once, the
ids go back to the blocks that have the word, and each block puts its documents together again by
position. Decoding joins ids to the token-byte table.

A frequent word costs one entry a block, not one a use, so no key grows with the number of documents.
Block tables are bucketed by block: the positions are written once and never shuffled.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows and repeated
ids give one output row each; a null id stays null; an empty table gives an empty result; other
columns are ignored and cannot clash. Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from maskframe.llm import blocks, common


BLOCK_BYTES = 6 << 20


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _token_table(path: str) -> pa.Array:
    """The bytes of each id; its size is that of the vocabulary file."""
    ranks = _ranks(path)
    known = {rank: token for token, rank in ranks.items()}
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())


def word_blocks(docs: DataFrame, pattern: str, id_col: str, text_col: str, block_bytes: int, buckets: int) -> DataFrame:
    """(block, doc_ids, n_words, width, spots, words): documents as positions into the block's distinct
    words, which lie in order of their bucket, packed bucket by bucket."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block = blocks.block_base()
        for ids, texts in blocks.grouped(batches, block_bytes):
            seen: dict[str, int] = {}
            spots, counts = [], []
            for text in texts:
                words = find(text.decode("utf-8", "replace"))
                for word in set(words).difference(seen):
                    seen[word] = len(seen)
                spots.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                counts.append(len(words))
            words = [word.encode() for word in seen]
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
            order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            flat = place[np.concatenate(spots)]
            parts = [
                {"bucket": int(key), "words": blocks.pack_words([words[i] for i in same])} for key, same in itertools.groupby(order, key=lambda i: bucket[i])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int32())), pa.array([blocks.pack(flat)], pa.binary()),
                    pa.array([parts], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
                ],
                ["block", "doc_ids", "n_words", "spots", "words"],
            )
            block += 1

    kind, id_type = common.id_ddl(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    rows = common.texts(docs, id_col, text_col)
    schema = f"block long, doc_ids array<{kind}>, n_words array<int>, spots binary, words array<struct<bucket:int,words:binary>>"
    return rows.mapInArrow(common.lean(split), schema)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None
) -> DataFrame:
    """(id_col, ids array<int>): the ids of each document's whole text.

    ``buckets`` (three a shuffle partition by default) deal out the distinct words; a bucket's words
    must fit in a task. A block's text must, too; one document is never split.
    """
    kind, id_type = common.id_ddl(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)
    buckets = buckets or 3 * common.partitions(docs.sparkSession)
    table, _ = common.bucketed(word_blocks(docs, pattern, id_col, text_col, block_bytes, buckets), "block", "bpe")

    def encode_bucket(rows: pa.Table) -> pa.Table:
        """Each distinct word of the bucket is encoded once, whatever number of blocks has it."""
        single, known = _encoder(path, pattern)._encode_single_piece, {}
        sizes, ids = [], []
        for packed in rows.column("words").to_pylist():
            words = blocks.unpack_words(packed)
            for word in words:
                if word not in known:
                    known[word] = single(word)
            found = [known[word] for word in words]
            sizes.append(blocks.pack(np.fromiter(map(len, found), np.uint32, len(found))))
            ids.append(blocks.pack(np.fromiter(itertools.chain.from_iterable(found), np.uint32)))
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    words = table.select("block", F.explode("words").alias("part")).select("block", "part.bucket", "part.words")
    encoded = words.groupBy("bucket").applyInArrow(encode_bucket, "block long, bucket int, sizes binary, ids binary")
    back = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parts = sorted(row["parts"] or [], key=lambda part: part["bucket"])
                size = np.concatenate([blocks.unpack(part["sizes"], np.uint32) for part in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
                values = np.concatenate([blocks.unpack(part["ids"], np.uint32) for part in parts] or [np.zeros(0, np.uint32)]).view(np.int32)
                begin = np.cumsum(size) - size
                spots = blocks.unpack(row["spots"], np.uint32)
                sizes = size[spots]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                take = np.arange(ends[-1]) + np.repeat(begin[spots] - ends[:-1], sizes)
                cuts = ends[np.concatenate(([0], np.cumsum(row["n_words"], dtype=np.int64)))]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values[take], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], id_type), lists], [id_col, "ids"])

    rows = table.select("block", "doc_ids", "n_words", "spots").join(back, "block", "left")
    return rows.mapInArrow(common.lean(assemble), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded binary): each id joined to its bytes in the token table, in order.

    The table has one row a vocabulary entry, a bound that does not depend on the documents, so
    every task holds it. Null ids lists decode to no bytes; an id outside the table is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_table(path)
        for batch in batches:
            lists = batch.column(1)
            flat = tokens.take(lists.flatten())
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            at = np.frombuffer(flat.buffers()[1], np.int64)[ends] if len(flat) else np.zeros(len(ends), np.int64)
            data = memoryview(flat.buffers()[2]) if len(flat) else memoryview(b"")
            whole = [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(whole, pa.binary())], names)

    names = [id_col, ids_col, "decoded"]
    kind = common.id_ddl(encoded, id_col)
    return encoded.select(id_col, ids_col).mapInArrow(common.lean(run), f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded binary")


def with_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document, encoded and decoded again."""
    both = decode(encode(docs, path, pattern), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """with_digests() without the ids."""
    return with_digests(docs, path, pattern).drop("ids")
