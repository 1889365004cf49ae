"""BPE encoding and decoding by tree concatenation.

A text of up to SEGMENT bytes is one leaf. A longer one is normalised as a whole, split at the strings of special tokens and
cut into SEGMENT-byte pieces wherever that falls, also within words; the pieces are rows that Spark deals out, so the
halves of one text are encoded in parallel. A document's leaves then come together and are joined in pairs, level by
level. At a join a window around the cut is encoded again, from a token start of the left side to a place beyond the
cut, and doubled until both sides agree; only the tokens between the two places change.

Why agreement is exact. Each node holds what its bytes encode to by themselves. Words are found from left to right
with at most three bytes of lookahead, so a word start of the left side lies there in the joined text too if it is four bytes or
more before the cut, and a word start beyond the cut that the window and the right side share is one in the joined
text; from there on the right side is right. Within a word, merges are found to be proper (each part of a merge is
made before it, each token by one merge): then a sequence of tokens is the encoding of their letters exactly if
each adjacent pair is. So the left side may be left within a word if the window begins with the left side's own token, and the right
side entered within a word behind a token that the window and the right side share. Words that begin with an
apostrophe, which may be contractions, are never left or entered within. Where merges are not proper only word starts
count.

Decoding joins the vocabulary's tokens by blanks where the tokenizer file has no decoder, as the library does, and else is the
library's.

Defined results: a null or empty text has no ids and decodes to the empty text; a null id stays null, repeated rows give a row
each; an empty table gives an empty result; other columns are ignored. Bytes that are not UTF-8 are read as U+FFFD. Strings of special
tokens in a text are special tokens, as in the library. The file's truncation and padding are not used. A tokenizer
that normalises or splits in another way than ``tokens._SPLITS`` encodes every text whole.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from maskframe.llm import blocks, common
from maskframe.llm.tokens import Encoder, tokenizer_of

SEGMENT, WINDOW = 16 << 10, 64
#: A place is settled by so many bytes behind it: a contraction has three.
AHEAD = 4
_QUOTE, _END = ord("'"), "</w>"


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Bytes of each id, whether it ends a word, whether it begins with an apostrophe; and whether merges are proper."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    n = max(model["vocab"].values()) + 1
    size, ends, quote = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    for token, i in model["vocab"].items():
        size[i], ends[i], quote[i] = len(token.removesuffix(_END)), token.endswith(_END), token.startswith("'")
    made, proper = set(), True
    for merge in model["merges"]:
        one, other = merge.split(" ") if isinstance(merge, str) else merge
        proper &= all(part in made or len(part.removesuffix(_END)) == 1 for part in (one, other)) and one + other not in made
        made.add(one + other)
    return size, ends, quote, proper


def cuts(text: bytes, segment: int) -> list[int]:
    """Where a text is cut: every ``segment`` bytes, at the next start of a character."""
    places = [0]
    while len(text) - places[-1] > segment:
        at = _character(text, places[-1] + segment, len(text))
        if at >= len(text):
            break
        places.append(at)
    return [*places, len(text)]


def _character(text: bytes, at: int, end: int) -> int:
    while at < end and text[at] & 0xC0 == 0x80:
        at += 1
    return at


class Joiner:
    """Joins the encodings of the adjacent parts of one normalised text."""

    def __init__(self, path: str, window: int = WINDOW):
        self.size, self.ends, self.quote, self.proper = _vocabulary(path)
        self.encoder, self.window = Encoder(path, normalised=True), window

    def leaf(self, text: bytes) -> np.ndarray:
        return self.encoder([text])[0]

    def tree(self, text: bytes, places: list[int], leaves: list[np.ndarray]) -> np.ndarray:
        """The encoding of ``text``, cut at ``places``, from those of its parts."""
        nodes = list(zip(places[:-1], places[1:], leaves, strict=True))
        while len(nodes) > 1:
            pairs = [(a, e, self.join(text, a, c, e, left, right)) for (a, c, left), (_, e, right) in zip(nodes[::2], nodes[1::2])]
            nodes = pairs + nodes[len(pairs) * 2 :]
        return nodes[0][2]

    def join(self, text: bytes, begin: int, cut: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of text[begin:end] from those of text[begin:cut] and text[cut:end]."""
        reach = self.window
        while True:
            high = _character(text, min(end, cut + reach), end)
            for keep, start, inside in self._exits(text, begin, cut, reach, left):
                window = self.leaf(text[start:high])
                if inside and not (len(window) and window[0] == left[keep]):
                    continue
                if high == end:
                    return np.concatenate((left[:keep], window))
                met = self._meet(text, start, cut, high, window, inside, right)
                if met:
                    return np.concatenate((left[:keep], window[: met[0]], right[met[1] :]))
                break
            reach *= 2

    def _exits(self, text: bytes, begin: int, cut: int, reach: int, left: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        """(tokens of the left side to keep, where the window starts, whether that is within a word)."""
        low = cut - reach
        if low <= begin:
            yield 0, begin, False
            return
        places = np.flatnonzero(np.frombuffer(text, np.uint8, cut - low, low) != 32)
        behind = np.cumsum(self.size[left[::-1][: len(places)]])
        behind = behind[behind <= len(places)]
        for n, at in zip(range(len(behind), 0, -1), (low + places[len(places) - behind[::-1]]).tolist()):
            keep = len(left) - n
            if at > cut - AHEAD:
                return
            if text[at] & 0xC0 == 0x80:
                continue
            inside = keep > 0 and not self.ends[left[keep - 1]]
            if not inside or (self.proper and text[at] != _QUOTE and not self._quoted(left, keep)):
                yield keep, at, inside

    def _quoted(self, ids: np.ndarray, at: int) -> bool:
        """Whether the word that token ``at`` lies in begins with an apostrophe."""
        while at > 0 and not self.ends[ids[at - 1]]:
            at -= 1
        return bool(self.quote[ids[at]])

    def _meet(self, text: bytes, start: int, cut: int, high: int, window: np.ndarray, inside: bool, right: np.ndarray) -> tuple[int, int] | None:
        """(tokens of the window to take, tokens of the right side to drop) at the first place where both agree."""
        raw = np.frombuffer(text, np.uint8, high - start, start)
        places = start + np.flatnonzero(raw != 32)
        mine = np.cumsum(self.size[window]) - self.size[window]
        mine = places[mine]
        places = places[np.searchsorted(places, cut) :]
        head = right[: len(places)]
        other = np.cumsum(self.size[head]) - self.size[head]
        other = places[other[other < len(places)]]
        for at in np.intersect1d(mine, other).tolist():
            if at > high - AHEAD:
                return None
            j, k = int(np.searchsorted(mine, at)), int(np.searchsorted(other, at))
            first = j > 0 and bool(self.ends[window[j - 1]]) or (j == 0 and not inside)
            if first and (k == 0 or self.ends[right[k - 1]]):
                return j, k
            shared = j > 0 and k > 0 and window[j - 1] == right[k - 1] and not self.ends[right[k - 1]]
            if self.proper and shared and not self._quoted(window, j) and not self._quoted(right, k):
                return j, k
        return None


@lru_cache(maxsize=2)
def _joiner(path: str, window: int) -> Joiner:
    """One a process, so that the pieces of windows are remembered from one document to the next."""
    return Joiner(path, window)


_PREPARED = "key long, id {kind}, part int, place int, text binary, ids binary"


def _prepare(docs: DataFrame, path: str, segment: int, id_col: str, text_col: str) -> DataFrame:
    """Short documents with their ids; long ones as rows of their normalised parts, one a segment. What is shuffled later,
    the texts and ids of long ones, is compressed."""
    kind, id_type = common.id_ddl(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key = Encoder(path), blocks.block_base()
        for keys, texts in blocks.grouped(batches):
            short = [i for i, text in enumerate(texts) if len(text) <= segment or not encoder.cuts]
            found = encoder([texts[i] for i in short])
            rows = [(None, keys[i], 0, 0, None, ids.astype("<u4").tobytes()) for i, ids in zip(short, found, strict=True)]
            for i in sorted(set(range(len(texts))).difference(short)):
                key += 1
                for part, piece in enumerate(encoder.parts(texts[i])):
                    if isinstance(piece, int):
                        rows.append((key, keys[i], part, 0, None, blocks.pack(np.array([piece], np.uint32))))
                        continue
                    text = encoder.tokenizer.normalizer.normalize_str(piece.decode("utf-8", "replace")).encode()
                    places = cuts(text, segment)
                    rows += [(key, keys[i], part, a, zstandard.compress(text[a:b]), None) for a, b in itertools.pairwise(places)]
            columns = zip(*rows, strict=True)
            types = [pa.int64(), id_type, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "id", "part", "place", "text", "ids"])

    return common.materialize(common.texts(docs, id_col, text_col).mapInArrow(run, _PREPARED.format(kind=kind)), "treebpe")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, window: int = WINDOW) -> DataFrame:
    """(id_col, ids binary): the ids of each document's whole text as little-endian unsigned 32-bit integers."""
    rows = _prepare(docs, path, segment, id_col, text_col)
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, normalised=True)
        for batch in batches:
            texts, known = batch.column("text").to_pylist(), batch.column("ids").to_pylist()
            found = iter(encoder([zstandard.decompress(text) for text in texts if text is not None]))
            ids = [blocks.pack(next(found).astype(np.uint32)) if text is not None else had for text, had in zip(texts, known, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    def join(group: pa.Table) -> pa.Table:
        """One document: its parts in order, each joined as a tree."""
        joiner, made = _joiner(path, window), []
        listed = sorted(zip(group.column("part").to_pylist(), group.column("place").to_pylist(), group.column("text").to_pylist(), group.column("ids").to_pylist(), strict=True), key=lambda r: r[:2])
        for _, some in itertools.groupby(listed, key=lambda r: r[0]):
            pieces = list(some)
            ids = [blocks.unpack(p[3], np.uint32) for p in pieces]
            if pieces[0][2] is None:
                made += ids
            else:
                text = b"".join(zstandard.decompress(p[2]) for p in pieces)
                made.append(joiner.tree(text, [*(p[1] for p in pieces), len(text)], ids))
        return pa.table({id_col: group.column("id").slice(0, 1), "ids": pa.array([np.concatenate(made).astype("<u4").tobytes()], pa.binary())})

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.where(F.col("key").isNotNull()).repartition(common.partitions(docs.sparkSession), "key", "part", "place")
    long = dealt.mapInArrow(leaves, _PREPARED.format(kind=kind)).groupBy("key").applyInArrow(join, f"`{id_col}` {kind}, ids binary")
    return rows.where(F.col("key").isNull()).select(F.col("id").alias(id_col), "ids").unionByName(long)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded string): the text of each row's ids, special tokens kept; null ids decode to the empty text."""
    kind = common.id_ddl(encoded, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        names = None
        if tokenizer.decoder is None:
            known = tokenizer.get_vocab(with_added_tokens=True)
            names = dict(zip(known.values(), known, strict=True)).get
        for batch in batches:
            lists = [np.frombuffer(ids or b"", "<u4").tolist() for ids in batch.column(1).to_pylist()]
            if names:
                texts = [" ".join(filter(None, map(names, ids))) for ids in lists]
            else:
                texts = [tokenizer.decode(ids, skip_special_tokens=False) for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded again."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
