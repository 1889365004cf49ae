"""Token-id shards: documents in id order, one wavelet matrix file a shard.

The documents are dealt out by ranges of their id and sorted; each task encodes its documents and
writes shards of about SHARD_TOKENS ids, cut between documents (one document is never cut). Files are
written beside their final name and moved, under a name that depends on the partition and a running
number only, so a task that runs again replaces its own files. Global offsets are sums over shards: a
window over one row a partition, then one over the shards of each partition.

Encoding is by the tokenizers library. For tokenizers that lower-case and split as ``_SPLITS`` says, texts are cut
where no token can reach across (blanks, and between letters and plain punctuation) and each distinct piece of a
block is looked up once, by its bytes, among those that the process knows from its earlier blocks and tasks; what is
new is encoded by the library, many pieces a call. Any other tokenizer encodes texts whole.

Defined results: a null or empty text has the end id alone; null ids come first; repeated rows and ids
are kept, ties in order of their text; an empty table gives no files and an empty result; other
columns are ignored. Bytes that are not UTF-8 are read as U+FFFD. The strings of special tokens in a text
are special tokens, as in the library.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from maskframe.llm import blocks, common
from maskframe.llm.wavelet import WaveletMatrix, dump

SHARD_TOKENS = 1 << 20
CACHE_PIECES = 400_000
_BLANK, _LETTER, _MARK, _OTHER = range(4)
_PLAIN = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+"


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[32, 10]] = _BLANK
    for c in range(33, 127):
        out[c] = _OTHER if chr(c) in "'0123456789" else _LETTER if chr(c).isalpha() else _MARK
    return out


_CLASS = _classes()
#: Whether a piece begins or ends between bytes of two classes (4 * left + right).
_BOUND = np.zeros(16, bool)
_BOUND[[_BLANK * 4 + k for k in (_LETTER, _MARK, _OTHER)] + [k * 4 + _BLANK for k in (_LETTER, _MARK, _OTHER)] + [_LETTER * 4 + _MARK, _MARK * 4 + _LETTER]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The normaliser and pre-tokenizer that the cuts are right for.
_SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Pieces of up to so many bytes are their own key.
_SHORT = 7
#: Plain pieces that are encoded in one call.
_AT_ONCE = 1 << 13
#: Bytes of texts whose pieces are found at once; arrays over them are the most memory that an encoder takes.
_RUN = 1 << 21


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """Byte to letter of byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, without truncation and padding; whether its texts can be cut; its special tokens' ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    added = settings.get("added_tokens") or []
    plain = not any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    return tokenizer, plain and all(settings.get(name) == wanted for name, wanted in _SPLITS.items()), {token["content"].encode(): token["id"] for token in added}


def tokenizer_of(path: str):
    """The library's tokenizer for a file, one a process."""
    return _tokenizer(path)[0]


@lru_cache(maxsize=2)
def _listing(path: str):
    """The model under a pre-tokenizer that takes plain pieces joined by zeros one by one, and the id of a zero; None where
    zeros have no token of their own."""
    import tokenizers

    listing, kinds = tokenizers.Tokenizer(tokenizer_of(path).model), tokenizers.pre_tokenizers
    listing.pre_tokenizer = kinds.Sequence([kinds.Digits(individual_digits=True), kinds.ByteLevel(add_prefix_space=False, use_regex=False)])
    zero = listing.encode("0", add_special_tokens=False).ids
    return (listing, zero[0]) if len(zero) == 1 and listing.id_to_token(zero[0]).startswith("0") else None


class Encoder:
    """Encodes runs of documents; remembers the ids of pieces, CACHE_PIECES at most besides those of one run, and forgets
    first what it has met in one run only. With ``normalised`` the texts have been through the normaliser and hold no
    special tokens."""

    def __init__(self, path: str, normalised: bool = False):
        (self.tokenizer, self.cuts, self.special), self.path, self.known = _tokenizer(path), path, {}
        #: The ids of pieces, ``filled`` in all; by the number that a piece has in ``known``: where its ids begin, how many
        #: there are, and whether it was met again. All have room to grow, so that a call costs what it learns.
        self.values, self.filled = np.zeros(0, np.uint32), 0
        self.starts, self.sizes, self.again = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.plain, self.normalised = re.compile(_PLAIN).fullmatch, normalised
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special and not normalised else None

    def parts(self, text: bytes) -> list[bytes | int]:
        """The text between special tokens, and the ids of these."""
        pieces = self.marks.split(text) if self.marks else [text]
        return [self.special[piece] if at % 2 else piece for at, piece in enumerate(pieces) if piece]

    def _model(self, text: str) -> list[int]:
        """The ids of a normalised piece."""
        return [token.id for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) for token in self.tokenizer.model.tokenize(word)]

    def _numbers(self, keys: list[int | bytes | tuple[bytes]]) -> np.ndarray:
        """The numbers of pieces, by their keys; unknown ones are learnt."""
        at = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        had, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0).tolist()
        self.again[at[had]] = True
        if self.known and len(self.known) + len(unseen) > CACHE_PIECES:
            at[had] = self._forget(at[had])
        if unseen:
            self._learn(dict.fromkeys([keys[i] for i in unseen]))
            at[unseen] = [self.known[keys[i]] for i in unseen]
        return at

    def _forget(self, needed: np.ndarray) -> np.ndarray:
        """Forgets the pieces met once, and all but ``needed`` ones if those met again are many; the new numbers of ``needed``."""
        n = len(self.known)
        keep = self.again[:n]
        if keep.sum() > CACHE_PIECES // 2:
            keep = np.zeros(n, bool)
            keep[needed] = True
        self.known = {key: k for k, key in enumerate(itertools.compress(self.known, keep.tolist()))}
        self.values, self.sizes, self.again = self.values[: self.filled][np.repeat(keep, self.sizes[:n])], self.sizes[:n][keep], np.zeros(keep.sum(), bool)
        self.starts, self.filled = np.cumsum(self.sizes) - self.sizes, len(self.values)
        return (np.cumsum(keep) - 1)[needed]

    def _learn(self, keys: Iterable[int | bytes | tuple[bytes]]) -> None:
        """Encodes the pieces of distinct keys: those plain ones first that need no normaliser."""
        plain, rest = {}, {}
        for key in keys:
            if isinstance(key, int):
                piece, mixed = key.to_bytes(8, "little")[: key >> 57], key >> 56 & 1
            else:
                piece, mixed = (key, False) if isinstance(key, bytes) else (key[0], True)
            (plain if not mixed and piece.isascii() or self.plain(piece) else rest)[key] = piece
        texts = [piece.decode("utf-8", "replace") for piece in rest.values()]
        encoded = map(self._model, texts) if self.normalised else (found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        made = [*self._plain(list(plain.values())), _flat(list(encoded))]
        values, sizes, n = np.concatenate([v for v, _ in made]), np.concatenate([k for _, k in made]), len(self.known)
        self.starts = _put(self.starts, n, np.cumsum(sizes) - sizes + self.filled)
        self.sizes, self.again = _put(self.sizes, n, sizes), _put(self.again, n, np.zeros(len(sizes), bool))
        self.values, self.filled = _put(self.values, self.filled, values), self.filled + len(values)
        self.known.update(zip(itertools.chain(plain, rest), range(n, n + len(sizes)), strict=True))

    def _plain(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of plain pieces, and how many each has, run by run."""
        listing, model, letters = _listing(self.path), self.tokenizer.model.tokenize, _byte_letters()
        for some in (pieces[k : k + _AT_ONCE] for k in range(0, len(pieces), _AT_ONCE)):
            if listing:
                ids = np.array(listing[0].encode_batch_fast([b"0".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
                zeros = np.flatnonzero(ids == listing[1])
                yield np.delete(ids, zeros), np.diff(np.concatenate(([-1], zeros, [len(ids)]))) - 1
            else:
                yield _flat([[token.id for token in model(piece.decode("latin-1").translate(letters))] for piece in some])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.cuts:
            encoded = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace") for text in texts], add_special_tokens=False)
            return [np.array(found.ids, np.uint32) for found in encoded]
        if self.marks and any(map(self.marks.search, texts)):
            parts = list(map(self.parts, texts))
            found = iter(self._runs([part for some in parts for part in some if isinstance(part, bytes)]))
            ids = [[next(found) if isinstance(part, bytes) else np.array([part], np.uint32) for part in some] for some in parts]
            return [np.concatenate(some) if some else np.zeros(0, np.uint32) for some in ids]
        return self._runs(texts)

    def _runs(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts without special tokens, run by run."""
        run = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // _RUN
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        return [ids for a, b in itertools.pairwise(cuts) for ids in self._run(texts[a:b])]

    def _run(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts without special tokens."""
        if not texts:
            return []
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        kind = _CLASS[raw]
        accent = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7) & (raw[1:] >= 0x80))
        kind[accent] = kind[accent + 1] = _LETTER
        pair = kind.copy()
        pair[1:] += kind[:-1] * 4
        bounds = np.flatnonzero(_BOUND[pair])  # the last byte is blank, so each piece has one where it ends
        starts = np.flatnonzero(kind[bounds] != _BLANK)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        begin, stop = bounds[starts], bounds[starts + 1]
        mixed = np.maximum.reduceat(kind, begin) == _OTHER
        lower = _LOWER[raw]
        high = accent + 1
        lower[high[raw[high] <= 0x9E]] += 0x20
        lower = np.where(np.repeat(np.concatenate(([False], mixed)), np.diff(np.concatenate(([0], begin, [len(raw)])))), raw, lower)
        number = self._pieces(lower, begin, stop, mixed)
        sizes_at = self.sizes[number]
        ends = np.concatenate(([0], np.cumsum(sizes_at)))
        ids = self.values[np.arange(ends[-1]) + np.repeat(self.starts[number] - ends[:-1], sizes_at)]
        return np.split(ids, ends[np.searchsorted(begin, np.cumsum(sizes)[:-1])])

    def _pieces(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The number of each piece. A short piece's bytes, size and kind are a key of 64 bits. Long ones are grouped by
        some of their bytes and compared with one of their group in full; what differs is looked up by itself."""
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        words = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes at each place
        size = (stop - begin).astype(np.uint64)
        short, place = size <= _SHORT, np.empty(len(begin), np.int64)
        first = words[begin]
        key = first[short] & ~(~np.uint64(0) << (size[short] * np.uint64(8))) | (size[short] * np.uint64(2) + mixed[short]) << np.uint64(56)
        keys, place[short] = _distinct(key)
        keys, long = keys.tolist(), np.flatnonzero(~short)
        if len(long):
            some = first[long] * np.uint64(0x9E3779B97F4A7C15) ^ words[stop[long] - 8] * np.uint64(0xC2B2AE3D27D4EB4F)
            some += words[(begin[long] + stop[long]) // 2 - 4] * np.uint64(0x165667B19E3779F9) + size[long] * np.uint64(2) + mixed[long]
            groups, group = _distinct(some)
            at = np.empty(len(groups), np.int64)
            at[group] = np.arange(len(group))
            one = long[at][group]
            width = (stop - begin)[long]
            equal = (width == (stop - begin)[one]) & (mixed[long] == mixed[one])
            width = np.where(equal, width, 1)
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            differs = data[np.repeat(begin[long], width) + step] != data[np.repeat(begin[one], width) + step]
            equal &= ~np.logical_or.reduceat(differs, np.cumsum(width) - width)
            place[long] = len(keys) + group
            place[long[~equal]] = len(keys) + len(at) + np.arange((~equal).sum())
            which, text = np.concatenate((long[at], long[~equal])), data.tobytes()
            listed = (text[a:b] for a, b in zip(begin[which].tolist(), stop[which].tolist(), strict=True))
            keys += [(piece,) if odd else piece for piece, odd in zip(listed, mixed[which].tolist(), strict=True)]
        return self._numbers(keys)[place]


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and their sizes."""
    return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _put(array: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` from a place on; where it lacks room it gets half as much again."""
    if at + len(more) > len(array):
        array = np.concatenate((array[:at], np.zeros(len(more) + at // 2, array.dtype)))
    array[at : at + len(more)] = more
    return array


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and which of them each one is."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a process, which its tasks share."""
    return Encoder(path)


def write(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Write the shards below ``folder``; returns the manifest (part, shard, n_docs, n_tokens, first)
    where ``first`` is the number of ids in all shards before. ``folder`` must be shared."""
    spark = docs.sparkSession
    rows = common.texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    dealt = rows.repartitionByRange(common.partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, encode, made = TaskContext.get().partitionId(), encoder(tokenizer), []
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)

        def put(ids: list, tokens: list[np.ndarray]) -> None:
            listed = np.array([0 if i is None else i for i in ids], np.int64)
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            known = np.array([i is not None for i in ids], np.int64)
            name = f"{root}/part-{part:06d}-{len(made):06d}"
            with store.open_output_stream(tmp := f"{name}.{uuid.uuid4().hex}.tmp") as out:
                out.write(dump(np.concatenate(tokens), np.concatenate(([part, len(made)], listed, sizes, known)).tobytes(), len(ids)))
            store.move(tmp, f"{name}.wvm")
            made.append((part, len(made), len(ids), int(sizes.sum())))

        ids, tokens, total = [], [], 0
        for some, texts in blocks.grouped(batches):
            for key, found in zip(some, encode(texts), strict=True):
                if ids and total + len(found) + 1 > shard_tokens:
                    put(ids, tokens)
                    ids, tokens, total = [], [], 0
                ids.append(key)
                tokens.append(np.append(found, np.uint32(end_id)))
                total += len(found) + 1
        if ids:
            put(ids, tokens)
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in range(4)], ["part", "shard", "n_docs", "n_tokens"])

    made = common.materialize(dealt.mapInArrow(save, "part long, shard long, n_docs long, n_tokens long"), "manifest")
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return made.withColumn("within", within).join(parts, "part").select("part", "shard", "n_docs", "n_tokens", (F.col("before") + F.col("within")).alias("first"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, shard, id, at, ids binary): the documents of all shards in ``folder``; ``at`` counts from
    the start of the shard, ``ids`` are little-endian unsigned 32-bit integers."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                matrix = WaveletMatrix(content.as_py())
                n = matrix.n_docs
                info = np.frombuffer(matrix.docs, np.int64)
                ids, sizes, known = (info[2 + k * n : 2 + (k + 1) * n] for k in range(3))
                ends = np.cumsum(sizes)
                data = matrix.ids().astype("<u4", copy=False).tobytes()
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                whole = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, info[0])), pa.array(np.full(n, info[1])), pa.array(ids, mask=known == 0), pa.array(ends - sizes), whole],
                    ["part", "shard", "id", "at", "ids"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(load, "part long, shard long, id long, at long, ids binary")


def digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files written for ``docs``."""
    spark = docs.sparkSession
    folder = common.scratch_path(spark, "tokens")
    manifest = write(docs, tokenizer, end_id, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder).join(manifest.select("part", "shard", "first"), ["part", "shard"]).select(
        F.col("id").alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
