"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are token sequences (lower-cased words, punctuation dropped; letters of
scripts without blanks are tokens of their own). Karp-Rabin hashes of every window of ``MATCH`` tokens run
over both; windows of a document that some item has are seeds, and joining them to the item's windows gives
the positions on both sides. For each document row and item the longest common run of unmarked tokens is
marked as a tile, again and again, until none of ``MATCH`` tokens is left. An item is leaked if its tiles
cover ``COVERAGE`` of its tokens, in whatever order they stand. An item of fewer than ``MATCH`` tokens has
one window, the whole item.

The benchmark is taken in blocks of ``BLOCK_TOKENS`` tokens at most, so what is sent to the tasks is bounded
however large the benchmark is. Documents are judged where they lie and nothing is shuffled, so a phrase
that many items and documents share costs no exchange. Within a block the hash is chosen so that different
windows have different hashes, and a document's window is compared with the item's token by token. A
document's places are followed one item position at a time, so memory grows with its length only.

Defined results: null texts have no tokens; items without tokens are not looked for; benchmark rows are
told apart by id and text, so a null or repeated item_id is looked for like any other; equal rows count once,
and a row without an id adds nothing where its text also stands under an id; document rows are judged one by one, so repeated rows and ids each give their own result rows; null
ids are kept; ids may be of any type; an empty table on either side gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from maskframe.llm import common

MATCH, COVERAGE = 5, 0.5
#: Tokens of the benchmark that one pass over the documents looks for.
BLOCK_TOKENS = 1_000_000
_MARKS = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
#: Letters of scripts that are written without blanks: Thai to Khmer, kana, Han, Hangul syllables.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff])")


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode("utf-8", "replace").translate(_MARKS).split()


def windows(ids: np.ndarray, match: int = MATCH, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Karp-Rabin hashes of every window of ``match`` token numbers."""
    out = np.zeros(max(len(ids) - match + 1, 0), np.uint64)
    for k in range(match):
        out = out * np.uint64(base) + ids[k : k + len(out)]
    return out


def greedy(places: list[np.ndarray], match: int) -> list[tuple[int, int, int]]:
    """(document start, item start, length) of the tiles; ``places[i]`` are the document positions, ascending,
    of the item's window at i. The longest goes first, of equal ones the first in the document."""
    size = len(places) + match - 1
    item_used = np.zeros(size, bool)
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, int, int]] = []

    def free_of(at: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for begin, stop in taken:
            out &= (at + match <= begin) | (at >= stop)
        return at[out]

    while True:
        best, ends = 0, []
        before, lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, every in enumerate(places):
            if item_used[i : i + match].any():
                before = before[:0]
                continue
            at = free_of(every)
            grown = np.ones(len(at), np.int64)
            if len(before) and len(at):
                spot = np.minimum(np.searchsorted(before, at - 1), len(before) - 1)
                grown += np.where(before[spot] == at - 1, lengths[spot], 0)
            longest = int(grown.max()) if len(grown) else 0
            if longest > best:
                best, ends = longest, []
            if longest and longest == best:
                ends.append((at[grown == best] - best + 1, i - best + 1))
            before, lengths = at, grown
        if not best:
            return sorted(found)
        length = best + match - 1
        docs, items = (np.concatenate(x) for x in zip(*((d, np.full(len(d), i)) for d, i in ends), strict=True))
        order = np.lexsort((items, docs))
        docs, items = docs[order], items[order]
        while len(docs):
            d, i = int(docs[0]), int(items[0])
            found.append((d, i, length))
            taken.append((d, d + length))
            item_used[i : i + length] = True
            left = ((docs + length <= d) | (docs >= d + length)) & ((items + length <= i) | (items >= i + length))
            docs, items = docs[left], items[left]


def tiles(pairs: list[tuple[int, int]], match: int = MATCH) -> list[tuple[int, int, int]]:
    """greedy() of the seeds' (document, item) positions."""
    spots = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
    return greedy([spots[spots[:, 1] == i, 0] for i in range(int(spots[:, 1].max()) + 1)], match) if len(spots) else []


class Seeds:
    """The windows of one width of a block of items, found in documents by hash and compared by tokens."""

    def __init__(self, numbered: list[np.ndarray], which: list[int], width: int):
        self.width, self.flat = width, np.concatenate([numbered[i] for i in which])
        sizes = np.array([len(numbered[i]) for i in which], np.int64)
        begin = np.cumsum(sizes) - sizes
        counts = sizes - width + 1
        spot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(begin, counts) + spot
        _, first, same = np.unique(np.stack([self.flat[start + k] for k in range(width)], axis=1), axis=0, return_index=True, return_inverse=True)
        self.base = 0x9E3779B97F4A7C15
        while len(np.unique(windows(self.flat, width, self.base)[start[first]])) < len(first):
            self.base += 2
        hashes = windows(self.flat, width, self.base)[start[first]]
        order = np.argsort(hashes)
        self.known, self.start = hashes[order], start[first][order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        number = number[same.ravel()]
        dealt = np.argsort(number, kind="stable")
        self.items, self.spots = np.repeat(np.array(which), counts)[dealt], spot[dealt]
        self.cuts = np.append(np.searchsorted(number[dealt], np.arange(len(order))), len(dealt))

    def met(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of the known windows among a document's token numbers (0: in no item)."""
        hashes = windows(ids, self.width, self.base)
        if not len(hashes) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.flatnonzero(unknown[self.width :] == unknown[: -self.width])
        window = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        hit = self.known[window] == hashes[at]
        at, window = at[hit], window[hit]
        for k in range(self.width):
            equal = self.flat[self.start[window] + k] == ids[at + k]
            at, window = at[equal], window[equal]
        return at, window

    def candidates(self, at: np.ndarray, window: np.ndarray, sizes: np.ndarray, coverage: float) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(item, places for greedy()) of the items whose windows in the document could cover enough."""
        seen = np.unique(window)
        order = np.argsort(window, kind="stable")
        ends = np.searchsorted(window[order], seen, "right")
        begins = np.searchsorted(window[order], seen, "left")
        count = self.cuts[seen + 1] - self.cuts[seen]
        listed = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.cuts[seen], count)
        items, spots, which = self.items[listed], self.spots[listed], np.repeat(np.arange(len(seen)), count)
        dealt = np.lexsort((spots, items))
        items, spots, which = items[dealt], spots[dealt], which[dealt]
        heads = np.flatnonzero(np.diff(items, prepend=-1))
        for a, b in zip(heads, np.append(heads[1:], len(items)), strict=True):
            item, own = int(items[a]), spots[a:b]
            covered = self.width + int(np.minimum(np.diff(own), self.width).sum())
            if covered >= coverage * sizes[item]:
                places = [np.zeros(0, np.int64)] * int(sizes[item] - self.width + 1)
                for spot, k in zip(own.tolist(), which[a:b].tolist(), strict=True):
                    places[spot] = at[order[begins[k] : ends[k]]]
                yield item, places


def _pass(docs: DataFrame, items: list[tuple[object, list[bytes]]], match: int, coverage: float, schema: str) -> DataFrame:
    """What documents leak of these items."""
    vocabulary: dict[bytes, int] = {}
    for _, words in items:
        for word in words:
            vocabulary.setdefault(word, len(vocabulary) + 1)
    numbered = [np.array([vocabulary[w] for w in words], np.uint64) for _, words in items]
    sizes = np.array([len(x) for x in numbered], np.int64)
    widths = sorted({min(match, int(n)) for n in sizes})
    seeds = [Seeds(numbered, [i for i, n in enumerate(sizes) if min(match, n) == width], width) for width in widths]
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, seeds, sizes, [item for item, _ in items]))
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seeds, sizes, names = sent.value
        number = vocabulary.get
        for batch in batches:
            rows = []
            for n, text in enumerate(batch.column(1)):
                words = tokens((text.as_py() or b"").decode("utf-8", "replace"))
                ids = np.fromiter(map(number, words, repeat(0)), np.uint64, len(words))
                for some in seeds:
                    at, window = some.met(ids)
                    if not len(at):
                        continue
                    for item, places in some.candidates(at, window, sizes, coverage):
                        found = greedy(places, some.width)
                        part = sum(length for *_, length in found) / int(sizes[item])
                        if part >= coverage:
                            rows.append((n, names[item], part, len(found), [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in found]))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [f.type for f in out_schema]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))], schema=out_schema)

    return docs.mapInArrow(common.lean(run), schema)


def leaks(
    docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(id_col, item_id, coverage, n_tiles, tiles) of every document row and item that it leaks."""
    rows = common.texts(docs, id_col, text_col)
    kind, item_kind = common.id_ddl(docs, id_col), common.id_ddl(benchmark, "item_id")
    texts = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    named = texts.where("item_id IS NOT NULL")
    texts = named.union(texts.where("item_id IS NULL").join(named.select(F.col("text").alias("__text")), F.col("text") == F.col("__text"), "left_anti"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_tokens)))
    schema = f"`{id_col}` {kind}, item_id {item_kind}, coverage double, n_tiles long, tiles array<struct<doc_start:long,item_start:long,length:long>>"
    results = None
    for block in range(blocks):
        some = [(r.item_id, tokens(r.text)) for r in texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        some = [(item, words) for item, words in some if words]
        if some:
            found = _pass(rows, some, match, coverage, schema)
            results = found if results is None else results.union(found)
    return docs.sparkSession.createDataFrame([], schema) if results is None else results


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that leak an item; columns unchanged. Rows are judged one by one,
    those without an id too."""
    keyed = docs.select(common.row_key().alias("key"), "text")
    return common.without(docs, common.materialize(leaks(keyed, benchmark, id_col="key").select("key").distinct(), "leaks"))
