"""Ranked lexical search of items against all documents, on a tiered index.

Documents are cut into blocks that a task can hold; each block has an index of its own, so no posting is ever shuffled. A
posting's impact, the term's weight times its share of the document, is what it adds to a score. A block's postings lie
in tiers: the first has the highest impacts, the last the rest, each a column of the written index of its own. Each term has, for each
tier, a residual bound: the highest impact that it has in the tiers below.

Search, for a block of items:

1. From the first tier alone (no other column is read) each block yields its best lower bounds, and over all blocks
   the k-th of these is a floor that the k-th score cannot lie beneath.
2. Each block takes its tiers one by one. After a tier a document's score lies between what it has so far and that plus the residual
   bounds of the item's terms it has not been seen with. Documents whose upper bound is beneath the floor are out. An item
   whose documents are all out or all exact is proved and looks no further; any other falls through to the next tier, where the
   floor rises with the block's own k-th lower bound. After the last tier all is exact.

A block returns at most k rows an item; these are merged by rank. Statistics are over all documents; term counts are summed
in each block before they are shuffled.

Items are taken in blocks of at most ITEM_BYTES of text, chosen by hash, and postings are kept for the terms of the block's items
only. What is sent to tasks is bounded by that, and so are the term counts that come back.

Defined results: a null or empty text has no term, as document it does not count and as item it has no rows; rows of one
item_id with different texts are items by themselves, equal ones one item; repeated documents are ranked one by
one; equal scores go by doc_id, a null doc_id last. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql.pandas.types import to_arrow_type

from maskframe.llm import blocks, common

TOP, ITEM_BYTES = 10, 8 << 20
#: The share of a block's postings in the first tiers; the last has the rest.
TIERS = (0.05, 0.25)
_TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def terms(text: bytes | str | None) -> list[bytes]:
    """The terms of a text, in order; only A-Z are lower-cased."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return _TERMS(raw.lower())


def weight(n: int, df: int) -> int:
    """What a term in ``df`` of ``n`` documents counts."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


_RAW = "block long, ids array<{kind}>, n binary, term binary, doc binary, tf binary, dfs array<struct<term:int,df:long>>, docs long, total long"


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row a block: ids and lengths of its documents, and the postings of the terms in ``vocabulary``, sorted by
    term; ``dfs``, ``docs`` and ``total`` are the block's part of the statistics."""
    known = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})
    kind, id_type = common.id_ddl(docs, id_col), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = known.value, blocks.block_base()
        for ids, texts in blocks.grouped(batches, block_bytes):
            n, term, doc, tf = [], [], [], []
            for at, text in enumerate(texts):
                words = terms(text)
                n.append(len(words))
                hits = [(number[word], count) for word, count in Counter(words).items() if word in number]
                term += [i for i, _ in hits]
                tf += [count for _, count in hits]
                doc += [at] * len(hits)
            order = np.argsort(np.array(term, np.int64), kind="stable")
            kept = [np.array(values, np.int32)[order] for values in (term, doc, tf)]
            values, counts = np.unique(kept[0], return_counts=True)
            columns = [
                pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), *(pa.array([blocks.pack(v)], pa.binary()) for v in (np.array(n, np.int64), *kept)),
                pa.array([[{"term": t, "df": c} for t, c in zip(values.tolist(), counts.tolist(), strict=True)]], pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))),
                pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "n", "term", "doc", "tf", "dfs", "docs", "total"])
            block += 1

    return common.materialize(common.texts(docs, id_col, text_col).mapInArrow(run, _RAW.format(kind=kind)), "postings")


def _tier_columns(tiers: int) -> list[str]:
    return [f"tier_{t}" for t in range(tiers)]


def index(raw: DataFrame, n_docs: int, total: int, weights: np.ndarray, shares: tuple[float, ...] = TIERS) -> DataFrame:
    """(block, ids, tier_0, tier_1, ...) of each block, written to the shared folder. A tier is (terms, documents,
    impacts, the distinct terms of the block, their residual bounds below the tier)."""
    sent = raw.sparkSession.sparkContext.broadcast(weights)
    kind, id_type = raw.schema["ids"].dataType.elementType.simpleString(), to_arrow_type(raw.schema["ids"].dataType)
    tiers = len(shares) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                n, (term, doc, tf) = blocks.unpack(batch.column(2)[at].as_py(), np.int64), (blocks.unpack(batch.column(k)[at].as_py(), np.int32).astype(np.int64) for k in (3, 4, 5))
                values, back = np.unique(n, return_inverse=True)
                m = np.array([10 + 90 * v * n_docs // total for v in values.tolist()], np.int64)[back]
                impact = w[term] * (1000000000 * tf // (1000 * tf + 8 * m[doc]))
                ranked = np.sort(impact)[::-1]
                edges = [int(ranked[min(len(ranked) - 1, int(share * len(ranked)))]) if len(ranked) else 0 for share in shares]
                tier = sum((impact < edge).astype(np.int64) for edge in edges) if edges else np.zeros(len(impact), np.int64)
                distinct, start = np.unique(term, return_index=True)
                cells = []
                for t in range(tiers):
                    here = tier == t
                    below = np.where(tier > t, impact, 0)
                    bound = np.maximum.reduceat(below, start) if len(start) else np.zeros(0, np.int64)
                    cells.append({"term": blocks.pack(term[here].astype(np.int32)), "doc": blocks.pack(doc[here].astype(np.int32)), "impact": blocks.pack(impact[here]), "terms": blocks.pack(distinct.astype(np.int32)), "bound": blocks.pack(bound)})
                cell = pa.struct([(name, pa.binary()) for name in ("term", "doc", "impact", "terms", "bound")])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), *(pa.array([c], cell) for c in cells)], ["block", "ids", *_tier_columns(tiers)])

    cell = "struct<term:binary,doc:binary,impact:binary,terms:binary,bound:binary>"
    schema = f"block long, ids array<{kind}>, " + ", ".join(f"{name} {cell}" for name in _tier_columns(tiers))
    return common.materialize(raw.select("block", "ids", "n", "term", "doc", "tf").mapInArrow(run, schema), "tiers")


class _Tier:
    """One tier of one block."""

    def __init__(self, cell: dict):
        self.doc, self.impact = blocks.unpack(cell["doc"], np.int32), blocks.unpack(cell["impact"], np.int64)
        self.terms, self.bound = blocks.unpack(cell["terms"], np.int32), blocks.unpack(cell["bound"], np.int64)
        term = blocks.unpack(cell["term"], np.int32)
        self.begin, self.end = np.searchsorted(term, self.terms), np.searchsorted(term, self.terms, "right")

    def add(self, item: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the item's postings of this tier to ``lower``; the documents seen and the term each was seen with."""
        at = np.searchsorted(self.terms, item)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == item)] if len(self.terms) else at[:0]
        size = self.end[at] - self.begin[at]
        take = np.arange(size.sum()) + np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
        docs = self.doc[take]
        np.add.at(lower, docs, self.impact[take])
        return docs, np.repeat(at, size)

    def residual(self, item: np.ndarray) -> int:
        """What the item's terms can add below this tier, to a document seen with none of them."""
        at = np.searchsorted(self.terms, item)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == item) if len(self.terms) else np.zeros(len(at), bool)
        return int(self.bound[at[here]].sum())


def _best(scores: np.ndarray, k: int) -> int:
    """The k-th highest of scores, zero if there are fewer above zero."""
    some = scores[scores > 0]
    return int(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else 0


def floors(tiers: DataFrame, items: list[np.ndarray], k: int) -> dict[int, int]:
    """The k-th best lower bound of each item, from the first tier alone."""
    sent = tiers.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tier, found = _Tier(cell), []
                for number, item in enumerate(sent.value):
                    lower = np.zeros(size, np.int64)
                    tier.add(item, lower)
                    best = lower[lower > 0]
                    best = np.partition(best, len(best) - k)[len(best) - k :] if len(best) > k else best
                    found.append((np.full(len(best), number), best))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[n] for f in found]), pa.int64()) for n in range(2)], ["item", "lower"])

    lower = tiers.select(F.size("ids").alias("size"), "tier_0").mapInArrow(run, "item long, lower long")
    order = Window.partitionBy("item").orderBy(F.desc("lower"))
    ranked = lower.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return {row.item: row.lower for row in ranked.where(F.col("place") == k).collect()}


def ranked_blocks(tiers: DataFrame, items: list[np.ndarray], floor: dict[int, int], k: int) -> DataFrame:
    """(item, doc, score, tiers_read): each block's documents that may be among the item's k best, with exact scores."""
    sent = tiers.sparkSession.sparkContext.broadcast((items, floor))
    names = [name for name in tiers.columns if name.startswith("tier_")]
    kind, id_type = tiers.schema["ids"].dataType.elementType.simpleString(), to_arrow_type(tiers.schema["ids"].dataType.elementType)

    def settle(item: np.ndarray, least: int, size: int, tier) -> tuple[np.ndarray, np.ndarray, int]:
        """Go down the tiers until the item is proved: the documents alive, their scores, the tiers read."""
        lower, seen = np.zeros(size, np.int64), []
        for depth in range(len(names)):
            here = tier(depth)
            seen.append(here.add(item, lower))
            upper = lower + here.residual(item)
            for docs, at in seen:
                np.subtract.at(upper, docs, here.bound[at])
            least = max(least, _best(lower, k))
            alive = np.flatnonzero(upper >= max(least, 1))
            if (upper[alive] == lower[alive]).all():
                break
        return alive, lower[alive], depth + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, least = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                loaded: dict[int, _Tier] = {}

                def tier(depth: int) -> _Tier:
                    if depth not in loaded:
                        loaded[depth] = _Tier(batch.column(names[depth])[at].as_py())
                    return loaded[depth]

                ids, size, found = batch.column("ids")[at].values, len(batch.column("ids")[at]), []
                for number, item in enumerate(wanted):
                    docs, scores, depth = settle(item, least.get(number, 0), size, tier)
                    if len(docs):
                        keep = np.arange(len(docs))
                        if len(docs) > k:
                            last = np.partition(scores, len(docs) - k)[len(docs) - k]
                            keep = np.flatnonzero(scores >= last)
                        if len(keep) > k:  # equal scores: the smallest ids
                            named = ids.take(pa.array(docs[keep])).to_pylist()
                            keep = keep[sorted(range(len(keep)), key=lambda x: (-scores[keep[x]], named[x] is None, named[x]))[:k]]
                        found.append((np.full(len(keep), number), docs[keep], scores[keep], np.full(len(keep), depth)))
                if found:
                    item, docs, scores, depth = (np.concatenate([f[n] for f in found]) for n in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids.take(pa.array(docs)), pa.array(scores, pa.int64()), pa.array(depth, pa.int32())], ["item", "doc", "score", "tiers_read"])

    return tiers.select("ids", *names).mapInArrow(run, f"item long, doc {kind}, score long, tiers_read int")


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    item_bytes: int = ITEM_BYTES, shares: tuple[float, ...] = TIERS, block_bytes: int = blocks.BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above zero."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("binary").alias("text")).where(F.octet_length("text") > 0).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // item_bytes) * 2 if size > item_bytes else 1)
    out = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = _search(docs, [(row.item_id, sorted(set(terms(bytes(row.text))))) for row in some.collect()], items, k, id_col, text_col, item_col, shares, block_bytes)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, asked: list[tuple], items: DataFrame, k: int, id_col: str, text_col: str, item_col: str, shares: tuple[float, ...], block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [(key, words) for key, words in asked if words]
    kinds = f"item_id {common.id_ddl(items, item_col)}, rank int, doc_id {common.id_ddl(docs, id_col)}, score long"
    vocabulary = sorted({word for _, words in asked for word in words})
    if not vocabulary:
        return spark.createDataFrame([], kinds)
    raw = postings(docs, vocabulary, id_col, text_col, block_bytes)
    n_docs, total = raw.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], kinds)
    counted = raw.select(F.explode("dfs").alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for row in counted:
        weights[row.term] = weight(n_docs, row.df)
    number = {word: i for i, word in enumerate(vocabulary)}
    # A term that no document has, or whose weight is zero, adds nothing.
    wanted = [np.array([number[word] for word in words if weights[number[word]] > 0], np.int64) for _, words in asked]
    tiers = index(raw, n_docs, total, weights, shares)
    floor = floors(tiers, wanted, k)
    best = ranked_blocks(tiers, wanted, floor, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(asked)], f"item long, item_id {common.id_ddl(items, item_col)}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


#: The same by scoring every posting of the items' terms.
SQL = r"""
WITH words AS (
  SELECT d.rowid AS row, d.doc_id, unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d
), sizes AS (SELECT row, count(*) AS n FROM words GROUP BY row
), total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), found AS (SELECT row, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT nd FROM total) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM found GROUP BY term
), parts AS (
  SELECT f.row, f.doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl))) AS part
  FROM found f JOIN weights USING (term) JOIN sizes USING (row) CROSS JOIN total
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores QUALIFY rank <= 10
"""
