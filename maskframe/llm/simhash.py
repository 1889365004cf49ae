"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour at distance one or less from
each. So every distinct fingerprint emits the 65 values of its ball of radius one; those that collide
on a value are within two bits of each other. A value can be in the ball of 65 fingerprints at most,
whatever the corpus, and copies of a text are one fingerprint before anything is emitted: no group
grows. Within a value each fingerprint is linked to the smallest one, verified by counting bits, which
keeps the components as they are without all pairs. ``links`` gives all pairs of different
fingerprints instead.

Components come from alternating star contraction on checkpointed edge tables; the driver sees two
numbers a round.

Two bits of 64 are the reach of op9's contract. A ball of radius two would reach four bits at 2,081 values a
fingerprint, more bytes than the texts, and a pair of similarity 0.8 differs in about ten; so the stage for
similar texts (module minhash) has several fingerprints a set and flips only the bits nearest to a tie.

Defined results: a null or empty text (no words) has fingerprint zero; repeated rows get equal results;
a null id is kept and never a component's name unless all ids of it are null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, Window

from maskframe.llm import common

WORDS, RADIUS, SEED = 3, 2, 42


def shingle_hashes(text: bytes | None, words: int = WORDS) -> list[int]:
    """A hash of each shingle, in order; a text of fewer words is one shingle."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return []
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """64 bits; bit k is set if it is in over half of the shingles' hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print long) of each document's whole text: A-Z lower-cased, words of non-blank bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(shingle_hashes(text.as_py(), words)) for text in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "print"])

    rows = common.texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {common.id_ddl(docs, id_col)}, print long")


def _ball(value: Column) -> Column:
    """The value and those that differ from it in one bit."""
    flips = F.array(*(F.lit(x) for x in [0, *(1 << k for k in range(63)), -(1 << 63)]))
    return F.transform(flips, lambda flip: value.bitwiseXOR(flip))


def star_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep the components; b < a."""
    balls = prints.select("print", F.explode(_ball(F.col("print"))).alias("value"))
    least = F.min("print").over(Window.partitionBy("value"))
    pairs = balls.select(F.col("print").alias("a"), least.alias("b")).where("a != b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def links(prints: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct fingerprints within the radius, b < a. A value's group has 65
    members at most, so the pairs of one fingerprint are bounded by the ball of radius two."""
    balls = prints.select("print", F.explode(_ball(F.col("print"))).alias("value"))
    met = balls.groupBy("value").agg(F.collect_set("print").alias("met")).where("size(met) > 1")
    pairs = met.select(F.explode("met").alias("a"), "met").select("a", F.explode("met").alias("b")).where("b < a")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def components(edges: DataFrame, pack: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn; minima are aggregated before the shuffle, and a hub's
    edges meet its minimum in a join that adaptive execution can split. ``pack`` is applied to the edges before they
    are written, once a round.
    """
    edges = common.materialize(pack(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    last = None
    while True:  # every round brings nodes nearer to their smallest one until nothing moves
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = common.materialize(pack(small.select("e.a", "e.b").where("a != b").distinct()), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        last = state


def cluster(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, print, component): each document's fingerprint and the smallest id it reaches."""
    found = common.materialize(fingerprints(docs, words, id_col, text_col), "prints")
    return named(found, "print", components(star_links(found.select("print").distinct())), id_col)


def named(found: DataFrame, key: str, roots: DataFrame, id_col: str = "doc_id", pack: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(id_col, key, component) of ``found`` (id, key), from the ``roots`` of keys that have links; ``pack`` as in components()."""
    keys = found.groupBy(key).agg(F.min("id").alias("least"))
    rooted = keys.join(roots, keys[key] == roots["node"], "left").select(key, "least", F.coalesce("root", key).alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    rooted = common.materialize(pack(rooted.join(names, "root").select(F.col(key).alias("of"), "component")), "components")
    return pack(found.join(rooted, found[key] == rooted["of"]).select(F.col("id").alias(id_col), key, "component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    return cluster(docs).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, find: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One row of ``docs`` of each component (of ``find``, else of cluster()): the one with the smallest id,
    and of rows with that id the one with the least row_key(). Columns are unchanged; rows without an id come
    last; of rows equal in id and text one stays."""
    keyed = docs.select(common.row_key().alias("key"), "text")
    found = common.materialize((find or _near)(keyed, "key").select("key", "component"), "clusters")
    left = common.without(docs, found.where(~F.col("key").eqNullSafe(F.col("component"))))
    repeats = found.groupBy("key").count().where("count > 1").select("key")
    if repeats.isEmpty():
        return left
    marked = left.withColumn("__key", common.row_key())
    again = marked.join(repeats, F.col("__key").eqNullSafe(F.col("key")), "left_semi").dropDuplicates(["__key"]).drop("__key")
    return common.without(left, repeats).unionByName(again)


def _near(docs: DataFrame, id_col: str) -> DataFrame:
    return cluster(docs, id_col=id_col)
