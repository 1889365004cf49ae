"""Texts with a Jaccard similarity of 0.8 or more of their five-word shingles, found by SimHash and ball hashing
and verified on whole sets. (The module's name is that of an earlier method.)

Texts with equal shingle sets are one set before anything is emitted.

1. A pair of similarity 0.8 differs in about ten bits of one fingerprint of 64, out of reach of any ball that can be
   written down. So each set has ``TABLES`` fingerprints of ``BITS`` bits, and its ball in each of them is not that of
   all bits but of the ``UNSURE`` bits whose counts are nearest to one half, as it is those that differ between similar
   sets: 128 values instead of 821 within two bits of 40, and more of the pairs. Sets with a common value in a table meet.
   A table brings a pair of similarity 0.8 together with probability 0.23, all tables miss it with about 0.00005
   (simulated for sets of 60 to 300 shingles), less above 0.8; ``FEW_UNSURE`` bits are tried for sets below ``FEW``.
2. Ball hashing is the only source of candidates. Each set is first compared, in each bucket of ``STARS`` tables in which
   it meets others, with the one of its largest company that has the most: in a group of near copies the one most are
   similar to.
3. The balls of all tables are dealt out with the components found so far, which names the sets that meet one of another
   component; only these go on. Their balls are dealt out twice more: once to compare each with the one that has the most
   company, and then for all pairs that still meet across components, so that no candidate link that matters is missed.
   Exact bounds are tried where the sets meet, and only pairs that pass them become rows, however large the group: shingles that
   no other set has are in a pair's union and not in its intersection, and of shingles dealt out to ``PARITY`` classes
   each class of which one set has an odd and the other an even number holds one at least that only one of them has.

Candidates are verified on their whole sets, so no pair below the threshold is ever linked.

A ball's values are never shuffled: a set goes, in 18 bytes, to the few buckets of a table that the first bits of its
values name, and the rest of its values are made there. Buckets grow in number with the sets.

Defined results: null texts and those without words have the empty set and are equal to each other; texts
of fewer than ``WORDS`` words are one shingle; sets are compared by 64-bit hashes; a null id is kept and never
a component's name unless all ids of it are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData

from maskframe.llm import common, simhash

#: Similar are sets whose intersection is ``SIMILAR[0] / SIMILAR[1]`` of their union.
WORDS, SIMILAR = 5, (4, 5)
TABLES, BITS, UNSURE = 38, 40, 7
#: Tables whose balls make the first links.
STARS = 8
#: Margins are coarse in sets of few shingles, so more bits count as unsure there.
FEW, FEW_UNSURE = 64, 9
#: Classes of the bound on what two sets do not share, a bit each; a multiple of 64.
PARITY = 1024
#: A bucket of a table gets about so many sets, as a power of two.
BUCKET = 13
#: Values of a bucket that are made at once where its balls are dealt out whole.
VALUES = 1 << 17
_LANES = -(-TABLES * BITS // 64)
_FLIP = np.random.default_rng(60).integers(0, 1 << 63, _LANES, dtype=np.uint64) << np.uint64(1)
_ODD = np.random.default_rng(61).integers(1 << 62, 1 << 63, _LANES, dtype=np.uint64) | np.uint64(1)
_LEAN = np.random.default_rng(62).integers(0, 2, TABLES * BITS) * 2 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = BITS // 8
_ROW, _SOME = 24, 100


def shingles(hashes: list[int]) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    return np.unique(np.array(hashes, np.uint64))


def whole(found: np.ndarray) -> int:
    """The identity of a set."""
    return xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)


def margins(found: np.ndarray) -> np.ndarray:
    """By bit of all tables: by how much the set's shingles that have it outnumber the others; never zero."""
    counts = np.zeros(_LANES * 64, np.int64)
    for at in range(0, len(found), 255):
        x = found[at : at + 255, None] ^ _FLIP
        x *= _ODD
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * (2 * counts[: TABLES * BITS] - len(found)) + _LEAN


def balls(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, tables) of fingerprints and of their unsure bits."""
    margin = np.array(list(map(margins, found)), np.int64).reshape(-1, TABLES, BITS)
    bit = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    prints = np.where(margin > 0, bit, np.uint64(0)).sum(axis=2, dtype=np.uint64)
    order = np.argsort(np.abs(margin) * BITS + np.arange(BITS), axis=2)[..., :FEW_UNSURE]
    unsure = np.array([UNSURE if len(x) >= FEW else FEW_UNSURE for x in found])[:, None, None]
    return prints, np.where(np.arange(FEW_UNSURE) < unsure, bit[order], np.uint64(0)).sum(axis=2, dtype=np.uint64)


def flipped(values: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): each row's value under every choice of its free bits."""
    rows = np.arange(len(values))
    while (some := np.flatnonzero(free)).size:
        low = free & (~free + np.uint64(1))
        values, rows = np.concatenate([values, values[some] ^ low[some]]), np.concatenate([rows, rows[some]])
        free = free ^ low
        free = np.concatenate([free, free[some]])
    return rows, values


def parity(found: np.ndarray) -> np.ndarray:
    """Whether each class of hashes has an odd number of the set's."""
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))


def _mapped(docs: DataFrame, id_col: str, text_col: str, kept: str) -> DataFrame:
    """(id, whole, n, balls and parity or shingles) of each row, as ``kept`` says."""
    short = kept == "balls"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(simhash.shingle_hashes(text.as_py(), WORDS)) for text in batch.column(1)]
            numbers = [np.fromiter(map(whole, found), np.uint64, len(found)).view(np.int64), np.fromiter(map(len, found), np.int64, len(found))]
            lists = [_packed(found), _lists(list(map(parity, found)))] if short else [_lists(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers), *lists], names)

    names = ["id", "whole", "n", *(["balls", "parity"] if short else [kept])]
    ddl = "balls binary, parity array<long>" if short else f"{kept} array<long>"
    return common.texts(docs, id_col, text_col).mapInArrow(common.lean(run), f"id {common.id_ddl(docs, id_col)}, whole long, n long, {ddl}")


def _bytes(x: np.ndarray, width: int) -> np.ndarray:
    """(len(x), width): the low bytes of 64-bit numbers."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _numbers(x: np.ndarray) -> np.ndarray:
    """The reverse of _bytes()."""
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel()


def _binaries(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binaries of the rows of bytes from each start to the next."""
    ends = np.append(starts, len(rows)) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _packed(found: list[np.ndarray]) -> pa.Array:
    """A binary a set: by table, the fingerprint and its unsure bits."""
    some = [balls(found[at : at + _SOME]) for at in range(0, len(found), _SOME)]
    rows = [np.concatenate([_bytes(x.ravel(), _BYTES) for x in ball], axis=1) for ball in some]
    return _binaries(np.concatenate([np.zeros((0, 2 * _BYTES), np.uint8), *rows]), np.arange(len(found)) * TABLES)


def _wide(column: pa.Array) -> np.ndarray:
    """A row of bytes for each long or list of longs of one length."""
    if pa.types.is_list(column.type):
        return np.array(column.flatten().to_numpy()).reshape(len(column), -1).view(np.uint8)
    return _bytes(np.array(column.to_numpy()), 8)


def _dealt(sketches: DataFrame, bits: int, tables: int, others: tuple[str, ...]) -> DataFrame:
    """(bucket, part): the sets of each bucket of each table that a batch has, with other columns of theirs and what is
    left of their balls."""
    shift = np.uint64(BITS - bits)
    below = (np.uint64(1) << shift) - np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ball = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, TABLES, 2 * _BYTES)
            ball = ball[:, :tables].reshape(-1, 2 * _BYTES)
            prints, free = _numbers(ball[:, :_BYTES]), _numbers(ball[:, _BYTES:])
            rows, bucket = flipped(prints >> shift, free >> shift)
            bucket = (rows % tables).astype(np.uint64) << np.uint64(bits) | bucket
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            sets = np.concatenate([_wide(column) for column in batch.columns[1:]], axis=1)[rows // tables]
            parts = np.concatenate([sets, _bytes(prints[rows] & below, _BYTES), _bytes(free[rows] & below, _BYTES)], axis=1)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].view(np.int64)), _binaries(parts, starts)], ["bucket", "part"])

    return sketches.where(F.col("n") >= SIMILAR[0]).select("balls", "whole", *others).mapInArrow(common.lean(run), "bucket long, part binary")


def _buckets(sketches: DataFrame, tables: int, *others: str) -> GroupedData:
    """The sets of a number of tables by bucket; see _read()."""
    bits = max(2, (sketches.count() >> BUCKET).bit_length())
    return _dealt(sketches, bits, tables, others).groupBy("bucket")


def _read(group: pa.Table, longs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longs of each set, low, free) of a bucket."""
    part = np.frombuffer(b"".join(group["part"].to_pylist()), np.uint8).reshape(-1, 8 * longs + 2 * _BYTES)
    numbers = np.ascontiguousarray(part[:, : 8 * longs]).view("<i8")
    return numbers, _numbers(part[:, 8 * longs : -_BYTES]), _numbers(part[:, -_BYTES:])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return starts, np.diff(np.append(starts, len(values)))


def divided(low: np.ndarray, free: np.ndarray, most: int = VALUES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, low, free) of the balls cut by the first bits of their values, so far that no part has more values than ``most``
    or a ball is one value: what a bucket takes in memory does not grow with it. Balls with a common value meet in one part."""
    parts = [(np.arange(len(low)), low, free, BITS)]
    while parts:
        rows, low, free, bits = parts.pop()
        if not bits or np.exp2(np.bitwise_count(free), dtype=np.float64).sum() <= most:
            yield rows, low, free
            continue
        one = np.uint64(1 << (bits - 1))
        for side in (np.uint64(0), one):
            some = np.flatnonzero((free & one != 0) | (low & one == side))
            if len(some):
                parts.append((rows[some], low[some] & ~one | side, free[some] & ~one, bits - 1))


def company(low: np.ndarray, free: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value) of the values that several balls of a bucket have, with different roots if given, by value, and
    which of them is in its row's largest value. Of values that the same balls have one stays, and none whose balls
    all have one and the same larger value as their largest."""
    rows, met = flipped(low, free)
    met <<= np.uint64(_ROW)
    met |= rows.view(np.uint64)
    del rows
    met.sort()
    same = met[1:] >> np.uint64(_ROW) == met[:-1] >> np.uint64(_ROW)
    met = met[np.append(same, False) | np.append(False, same)]
    rows, values = (met & np.uint64((1 << _ROW) - 1)).astype(np.int64), met >> np.uint64(_ROW)
    if len(rows) and root is not None:
        starts, sizes = _runs(values)
        split = np.repeat(np.minimum.reduceat(root[rows], starts) != np.maximum.reduceat(root[rows], starts), sizes)
        rows, values = rows[split], values[split]
    if not len(rows):
        return rows, values, np.zeros(0, bool)
    starts, sizes = _runs(values)
    mark = (rows.astype(np.uint64) + np.uint64(1)) * _MIX
    mark = (mark ^ mark >> np.uint64(29)) * _ODD[0]
    kept = np.zeros(len(starts), bool)
    kept[np.unique(np.add.reduceat(mark ^ mark >> np.uint64(32), starts), return_index=True)[1]] = True
    rank = np.empty(len(starts), np.int64)
    rank[np.lexsort((sizes, kept))] = np.arange(len(starts))
    top = np.zeros(rows.max() + 1, np.int64)
    np.maximum.at(top, rows, np.repeat(rank, sizes))
    least, most = np.minimum.reduceat(top[rows], starts), np.maximum.reduceat(top[rows], starts)
    kept &= (least != most) | (rank == most)
    kept, largest = np.repeat(kept, sizes), top[rows] == np.repeat(rank, sizes)
    return rows[kept], values[kept], largest[kept]


def merged(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) by value, with values that balls in common connect made one where that gives at most twice as
    many pairs: a group of near copies has far fewer rows so, and no pair is lost."""
    if not len(rows):
        return rows, values
    (starts, sizes), label = _runs(values), np.arange(rows.max() + 1)
    while True:  # labels fall to the smallest one they are connected to
        least = label.copy()
        np.minimum.at(least, rows, np.repeat(np.minimum.reduceat(label[rows], starts), sizes))
        least = least[least]
        if (least == label).all():
            break
        label = least
    group = label[rows[starts]]
    balls_in = np.bincount(label[np.unique(rows)], minlength=len(label)).astype(float)
    pairs = np.bincount(group, weights=sizes.astype(float) ** 2, minlength=len(label))
    first = np.full(len(label), len(starts))
    np.minimum.at(first, group, np.arange(len(starts)))
    named = np.where((balls_in**2 <= 2 * pairs)[group], first[group], np.arange(len(starts)))
    values = np.repeat(values[starts][named], sizes)
    order = np.lexsort((rows, values))
    rows, values = rows[order], values[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]))
    return rows[new], values[new]


def _stars(rows: np.ndarray, values: np.ndarray, largest: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """(pairs, 2): each set, and that of its largest value which has the most company."""
    often = np.bincount(rows, minlength=len(sets))
    order = np.lexsort((sets[rows], often[rows], values))
    rows, values, largest = rows[order], values[order], largest[order]
    starts, sizes = _runs(values)
    hub = np.repeat(rows[starts + sizes - 1], sizes)
    some = largest & (rows != hub)
    return np.stack([sets[rows[some]], sets[hub[some]]], 1)


def crossing(rows: np.ndarray, values: np.ndarray, known: np.ndarray, hubs: bool) -> np.ndarray:
    """(pairs, 2): rows with a common value and different roots that no bound rules out, by what is ``known`` of each:
    root, size, shingles no other set has, parities. With ``hubs`` only pairs with the row of a value that has the most company."""
    (part, of), (root, n, own), odd = SIMILAR, known[:, :3].T, known[:, 3:].astype(np.uint64)
    order = np.lexsort((n[rows], values))
    rows, often = rows[order], np.bincount(rows, minlength=len(known))
    pairs = [np.zeros((0, 2), np.int64)]
    for at, size in zip(*map(np.ndarray.tolist, _runs(values[order])), strict=True):
        some = rows[at : at + size]
        if hubs:
            left = some[often[some].argmax()][None]
        else:  # every pair of different roots has one outside of the largest component
            names, of_name, counts = np.unique(root[some], return_inverse=True, return_counts=True)
            left = some[of_name != counts.argmax()]
        sizes = n[some]
        for x in left.tolist():
            both = n[x] - own[x]
            y = some[np.searchsorted(sizes, -(-n[x] * part // of)) : np.searchsorted(sizes, both * of // part - own[x], "right")]
            shared = np.minimum(both, n[y] - own[y]) * of >= np.maximum(n[x] + own[y], n[y] + own[x]) * part
            y = y[shared & (root[y] != root[x])]
            apart = np.bitwise_count(odd[y] ^ odd[x]).sum(axis=1, dtype=np.int64)
            y = y[apart * (of + part) <= (n[x] + n[y]) * (of - part)]
            pairs.append(np.stack([np.full(len(y), x), y], 1))
    return np.concatenate(pairs)


def _ball_pairs(sketches: DataFrame, hubs: bool | None = None) -> DataFrame:
    """(a, b) of sets that meet, found by their balls: each set and the one that has the most company where it has the most
    itself; with ``hubs`` given, of sets with a root, pairs of different roots that may be similar: see crossing()."""
    known = ("root", "n", "own", "parity")

    def stars(key: tuple, group: pa.Table) -> pa.Table:
        numbers, low, free = _read(group, 1)
        return _ordered(_stars(*company(low, free), numbers[:, 0]))

    def across(key: tuple, group: pa.Table) -> pa.Table:
        numbers, low, free = _read(group, 4 + PARITY // 64)
        pairs = []
        for some, low, free in divided(low, free):
            rows, values, _ = company(low, free, numbers[some, 1])
            pairs.append(_ordered(numbers[some, 0][crossing(*merged(rows, values), numbers[some, 1:], hubs)]))
        return pa.concat_tables(pairs)

    if hubs is None:
        return _buckets(sketches, STARS).applyInArrow(stars, "a long, b long").distinct()
    return _buckets(sketches, TABLES, *known).applyInArrow(across, "a long, b long").distinct()


def _ordered(pairs: np.ndarray) -> pa.Table:
    """(a, b) of pairs, each once."""
    pairs = np.unique(np.sort(pairs.reshape(-1, 2), axis=1), axis=0)
    return pa.table({"a": pairs[:, 1], "b": pairs[:, 0]})


def _met(sketches: DataFrame) -> DataFrame:
    """(whole) of the sets that meet one of another root."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        numbers, low, free = _read(group, 2)
        met = np.zeros(len(numbers), bool)
        for some, low, free in divided(low, free):
            met[some[company(low, free, numbers[some, 1])[0]]] = True
        return pa.table({"whole": numbers[met, 0]})

    return _buckets(sketches, TABLES, "root").applyInArrow(run, "whole long").distinct()


def _rooted(sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """The sketches with their roots."""
    return sketches.join(roots, sketches["whole"] == roots["node"], "left").withColumn("root", F.coalesce("root", "whole")).drop("node")


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that sizes and parities do not rule out."""
    part, of = SIMILAR
    left, right = (sketches.select(F.col("whole").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}")) for side in ("a", "b"))
    near = _close("n_a", "n_b") & (_apart("parity_a", "parity_b") * (of + part) <= (F.col("n_a") + F.col("n_b")) * (of - part))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("whole").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("whole").alias("b"), F.col("shingles").alias("y"))
    part, of = SIMILAR
    near = f"least(size(x), size(y)) * {of} >= greatest(size(x), size(y)) * {part}"
    both = pairs.join(left, "a").join(right, "b").where(near)
    alike = f"size(array_intersect(x, y)) * {part + of} >= (size(x) + size(y)) * {part}"
    return both.where(alike).select("a", "b")


def _close(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar."""
    part, of = SIMILAR
    return F.least(a, b) * of >= F.greatest(a, b) * part


def _apart(a: str, b: str) -> Column:
    """At least so many shingles are in one of the sets only, by their parities."""
    return reduce(add, (F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(PARITY // 64)))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, whole, component): each document's set and the smallest id that links reach from it."""
    found = common.materialize(_mapped(docs, id_col, text_col, "balls"), "found")
    pack = partial(common.packed, rows=found.count())
    sketches = common.materialize(pack(found.select("whole", "n", "balls", "parity").dropDuplicates(["whole"])), "sketches")

    def whole_sets(wanted: DataFrame) -> DataFrame:
        one = found.join(wanted, "whole").groupBy("whole").agg(F.min("id").alias("one")).select("one").distinct()
        some = docs.join(one, F.col(id_col).eqNullSafe(F.col("one")), "left_semi")
        sets = _mapped(some, id_col, text_col, "shingles").join(wanted, "whole", "left_semi").select("whole", "shingles")
        return common.materialize(pack(sets.dropDuplicates(["whole"])), "sets")

    tried = common.materialize(pack(_possible(_ball_pairs(sketches), sketches)), "pairs")
    sets = whole_sets(tried.select(F.explode(F.array("a", "b")).alias("whole")).distinct())
    roots = simhash.components(_verified(tried, sets), pack)
    met = common.materialize(pack(_met(_rooted(sketches, roots))), "met")
    sets = sets.union(whole_sets(met.join(sets, "whole", "left_anti")))
    left = common.materialize(pack(_bounded(sketches.join(met, "whole"), sets.join(met, "whole", "left_semi"))), "left")
    for hubs in (True, False):
        pairs = _ball_pairs(_rooted(left, roots), hubs).join(tried, ["a", "b"], "left_anti")
        pairs = common.materialize(pack(pairs), "pairs")
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots, tried = simhash.components(_verified(pairs, sets).union(known), pack), tried.union(pairs)
    return simhash.named(found, "whole", roots, id_col, pack)


def _bounded(sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The sketches with how many shingles none of the other sets has (``own``), but for those that can be similar to
    none of them for it."""
    part, of = SIMILAR
    held = sets.select("whole", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("sets"), F.min("whole").alias("whole"))
    alone = held.where("sets = 1").groupBy("whole").agg(F.count("*").alias("own"))
    return sketches.join(alone, "whole", "left").withColumn("own", F.coalesce("own", F.lit(0))).where((F.col("n") - F.col("own")) * of >= F.col("n") * part)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component: see simhash.first_of_each()."""
    return simhash.first_of_each(docs, cluster)
