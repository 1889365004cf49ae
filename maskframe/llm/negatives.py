"""Hard negatives for contrastive training by branch and bound on ball trees.

Rows are dealt out by the hash of their id into trees of at most TREE_BYTES of components; each is built in one
task and written to the shared folder. A ball (centre c, radius r) bounds the inner product with an anchor q from both
sides: q.c - |q| r <= q.x <= q.c + |q| r. A search goes down a tree with a block of anchors at once. A node is left for
an anchor if its label does not fit, if its bounds lie outside the score window, or if its upper bound, cut at the
window's end, is strictly beneath the current kth score; equal scores are never pruned, as ties go by id.

Two passes over the written trees: the first finds the positives of each anchor, the second the negatives within the
windows that the positives' scores set. In a pass each tree's partition holds that tree first and then the blocks
of anchors, which stream past it: a task holds one tree and one block whatever the number of anchors. A tree
returns at most k rows an anchor, and these are merged by rank. Nothing is collected and nothing is broadcast. As every
anchor may meet every tree, the work grows with anchors times rows where bounds do not prune; a pass sends anchors times
trees vectors of one or two bytes a component.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; a shorter
vector is taken as filled up with zeros. Repeated rows count as often as they stand among positives and negatives, but an
anchor never is its own positive, neither is another row of its id; anchors equal in id, label and vector are one
anchor. An empty table gives an empty result; other columns are ignored. Inner products must stay below 2**53 in
magnitude (scaled components below about 4,000,000 at 512 dimensions); beyond that ``mine`` raises a ValueError before
any work.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from maskframe.llm import blocks, common

TREE_BYTES, LEAF, ANCHORS = 64 << 20, 128, 256
POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score is at least LOW and at most HIGH hundredths of its positive's.
LOW, HIGH = 30, 90
SEEDS, BUFFER = 1024, 1 << 20
_LIMIT = float(1 << 53)


class BallTree:
    """The rows of one tree in the order of its leaves, and its nodes as arrays. Each label of more than a
    leaf's rows has a root of its own; the rest share one."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, labels))
        self.nodes: list[tuple] = []  # begin, end, left, right, uniform
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.vectors, self.order, self.leaf = vectors, order, leaf
        values, begin, count = np.unique(labels[order], return_index=True, return_counts=True)
        own = count > leaf
        rest = [order[b : b + n] for b, n, big in zip(begin, count, own, strict=True) if not big]
        self.order = np.concatenate([order[b : b + n] for b, n, big in zip(begin, count, own, strict=True) if big] + rest or [order])
        self.roots, at = [], 0
        for n in count[own].tolist():
            self.roots.append(self._grow(at, at + n))
            at += n
        if at < len(order):
            self.roots.append(self._grow(at, len(order)))
        self.vectors, self.ids, self.labels = vectors[self.order], ids[self.order], labels[self.order]
        self.uniform = np.array([self.labels[b] == self.labels[e - 1] and (self.labels[b:e] == self.labels[b]).all() for b, e, _, _ in self.nodes], bool)

    def _grow(self, begin: int, end: int) -> int:
        """The node of rows begin to end: halves along the line between two far rows."""
        here = self.order[begin:end]
        rows = self.vectors[here]
        centre = rows.mean(axis=0)
        gap = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        node = len(self.nodes)
        self.nodes.append((begin, end, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(gap.max()))
        if end - begin > self.leaf:
            one = rows[gap.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            half = (end - begin) // 2
            self.order[begin:end] = here[np.argsort(rows @ (other - one), kind="stable")]
            self.nodes[node] = (begin, end, self._grow(begin, begin + half), self._grow(begin + half, end))
        return node

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, ids=self.ids, labels=self.labels, nodes=np.array(self.nodes, np.int64), centres=np.array(self.centres), radii=np.array(self.radii), roots=np.array(self.roots),
            uniform=self.uniform, vectors=np.frombuffer(blocks.pack(self.vectors.ravel()), np.uint8), width=self.vectors.shape[1],
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        found, tree = np.load(io.BytesIO(data)), cls.__new__(cls)
        tree.ids, tree.labels, tree.uniform, tree.radii, tree.centres = (found[k] for k in ("ids", "labels", "uniform", "radii", "centres"))
        tree.nodes, tree.roots = found["nodes"].tolist(), found["roots"].tolist()
        tree.vectors = blocks.unpack(found["vectors"].tobytes(), np.float64).reshape(len(tree.ids), int(found["width"]))
        return tree

    def search(self, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(query, id, score) of the k best rows of each query, best first, equal scores by id.

        Query j is the vector ``queries[row[j]]`` with scores from ``low[j]`` to ``high[j]``. With ``same`` rows must have the
        anchor's label and another id than ``own``, else another label."""
        width = max(queries.shape[1], self.vectors.shape[1])
        queries, vectors, centres = _widen(queries, width), _widen(self.vectors, width), _widen(self.centres, width)
        norms = np.sqrt((queries**2).sum(axis=1))
        best = np.full((len(row), k), -np.inf)

        def fits(which: np.ndarray, lo: int, hi: int) -> np.ndarray:
            match = labels[row[which]][:, None] == self.labels[lo:hi][None, :]
            return match & (own[row[which]][:, None] != self.ids[lo:hi][None, :]) if same else ~match

        # Scores of some rows give a first kth; they are met again in their leaves.
        some = np.unique(np.linspace(0, len(self.ids) - 1, min(SEEDS, len(self.ids))).astype(np.int64))
        scores = np.rint(queries @ vectors[some].T)
        match = labels[:, None] == self.labels[some][None, :]
        match = match & (own[:, None] != self.ids[some][None, :]) if same else ~match
        kth = np.full(len(row), -np.inf)
        if len(some) >= k:
            for at in range(0, len(row), 512):
                j = slice(at, at + 512)
                inside = scores[row[j]]
                inside = np.where(match[row[j]] & (inside >= low[j, None]) & (inside <= high[j, None]), inside, -np.inf)
                kth[j] = np.partition(inside, len(some) - k, axis=1)[:, len(some) - k]

        found: list[tuple] = []
        held = 0
        stack = [(node, np.arange(len(row))) for node in self.roots]
        while stack:
            node, active = stack.pop()
            begin, end, left, right = self.nodes[node]
            if self.uniform[node]:
                equal = labels[row[active]] == self.labels[begin]
                active = active[equal if same else ~equal]
            at = row[active]
            near, spread = queries[at] @ centres[node], norms[at] * self.radii[node]
            slack = 1e-9 * (np.abs(near) + spread + norms[at]) + 1e-6
            upper, lower = near + spread + slack, near - spread - slack
            active = active[(lower <= high[active]) & (upper >= low[active]) & (np.minimum(upper, high[active]) >= kth[active])]
            if not len(active):
                continue
            if left >= 0:
                ahead = queries[row[active]].mean(axis=0) @ (centres[left] - centres[right]) > 0
                stack += [(right, active), (left, active)] if ahead else [(left, active), (right, active)]
                continue
            anchors, back = np.unique(row[active], return_inverse=True)
            scores = np.rint(queries[anchors] @ vectors[begin:end].T)[back]
            inside = fits(active, begin, end) & (scores >= low[active, None]) & (scores <= high[active, None]) & (scores >= kth[active, None])
            j, x = np.nonzero(inside)
            if not len(j):
                continue
            found.append((active[j], self.ids[begin + x], scores[j, x]))
            held += len(j)
            hit = np.flatnonzero(inside.any(axis=1))
            merged = np.concatenate((best[active[hit]], np.where(inside[hit], scores[hit], -np.inf)), axis=1)
            best[active[hit]] = np.partition(merged, merged.shape[1] - k, axis=1)[:, merged.shape[1] - k :]
            kth[active[hit]] = np.maximum(kth[active[hit]], best[active[hit]].min(axis=1))
            if held > BUFFER:
                found = [_top(found, k)]
                held = len(found[0][0])
        return _top(found, k)


def _widen(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] == width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def _top(found: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The k best (query, id, score) of each query."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, ids, scores = (np.concatenate([some[n] for some in found]) for n in range(3))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(query)) + 1))
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as a matrix, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=1)) or 1
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scaled(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, vector array<double> of whole numbers) of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    return rows.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"))


def grow(rows: DataFrame, trees: int) -> DataFrame:
    """(tree, tall, data): the ball trees of ``rows``, written to the shared folder."""

    def build(group: pa.Table) -> pa.Table:
        made = BallTree(_matrix(group.column("vector")), group.column("id").to_numpy(), group.column("label").to_numpy())
        return pa.table({"tree": group.column("tree").slice(0, 1), "data": pa.array([made.dump()], pa.binary())})

    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("id"), F.lit(trees)).cast("int"))
    return common.materialize(dealt.groupBy("tree").applyInArrow(build, "tree int, data binary"), "balltrees")


_ANCHOR = "id long, mark long, label long, vector array<double>, positives array<struct<id:long,score:long>>"


def _visits(trees: DataFrame, anchors: DataFrame, n_trees: int, anchor_blocks: int, k: int) -> DataFrame:
    """(id, mark, positive, positive_score, found, score): each anchor's k best rows of each tree; of its
    positives where these are null, of the negatives in each positive's window otherwise."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(at, ANCHORS))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], ["data"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = number = None
        for batch in batches:
            for key, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == 0:
                    tree, number = BallTree.load(data.as_py()), key
                elif key == number:
                    block = pa.ipc.open_stream(data.as_py()).read_all()
                    yield _answer(tree, block, k)

    packed = anchors.repartition(anchor_blocks).mapInArrow(pack, "data binary")
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), F.lit(1).alias("kind"), "data")
    both = trees.select("tree", F.lit(0).alias("kind"), "data").unionByName(sent)
    side = both.repartition(n_trees, "tree").sortWithinPartitions("tree", "kind")
    return side.mapInArrow(search, "id long, mark long, positive long, positive_score long, found long, score long")


def _answer(tree: BallTree, block: pa.Table, k: int) -> pa.RecordBatch:
    queries, own, labels = _matrix(block.column("vector")), block.column("id").to_numpy(), block.column("label").to_numpy()
    listed = block.column("positives").to_pylist()
    same = listed[0] is None
    if same:
        row = np.arange(len(own))
        positive = score = np.zeros(len(own), np.int64)
        low, high = np.full(len(own), -np.inf), np.full(len(own), np.inf)
    else:
        row = np.repeat(np.arange(len(own)), [len(some) for some in listed])
        positive = np.array([p["id"] for some in listed for p in some], np.int64)
        score = np.array([p["score"] for some in listed for p in some], np.int64)
        low, high = -((-LOW * score) // 100).astype(float), ((HIGH * score) // 100).astype(float)
    j, found, at = tree.search(queries, labels, own, row, low, high, k, same)
    mark = block.column("mark").to_numpy()
    columns = [own[row[j]], mark[row[j]], positive[j], score[j], found, at.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "mark", "positive", "positive_score", "found", "score"])


def mine(
    rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, tree_bytes: int = TREE_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``anchor`` holds; ``label`` is the label that counts, an integer. Both are Columns of
    ``rows``. Each anchor has its ``positives`` best rows of its label, and each of these the ``negatives`` best rows of
    other labels whose score is LOW to HIGH hundredths of the positive's."""
    spark = rows.sparkSession
    held = scaled(rows, id_col, vector_col, label)
    wanted = scaled(rows.where(anchor), id_col, vector_col, label).dropDuplicates(["id", "label", "vector"])
    size = F.coalesce(F.aggregate("vector", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))), F.lit(0.0))
    n, width, most = held.agg(F.count("*"), F.max(F.size("vector")), F.max(size)).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if max(width, 1) * most * most >= _LIMIT:
        raise ValueError(f"inner products of {width} components up to {most:g} may pass 2**53")
    n_trees = max(-(-n * max(width, 1) * 8 // tree_bytes), min(common.partitions(spark), -(-n // 4096)))
    trees = grow(held, n_trees)
    wanted = common.materialize(wanted.withColumn("mark", F.xxhash64("label", "vector")), "anchors")
    blocks_of = max(1, -(-wanted.count() // ANCHORS))
    first = _visits(trees, wanted.select("id", "mark", "label", "vector", F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")), n_trees, blocks_of, positives)
    order = Window.partitionBy("id", "mark").orderBy(F.desc("score"), "found")
    kept = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # A positive that scores below zero has an empty window; rows of one id and score are one positive.
    windows = kept.where(F.col("score") >= 0).groupBy("id", "mark").agg(F.collect_set(F.struct(F.col("found").alias("id"), "score")).alias("positives"))
    again = common.materialize(wanted.join(windows, ["id", "mark"]).select("id", "mark", "label", "vector", "positives"), "windows")
    second = _visits(trees, again, n_trees, blocks_of, negatives)
    order = Window.partitionBy("id", "mark", "positive", "positive_score").orderBy(F.desc("score"), "found")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def contract(rows: DataFrame) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100; where it is divisible by 7 the label moves on by one."""
    key = F.col("vec_id")
    return mine(rows, key % 100 == 0, F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same by all pairs of anchors and rows; exact, as whole numbers in doubles are.
SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
