"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are counted in one pass and written as a narrow table. The trees are
fitted on the driver on a sample of labelled rows of bounded size (``SAMPLE``), chosen by a hash of the
id, so that the same rows come again. Splits are found on quantile bins; on features with a monotonic
constraint a split must order its children's values, and the children's values are clipped to the
middle of the two in all that grows below them. A fitted model is flat arrays of nodes; scoring walks
all rows of a batch down a tree at once.

Defined results: a null text has no words; base rules fail it. Texts of any length are read whole.
Labels with a null outcome are ignored; the first (smallest) of several labels counts. With fewer than
``LEAST`` labelled rows, or of one class only, the method keeps all that the base rules keep. Repeated
rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from maskframe.llm import common

#: Labelled rows to fit on, at most.
SAMPLE = 20_000
LEAST = 50
#: A document goes if its chance of being good is below the point that this share of the sample's good
#: documents lies under, and below a half.
GOOD_LOST = 0.002
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct")
#: Feature -> +1 (more is never worse), -1 (more is never better).
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1}
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words")


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    blanks = sum(map(text.count, BLANKS))
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    repeated = 0
    for line in lines:
        if line.strip(BLANKS):
            if line in seen:
                repeated += 1
            seen.add(line)
    covered = 0
    if n >= 3:
        triples = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(triples)) < len(triples):
            twice = {t for t, c in Counter(triples).items() if c > 1}
            until = 0
            for i, triple in enumerate(triples):
                if triple in twice:
                    covered += i + 3 - max(i, until)
                    until = i + 3
    letters = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    marks = sum(map(text.count, "!?.,;:"))
    return (n, len(text) - blanks, sum(map(text.count, SYMBOLS)), repeated, covered, len(text), upper, digits, marks, len(lines), len(set(words)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, MORE) of every document; the id may be of any type."""
    names = ["id", *COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((text.as_py() or b"").decode("utf-8", "replace")) for text in batch.column(1)]
            found = np.array(rows, np.int64).reshape(-1, len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(names) - 1))], names)

    rows = common.texts(docs, id_col, text_col)
    return rows.mapInArrow(common.lean(run), f"id {common.id_ddl(docs, id_col)}, " + ", ".join(f"{n} long" for n in names[1:]))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the statistics, a column each of FEATURES."""
    n, chars, lines = (np.maximum(counts[k], 1).astype(np.float64) for k in ("n_words", "n_chars", "n_lines"))
    columns = (
        np.log1p(counts["n_words"]), counts["word_chars"] / n, counts["n_symbols"] / n, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / n,
        counts["n_upper"] / chars, counts["n_digits"] / chars, counts["n_marks"] / n, counts["n_distinct"] / n, np.log1p(n / lines),
    )
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Flat nodes of all trees: a leaf has feature -1; ``left`` is the first child, the second follows."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    cut: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(feature, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, constraints: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, smooth: float = 5.0, least: float = 5.0
) -> Trees:
    """Boost logistic loss. ``constraints``: -1, 0 or 1 a feature."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin, nodes, roots = np.full(len(x), base), [], []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple | None:
        total_g, total_h, found = g[rows].sum(), h[rows].sum(), None
        worth = total_g**2 / (total_h + smooth)
        for k, e in enumerate(edges):
            left_g = np.cumsum(np.bincount(binned[rows, k], g[rows], len(e) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, k], h[rows], len(e) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - worth
            a, b = np.clip(-left_g / (left_h + smooth), low, high), np.clip(-right_g / (right_h + smooth), low, high)
            gain[(left_h < least) | (right_h < least) | (constraints[k] * (b - a) < 0)] = -1
            if len(gain) and gain.max() > 1e-6 and (found is None or gain.max() > found[0]):
                i = int(gain.argmax())
                found = (float(gain[i]), k, i, float(a[i]), float(b[i]))
        return found

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + smooth), low, high))
        split = best(rows, g, h, low, high) if level < depth else None
        if split is None:
            nodes[at] = (-1, 0.0, 0, rate * value)
            margin[rows] += rate * value
            return
        _, k, i, a, b = split
        left = len(nodes)
        nodes.extend([None, None])
        nodes[at] = (k, float(edges[k][i]), left, 0.0)
        middle, sign = (a + b) / 2, constraints[k]
        below = binned[rows, k] <= i
        grow(left, rows[below], g, h, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
        grow(left + 1, rows[~below], g, h, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(nodes))
        nodes.append(None)
        grow(roots[-1], np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf)
    feature, threshold, left, value = (np.array(column) for column in zip(*nodes, strict=True))
    return Trees(np.array(roots), feature, threshold, left, value, base)


def train(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE, good_lost: float = GOOD_LOST) -> Trees | None:
    """Fit on at most ``sample`` labelled rows of ``counts`` (id, COUNTS, MORE); None if they say too little. Of
    rows with one id the first by their counts is taken, so that the same rows come again."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("good"))
    chosen = marks.orderBy(F.xxhash64("of"), "of").limit(sample)
    met = counts.join(F.broadcast(chosen), F.col("id") == F.col("of"))  # ``sample`` bounds the chosen
    first = met.groupBy("of").agg(F.min(F.struct("good", *COUNTS, *MORE)).alias("row"))
    rows = first.orderBy("of").select("row.*").toPandas()
    y = (rows["good"].to_numpy() > 0).astype(np.float64)
    if len(rows) < LEAST or y.min() == y.max():
        return None
    x = features({name: rows[name].to_numpy() for name in (*COUNTS, *MORE)})
    model = fit(x, y, np.array([MONOTONE.get(name, 0) for name in FEATURES]))
    model.cut = min(float(np.quantile(model.margin(x)[y == 1], good_lost)), 0.0)
    return model


def score(counts: DataFrame, model: Trees | None) -> DataFrame:
    """(id, COUNTS, margin, method_kept) of every row of ``counts``."""
    names = ["id", *COUNTS, "margin", "method_kept"]
    kind = common.id_ddl(counts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: batch.column(name).to_numpy() for name in (*COUNTS, *MORE)}
            margin = model.margin(features(found)) if model else np.zeros(batch.num_rows)
            kept = margin >= (model.cut if model else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(name) for name in COUNTS), pa.array(margin), pa.array(kept)], names)

    return counts.mapInArrow(common.lean(run), f"id {kind}, " + ", ".join(f"{n} long" for n in COUNTS) + ", margin double, method_kept boolean")


def verdicts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, margin of every document."""
    counts = common.materialize(measure(docs), "statistics")
    return _judged(counts, train(counts, labels, sample)).withColumnRenamed("id", "doc_id")


def _judged(counts: DataFrame, model: Trees | None) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return score(counts, model).select("id", *COUNTS, failed.alias("base_failed"), (~failed & F.col("method_kept")).alias("kept"), "margin")


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are kept; columns unchanged. Rows are judged one by one: those without an
    id and those that share one with other texts by their own text."""
    keyed = docs.select(common.row_key().alias("key"), "text")
    counts = common.materialize(measure(keyed, "key"), "statistics")
    model = train(counts.select("id.id", *COUNTS, *MORE), labels, sample)
    rejected = _judged(counts, model).where(~F.col("kept")).select(F.col("id").alias("key"))
    return common.without(docs, common.materialize(rejected, "rejected"))
