"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features gives each document a score f; ordered thresholds cut it
into grades, P(grade >= k) = sigmoid(f - t_k). Features are the distinct words of the whole text (case
and marks at the ends apart), the shares of word shapes, and bands of length and of repetition, all
hashed. The model is fitted on the
driver on a sample of labelled rows of bounded size (``SAMPLE``), chosen by a hash of the id; only the
sample's feature numbers leave the cluster. Scoring is one pass over all documents.

Grades: 0 toxic, 1 of low quality, 2 good.

Defined results: a null or empty text has no features, so its grade is that of the thresholds; labels
without toxic and quality are ignored, the lowest grade of several counts; with fewer than ``LEAST``
labelled rows or one grade only every document has the top grade; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from maskframe.llm import common

#: Labelled rows to fit on, at most.
SAMPLE = 8_000
LEAST = 50
SPACE = 1 << 22
GRADES = 3
#: Features that fewer documents of the sample have are left out.
MIN_DOCS = 10
KNOWN = 400_000


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", token)))[:12]


def _number(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % SPACE


def token_features(token: str) -> tuple[int, tuple[int, ...]]:
    """Numbers of a token's word, and of its shape and kind."""
    word = token.strip("!?.,;:\"'()[]{}*#$%&|<>-").lower()
    kinds = [f"s{_shape(token)}"]
    if any(c in "#*$%&|<>" for c in token):
        kinds.append("k symbols")
    if len(token) > 1 and token.isupper():
        kinds.append("k upper")
    return _number(f"w{word}"), tuple(map(_number, kinds))


class _Tokens(dict):
    """token -> what ``make`` gives; forgets all when it grows too large."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, token: str):
        if len(self) >= KNOWN:
            self.clear()
        found = self[token] = self.make(token)
        return found


def text_features(text: str, known: _Tokens) -> tuple[dict[int, float], int]:
    """Feature -> value of a text, and its number of words."""
    counts = Counter(text.split())
    n, out = sum(counts.values()), {}
    weight = min(1.0, 3 / (len(counts) + 1) ** 0.25)  # long texts have more words that mean nothing
    for token, count in counts.items():
        word, kinds = known[token]
        out[word] = weight
        for kind in kinds:
            out[kind] = out.get(kind, 0.0) + 10.0 * count / n
    if n:
        for band in (f"n{n.bit_length()}", f"d{20 * len(counts) // n}", f"t{n.bit_length()}.{20 * counts.most_common(1)[0][1] // n}"):
            out[_number(band)] = 1.0
    return out, n


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ...; a column each."""
        return 1 / (1 + np.exp(-(f[:, None] - self.thresholds[None, :])))


def fit(features: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 30, rate: float = 0.01, prior: float = 3.0, batch: int = 64, steps: int = 4000) -> Model:
    """Maximum likelihood by Adam, for ``epochs`` and at least ``steps`` steps; thresholds are a first one
    and positive steps. ``prior`` is the precision of the weights' normal prior."""
    names, seen = np.unique(np.concatenate([f for f, _ in features]), return_counts=True)
    names = names[seen >= MIN_DOCS]
    rows = []
    for f, v in features:
        at = np.minimum(np.searchsorted(names, f), len(names) - 1) if len(names) else f[:0]
        known = names[at] == f if len(names) else np.zeros(len(f), bool)
        rows.append((at[known], v[known]) if len(names) else (at, v[:0]))
    share = np.array([np.clip((grades >= k).mean(), 0.01, 0.99) for k in range(1, GRADES)])
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    size = max(len(names), 1)
    weights, theta = np.zeros(size), np.concatenate((start[:1], gaps))
    moments = [np.zeros(size), np.zeros(size), np.zeros(len(theta)), np.zeros(len(theta))]
    random, t = np.random.default_rng(6), 0
    for _ in range(max(epochs, steps // -(-len(rows) // batch))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            f = np.bincount(owner, weights[index] * value, len(some))
            cut = np.concatenate(([-np.inf], np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:])))), [np.inf]))
            with np.errstate(over="ignore"):
                a, b = (1 / (1 + np.exp(-(f - cut[grades[some] + k]))) for k in (0, 1))
            p = np.maximum(a - b, 1e-9)
            d_cut = np.zeros(GRADES + 1)
            np.add.at(d_cut, grades[some], -a * (1 - a) / p)
            np.add.at(d_cut, grades[some] + 1, b * (1 - b) / p)
            inner = d_cut[1:-1]
            d_theta = np.concatenate(([inner.sum()], np.cumsum(inner[::-1])[::-1][1:] * np.exp(theta[1:]))) / len(some)
            d_weights = np.bincount(index, ((1 - a - b) / len(some))[owner] * value, size) - prior / len(rows) * weights
            t += 1
            for target, grad, first, second in ((weights, d_weights, *moments[:2]), (theta, d_theta, *moments[2:])):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                target += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    spread = np.zeros(SPACE, np.float32)
    spread[names] = weights[: len(names)]
    return Model(spread, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:])))))


def graded(labels: DataFrame) -> DataFrame:
    """(of, grade): the rating of each labelled document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    return labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("of"), grade.alias("grade")).groupBy("of").agg(F.min("grade").alias("grade")).where("grade IS NOT NULL")


def sample_features(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and grades of at most ``sample`` rated documents, chosen by a hash of the id. The ids are
    broadcast: ``sample`` bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens(token_features)
        for batch in batches:
            found = [text_features((x.as_py() or b"").decode("utf-8", "replace"), known)[0] for x in batch.column(2)]
            lists = [pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["of", "grade", "features", "values"])

    chosen = ratings.orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = common.texts(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("id") == F.col("of")).select(F.col("of").cast("long"), "grade", "text")
    local = rows.mapInArrow(run, "of long, grade int, features array<int>, values array<float>").dropDuplicates(["of"]).orderBy("of").toPandas()
    return [(np.asarray(f, np.int32), np.asarray(v, np.float32)) for f, v in zip(local["features"], local["values"], strict=True)], local["grade"].to_numpy(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows."""
    features, grades = sample_features(docs, graded(labels), sample)
    if len(grades) < LEAST or grades.min() == grades.max():
        return Model(np.zeros(SPACE, np.float32), np.array([-40.0, -39.0]))
    return fit(features, grades)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, p_at_least_1, p_at_least_2) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPACE numbers
    names = [id_col, "expected_grade", "p_at_least_1", "p_at_least_2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        known = _Tokens(token_features)
        for batch in batches:
            f = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                values, _ = text_features((text.as_py() or b"").decode("utf-8", "replace"), known)
                f[i] = found.weights[np.fromiter(values, np.int64, len(values))] @ np.fromiter(values.values(), np.float64, len(values))
            tails = found.tails(f)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])], names)

    rows = common.texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {common.id_ddl(docs, id_col)}, expected_grade double, p_at_least_1 double, p_at_least_2 double")


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail probabilities and ``kept``: good with a chance of ``least``."""
    return score(docs, train(docs, labels)).withColumn("kept", F.col("p_at_least_2") >= least)
