"""Quality scores: random-indexing word vectors, pooled per document, and a small network.

Every token number has a sparse random vector. A token's word vector is the sum
of the random vectors of its neighbours, over the whole corpus. A document is
the mean of its word vectors, once plainly and once with frequent tokens weighted
down, and the mean product of neighbouring ones. A network of two layers is fitted to labelled documents with numpy, and its
probabilities are calibrated by a temperature on labelled rows it was not fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.language import held_out
from harrow.llm.textblocks import column_of, mixed, pieces, span_hashes, utf8

ROWS = 1 << 14  # token numbers: a hash of the token
DIMENSIONS = 48
FEATURES = 3 * DIMENSIONS
NONZERO = 2
REACH = 2  # neighbours on each side
BLOCK_ROWS = 256
STEP = 64
FIT_ROWS = 20_000
THRESHOLD = 0.3
_WEIGHT = 1e-3

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_KIND[:] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all texts and how many each has. A token is a run of letters, digits or signs."""
    data, starts = utf8(column)
    kind = _KIND[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[starts[:-1][starts[:-1] < starts[1:]]] = True
    at = np.flatnonzero(begins)
    to = np.append(at[1:], len(data))
    real = kind[at] > 0
    at, to = at[real], to[real]
    numbers = (span_hashes(data, at, to) & np.uint64(ROWS - 1)).astype(np.int64)
    return numbers, np.diff(np.searchsorted(at, starts))


def _random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each token number, the places and signs of its random vector."""
    drawn = mixed(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(0xA5A5)).reshape(ROWS, NONZERO)
    return (drawn % np.uint64(DIMENSIONS)).astype(np.int64), np.where(drawn >> np.uint64(63), -1.0, 1.0)


def _add_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of the binary blocks of each group."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK_ROWS * (DIMENSIONS + 1))
        for raw in table.column("part"):
            total += np.frombuffer(raw.as_buffer(), np.float64)
        own = {k: [table.column(k)[0].as_py()] for k in keys}
        return pa.table({**own, "part": pa.array([total.tobytes()], pa.binary())})

    schema = ", ".join(f"{k} long" for k in keys)
    return rows.groupBy(*keys).applyInArrow(add, f"{schema}, part binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Sums of neighbours' random vectors per token number, and its count in the last column.

    All texts of docs count. Each task sends its sums once, in blocks of token
    numbers; blocks are added in three steps of STEP each, so that none adds up
    many: 256 k tasks make at most STEP blocks a step. The result has a fixed size.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = _random_vectors()
        sums = np.zeros(ROWS * DIMENSIONS)
        counts = np.zeros(ROWS)
        for piece in pieces(batches):
            numbers, per_text = tokens(column_of(piece, "text"))
            text = np.repeat(np.arange(len(per_text)), per_text)
            counts += np.bincount(numbers, minlength=ROWS)
            for away in range(1, REACH + 1):
                near = text[away:] == text[:-away]
                left, right = numbers[:-away][near], numbers[away:][near]
                for word, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        sums += np.bincount(
                            word * DIMENSIONS + places[other, k], signs[other, k], minlength=ROWS * DIMENSIONS
                        )
        if counts.any():
            table = np.column_stack((sums.reshape(ROWS, DIMENSIONS), counts))
            few = TaskContext.get().partitionId() // STEP
            for block in range(0, ROWS, BLOCK_ROWS):
                part = table[block : block + BLOCK_ROWS]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": [block], "few": [few], "part": [part.tobytes()]})

    parts = docs.select("text").mapInArrow(gather, "block long, few long, part binary")
    out = np.zeros((ROWS, DIMENSIONS + 1))
    some = _add_up(parts, ["block", "few"]).withColumn("few", F.floor(F.col("few") / STEP))
    for row in _add_up(_add_up(some, ["block", "few"]), ["block"]).collect():
        out[row["block"] : row["block"] + BLOCK_ROWS] = np.frombuffer(row["part"]).reshape(BLOCK_ROWS, -1)
    return out


def pooling_table(table: np.ndarray) -> np.ndarray:
    """Per token number: its word vector, the same weighted, that weight, and the unit word vector."""
    counts = table[:, -1]
    vectors = table[:, :-1] / np.maximum(counts, 1)[:, None]
    seen = counts > 0
    if seen.any():
        vectors[seen] -= np.average(vectors[seen], axis=0, weights=counts[seen])
    weight = (_WEIGHT / (_WEIGHT + counts / max(1, counts.sum())))[:, None]
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    return np.column_stack((vectors, vectors * weight, weight, unit)).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """One row per text: mean word vector, weighted mean, and mean product of neighbours' unit vectors.

    The last tells texts that repeat themselves. An empty or null text has zeros.
    """
    numbers, per_text = tokens(column)
    d = DIMENSIONS
    out = np.zeros((len(per_text), FEATURES))
    full = np.flatnonzero(per_text)
    if len(full):
        begins = (np.cumsum(per_text) - per_text)[full]
        last = np.zeros(len(numbers), bool)
        last[begins + per_text[full] - 1] = True
        sums = np.zeros((len(full), 3 * d + 1))
        step = 1 << 15  # tokens at a time
        for at in range(0, len(numbers), step):
            to = min(at + step, len(numbers))
            rows = table[numbers[at : to + 1]]
            alike = np.zeros((to - at, d), np.float32)
            n = len(rows) - 1
            alike[:n] = rows[:-1, 2 * d + 1 :] * rows[1:, 2 * d + 1 :]
            alike[last[at:to]] = 0
            low = int(np.searchsorted(begins, at, side="right")) - 1
            high = int(np.searchsorted(begins, to, side="left"))
            cuts = np.maximum(begins[low:high], at) - at
            sums[low:high, : 2 * d + 1] += np.add.reduceat(rows[: to - at, : 2 * d + 1], cuts, axis=0)
            sums[low:high, 2 * d + 1 :] += np.add.reduceat(alike, cuts, axis=0)
        size = per_text[full][:, None]
        out[full, :d] = sums[:, :d] / size
        out[full, d : 2 * d] = sums[:, d : 2 * d] / np.maximum(sums[:, 2 * d : 2 * d + 1], 1e-12)
        out[full, 2 * d :] = sums[:, 2 * d + 1 :] / size
    return out


class Network:
    """Two layers; score() gives the calibrated probability of label 1."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.middle, self.scale = np.zeros(width), np.ones(width)
        self.weights = [
            draw.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden),
            draw.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1),
        ]
        self.temperature = 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        inner = np.maximum(x @ a + b, 0)
        return inner, inner @ c + d[0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, seed: int = 11) -> None:
        """Adam on the log loss; the temperature from a fifth of the rows set aside.

        Without rows the score is 0.5; with one label only, that label's share
        smoothed by one row of each.
        """
        if len(set(y.tolist())) < 2:
            self.weights = [np.zeros_like(w) for w in self.weights]
            share = (y.sum() + 1) / (len(y) + 2)
            self.weights[3][0] = np.log(share / (1 - share))
            return
        draw = np.random.default_rng(seed)
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.middle) / self.scale
        order = draw.permutation(len(x))
        aside, use = np.split(order, [len(x) // 5])
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for _ in range(epochs):
            use = draw.permutation(use)
            for at in range(0, len(use), batch):
                rows = use[at : at + batch]
                inner, z = self._forward(x[rows])
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                back = np.outer(error, self.weights[2]) * (inner > 0)
                slopes = [x[rows].T @ back + 1e-4 * self.weights[0], back.sum(axis=0), inner.T @ error, np.array([error.sum()])]
                step += 1
                for w, m, v, g in zip(self.weights, first, second, slopes, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(aside):
            z = self._forward(x[aside])[1]
            choices = np.exp(np.linspace(-2, 3, 101))
            losses = [np.mean(np.logaddexp(0, z / t) - y[aside] * z / t) for t in choices]
            self.temperature = float(choices[int(np.argmin(losses))])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._forward((x - self.middle) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    labels holds (doc_id, quality); null labels and labels of held-out or unknown
    documents are not used. The network is fitted to at most `fit_rows` labelled
    rows, those with the smallest hash of doc_id (repeated labels of a document
    count as their largest, and of repeated documents the first text); word vectors
    cover every text. Empty and null texts
    get the score of an empty document. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(pooling_table(word_vectors(docs)))
    known = (
        labels.where("quality is not null and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = pooled(column_of(piece, "text"), table.value)
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(piece, "doc_id"),
                    column_of(piece, "quality"),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "quality", "x"],
            )

    # of rows with one doc_id, the one whose text comes first
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted(sample.mapInArrow(features, "doc_id long, quality int, x binary").collect())
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), FEATURES)
    y = np.array([r["quality"] == 1 for r in rows], np.float64)
    network = Network(FEATURES)
    network.fit(x, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            p = network.score(pooled(column_of(piece, "text"), table.value))
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(piece, "doc_id"),
                    column_of(piece, "held_out"),
                    pa.array(p),
                    pa.array((p >= THRESHOLD).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )
