"""Document quality: random-indexing word vectors, pooled per document, and a small neural network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from skyledger.llm.common import Memo, labelled_sample, over_batches

BUCKETS, DIM = 1 << 14, 48  # word vectors: tokens share 16,384 rows of 48 numbers, 3 MB in all
SEEDS = 4  # non-zero entries of a token's index vector
NEAR = 2  # words on either side that make a context
HIDDEN = 24
PER_CLASS = 3000  # training documents of each label


def token_ids(word: str) -> tuple[int, ...]:
    """The buckets of a blank-separated word: its letters, its shape, its trailing signs."""
    core = word.strip("\"'.,;:!?()[]{}<>*&$%#|-_=+~^/\\@")
    rest = word.replace(core, "", 1) if core else word
    shape = "".join(
        "A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in core[:12]
    )
    squeezed = "".join(c for i, c in enumerate(shape) if i == 0 or shape[i - 1] != c)
    keys = ["w" + core.lower(), "s" + squeezed, "r" + rest[:4]]
    return tuple(xxhash.xxh3_64_intdigest(k) % (BUCKETS - 8) for k in keys)


REPEATED, SAME, AGAIN, LINE = (BUCKETS - 8 + k for k in range(4))  # marks besides the words


def document_ids(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets in order (words x 3), and the marks of repetition.

    Marks: a word that was there just before, a three-word run that was there before, a line that
    was there before. An empty text has neither words nor marks.
    """
    words = (text or "").split()
    if not words:
        return np.empty((0, 3), dtype=np.int64), np.empty(0, dtype=np.int64)
    ids = np.array(list(map(memo.__getitem__, words)), dtype=np.int64).reshape(-1, 3)
    core = ids[:, 0]
    marks = [np.full(int((core[1:] == core[:-1]).sum()), SAME)]
    if len(core) > 2:
        runs = (core[:-2] * BUCKETS + core[1:-1]) * BUCKETS + core[2:]
        marks.append(np.full(len(runs) - len(np.unique(runs)), AGAIN))
    lines = [x for x in text.split("\n") if x]
    marks.append(np.full(len(lines) - len(set(lines)), LINE))
    marks.append(np.full(len(lines), REPEATED))
    return ids, np.concatenate(marks)


def index_vectors() -> np.ndarray:
    """One sparse vector of +1 and -1 per bucket: nearly orthogonal, and the same everywhere."""
    draw = np.random.default_rng(20240607)
    table = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = draw.integers(0, DIM, (BUCKETS, SEEDS))
    sign = draw.integers(0, 2, (BUCKETS, SEEDS)) * 2 - 1
    for k in range(SEEDS):
        table[np.arange(BUCKETS), at[:, k]] += sign[:, k]
    return table


def _contexts():
    index = index_vectors()

    def run(batches):
        memo, total = Memo(token_ids), np.zeros((BUCKETS, DIM), dtype=np.float32)
        for batch in batches:
            for text in batch.column("text"):
                core = document_ids(text.as_py(), memo)[0][:, 0]
                for step in range(1, NEAR + 1):
                    for centre, other in ((core[step:], core[:-step]), (core[:-step], core[step:])):
                        for s in range(0, len(centre), 50_000):
                            _add_rows(total, centre[s : s + 50_000], index[other[s : s + 50_000]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    return run


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, with repeated rows of ``at`` summed."""
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    if len(starts):
        total[at[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)


def word_vectors(sample: DataFrame, tasks: int = 4) -> np.ndarray:
    """Random indexing: a bucket's vector is its own index vector and the sum of its neighbours'.

    Each of a fixed number of tasks sums one table, of a size that no corpus changes.
    """
    parts = sample.select("text").repartition(tasks).mapInArrow(_contexts(), "part binary").collect()
    context = sum(
        (np.frombuffer(r["part"], dtype=np.float32).reshape(BUCKETS, DIM) for r in parts),
        np.zeros((BUCKETS, DIM), dtype=np.float32),
    )
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    index = index_vectors()
    return (context + index / np.linalg.norm(index, axis=1, keepdims=True).clip(1)).astype(np.float32)


def pool(ids: np.ndarray, marks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean vectors of the words, of shapes and signs, and of the marks, and the log length."""
    n = max(len(ids), 1)
    parts = []
    for k in range(3):
        counts = np.bincount(ids[:, k], minlength=BUCKETS) if len(ids) > BUCKETS else None
        if counts is None:
            parts.append(table[ids[:, k]].sum(axis=0) / n)
        else:
            parts.append(counts.astype(np.float32) @ table / n)
    rates = [(marks == k).sum() / n for k in (SAME, AGAIN, LINE, REPEATED)]
    return np.concatenate([*parts, rates, [np.log1p(len(ids)) / 10]]).astype(np.float32)


WIDE = 3 * DIM + 5


@dataclass
class Network:
    """tanh layer, logistic output, and a temperature fitted on rows that training did not see."""

    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -30, 30)))


def train(table, x, y, weight, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature minimises log loss on the others."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    draw = np.random.default_rng(5)
    kept = draw.random(len(y)) < 0.2
    if min(len(set(y[kept])), len(set(y[~kept]))) < 2:
        kept[:] = False
    z, t, w = ((x - mean) / scale)[~kept], y[~kept], weight[~kept] / weight[~kept].sum()
    p = [
        draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = w * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - t)
        back = np.outer(error, p[2]) * (1 - h * h)
        slopes = [z.T @ back + decay * p[0], back.sum(axis=0), h.T @ error + decay * p[2],
                  np.array([error.sum()])]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    net = Network(table, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if kept.any():
        best = np.inf
        for temperature in np.geomspace(0.3, 5, 40):
            net.temperature = float(temperature)
            q = np.clip(net.probability(x[kept]), 1e-6, 1 - 1e-6)
            loss = -(weight[kept] * (y[kept] * np.log(q) + (1 - y[kept]) * np.log(1 - q))).sum()
            if loss < best:
                best, chosen = loss, net.temperature
        net.temperature = chosen
    return net


def _pooled(table):
    def build():
        memo, vectors = Memo(token_ids), table.value

        def work(batch: pa.RecordBatch) -> list:
            flat = [pool(*document_ids(t.as_py(), memo), vectors) for t in batch.column("text")]
            return [batch.column("y"), [v.tobytes() for v in flat]]

        return work

    return build


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS):
    """A network from about ``per_class`` labelled documents of each value of ``labels.quality``.

    Returns a number instead, the share of label 1 (one half without labels), if fewer than two
    values are there to learn.
    """
    spark = docs.sparkSession
    sample, weights = labelled_sample(docs, labels, "quality", learn, per_class)
    if len(weights) < 2:
        return float(next(iter(weights), 0.5))
    sample = sample.cache()
    table = word_vectors(sample)
    shared = spark.sparkContext.broadcast(table)
    rows = over_batches(
        sample.select("y", "text").repartition(8), _pooled(shared), "y int, v binary"
    ).collect()
    sample.unpersist()
    shared.unpersist()
    if len({r["y"] for r in rows}) < 2:
        return float(rows[0]["y"]) if rows else 0.5
    rows.sort(key=lambda r: (r["y"], bytes(r["v"])))  # the order of tasks changes nothing
    x = np.stack([np.frombuffer(r["v"], dtype=np.float32) for r in rows]).astype(np.float64)
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    return train(table, x, y, np.array([weights[r["y"]] for r in rows]))


def _scorer(shared):
    def build():
        net, memo = shared.value, Memo(token_ids)

        def scores(batch: pa.RecordBatch) -> np.ndarray:
            if isinstance(net, float):
                return np.full(batch.num_rows, net)
            pooled = [pool(*document_ids(t.as_py(), memo), net.table) for t in batch.column("text")]
            return net.probability(np.stack(pooled).astype(np.float64))

        return scores

    return build


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text; null counts as empty."""
    scorer = _scorer(docs.sparkSession.sparkContext.broadcast(model))

    def build():
        scores = scorer()
        return lambda batch: [batch.column("doc_id"), scores(batch)]

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return over_batches(rows, build, "doc_id long, score double")


def keep_good(docs: DataFrame, model, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    scorer = _scorer(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        scores = scorer()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scores(batch) >= least))

    return docs.mapInArrow(run, docs.schema)
