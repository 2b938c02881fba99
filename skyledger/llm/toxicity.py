"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import Memo, labelled_sample, mix64, over_batches, share_of
from skyledger.llm.near import shingles, word_hashes

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)  # letters of a beginning that counts as a token
PER_CLASS = 8000  # training documents of each label, half for the words, half for the calibration
PRIOR = 0.025  # weight of the Dirichlet prior: this part of a token's count under both labels
LEAST = 3.0  # log-odds that a token must have: what a topic or a language has in common stays below
OFTEN = 3  # documents in which a token must be to be tested at all
MINIMA = 8  # smallest shingle hashes by which near copies of a training document are known
GAP = 0.25  # what any other token takes from a passage
AGAIN = 0.5  # share of its score that a word which comes again adds to the evidence
STEP, STEPS = 0.25, 64  # token scores are counted in steps of a quarter


def tokens(word: str) -> list[str]:
    """Runs of letters of a blank-separated word, in lower case, and their beginnings.

    An insult comes with many endings: a beginning such as ``abcd*`` stands for all of them.
    """
    found = LETTERS.findall(word.lower())
    return found + [w[:k] + "*" for w in found for k in STEMS if k < len(w)]


def _count_words():
    def run(batches):
        memo, seen = Memo(tokens), {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch.column("y"), batch.column("text"), strict=True):
                words = set((text.as_py() or "").split())
                seen[int(y.as_py() > 0)].update({t for w in words for t in memo[w]})
        rows = [(w, y, n) for y, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64())],
            names=["word", "y", "n"],
        )

    return run


def _minima():
    words = word_hashes()
    seeds = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, MINIMA + 1)]

    def work(batch: pa.RecordBatch) -> list:
        found = []
        for text in batch.column("text"):
            s = shingles((text.as_py() or "").encode(), words)
            found.append([int(mix64(s ^ seed).min().view(np.int64)) for seed in seeds] if len(s) else None)
        return [batch.column("doc_id"), batch.column("y"), found]

    return work


def without_copies(sample: DataFrame) -> DataFrame:
    """One document of each group of equal or near-equal texts of a label: those that share one of their
    smallest shingle hashes. Else the copies of one document would make all its words insults."""
    picked = sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text")
    rows = over_batches(picked, _minima, "doc_id long, y int, low array<long>")
    for k in range(MINIMA):
        first = F.row_number().over(Window.partitionBy("y", F.col("low")[k]).orderBy("doc_id"))
        rows = rows.withColumn("first", first).where("first = 1 OR low IS NULL").drop("first")
    return picked.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")


def word_scores(sample: DataFrame) -> dict[str, float]:
    """Tokens that speak for label 1, with their log-odds.

    A document counts a token once: repeats are not independent, and neither are copies of a document.
    The prior is Dirichlet, in proportion to a token's frequency under both labels, so that rare tokens
    start out neutral. A token counts if its likelihood ratio exceeds what the best of all tested tokens
    reaches by chance, 2 log(tested), however few documents it is in.
    """
    sample = without_copies(sample).cache()
    counted = sample.select("y", "text").mapInArrow(_count_words(), "word string, y int, n long")
    per_word = (
        counted.groupBy("word")
        .agg(
            F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"),
            F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"),
        )
        .where(F.col("n1") + F.col("n0") >= OFTEN)
        .cache()
    )
    sizes = {int(r["y"] > 0): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    d1, d0 = sizes.get(1, 0), sizes.get(0, 0)
    both, n1, n0 = F.col("n1") + F.col("n0"), F.col("n1"), F.col("n0")
    a1, a0 = n1 + PRIOR * both, n0 + PRIOR * both
    rest1, rest0 = F.lit(d1 + PRIOR * (d1 + d0)) - a1, F.lit(d0 + PRIOR * (d1 + d0)) - a0
    odds = F.log(a1 / F.greatest(rest1, F.lit(0.5))) - F.log(a0 / F.greatest(rest0, F.lit(0.5)))
    share = d1 / max(d1 + d0, 1)
    surprise = lambda n, part: F.when(n > 0, n * F.log(n / (both * part))).otherwise(0.0)
    ratio = 2 * (surprise(n1, max(share, 1e-9)) + surprise(n0, max(1 - share, 1e-9)))
    sure = 2 * math.log(max(per_word.count(), 2))
    chosen = (ratio >= sure) & (odds >= LEAST)
    rows = per_word.where(chosen).select("word", odds.alias("odds")).collect()
    per_word.unpersist()
    sample.unpersist()
    return {r["word"]: float(r["odds"]) for r in rows}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring passages (first, last, score) of a sequence, in linear time.

    Only positive tokens begin a step: what lies between two of them is one number. Each open passage
    remembers the nearest one before it that begins lower, so no passage is looked at twice.
    """
    total = np.cumsum(scores, dtype=np.float64)
    left, right, first, last, link = [], [], [], [], []
    for p in np.flatnonzero(scores > 0):
        lo, hi, begin = float(total[p]) - float(scores[p]), float(total[p]), int(p)
        k = len(left) - 1
        while True:
            while k >= 0 and left[k] >= lo:
                k = link[k]
            if k < 0 or right[k] >= hi:
                break
            lo, begin = left[k], first[k]
            before = link[k]
            del left[k:], right[k:], first[k:], last[k:], link[k:]
            k = before
        left.append(lo)
        right.append(hi)
        first.append(begin)
        last.append(int(p))
        link.append(k)
    return [(f, e, r - x) for f, e, x, r in zip(first, last, left, right, strict=True)]


@dataclass
class Model:
    words: dict[str, float]
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    bias: float = 0.0
    slope: float = 0.0

    def token_score(self, word: str) -> float:
        found = [self.words[t] for t in tokens(word) if t in self.words]
        return max(found) if found else -GAP

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Minus the log of the chance that clean text of ``n`` tokens has such passages.

        For the best r passages, whichever r says most: their sum, by the law
        exp(-t) t^(r-1) / (r! (r-1)!), or that r reach the r-th score, by Poisson's.
        """
        best, total, summing = 0.0, 0.0, True
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
            log_e = math.log(self.scale * n) - self.rate * s
            summing = summing and (r == 1 or -log_e > math.log(r))
            if summing:
                total -= log_e
                if total > 0:
                    log_p = (r - 1) * math.log(total) - total - math.lgamma(r + 1) - math.lgamma(r)
                    best = max(best, -log_p - math.log(r))
            if log_e < math.log(r):
                log_p = r * log_e - math.exp(log_e) - math.lgamma(r + 1)
                best = max(best, -log_p - math.log(r))
        return best

    def probability(self, evidence: float) -> float:
        x = self.bias + self.slope * min(evidence, 40.0)
        return 1 / (1 + math.exp(-max(min(x, 30.0), -30.0)))


def _token_scores(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the words in order, and what each adds to the evidence.

    Passages are searched on the scores. A word that comes again depends on its first occurrence, so it
    adds only the part ``AGAIN`` of its score to the evidence.
    """
    words = (text or "").split()
    scores = np.fromiter(map(memo.__getitem__, words), dtype=np.float32, count=len(words))
    adds, seen = scores.copy(), set()
    for p in np.flatnonzero(scores > 0):
        if words[p] in seen:
            adds[p] *= AGAIN
        seen.add(words[p])
    return scores, adds


def _weighed(found: list[tuple[int, int, float]], adds: np.ndarray) -> list[tuple[int, int, float]]:
    """The passages with what they add to the evidence, where that is anything."""
    total = np.concatenate([[0.0], np.cumsum(adds, dtype=np.float64)])
    added = [(f, e, float(total[e + 1] - total[f])) for f, e, _ in found]
    return [x for x in added if x[2] > 0]


def _look(shared):
    """Per document: words, how often each step of token scores comes, its passages and the least of them."""

    def build():
        memo = Memo(shared.value.token_score)

        def work(batch: pa.RecordBatch) -> list:
            sizes, counts, found, least = [], [], [], []
            for text in batch.column("text"):
                s, adds = _token_scores(text.as_py(), memo)
                steps = np.minimum(adds[adds > 0] / STEP, STEPS - 1).astype(np.int64)
                passages = [x[2] for x in _weighed(segments(s), adds)]
                sizes.append(len(s))
                counts.append(np.bincount(steps, minlength=STEPS))
                found.append(len(passages))
                least.append(min(passages, default=None))
            return [batch.column("y"), sizes, counts, found, least]

        return work

    return build


def _weigh(shared):
    def build():
        model: Model = shared.value
        memo = Memo(model.token_score)

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for text in batch.column("text"):
                s, adds = _token_scores(text.as_py(), memo)
                out.append(model.evidence(len(s), _weighed(segments(s), adds)))
            return [batch.column("y"), out]

        return work

    return build


def _law(model: Model, clean: DataFrame) -> Model:
    """lambda and K of the extreme-value law from the clean documents of the calibration half.

    What reaches the driver are sums over all of them, whatever the length of their texts.
    """
    shared = clean.sparkSession.sparkContext.broadcast(model)
    rows = over_batches(clean, _look(shared), "y int, n long, counts array<long>, found long, least double")
    sums = rows.agg(
        F.sum("n").alias("n"), F.sum("found").alias("found"), F.min("least").alias("least"),
        *[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(STEPS)],
    ).first()
    n, found = sums["n"] or 0, sums["found"] or 0
    counts = np.array([sums[f"c{k}"] or 0 for k in range(STEPS)], dtype=np.float64)
    at = (np.arange(STEPS) + 0.5) * STEP
    share = (counts + 0.5 / STEPS) / max(n + 0.5, 1.0)
    low, high = 1e-3, 1.0
    loss = lambda x: float((share * np.exp(x * at)).sum()) + (1 - share.sum()) * math.exp(-x * GAP) - 1
    while loss(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if loss(middle) < 0 else (low, middle)
    model.rate = high
    floor = 1.0 if sums["least"] is None else sums["least"]
    model.scale = (found + 0.5) / max(n * math.exp(-model.rate * floor), 1e-12)
    model.scale = min(max(model.scale, 1e-9), 1.0)
    return model


def _curve(model: Model, rows: list, weights: dict) -> Model:
    """A logistic curve over the evidence of labelled documents."""
    x = np.array([min(r["evidence"], 40.0) for r in rows])
    y = np.array([float(r["y"] > 0) for r in rows])
    w = np.array([weights[r["y"]] for r in rows])
    w = w / w.sum()
    p = np.zeros(2)
    columns = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):  # Newton, with a little ridge for labels that the evidence separates
        q = 1 / (1 + np.exp(-np.clip(columns @ p, -30, 30)))
        slope = columns.T @ (w * (q - y)) + 1e-5 * p
        p -= np.linalg.solve(
            (columns * (w * q * (1 - q))[:, None]).T @ columns + 1e-5 * np.eye(2), slope
        ).clip(-2, 2)
    model.bias, model.slope = float(p[0]), float(max(p[1], 0.0))
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """A model from about ``per_class`` labelled documents of each value of ``labels.toxic``.

    One half, by a hash of the id, gives the token scores, the other the calibration. Without both
    label values every document gets the share of label 1 (one half without labels).
    """
    sample, weights = labelled_sample(docs, labels, "toxic", learn, per_class, seed=11)
    if len(weights) < 2:
        share = min(max(float(next(iter(weights), 0.5)), 1e-6), 1 - 1e-6)
        return Model({}, bias=math.log(share / (1 - share)))
    sample = sample.withColumn("half", share_of(F.col("doc_id"), 12) < 0.5).cache()
    model = Model(word_scores(sample.where("half")))
    rest = sample.where("NOT half").select("y", "text")
    model = _law(model, rest.where("y = 0"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = over_batches(rest, _weigh(shared), "y int, evidence double").collect()
    sample.unpersist()
    rows.sort(key=lambda r: (r["y"], r["evidence"]))
    return _curve(model, rows, weights) if rows else model


def _score(shared):
    def build():
        model: Model = shared.value
        memo = Memo(model.token_score)

        def work(batch: pa.RecordBatch) -> list:
            scores, passages = [], []
            for text in batch.column("text"):
                s, adds = _token_scores(text.as_py(), memo)
                found = segments(s)
                scores.append(model.probability(model.evidence(len(s), _weighed(found, adds))))
                passages.append([{"first": f, "last": e, "score": v} for f, e, v in found])
            return [batch.column("doc_id"), scores, passages]

        return work

    return build


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): the probability of label 1, and every passage found.

    Passages are (first, last, score) in blank-separated words of the whole text, from 0; words that
    come again count in full there, and in part in the document's score. Null counts as empty: no
    passages, and the score of a document without evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return over_batches(
        rows, _score(shared),
        "doc_id long, score double, passages array<struct<first:int,last:int,score:double>>",
    )
