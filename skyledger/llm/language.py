"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import Memo, over_batches, share_of

RUNS = re.compile(r"[^\W\d_]+")  # letters, and signs such as a half or a raised two
DIM = 1024  # of all vectors
GRAM = 3  # letters bound into one vector; a word begins and ends with a blank
PER_LANGUAGE = 500  # training documents of each language
MOST_GRAMS = 20_000  # vectors a task keeps before it starts afresh


def letter_runs(word: str) -> list[str]:
    """Runs of letters; numbers of any script and other signs part them."""
    out = []
    for run in RUNS.findall(word):
        out += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return out


def letter_vector(letter: str) -> np.ndarray:
    """A random vector of +1 and -1, the same wherever the letter occurs."""
    bits = np.random.default_rng(ord(letter)).integers(0, 2, DIM)
    return (bits * 2 - 1).astype(np.float32)


class Encoder:
    """Documents as bundles of n-gram vectors: each binds its letters, rotated by their place."""

    def __init__(self):
        self.letters = Memo(letter_vector, 20_000)
        self._fresh()

    def _fresh(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, DIM), dtype=np.float32)
        self.words = Memo(self._word_rows)

    def _word_rows(self, word: str) -> tuple[int, ...]:
        found = []
        for letters in letter_runs(word.lower()):
            padded = f" {letters} "
            found += [self._row(padded[k : k + GRAM]) for k in range(len(padded) - GRAM + 1)]
        return tuple(found)

    def _row(self, gram: str) -> int:
        row = self.rows.get(gram)
        if row is None:
            row = self.rows[gram] = len(self.rows)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            bound = np.ones(DIM, dtype=np.float32)
            for place, letter in enumerate(gram):
                bound *= np.roll(self.letters[letter], GRAM - 1 - place)
            self.table[row] = bound
        return row

    def document(self, text: str | None) -> np.ndarray | None:
        """The bundle of all n-grams of a text at unit length; None without letters."""
        if len(self.rows) > MOST_GRAMS:
            self._fresh()
        rows = np.fromiter(
            chain.from_iterable(map(self.words.__getitem__, (text or "").split())), dtype=np.int64
        )
        if not len(rows):
            return None
        counts = np.bincount(rows)
        used = np.flatnonzero(counts)
        bundle = np.sqrt(counts[used]).astype(np.float32) @ self.table[used]
        length = float(np.linalg.norm(bundle))
        return bundle / length if length > 0 else None


def _bundles():
    def run(batches):
        encoder, total = Encoder(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                v = encoder.document(text.as_py())
                if v is not None:
                    lang = lang.as_py()
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["lang", "part"],
        )

    return run


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes: bundles of about ``per_language`` documents each.

    Documents are chosen by a hash of the id among those with a language that ``learn`` admits. What
    all prototypes have in common is taken off them, as it tells no language from another.
    """
    known = docs.where(F.col("lang").isNotNull() & learn).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    rates = counts.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("rate"))
    sample = known.join(F.broadcast(rates), "lang").where(share_of(F.col("doc_id"), 5) < F.col("rate"))
    parts = sample.select("lang", "text").repartition(6).mapInArrow(_bundles(), "lang string, part binary")
    total: dict[str, np.ndarray] = {}
    for r in parts.collect():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["part"], dtype=np.float64)
    names = sorted(total)
    if not names:
        return [], np.empty((0, DIM))
    unit = np.stack([total[n] / np.linalg.norm(total[n]) for n in names])
    if len(names) > 1:
        unit = unit - unit.mean(axis=0)
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    return names, np.round(unit / np.maximum(length, 1e-12), 9).astype(np.float32)


def _predict(shared):
    def build():
        names, prototypes = shared.value
        encoder = Encoder()

        def work(batch: pa.RecordBatch) -> list:
            found, scores = [], []
            for text in batch.column("text"):
                v = encoder.document(text.as_py()) if names else None
                if v is None:
                    found.append("und")
                    scores.append(0.0)
                    continue
                cosines = prototypes @ v
                best = int(cosines.argmax())
                found.append(names[best])
                scores.append(min(max(float(cosines[best]), 0.0), 1.0))
            return [batch.column("doc_id"), found, scores]

        return work

    return build


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text: the nearest prototype and its cosine.

    ``und`` with score 0 if a text is null or has no letter, or if there was no language to learn.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return over_batches(rows, _predict(shared), "doc_id long, lang_pred string, score double")
