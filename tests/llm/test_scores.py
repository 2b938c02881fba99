"""Toxicity, quality and language: accuracy on held-out rows, parts against brute force, edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import language, quality, toxicity
from skyledger.llm.common import Memo, labelled_sample, remainder
from skyledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
LONG = "Some words of a long text. " * 60_000
ODD = [(1, None), (2, ""), (3, LONG), (4, "\t\n "), (5, "x"), (5, "x"), (6, "42 ++ 7"), (7, "🙂 é́")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def brute_segments(scores):
    """The best passage, then the best to its left and right, and so on."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (i, j, total)
    if best is None:
        return []
    i, j, _ = best
    left = [(a, b, s) for a, b, s in brute_segments(scores[:i])]
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]
    return left + [best] + right


def test_segments_equal_the_recursive_definition():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 30, 45):
        for _ in range(30):
            s = np.round(draw.normal(-0.4, 1, n), 3)
            got = toxicity.segments(s.astype(np.float64))
            want = brute_segments(list(s))
            assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
            assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_segments_take_linear_time():
    s = np.tile([1.0, -0.9], 200_000)
    assert len(toxicity.segments(s)) == 1


def accuracy(scores, labels, column, least):
    held = scores.where(remainder(F.col("doc_id"), 4) == 2).join(labels, "doc_id").collect()
    hit = [(r[column], r["score"] >= least) for r in held]
    return [np.mean([p == bool(y) for y, p in hit if y == k]) for k in (0, 1)]


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    clean, toxic = accuracy(toxicity.score(docs, model), labels, "toxic", 0.3)
    assert clean >= 0.95 and toxic >= 0.6  # a handful of toxic rows here; larger tables reach 0.99


def test_toxicity_finds_a_passage_in_a_long_text(corpus, rows):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    worst = max(model.words, key=lambda w: (not w.endswith("*"), model.words[w]))
    text = "and the on " * 20_000
    got = {r["doc_id"]: r for r in toxicity.score(
        rows([(1, text), (2, text + f"{worst}! " * 2 + text), (3, text.upper())], DOCS), model).collect()}
    assert [p["first"] for p in got[2]["passages"]] == [60_000] and not got[1]["passages"]
    assert got[2]["score"] > got[1]["score"] == got[3]["score"]


def test_toxicity_finds_passages_of_words_that_came_before(rows):
    model = toxicity.Model({"vile": 4.0, "mean": 4.0, "nasty": 4.0}, rate=3.0, bias=-5.0, slope=0.1)
    gap = " x" * 40
    texts = [f"vile{gap} mean{gap} vile{gap} vile y mean{gap}", f"vile{gap} mean y vile y mean",
             ("vile" + gap + " ") * 50, "vile" + gap + " x" * 41 * 49,
             f"vile{gap} mean{gap} nasty", f"vile{gap} vile{gap} vile"]
    got = {r["doc_id"]: r for r in toxicity.score(rows(list(enumerate(texts)), DOCS), model).collect()}
    spans = [[(p["first"], p["last"], p["score"]) for p in got[k]["passages"]] for k in range(6)]
    assert spans[0] == [(0, 0, 4.0), (41, 41, 4.0), (82, 82, 4.0), (123, 125, 7.75)]
    assert spans[1] == [(0, 0, 4.0), (41, 45, 11.5)]
    assert len(spans[2]) == 50 and len(spans[3]) == 1 and len(spans[5]) == 3
    assert got[2]["score"] > got[3]["score"] and got[4]["score"] > got[5]["score"]


def invented(draw, insults, vocabulary, count):
    """Short clean texts, and toxic ones that hold one insult each."""
    words = draw.choice(vocabulary, (count, 14))
    texts = [list(w) for w in words]
    for k, t in enumerate(texts):
        if k % 2:
            t[draw.integers(14)] = insults[draw.integers(len(insults))] + "!"
    return [(k, " ".join(t), k % 2) for k, t in enumerate(texts)]


def test_toxicity_learns_rare_insults_but_no_copies(spark):
    """200 insults, each in half a per cent of the toxic documents; copies of one text teach nothing."""
    draw = np.random.default_rng(21)
    letters = np.array(list("bcdfgklmnprstvz")), np.array(list("aeiou"))

    def word(n):
        return "".join(draw.choice(letters[k % 2]) for k in range(n))

    insults = [word(8) for _ in range(200)]
    vocabulary = np.array([word(6) for _ in range(1500)])
    data = invented(draw, insults, vocabulary, 16_000)
    copied = "".join(f" uncommon{word(5)}" for _ in range(30)).split()
    for k in range(1500):  # near copies of one toxic text
        t = list(copied)
        t[draw.integers(30)] = word(7)
        data.append((20_000 + k, " ".join([*t, insults[0]]), 1))
    docs = spark.createDataFrame([r[:2] for r in data], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert sum(w in model.words for w in insults) >= 180
    assert not any(w in model.words for w in copied)
    fresh = invented(draw, insults, vocabulary, 1000)
    got = {r["doc_id"]: r["score"] >= 0.3 for r in toxicity.score(spark.createDataFrame([r[:2] for r in fresh], DOCS), model).collect()}
    assert np.mean([got[k] for k, _, y in fresh if y]) >= 0.9
    assert np.mean([got[k] for k, _, y in fresh if not y]) <= 0.02


def test_toxicity_evidence_equals_the_formula(rows):
    """Scores of whole texts from all passages, found by looking at every one of them."""
    model = toxicity.Model({"vile": 4.0, "mean": 3.0}, rate=1.3, scale=0.2, bias=-4.0, slope=0.3)
    texts = ["vile x x vile y " * 3, "x " * 50, "mean", "", "vile mean x x x x x x x x x x x x x x x x x x mean " * 4]

    def slow(text):
        words = text.split()
        scores = [model.words.get(w, -toxicity.GAP) for w in words]
        adds = [s * (toxicity.AGAIN if s > 0 and w in words[:k] else 1) for k, (w, s) in enumerate(zip(words, scores, strict=True))]
        found = sorted((x for x in (sum(adds[a : b + 1]) for a, b, _ in brute_segments(scores)) if x > 0), reverse=True)
        best = 0.0
        for r in range(1, len(found) + 1):
            gains = [model.rate * s - np.log(model.scale * len(words)) for s in found[:r]]
            if all(k == 0 or g > np.log(k + 1) for k, g in enumerate(gains)) and sum(gains) > 0:
                chance = np.exp(-sum(gains)) * sum(gains) ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))
                best = max(best, -np.log(chance) - np.log(r))
            expected = np.exp(-gains[-1])
            if np.log(expected) < np.log(r):
                best = max(best, -np.log(expected**r * np.exp(-expected) / math.factorial(r)) - np.log(r))
        return 1 / (1 + np.exp(-(model.bias + model.slope * min(best, 40.0))))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows(list(enumerate(texts)), DOCS), model).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx([slow(t) for t in texts])


def test_toxicity_cases(rows, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    wide = rows([(i, t, "y", 1) for i, t in ODD], DOCS + ", y string, passages int")
    got = toxicity.score(wide, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.3 for r in got)
    assert toxicity.score(rows([], DOCS), model).count() == 0


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    bad, good = accuracy(quality.score(docs, model), labels, "quality", 0.7)
    assert good >= 0.97 and bad >= 0.8
    again = quality.fit(docs.repartition(5), labels, remainder(F.col("doc_id"), 4) != 2)
    assert np.allclose(again.w1, model.w1, atol=1e-3)


def test_quality_cases(rows, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    wide = rows([(i, t, "y", 1) for i, t in ODD], DOCS + ", y string, score int")
    got = quality.score(wide, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(wide, model)
    assert kept.columns == wide.columns
    ids = {r["doc_id"] for r in got if r["score"] >= 0.7}
    assert {r["doc_id"] for r in kept.collect()} == ids
    assert quality.score(rows([], DOCS), model).count() == 0


def test_without_labels_or_with_one_value(rows):
    docs = rows([(1, "a"), (2, None)], DOCS)
    none = rows([], "doc_id long, quality int, toxic int")
    one = rows([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    true = F.lit(True)
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none, true)).collect()] == [0.5, 0.5]
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, one, true)).collect()] == [1.0, 1.0]
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none, true)).collect()] == [0.5, 0.5]
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, one, true)).collect())
    empty = rows([], DOCS)
    assert quality.fit(empty, rows([(1, 1), (2, 0)], "doc_id long, quality int"), true) == 0.5


def test_sample_is_balanced_bounded_and_reproducible(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("bad"))
    sample, weights = labelled_sample(docs, labels, "bad", F.lit(True), 1000)
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    assert 850 < n[0] < 1150 and 850 < n[1] < 1150
    assert weights == {0: pytest.approx(18.0), 1: pytest.approx(2.0)}
    assert sample.exceptAll(labelled_sample(docs, labels, "bad", F.lit(True), 1000)[0]).count() == 0


def test_language_on_held_out_rows(corpus):
    docs, _ = corpus
    model = language.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    got = language.predict(docs, model).where(remainder(F.col("doc_id"), 5) == 0).join(docs, "doc_id")
    hits = [r["lang"] == r["lang_pred"] for r in got.collect()]
    assert np.mean(hits) >= 0.97


def test_language_cases(rows):
    docs = rows(
        [(i, "the cat and the dog of this house", "en") for i in range(9)]
        + [(20 + i, "der hund und die katze im haus", "de") for i in range(9)]
        + [(40, "das hier ist ohne sprache", None)], DOCS + ", lang string",
    )
    model = language.fit(docs, F.lit(True))
    assert model[0] == ["de", "en"]
    wide = rows([*((i, t, 1) for i, t in ODD), (8, "THE DOG", 1), (9, "die Katze", 1)], DOCS + ", lang_pred int")
    got = {r["doc_id"]: r for r in language.predict(wide, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4, 6, 8, 9)] == ["und"] * 4 + ["en", "de"]
    assert got[1]["score"] == 0.0 and got[3]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit(rows([(1, "a", None)], DOCS + ", lang string"), F.lit(True))
    assert [r["lang_pred"] for r in language.predict(rows([(1, "a")], DOCS), nothing).collect()] == ["und"]
    assert language.predict(rows([], DOCS), model).count() == 0


def test_language_vectors_bind_places():
    encoder = language.Encoder()
    a, b = encoder.document("abc"), encoder.document("cba")
    assert abs(float(a @ b)) < 0.5 < float(a @ encoder.document("ABC abc")) + 1e-6
    rows = encoder.table[: len(encoder.rows)]
    letters = encoder.letters
    want = np.roll(letters["a"], 2) * np.roll(letters["b"], 1) * letters["c"]
    assert (rows[encoder.rows["abc"]] == want).all()


def slow_bundle(text):
    """Every n-gram of every word, bound letter by letter; the square root of its count."""
    grams = Counter()
    for word in (text or "").lower().split():
        run = ""
        for c in word + " ":
            if c.isalpha():
                run += c
            elif run:
                grams.update(f" {run} "[k : k + 3] for k in range(len(run)))
                run = ""
    total = np.zeros(language.DIM)
    for gram, n in grams.items():
        bound = np.ones(language.DIM)
        for place, c in enumerate(gram):
            bound *= np.roll(language.letter_vector(c), 2 - place)
        total += np.sqrt(n) * bound
    return total / np.linalg.norm(total) if grams else None


def test_language_equals_a_slow_version(spark):
    """op5 over the whole table: bundles, prototypes and cosines worked out one n-gram at a time."""
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op5_language_id"](spark, sf).collect()}
    bundles = {i: slow_bundle(t) for i, t, _ in docs}
    total = {}
    for i, _, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 5 and bundles[i] is not None:
            total[lang] = total.get(lang, 0) + bundles[i]
    names = sorted(total)
    unit = np.stack([total[n] / np.linalg.norm(total[n]) for n in names])
    unit -= unit.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i, v in bundles.items():
        if v is None:
            assert got[i] == ("und", 0.0)
            continue
        cosines = unit @ v
        best = cosines.max()
        assert got[i][1] == pytest.approx(max(best, 0), abs=2e-4)
        assert cosines[names.index(got[i][0])] >= best - 2e-4


def test_signs_that_are_no_letters(rows):
    docs = rows([(i, "the cat and the dog", "en") for i in range(5)] + [(9, "der hund", "de")], DOCS + ", lang string")
    odd = [(1, "½ ²"), (2, "①② ٣٤"), (3, "½the½"), (4, "_ 12 ³")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(rows(odd, DOCS), language.fit(docs, F.lit(True))).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["und", "und", "en", "und"]


def test_quality_equals_a_slow_version(spark):
    """op7 over the whole table: word vectors, pooling and the network worked out one word at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    sample = [r["text"] or "" for r in labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), 4) != 2, quality.PER_CLASS)[0].collect()]
    index, context = quality.index_vectors().astype(float), np.zeros((quality.BUCKETS, quality.DIM))
    for text in sample:
        core = [quality.token_ids(w)[0] for w in text.split()]
        for k, a in enumerate(core):
            for b in core[max(0, k - quality.NEAR) : k] + core[k + 1 : k + 1 + quality.NEAR]:
                context[a] += index[b]
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    table = context + index / np.linalg.norm(index, axis=1, keepdims=True).clip(1)
    assert np.allclose(net.table, table, atol=1e-4)

    def slow(text):
        words = (text or "").split()
        ids = [quality.token_ids(w) for w in words]
        n = max(len(words), 1)
        parts = [sum((table[i[k]] for i in ids), np.zeros(quality.DIM)) / n for k in range(3)]
        core = [i[0] for i in ids]
        runs = [tuple(core[k : k + 3]) for k in range(len(core) - 2)]
        lines = [x for x in (text or "").split("\n") if x] if words else []
        rates = [sum(a == b for a, b in zip(core, core[1:], strict=False)), len(runs) - len(set(runs)),
                 len(lines) - len(set(lines)), len(lines)]
        x = np.concatenate([*parts, np.array(rates) / n, [np.log1p(len(words)) / 10]])
        h = np.tanh(((x - net.mean) / net.scale) @ net.w1 + net.b1)
        return 1 / (1 + np.exp(-np.clip((h @ net.w2 + net.b2) / net.temperature, -30, 30)))

    got = {r["doc_id"]: r["score"] for r in QUERIES["op7_quality_classifier"](spark, sf).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(slow(r["text"]), abs=2e-3)


def test_memo_forgets_and_computes_again():
    memo = Memo(len, limit=2)
    assert [memo[w] for w in ("a", "bb", "ccc", "a", "bb")] == [1, 2, 3, 1, 2] and len(memo) <= 2


@pytest.mark.parametrize("name,modulus,out,least", [
    ("op1_toxicity", 4, 2, 0.3), ("op7_quality_classifier", 4, 2, 0.7), ("op5_language_id", 5, 0, None),
])
def test_queries_return_every_document(spark, name, modulus, out, least):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES[name](spark, sf)
    assert got.count() == docs.count()
    assert got.where(F.col("held_out") != (remainder(F.col("doc_id"), modulus) == out)).count() == 0
    if least is not None:
        assert got.where(F.col("predicted") != (F.col("score") >= least).cast("int")).count() == 0
