"""The pipeline's stages on their own input, and the folder's independence."""

from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_groups

from skyledger.llm.queries import ORACLE, QUERIES
from skyledger.session import stage

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "packing"]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_nothing_else_imports_the_folder():
    for path in (ROOT / "skyledger").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs
    for name, apply in corpus_pipeline.STAGES[:3]:
        after = stage(apply(spark, before, SF), "t")
        assert after.schema.simpleString() == docs.schema.simpleString()
        old, new = (dict(x.select("doc_id", "text").collect()) for x in (before, after))
        assert set(new) <= set(old) and all(new[i] == old[i] for i in new)
        if name == "quality_classifier":
            good = [i for i in old if labels.get(i) == 1]
            assert sum(i in new for i in good) >= 0.95 * len(good)
        if name == "exact_dedup":
            last = {}
            for i, t in old.items():
                last[t] = max(last.get(t, i), i)
            assert set(new) == set(last.values())
        if name == "minhash_near_dedup":
            assert set(new) == {d for d, _, c in brute_groups(list(old.items())) if d == c}
        before = after
    mixed = stage(corpus_pipeline.mix_sources(spark, before, SF), "t")
    assert mixed.columns == docs.columns
    whole = dict(before.select("doc_id", "text").collect())
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed.collect())
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


@pytest.mark.parametrize("name,apply", corpus_pipeline.STAGES)
def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, name, apply):
    """Rows without an id, one id many times, and columns named like internal ones: each row is a document
    of its own, and every column comes back."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    many = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(7)).when(F.col("doc_id") % 3 == 1, F.col("doc_id")))
    wide = many.unionByName(many).withColumns({"__row": F.lit("u"), "__MIX_SIZE": F.lit(5), "row": F.col("text")})
    wide = stage(wide, "t")
    out = apply(spark, wide, SF)
    if name == "packing":
        tokens = out.groupBy("doc_id", "doc_crc32").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one")).collect()
        assert all(r["n"] % r["one"] == 0 for r in tokens) and sum(r["n"] // r["one"] for r in tokens) == wide.count()
        return
    assert out.columns == wide.columns
    got = out.collect()
    assert got and all(r["__row"] == "u" and r["__MIX_SIZE"] == 5 for r in got)
    if name != "source_mixing":
        assert all(r["row"] == r["text"] for r in got)
        texts = {r["text"] for r in wide.collect()}
        kept = [r["text"] for r in got]
        assert set(kept) <= texts
        if name == "exact_dedup":
            assert sorted(kept) == sorted(texts)
        if name == "minhash_near_dedup":
            groups = brute_groups(list(enumerate(sorted(texts))))
            assert len(kept) == len({c for _, n, c in groups if n}) + sum(r["text"] in {t for t, (_, n, _) in zip(sorted(texts), groups, strict=True) if not n} for r in wide.collect())
    else:
        words = lambda t: len((t or "").split())
        assert sum(words(r["text"]) for r in got) == pytest.approx(1.5 * sum(words(r["text"]) for r in wide.collect()), rel=0.05)


@pytest.mark.parametrize("name,apply", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, apply):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IS NULL")
    assert apply(spark, empty, SF).count() == 0
