"""Exact and near duplicates of documents: edge cases and comparison with brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import exact, near
from skyledger.llm.components import components
from skyledger.llm.queries import QUERIES
from skyledger.session import stage

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
LONG = "word " * 400_000


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_cases(rows):
    data = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, LONG), (6, LONG + "."), (7, LONG), (8, "A"), (9, "a ")]
    got = by_id(exact.mark_copies(rows(data, DOCS)))
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()} == {
        1: (4, 2, False), 4: (4, 2, True), 2: (3, 2, False), 3: (3, 2, True), 5: (7, 2, False),
        7: (7, 2, True), 6: (6, 1, True), 8: (8, 1, True), 9: (9, 1, True),
    }
    assert got[1]["text_sha256"] == hashlib.sha256(b"a").hexdigest()
    assert got[2]["text_sha256"] == hashlib.sha256(b"").hexdigest()


def test_exact_smallest_and_normalised(rows):
    got = by_id(exact.mark_copies(rows([(1, "A b"), (2, "a b"), (3, "c")], DOCS), F.lower("text"), keep="smallest"))
    assert [got[i]["keep_id"] for i in (1, 2, 3)] == [1, 1, 3]
    with pytest.raises(ValueError):
        exact.mark_copies(rows([(1, "a")], DOCS), keep="any")


def test_exact_groups_over_many_partitions(spark):
    """A third of all rows are copies of one text; runs go over the partitions' edges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = spark.range(9000).select(
            F.col("id").alias("doc_id"),
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"),
        ).repartition(7)
        got = exact.mark_copies(data)
        want = data.groupBy("text").agg(F.max("doc_id").alias("k"), F.count("*").alias("n"))
        both = got.join(data, "doc_id").join(want, "text")
        assert both.count() == 9000
        assert both.where("keep_id <> k OR group_size <> n OR kept <> (doc_id = k)").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exact_empty_repeated_and_clashing_columns(rows):
    assert exact.mark_copies(rows([], DOCS)).count() == 0
    again = exact.mark_copies(rows([(1, "a"), (1, "a"), (None, "a")], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in again) == [
        (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    wide = rows([(1, "a", "x", 7), (2, "a", "y", 8)], DOCS + ", sha string, part int")
    assert exact.drop_copies(wide).collect() == [(2, "a", "y", 8)]


def shingle_sets(docs):
    out = []
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        out.append((doc_id, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_groups(docs):
    """Smallest doc_id that links reach, from all pairs."""
    sets = shingle_sets(docs)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for group in holders.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 85 * len(a | b):
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
    low = {}
    for i, (doc_id, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return [(d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)]


def near_rows(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def edited_copies(count: int, seed: int):
    """Copies of one text with more and more edits: every likeness from 0.3 to 1."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(count):
        words = list(base)
        for _ in range(draw.randrange(0, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10_000)}"
        docs.append((1000 - i, " ".join(words)))
    return docs


def test_near_group_of_edited_copies_equals_brute_force(rows):
    docs = edited_copies(120, 1) + [(2000 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(20)]
    assert near_rows(near.near_groups(rows(docs, DOCS))) == sorted(brute_groups(docs))


def test_near_cases(rows):
    base = [f"w{k}" for k in range(60)]
    docs = [
        (5, " ".join(base)), (4, " ".join(base).upper()), (3, "\t" + "\n ".join(base)),
        (2, " ".join(base[:-1])), (9, None), (8, ""), (7, " \n\t"), (6, "one two"), (1, "ONE  two"),
        (10, "two one"), (11, "école É"), (12, "école é"),
        (13, " ".join(f"v{k}" for k in range(200_000))), (14, " ".join(f"v{k}" for k in range(199_000))),
    ]
    got = near_rows(near.near_groups(rows(docs, DOCS)))
    assert got == sorted(brute_groups(docs))
    assert {d: c for d, _, c in got}[13] == 13 and {d: c for d, _, c in got}[14] == 13


def test_near_empty_repeated_and_clashing_columns(rows):
    assert near.near_groups(rows([], DOCS)).count() == 0
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "something else"), (None, "a b c d e f g")]
    got = near.near_groups(rows(docs, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [
        (0, 3, 1, False), (1, 1, 1, True), (1, 3, 1, True), (1, 3, 1, True)]
    wide = rows([(1, "a b", "x", 3), (2, "A b", "y", 4)], DOCS + ", digest string, node int")
    assert near.drop_near_copies(wide).collect() == [(1, "a b", "x", 3)]


LEAF = "one two three four five six seven eight"
REPEATED = [(5, LEAF), (9, LEAF), (5, "unique of its own"), (3, "same row"), (3, "same row"), (None, "null id only"),
            (None, "null id only"), (None, LEAF), (None, "null and one"), (1, "null and one"), (None, "alone")]


@pytest.mark.parametrize("keep,leaf", [("largest", 9), ("smallest", 5)])
@pytest.mark.parametrize("parts", [1, 4])
def test_exact_drop_keeps_one_row_of_each_text(rows, keep, leaf, parts):
    got = exact.drop_copies(rows(REPEATED, DOCS).repartition(parts), keep=keep).collect()
    want = {(leaf, LEAF), (5, "unique of its own"), (3, "same row"), (None, "null id only"), (1, "null and one"), (None, "alone")}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_near_drop_keeps_one_row_of_each_group(rows):
    docs = [(d, t.upper() if k % 2 else t) for k, (d, t) in enumerate(REPEATED)] + [(3, None), (3, ""), (None, " ")]
    got = near.drop_near_copies(rows(docs, DOCS)).collect()
    words = [(r["doc_id"], r["text"].lower()) for r in got if (r["text"] or "").strip()]
    want = {(5, LEAF), (5, "unique of its own"), (3, "same row"), (None, "null id only"), (1, "null and one"), (None, "alone")}
    assert len(words) == len(want) and set(words) == want and len(got) == len(want) + 3


@pytest.mark.parametrize("name", ["__row", "__ROW", "row"])
def test_columns_named_like_row_keys(rows, name):
    docs = [(k, f"{LEAF} {k // 2} {k // 2}" if k < 6 else "x y z", 7) for k in range(8)]
    wide = rows(docs, DOCS + f", {name} int")
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(wide).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6}
    for drop, kept in ((exact.drop_copies, {1, 3, 5, 7}), (near.drop_near_copies, {0, 2, 4, 6})):
        out = drop(wide)
        assert out.columns == wide.columns and {(r["doc_id"], r[name]) for r in out.collect()} == {(k, 7) for k in kept}
    both = rows([(*d, "v") for d in docs], DOCS + ", __row int, ___row string")
    assert near.drop_near_copies(both).columns == both.columns and near.drop_near_copies(both).count() == 4


@pytest.mark.parametrize("doc_id", [None, 7])
def test_near_groups_read_one_row_a_class_whatever_the_ids(rows, monkeypatch, doc_id):
    """2,000 rows without an id, or with one id, in near pairs: no row is read more than once."""
    staged = {}

    def watch(df, label, **options):
        out = stage(df, label, **options)
        staged.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(near, "stage", watch)
    text = lambda k, end: " ".join(f"t{k}_{i}" for i in range(40)) + end
    docs = [(doc_id, text(k, end)) for k in range(1000) for end in ("", " more")]
    got = near.near_groups(rows(docs, DOCS)).collect()
    assert len(got) == 2000 and all(r["n_shingles"] in (36, 37) and r["component_id"] == doc_id for r in got)
    assert sum(s.count() for s in staged["near-sets"]) == 2000
    assert sum(s.count() for s in staged["near-checked"]) == 1000
    kept = near.drop_near_copies(rows(docs, DOCS)).collect()
    assert len(kept) == 1000 and len({r["text"].split()[0] for r in kept}) == 1000


def test_exact_copies_with_one_id_are_spread(spark):
    """Rows equal in text and id, a third of all, go over many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = spark.range(6000).select(
            F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
            F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("")).alias("text"),
        )
        marks = exact._marks(data, F.monotonically_increasing_id())
        hot = marks.where("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert marks.where("doc_id IS NULL AND (group_size <> 2000 OR NOT kept)").count() == 0
        assert marks.count() == 6000 and len(hot) > 1
        assert exact.drop_copies(data).count() == 4001
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmaps_never_rule_out_a_link():
    draw = np.random.default_rng(1)
    for n in (6, 50, 700, 9000):
        a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.95)], draw.integers(0, 2**63, 2, dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in (near.parity(a) ^ near.parity(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_bands_find_links_at_the_threshold():
    """Sets at likeness 0.85 share a band nearly always, sets at 0.3 hardly ever."""
    draw, probes = np.random.default_rng(2), near.probe_table()
    hits = {0.85: 0, 0.3: 0}
    for likeness in hits:
        for _ in range(300):
            n = int(draw.integers(40, 2000))
            shared = round(n * likeness)
            pool = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            half = shared + (n - shared) // 2
            a, b = np.sort(pool[:half]), np.sort(np.concatenate([pool[:shared], pool[half:]]))
            hits[likeness] += bool((near.bands(a, probes) == near.bands(b, probes)).any())
    assert hits[0.85] >= 299 and hits[0.3] <= 15


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 299), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(50))
    assert got[300] == 299 and len(got) == 93


def test_components_of_random_edges_and_of_stars_with_more(spark):
    """Sparse random graphs against a search; components found before, as stars, take further edges."""
    draw = np.random.default_rng(8)
    for nodes, count in ((400, 180), (400, 420), (60, 300)):
        edges = [tuple(map(int, e)) for e in draw.integers(0, nodes, (count, 2))]
        near_to: dict = {}
        for a, b in edges:
            if a != b:
                near_to.setdefault(a, set()).add(b)
                near_to.setdefault(b, set()).add(a)
        want: dict = {}
        for start in sorted(near_to):
            todo = [] if start in want else [start]
            while todo:
                node = todo.pop()
                if node not in want:
                    want[node] = start
                    todo += near_to[node]
        table = lambda rows: spark.createDataFrame(rows, "a long, b long")
        whole = components(table(edges))
        half = components(table(edges[: count // 2])).select(F.col("node").alias("a"), F.col("component").alias("b"))
        more = components(half.unionByName(table(edges[count // 2 :])))
        for got in (whole, more):
            assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_queries_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert near_rows(QUERIES["op6_minhash_near_dedup"](spark, SF)) == sorted(brute_groups(docs))
