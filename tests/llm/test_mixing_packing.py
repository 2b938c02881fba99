"""Source mixing against one-by-one apportionment, and packing as an exact round trip."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyledger.llm import mixing, packing
from skyledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string"


def sainte_lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("weights,seats", [
    ([53, 24, 23], 7), ([5, 5, 5, 5], 6), ([1000, 1, 1, 1], 50), ([3], 9), ([0, 4, 0, 1], 11),
    ([7, 1, 1, 1, 1, 1, 1, 1, 1, 1], 40), ([9, 8, 7, 6, 5, 4, 3, 2, 1], 0),
])
def test_apportionment_equals_one_seat_at_a_time(rows, weights, seats):
    parts = rows([(1, i, float(w), seats) for i, w in enumerate(weights)], "g int, part int, w double, seats long")
    got = {r["part"]: r["quota"] for r in mixing.apportion(parts, ["g"], "w", "seats").collect()}
    assert [got[i] for i in range(len(weights))] == sainte_lague(weights, seats)


def test_targets_stop_at_the_cap_and_share_the_rest(rows):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 10, None: 400}
    out = mixing.targets(rows(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2)
    got = {r["source"]: r["target"] for r in out.collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [k for k in sizes if k not in want]
        level = (total - sum(want.values())) / sum(weights[k] for k in free)
        over = [k for k in free if level * weights[k] > 2 * sizes[k]]
        if not over:
            break
        want |= {k: 2.0 * sizes[k] for k in over}
    want |= {k: level * weights[k] for k in free}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_mix_cases(rows):
    docs = [(i, "w " * (i % 40), f"s{i % 3}" if i % 7 else None) for i in range(200)]
    docs += [(900, None, "s0"), (901, "", "s1"), (902, "x " * 60_000, "long"), (903, " \x0b\n", "blank"), (5, "again", "s1")]
    got = mixing.mix(rows(docs, DOCS)).collect()
    assert len(got) == len(docs)
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1:] = [r["target"], r["source_size"]]
    for taken, target, _ in per.values():
        assert abs(taken - target) <= 16
    assert sum(p[1] for p in per.values()) == pytest.approx(1.5 * sum(p[2] for p in per.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(rows(docs, DOCS)).collect())) or None in per


@pytest.mark.parametrize("weights,room,seats", [
    ([53, 24, 23], [2, 10, 10], 12), ([8, 1, 1, 1, 1, 1, 1], [2, 1, 1, 1, 1, 1, 1], 7), ([9, 9, 3], [3, 3, 1], 20),
    ([400, 1, 1, 1, 1, 1, 1], [100, 1, 1, 1, 1, 1, 1], 90), ([5], [2], 3), ([4, 4, 4, 4], [1, 1, 1, 1], 3),
])
def test_apportionment_within_room_equals_one_seat_at_a_time(rows, weights, room, seats):
    parts = rows([(1, i, float(w), r, seats) for i, (w, r) in enumerate(zip(weights, room, strict=True))],
                 "g int, part int, w double, room long, seats long")
    got = {r["part"]: r["quota"] for r in mixing.apportion(parts, ["g"], "w", "seats", "room").collect()}
    want = [0] * len(weights)
    for _ in range(min(seats, sum(room))):
        able = [i for i in range(len(weights)) if want[i] < room[i]]
        want[max(able, key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
    assert [got[i] for i in range(len(weights))] == want


def test_small_sources_reach_their_target_whatever_the_others_are(spark):
    """A source of one-word documents beside sources a thousand times larger, in many shards and groups."""
    from pyspark.sql import functions as F

    big = spark.range(200_000).select(
        F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 9).cast("int")), " ").alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("c").alias("source"),
    )
    small = spark.range(100).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit("one").alias("text"), F.lit("b").alias("source"))
    out = mixing.mix(big.unionByName(small)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count_distinct("shard").alias("shards"),
        F.max(F.col("taken") - 2 * F.col("size")).alias("over"),
    )
    for r in out.collect():
        assert r["over"] <= 0 and abs(r["taken"] - r["target"]) <= 8 * r["shards"]
        assert abs(r["taken"] - r["target"]) <= max(8, 2e-4 * r["target"])
        assert r["shards"] == (1 if r["source"] == "b" else r["shards"]) and (r["source"] == "b" or r["shards"] > 40)


def test_hot_and_null_ids_are_spread_over_shards(rows, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_SHARD", 50)
    data = [(None, f"text {k}", "s") for k in range(1500)] + [(7, "the same text", "s")] * 1500
    data += [(7, f"other {k}", "t") for k in range(500)] + [(None, None, "s")] * 700
    got = mixing.mix(rows(data, DOCS)).collect()
    assert len(got) == len(data)
    per = defaultdict(int)
    for r in got:
        per[r["source"], r["shard"]] += r["size"] > 0
    assert max(per.values()) < 200 and len(per) > 40
    for s in ("s", "t"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 16
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"], r["source"]) for r in rs)
    assert key(got) == key(mixing.mix(rows(data, DOCS).repartition(7)).collect())


def test_columns_named_like_row_keys(rows):
    data = [(i, "w " * (i % 7), "s", "u", 5, "v") for i in range(60)]
    wide = rows(data, DOCS + ", __row string, __mix_size int, `__MIX_TAKEN` string")
    out = mixing.apply_mix(wide)
    assert out.columns == wide.columns
    assert {(r["__row"], r["__mix_size"], r["__MIX_TAKEN"]) for r in out.collect()} == {("u", 5, "v")}


def test_packing_after_a_mix_can_be_written_out(rows):
    """Copies of a document, whole and cut, and rows with null and equal ids."""
    data = [(1, "some words here and there", "s")] * 3 + [(1, "other words", "s"), (None, "nobody's words", "t"), (None, "x", "t")]
    data += [(k, f"text {k} " * 40, "s") for k in range(20, 60)]
    mixed = mixing.apply_mix(rows(data, DOCS))
    packed = packing.pack(mixed, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"], tuple(tokenizer.encode(r["text"], add_special_tokens=False).ids + [2])] += 1
    found = packing.tokens(mixed, packed, PATH).collect()
    places = [(r["sequence_id"], r["offset"]) for r in found]
    assert len(set(places)) == len(places) == packed.count()
    rows_of = {(r["sequence_id"], r["offset"]): r for r in packed.collect()}
    pieces = defaultdict(Counter)
    for r in found:
        p = rows_of[r["sequence_id"], r["offset"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == p["length"]
        pieces[p["doc_id"], p["doc_crc32"]][p["start"], p["length"], tuple(r["ids"])] += 1
    for (doc_id, ids), times in want.items():
        mine = pieces[doc_id, zlib.crc32(np.array(ids, dtype="<u4").tobytes())]
        flat = Counter()
        for (start, length, part), n in mine.items():
            assert ids[start : start + length] == part
            flat.update(dict.fromkeys(range(start, start + length), n))
        assert set(flat.values()) == {times} and len(flat) == len(ids)


def test_words_are_remembered_in_two_generations():
    words = packing.Words(PATH, limit=2000)
    texts = [f"alpha{k} beta gamma{k}!" for k in range(200)]
    want = [packing.Words(PATH).tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    got = [np.frombuffer(packing.token_bytes(t.encode(), words), dtype="<u4").tolist() for t in texts]
    assert got == want and b"beta" in words.known and len(words.known) + len(words.older) < 60


def test_mix_of_nothing(rows):
    assert mixing.mix(rows([], DOCS)).count() == 0
    assert [r["taken"] for r in mixing.mix(rows([(1, None, "a"), (2, "", None)], DOCS)).collect()] == [0, 0]


def test_applied_mix_holds_the_words_taken(rows):
    docs = rows([(i, f"a{i}  b\nc d e" * (i % 5), "s" if i % 4 else "t", i, "v") for i in range(60)],
                DOCS + ", size int, taken string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words, texts = defaultdict(int), {r["doc_id"]: r["text"] for r in docs.collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_applied_mix_of_null_and_repeated_ids(rows):
    ids = [None, None, None, 7, 7, 7, 7, *range(20, 40)]
    docs = rows([(d, " ".join([f"t{k}"] * (5 + k % 4)), "s" if k % 3 else "t") for k, d in enumerate(ids)], DOCS)
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"]
    sizes = {r["text"].split()[0]: len(r["text"].split()) for r in docs.collect()}
    for r in mixing.apply_mix(docs).collect():
        words = r["text"].split()
        got[r["doc_id"], r["source"], sizes[words[0]]] += len(words)
        assert len(set(words)) == 1
    assert dict(got) == {k: v for k, v in want.items() if v} and any(k[0] is None for k in got)


def test_mix_plan_has_no_python(spark):
    plan = QUERIES["op2_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def check_packing(docs, pieces):
    tokenizer = Tokenizer.from_file(PATH)
    left = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        left[doc_id].append(ids)
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        spans[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    if all(len(v) == 1 for v in left.values()):
        for doc_id, (ids,) in left.items():
            at = 0
            for p in sorted(spans.pop((doc_id, len(ids))), key=lambda p: p["start"]):
                assert p["start"] == at and p["length"] > 0
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
            assert at == len(ids)
        assert not spans
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert total == sum(len(x) for v in left.values() for x in v)
    return padding, total


def test_packing_cases(rows):
    docs = [
        (1, None), (2, ""), (3, "Hello  wörld's <|endoftext|> É́\x1f x 日本 🙂"), (4, "word " * 30_000),
        (5, " ".join(["w"] * 4095)), (6, " ".join(["w"] * 4096)), (7, " ".join(["w"] * 63)),
        *((10 + i, " ".join(["a b"] * (i * 13))) for i in range(150)),
    ]
    wide = rows([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, kind int, part string")
    padding, total = check_packing(docs, packing.pack(wide, PATH).collect())
    assert padding <= 2 * packing.WINDOW


def test_packing_of_one_length_only_and_repeated_rows(rows):
    docs = [(i % 50, "a " * 2600) for i in range(60)]
    padding, total = check_packing(docs, packing.pack(rows(docs, "doc_id long, text string"), PATH).collect())
    assert padding <= 2 * packing.WINDOW
    assert packing.pack(rows([], "doc_id long, text string"), PATH).count() == 0


def test_packing_query_is_a_round_trip(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    padding, total = check_packing(docs, QUERIES["op10_packing"](spark, SF).collect())
    assert padding < 0.05 * total


def test_tokens_follow_their_spans(rows):
    docs = rows([(i, f"some words of text {i} " * 90) for i in range(12)], "doc_id long, text string")
    packed = packing.pack(docs, PATH)
    crc = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packed.collect()}
    for r in packing.tokens(docs, packed, PATH).collect():
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == crc[r["sequence_id"], r["offset"]]


def test_least_squares_is_not_negative_and_close():
    draw = np.random.default_rng(4)
    use = packing.combinations()
    assert ((use.T @ np.arange(packing.SLOTS)) == packing.SLOTS).all()
    wanted = use @ np.floor(draw.random(use.shape[1]) * 3 * (draw.random(use.shape[1]) < 0.02))
    x = packing.non_negative_least_squares(use, wanted)
    assert (x >= 0).all() and np.abs(use @ x - wanted).max() < 1e-6


def test_plan_places_every_piece_once():
    draw = np.random.default_rng(5)
    counts = {int(k): int(draw.integers(0, 40)) for k in range(1, 65)}
    counts |= {packing.CRUMB + k: int(draw.integers(0, 200)) for k in range(1, 64)}
    plan = packing.Plan(counts)
    used = defaultdict(list)
    for k in range(1, 64):
        if plan.taken[k]:
            window, unit = plan.whole(k, np.arange(plan.taken[k]))
            for w, u in zip(window, unit, strict=True):
                used[int(w)].append((int(u), k))
        window, offset = plan.crumb(k, np.arange(counts[packing.CRUMB + k]))
        for w, o in zip(window, offset, strict=True):
            used[int(w)].append((int(o) , k))
    for w, parts in used.items():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at == 64 if w < plan.rest_window else at <= packing.WINDOW
