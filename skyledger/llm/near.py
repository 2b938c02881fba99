"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import Memo, keyed, mix64, over_batches, share_of
from skyledger.llm.components import components
from skyledger.session import stage

WIDTH = 5  # words of a shingle
BINS, ROWS = 256, 8  # of one permutation; bins a band. 32 bands find 0.85 with probability 0.99996
LINK = 85  # per cent of the union that two sets must share
ATTEMPTS = 1024  # probes an empty bin makes for a full one; sets below SMALLEST need none
SMALLEST = 6  # a smaller set can't reach 0.85 with any other set

ODD = 1024  # bits of a parity sketch

SIGNATURE = "doc_id long, row long, n_shingles long, digest binary, bands array<long>, odd array<long>"


def shingles(text: bytes | None, words: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of UTF-8 text; one for fewer words."""
    found = (text or b"").lower().split()  # on bytes both mean A-Z and \x20 \x09-\x0D alone
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    count = max(len(h) - WIDTH + 1, 1)
    total = np.full(count, len(h) if len(h) < WIDTH else WIDTH, dtype=np.uint64)
    for k in range(min(WIDTH, len(h))):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += h[k : k + count]
        total ^= total >> np.uint64(29)
    return np.unique(mix64(total))


def word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def probe_table() -> np.ndarray:
    """Bins that an empty bin asks in turn, the same for every document."""
    at = np.arange(ATTEMPTS * BINS, dtype=np.uint64).reshape(ATTEMPTS, BINS)
    return (mix64(at + np.uint64(1 << 40)) % np.uint64(BINS)).astype(np.int64)


def bands(sets: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The band keys of a set of at least ``SMALLEST`` sorted hashes.

    The top bits of a hash choose its bin and the smallest hash of a bin stays: one permutation. An
    empty bin copies the bin that its own sequence of probes hits first, which makes the copies
    independent of each other (optimal densification).
    """
    place = (sets >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    low = np.zeros(BINS, dtype=np.uint64)
    low[place[first]] = sets[first]
    full = np.zeros(BINS, dtype=bool)
    full[place[first]] = True
    start = 0
    empty = np.flatnonzero(~full)
    source = np.arange(BINS)
    while len(empty) and start < ATTEMPTS:
        asked = probes[start : start + 32][:, empty]
        hit = full[asked]
        found = hit.any(axis=0)
        source[empty[found]] = asked[hit.argmax(axis=0)[found], np.flatnonzero(found)]
        empty, start = empty[~found], start + 32
    source[empty] = place[0]
    rows = low[source].reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key + rows[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def parity(sets: np.ndarray) -> np.ndarray:
    """A bitmap in which every hash flips one bit. Two bitmaps differ in no more bits than there are
    hashes in only one of the two sets, so their distance proves that sets are too different."""
    flips = np.bincount((sets & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _sign():
    words, probes, none = word_hashes(), probe_table(), np.empty(0, dtype=np.int64)

    def work(batch: pa.RecordBatch) -> list:
        sizes, digests, keys, odd = [], [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(bands(s, probes) if len(s) >= SMALLEST else none)
            odd.append(parity(s) if len(s) >= SMALLEST else none)
        lists = [
            pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, v)]).astype(np.int32), pa.array(np.concatenate(v))
            )
            for v in (keys, odd)
        ]
        return [batch.column("doc_id"), batch.column("row"), sizes, digests, *lists]

    return work


def signatures(docs: DataFrame, row: str) -> DataFrame:
    """Per row: its key, the column ``row``; the size of its shingle set, a digest of the set, its band
    keys and its bitmap."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col(row).alias("row"), F.col("text").cast("binary").alias("text")
    )
    return over_batches(rows, _sign, SIGNATURE)


def _overlap():
    def work(batch: pa.RecordBatch) -> list:
        shared = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            both = np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)])
            both.sort(kind="stable")  # two sorted runs: a merge
            shared.append(int((both[1:] == both[:-1]).sum()))
        return [batch.column("a"), batch.column("b"), shared]

    return work


def _sets():
    words = word_hashes()

    def work(batch: pa.RecordBatch) -> list:
        found = [shingles(t.as_py(), words).tobytes() for t in batch.column("text")]
        return [batch.column("node"), found]

    return work


class _Verifier:
    """Confirms candidate pairs (a, b, n_a, n_b) on full sets, and remembers what it has seen.

    ``nodes`` are the row keys that stand for the candidate classes: each is read from one row.
    """

    def __init__(self, docs: DataFrame, row: str, nodes: DataFrame):
        texts = docs.select(F.col(row).alias("node"), F.col("text").cast("binary").alias("text"))
        # candidates grow with the corpus, so they are never broadcast: one plan at every size
        found = over_batches(nodes.hint("merge").join(texts, "node"), _sets, "node long, shingles binary")
        self.sets = stage(found, "near-sets")
        self.seen: DataFrame | None = None

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, both): pairs that were not seen yet and can reach the threshold by size."""
        fit = pairs.where(100 * F.least("n_a", "n_b") >= LINK * F.greatest("n_a", "n_b"))
        if self.seen is not None:
            fit = fit.join(self.seen.select("a", "b"), ["a", "b"], "left_anti")
        fit = stage(fit, "near-pairs")
        b = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        a = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        whole = fit.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
        shared = over_batches(whole, _overlap, "a long, b long, both long")
        done = stage(fit.join(shared, ["a", "b"]), "near-checked")
        self.seen = done if self.seen is None else self.seen.unionByName(done)
        return done


def _linked() -> Column:
    return 100 * F.col("both") >= LINK * (F.col("n_a") + F.col("n_b") - F.col("both"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 x shared >= 85 x all of their distinct five-word shingles;
    ``component_id`` is the smallest doc_id that links reach. A text without words (or null) links with
    nothing. Rows with the same set are one class from the start, so copies cost nothing further. A
    repeated doc_id is a document a row.

    1. Classes that share a bucket get one candidate edge each, to the first class of the bucket:
       a star, so a bucket of n classes has n - 1 edges. Edges are confirmed on full sets.
    2. A member whose edge failed may still link with others of its bucket. Members that are not yet
       in the component of the first centre become centres themselves, 8 a bucket, then 64 and so
       on, until none is left: all pairs of a bucket are compared but those that are linked already or
       that sizes or bitmaps prove to be too different. So no link between members of a bucket is
       lost, and groups of near copies never become all pairs.
    """
    rows, row = keyed(docs.select("doc_id", "text"), "near-rows")
    return _groups(rows, row).drop("row", "keep_row")


def _groups(docs: DataFrame, row: str) -> DataFrame:
    """The columns of ``near_groups``, the row key (the column ``row`` of ``docs``) and ``keep_row``: the
    one row of the component that stays, of equal ids the one with the smallest key."""
    signed = stage(signatures(docs, row), "near-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))
    classes = stage(
        signed.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("row").alias("node"), F.min("doc_id").alias("low"), first.alias("first"),
            F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"),
            F.any_value("odd").alias("odd"),
        ),
        "near-classes",
    )
    roots = _join_classes(docs, row, classes)
    named = classes.select("digest", "node", "low", "first").join(
        roots.withColumnRenamed("component", "root"), "node", "left"
    )
    named = stage(named.withColumn("root", F.coalesce("root", "node")), "near-named")
    smallest = named.groupBy("root").agg(
        F.min("low").alias("component_id"), F.min("first").getField("row").alias("keep_row")
    )
    groups = named.join(smallest, "root").select("digest", "component_id", "keep_row")
    out = (
        signed.where("n_shingles > 0")
        .select("doc_id", "n_shingles", "digest", "row")
        .join(groups, "digest")
        .select("doc_id", "n_shingles", "component_id", "row", "keep_row")
        .unionByName(
            signed.where("n_shingles = 0").select(
                "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row",
                F.col("row").alias("keep_row"),
            )
        )
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _join_classes(docs: DataFrame, row: str, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that link with another one."""
    spread = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = (
        spread.groupBy("key")
        .agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size"))
        .where("size > 1")
    )
    members = stage(
        spread.join(shared.select("key", "first"), "key").select(
            "key", "node", "n", F.col("first.node").alias("centre"), F.col("first.n").alias("n_centre")
        ),
        "near-members",
    )
    verify = _Verifier(docs, row, members.select("node").distinct())
    star = members.where("node <> centre").select(
        F.col("centre").alias("a"), F.col("node").alias("b"),
        F.col("n_centre").alias("n_a"), F.col("n").alias("n_b"),
    ).distinct()
    checked = verify(star)
    links = checked.where(_linked()).select("a", "b")
    roots = stage(components(links), "near-roots")

    # everything but the first centres, which are done
    rest = stage(members.where("node <> centre").select("key", "node", "n", "centre"), "near-rest")
    centres, turn = 8, 1
    while True:
        of_node = roots.withColumnRenamed("component", "root")
        of_centre = roots.select(F.col("node").alias("centre"), F.col("component").alias("main"))
        placed = (
            rest.join(of_node, "node", "left")
            .join(of_centre, "centre", "left")
            .withColumn("root", F.coalesce("root", "node"))
            .withColumn("main", F.coalesce("main", "centre"))
        )
        outside = F.col("root") != F.col("main")
        open_keys = (
            placed.where(outside)
            .groupBy("key")
            .agg(F.count("*").alias("open"), F.min("node").alias("next"))
        )
        # a bucket is done when all its members have the root of its first centre
        active = stage(
            placed.join(open_keys, "key").join(classes.select("node", "odd"), "node"), "near-active"
        )
        if active.isEmpty():
            return roots
        chosen = outside & (
            (F.col("node") == F.col("next"))
            | (share_of(F.col("node"), turn) < F.lit(float(centres)) / F.col("open"))
        )
        active = active.withColumn("chosen", chosen)
        x, y = active.where("chosen").alias("x"), active.alias("y")
        differ = sum(
            (F.bit_count(F.col("x.odd")[k].bitwiseXOR(F.col("y.odd")[k])) for k in range(ODD // 64)),
            F.lit(0),
        )
        # 100 shared >= 85 all, in terms of what only one of them has
        near = (200 - (100 - LINK)) * differ <= (100 - LINK) * (F.col("x.n") + F.col("y.n"))
        sizes = 100 * F.least("x.n", "y.n") >= LINK * F.greatest("x.n", "y.n")
        pairs = (
            x.join(
                y,
                (F.col("x.key") == F.col("y.key"))
                & (F.col("x.root") != F.col("y.root"))
                & (~F.col("y.chosen") | (F.col("x.node") < F.col("y.node")))
                & near
                & sizes,
            )
            .select(
                F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
                F.when(F.col("x.node") < F.col("y.node"), F.col("x.n")).otherwise(F.col("y.n")).alias("n_a"),
                F.when(F.col("x.node") < F.col("y.node"), F.col("y.n")).otherwise(F.col("x.n")).alias("n_b"),
            )
            .distinct()
        )
        found = verify(pairs).where(_linked()).select("a", "b")
        if not found.isEmpty():
            stars = roots.select(F.col("node").alias("a"), F.col("component").alias("b"))
            roots = stage(components(stars.unionByName(found)), "near-roots")
        rest = stage(active.where(~F.col("chosen")).select(*rest.columns), "near-rest")
        centres, turn = centres * 8, turn + 1


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id, null last.

    Rows go by the row key of a staged copy, which also decides between equal ids. Texts without words
    are no group and stay.
    """
    rows, row = keyed(docs, "near-rows")
    dropped = _groups(rows, row).where("row <> keep_row").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").drop(row)
