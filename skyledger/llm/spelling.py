"""Spelling variants: words one edit apart, found with bitsets per (position, letter) of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import stage

SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
EVERY = 31  # a run loses a letter if this divides its hash
TIMES = 10  # a form occurs this many times as often as its variant
HELD = 200_000  # distinct words that a task counts before it hands them on
SHARD = 16_384  # entries of a shard past which it is cut into tiles
BLOCK = 1024  # entries, at least, that share a set of bitsets

COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def lose_letter(word: str, start: int) -> str:
    """``word`` without the code point that its hash names, if the hash asks for it; ``start`` is the
    crc32 of what stands before the word."""
    h = zlib.crc32(word.encode(), start)
    if h % EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(batches):
    # maximal runs: a shorter run can't match, a longer one matches from its first letter
    runs = re.compile("[a-zA-ZÀ-ÿ]{%d,}" % SHORTEST)
    found: Counter = Counter()

    def hand_on():
        words, n = list(found), list(found.values())
        found.clear()
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at : at + 50_000], pa.string()), pa.array(n[at : at + 50_000], pa.int64())],
                schema=COUNTED,
            )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            start = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
            lowered = text.as_py().lower().decode()  # of bytes: A-Z alone
            for run, n in Counter(runs.findall(lowered)).items():
                word = lose_letter(run, start)
                if len(word) >= SHORTEST:
                    found[word] += n
            if len(found) >= HELD:
                yield from hand_on()
    yield from hand_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all whole texts that occur at least twice."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _entries(words: DataFrame) -> DataFrame:
    """Every word in the shards where a word one edit away may stand.

    An edit leaves the letters before it and those behind it as they are, so two words of which the
    shorter has m letters share their first or their last m // 2 letters. A shard holds the words of m
    and of m + 1 letters that agree in one such half.
    """
    m, word = F.length("word"), F.col("word")

    def entry(side: int, letters: Column, core: bool) -> Column:
        half = (letters / 2).cast("int")
        part = F.substring(word, F.lit(1), half) if side == 0 else F.right(word, half)
        return F.struct(
            letters.alias("letters"), F.lit(side).alias("side"), part.alias("part"), F.lit(core).alias("core")
        )

    own = F.array(entry(0, m, True), entry(1, m, True))
    below = F.array(entry(0, m - 1, False), entry(1, m - 1, False))
    every = F.when(m > SHORTEST, F.concat(own, below)).otherwise(own)
    return words.select("word", "n", F.explode(every).alias("e")).select("word", "n", "e.*")


class Slices:
    """Bit-sliced words: for a position and a letter the set of words that have the letter there."""

    def __init__(self, codes: np.ndarray, letters: int):
        self.codes, self.letters = codes, letters

    def at(self, position: int) -> np.ndarray:
        """(letter, words of 64 bits); letter 0 is no letter, and the set of nothing."""
        column = self.codes[:, position] if position < self.codes.shape[1] else np.zeros(len(self.codes), np.uint8)
        hits = column[None, :] == np.arange(self.letters, dtype=np.uint8)[:, None]
        hits[0] = False
        return pack(hits)


def pack(flags: np.ndarray) -> np.ndarray:
    """Booleans of the last axis as unsigned 64-bit words."""
    wide = -(-flags.shape[-1] // 64) * 64
    room = np.zeros((*flags.shape[:-1], wide), dtype=bool)
    room[..., : flags.shape[-1]] = flags
    return np.packbits(room, axis=-1, bitorder="little").view(np.uint64)


def letter_codes(words: list[str], width: int) -> np.ndarray:
    """One row of letter numbers per word, 0 behind its end. The alphabet is a-z and U+00C0 to U+00FF."""
    raw = np.array([w.encode("latin-1") for w in words], dtype=f"S{width}")
    flat = raw.view(np.uint8).reshape(len(words), width)
    return np.where(flat >= 0xC0, flat - (0xC0 - 27), np.where(flat > 0, flat - 96, 0)).astype(np.uint8)


LETTERS = 27 + 64


def one_edit(queries: np.ndarray, members: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) one edit apart: queries have ``length`` letters, members that or one more.

    Letter by letter, three sets are kept per query, as bits over all members: ``same`` agrees with
    all letters so far, ``changed`` with all but one at the same positions, ``longer`` agrees after one
    inserted letter, so that its position runs ahead by one.
    """
    slices, full = Slices(members, LETTERS), pack(np.ones(len(members), dtype=bool))
    is_long = members[:, length] > 0
    out = []
    for a in range(0, len(queries), step := max(64, (1 << 17) // len(full))):
        q = queries[a : a + step]
        same = np.repeat(full[None, :], len(q), axis=0)
        changed, longer = np.zeros_like(same), same.copy()
        here = slices.at(0)
        for i in range(length):
            ahead = slices.at(i + 1)
            hit = here[q[:, i]]
            changed &= hit
            changed |= same & ~hit
            same &= hit
            longer &= ahead[q[:, i]]
            longer |= same
            here = ahead
        found = (changed & pack(~is_long)) | (longer & pack(is_long))
        i, w = np.nonzero(found)
        bits = np.unpackbits(found[i, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, b = np.nonzero(bits)
        out.append((i[k] + a, w[k] * 64 + b))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _meet(block: pa.Table, shard: np.ndarray) -> list:
    """Columns of ``FOUND`` for the entries of whole shards of one length."""
    words = block.column("word").to_pylist()
    length = block.column("letters")[0].as_py()
    n, core, side, bucket, cross = (
        block.column(c).to_numpy() for c in ("n", "core", "side", "bucket", "cross")
    )
    codes = letter_codes(words, length + 1)
    queries = np.flatnonzero(core)
    if not len(queries):
        return []
    i, y = one_edit(codes[queries, :length], codes, length)
    x = queries[i]
    mine = (shard[x] == shard[y]) & (~cross[x] | (bucket[x] != bucket[y]))
    x, y = x[mine], y[mine]
    # a pair that shares both halves counts in the shard of its first half
    half = length // 2
    mine = (side[x] == 0) | (codes[x, :half] != codes[y, :half]).any(axis=1)
    x, y = x[mine], y[mine]
    up = ~core[y]
    x, y = np.concatenate([x, y[up]]), np.concatenate([y, x[up]])
    if not len(x):
        return []
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    word = block.column("word")
    return [
        word.take(pa.array(x[first])), np.diff(np.append(first, len(x))),
        word.take(pa.array(y[first])), n[y[first]],
    ]


def _match(batches):
    """Whole shards, several at a time if they are small, from rows sorted by shard."""
    names = ("letters", "side", "part", "low", "high")

    def cut(rows: pa.Table, last: bool):
        """Splits rows into blocks of whole shards; returns what may still grow."""
        total = rows.num_rows
        change = np.zeros(total, dtype=bool)
        change[:1] = True
        letters = rows.column("letters").to_numpy()
        for name in names:
            codes = rows.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.append(np.flatnonzero(change), total)
        shard = np.cumsum(change)
        begin, blocks = 0, []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if letters[s] != letters[begin]:
                blocks.append((begin, int(s)))
                begin = int(s)
            if e - begin >= BLOCK and e < total:
                blocks.append((begin, int(e)))
                begin = int(e)
        if last and begin < total:
            blocks.append((begin, total))
            begin = total
        return [(rows.slice(s, e - s), shard[s:e]) for s, e in blocks if s < e], rows.slice(begin)

    def emit(blocks):
        for block, shard in blocks:
            columns = _meet(block, shard)
            if columns:
                made = [
                    (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)).cast(t)
                    for c, t in zip(columns, FOUND.types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(made, schema=FOUND)

    held = None
    for batch in batches:
        if batch.num_rows:
            new = pa.Table.from_batches([batch])
            held = new if held is None or not held.num_rows else pa.concat_tables([held, new])
            blocks, held = cut(held, False)
            yield from emit(blocks)
    if held is not None and held.num_rows:
        yield from emit(cut(held, True)[0])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near word: ``best`` is the near word of
    largest n, of equal ones the first in code-point order.

    A shard of more than ``SHARD`` entries is cut into tiles: entries are dealt over k buckets, and a
    tile holds two of them (or one), so that every pair of entries meets in exactly one tile.
    """
    entries = _entries(words)
    shard = ["letters", "side", "part"]
    large = stage(
        entries.groupBy(*shard).agg(F.count("*").alias("size")).where(F.col("size") > SHARD)
        .select(*shard, F.ceil(F.col("size") / SHARD).cast("int").alias("k")),
        "spelling-large",
    )
    dealt = (
        entries.join(large, shard, "left")
        .withColumn("k", F.coalesce("k", F.lit(1)))
        .withColumn("bucket", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select(
            "word", "n", "core", "bucket", *shard, F.least("bucket", "other").alias("low"),
            F.greatest("bucket", "other").alias("high"),
        )
        .withColumn("cross", F.col("low") != F.col("high"))
    )
    group = [*shard, "low", "high"]
    found = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_match, "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms. Every step is at least ``TIMES`` as frequent, so a
    chain has no circle and under 20 steps; each round doubles how far a word sees."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(now.join(ahead, "root", "left").select("word", "root", "further"), "spelling-roots")
        if moved.where("further IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; where 31 divides
    the crc32 of ``<doc_id>:<run>`` the run loses the letter number hash % length. Those of at least
    7 letters and 2 occurrences in all count. Two words are near if one inserted, deleted or replaced
    letter turns one into the other. ``form`` is the near word of largest n (of equal ones the smallest
    in code-point order) if it occurs at least 10 times as often, ``root`` where following forms ends.

    A null text has no words, a null doc_id stands as nothing before the colon; every row counts, also
    those with equal ids. Words of any length are compared whole. No words: no rows.
    """
    words = stage(vocabulary(docs), "spelling-words")
    near = near_words(words)
    named = stage(
        words.join(near, "word", "left").withColumn(
            "fits", F.col("best_n") >= F.lit(TIMES) * F.col("n")
        ).select(
            "word", F.when(F.col("fits"), F.col("best")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("fits"), F.col("best_n")).alias("form_n"),
        ),
        "spelling-named",
    )
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
