"""Packing documents into token windows: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import string
import sys
import types
import unicodedata
import zlib
from collections import Counter
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import Memo, over_batches
from skyledger.session import stage

WINDOW, UNIT = 4096, 64
SLOTS = WINDOW // UNIT  # a window holds 64 units of 64 tokens
DEPTH = 4  # pieces of a combination
END = 2  # id after each document
CRUMB = 100  # kind of a piece shorter than a unit: CRUMB + its length
ROOM = WINDOW - UNIT + 1  # crumbs that start within so many tokens fit one window

CHUNK = 2 << 20  # bytes of text whose words are held at a time
KEPT = 80 << 20  # bytes of words that a generation of a worker's memory holds
ENTRY = 230  # bytes that a remembered word takes beside its letters and ids

PIECES = (
    "doc_id long, doc_tokens long, doc_crc32 long, start long, length long, kind int, part int, nth long, "
    "crcs array<long>"
)
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long, "
    "sequence_id long, offset long"
)


class Words:
    """The ids of blank-separated words, as bytes, from a vocabulary file.

    The vocabulary lower-cases, drops white space and never joins over it, so the ids of a text are
    those of its words, and a word is worked out once however often it comes. Most words are a run of
    letters and some signs, which the vocabulary takes apart: then only the letters are looked up, many
    in one call. Words are remembered in two generations of at most ``limit`` bytes: when the younger
    one is full it becomes the older one, and words of the older one that come again move back. What is
    forgotten is worked out again, so the limit bounds memory and changes no result.
    """

    def __init__(self, path: str, limit: int = KEPT):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case letters in normal form there is nothing to normalise and to take apart
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)  # ids with which a run ends
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held, self.limit = 0, limit

    @classmethod
    def of_worker(cls, path: str) -> Words:
        """The one instance of this Python worker, which lives on between its tasks.

        It is kept in a module of its own: functions that travel to the executors have new globals in
        every task.
        """
        name = "skyledger_worker"
        kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("words", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def split(self, text: bytes | None) -> list[bytes]:
        text = text or b""
        # the special tokens are written <|...|> and are not lower-cased before they are found
        return (text if b"<|" in text else text.lower()).split()

    def ids(self, words: list[bytes]) -> bytes:
        """The ids of words that were learned, and ``END``: little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, words)) + END.to_bytes(4, "little")

    def _encode(self, word: str) -> bytes:
        found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()

    def _runs(self, tokenizer, names: list[str]) -> dict[str, bytes]:
        """The ids of runs of letters, thousands in one call: each ends with an id that ends a run."""
        out: dict[str, bytes] = {}
        for at in range(0, len(names), 2000):
            part = names[at : at + 2000]
            joined = tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            found = np.array(joined[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[found])
            if len(last) == len(part) and last[-1] == len(found) - 1:
                raw, cuts = found.tobytes(), [0, *((last + 1) * 4).tolist()]
                out.update(zip(part, [raw[x:y] for x, y in pairwise(cuts)], strict=True))
            else:
                out.update((name, self._encode(name)) for name in part)
        return out

    def learn(self, texts: list[list[bytes]]) -> None:
        """Makes the ids of all these words known."""
        if self.held > self.limit:
            self.older, self.known, self.held = self.known, {}, 0
        words = set(chain.from_iterable(texts)).difference(self.known)
        again = words.intersection(self.older)
        for word in again:
            self._keep(word, self.older[word])
        words = list(words - again)
        if not words:
            return
        read = b" ".join(words).decode().split(" ")
        letters = [text.rstrip(string.punctuation) for text in read]
        runs = dict.fromkeys(x for x in letters if x.isalpha())
        plain = [x for x in runs if self._is_plain(x)]
        found = self._runs(self.plain, plain)
        found |= self._runs(self.tokenizer, [x for x in runs if x not in found])
        signs = Memo(self._encode)
        for word, text, run in zip(words, read, letters, strict=True):
            ids = found.get(run)
            if ids is None:
                self._keep(word, self._encode(text))
            elif len(run) == len(text):
                self._keep(word, ids)
            else:
                self._keep(word, ids + signs[text[len(run) :]])

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + ENTRY

    @staticmethod
    def _is_plain(run: str) -> bool:
        known = run.isascii() or (max(run) < "\u0250" and unicodedata.is_normalized("NFC", run))
        return known and run == run.lower()


def token_bytes(text: bytes | None, words: Words) -> bytes:
    """The ids of a whole text and ``END``."""
    found = words.split(text)
    words.learn([found])
    return words.ids(found)


def chunks(texts: pa.Array):
    """(first row, texts as bytes) of consecutive rows, about ``CHUNK`` bytes at a time."""
    first, rows, held = 0, [], 0
    for i, text in enumerate(texts):
        rows.append(text.as_py())
        held += len(rows[-1] or b"")
        if held >= CHUNK:
            yield first, rows
            first, rows, held = i + 1, [], 0
    if rows:
        yield first, rows


def _cut(path: str):
    def build():
        words, part, nth = Words.of_worker(path), TaskContext.get().partitionId(), Counter()

        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(9)]

            def put(*values):
                for column, v in zip(out, values, strict=True):
                    column.append(v)

            names = batch.column("doc_id").to_pylist()
            for first, rows in chunks(batch.column("text")):
                texts = [words.split(t) for t in rows]
                words.learn(texts)
                for doc_id, found in zip(names[first : first + len(rows)], texts, strict=True):
                    ids = memoryview(words.ids(found))
                    n, whole = len(ids) // 4, zlib.crc32(ids)
                    at = 0
                    while at < n:
                        left = n - at
                        if left >= WINDOW:
                            length, kind = WINDOW, SLOTS
                        elif left >= UNIT:
                            length, kind = left // UNIT * UNIT, left // UNIT
                        else:
                            length, kind = left, CRUMB + left
                        step = UNIT if kind < SLOTS else length
                        crcs, crc = [], 0
                        for k in range(at, at + length, step):
                            crc = zlib.crc32(ids[4 * k : 4 * (k + step)], crc)
                            crcs.append(crc)
                        put(doc_id, n, whole, at, length, kind, part, nth[kind], crcs)
                        nth[kind] += 1
                        at += length
            return out

        return work

    return build


def cut(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of every document: whole windows, whole units, and what is left (a crumb).

    ``nth`` numbers the pieces of a kind within the task that cut them; ``crcs`` are running
    checksums at each unit of a piece that may be cut again.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return over_batches(rows, _cut(path), PIECES)


def combinations(depth: int = DEPTH) -> np.ndarray:
    """Every way to fill a window exactly with 2 to ``depth`` pieces of whole units: kind x way."""
    ways: list[list[int]] = []

    def extend(parts: list[int], left: int) -> None:
        top = parts[-1] if parts else SLOTS - 1
        if left == 0:
            ways.append(parts)
        elif len(parts) < depth:
            for k in range(min(top, left), 0, -1):
                if k * (depth - len(parts)) >= left:
                    extend([*parts, k], left - k)

    extend([], SLOTS)
    use = np.zeros((SLOTS, len(ways)))
    for j, way in enumerate(ways):
        for k in way:
            use[k, j] += 1
    return use


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that brings a @ x closest to b: columns enter one by one while they still help."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    slack = 1e-9 * max(1.0, np.abs(b).max(initial=0.0))
    for _ in range(4 * a.shape[0] + 20):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > slack).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= slack
            move = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += min(move, 1.0) * (z - x[at])
            drop = at[low & (x[at] <= slack)]
            if len(drop) == 0:
                drop = at[low][:1]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


class Plan:
    """Where the i-th piece of a kind goes, from the number of pieces of every kind alone.

    Windows are: whole pieces of a window; the chosen combinations, as often as least squares and
    rounding down say; the other pieces end to end, cut where a window is full; crumbs end to end.
    """

    def __init__(self, counts: dict[int, int]):
        left = np.array([counts.get(k, 0) if 0 < k < SLOTS else 0 for k in range(SLOTS)])
        use = combinations()
        ideal = non_negative_least_squares(use, left.astype(float))
        next_window = counts.get(SLOTS, 0)
        taken = np.zeros(SLOTS, dtype=np.int64)
        slots: list[list[list[int]]] = [[] for _ in range(SLOTS)]  # first index, window, unit
        for j in np.argsort(-ideal, kind="stable"):
            kinds = np.flatnonzero(use[:, j])
            times = int(min([np.floor(ideal[j] + 1e-6), *(left[kinds] // use[kinds, j])]))
            if times <= 0:
                continue
            unit = 0
            for k in kinds:
                for _ in range(int(use[k, j])):
                    slots[k].append([int(taken[k]), next_window, unit])
                    taken[k] += times
                    left[k] -= times
                    unit += int(k)
            next_window += times
        self.slots = [np.array(s, dtype=np.int64).reshape(-1, 3) for s in slots]
        self.taken, self.rest_window = taken, next_window
        sizes = left * np.arange(SLOTS)
        self.rest_base = np.cumsum(sizes) - sizes  # in units
        self.crumb_window = next_window + -(-int(sizes.sum()) // SLOTS)
        crumbs = np.array([counts.get(CRUMB + k, 0) * k for k in range(UNIT)], dtype=np.int64)
        self.crumb_base = np.cumsum(crumbs) - crumbs

    def whole(self, kind: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and unit of pieces that go into combinations."""
        table = self.slots[kind]
        at = np.searchsorted(table[:, 0], i, side="right") - 1
        return table[at, 1] + i - table[at, 0], table[at, 2]

    def crumb(self, size: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of crumbs: those that start within the same ``ROOM`` tokens share one."""
        at = self.crumb_base[size] + i * size
        begin = at // ROOM * ROOM
        kind = np.maximum(np.searchsorted(self.crumb_base, begin, side="right") - 1, 1)
        step = -(-(begin - self.crumb_base[kind]) // kind) * kind
        after = np.append(self.crumb_base[1:], np.iinfo(np.int64).max)[kind]
        first = np.minimum(self.crumb_base[kind] + step, after)
        return self.crumb_window + at // ROOM, at - first


def _tail_crc(whole: int, head: int, tail_units: int) -> int:
    """crc32 of the end of a piece from those of the piece and of its beginning: crc32 is linear."""
    zeros = bytes(4 * UNIT * tail_units)
    return whole ^ zlib.crc32(zeros, head) ^ zlib.crc32(zeros)


def _place(shared):
    def build():
        plan: Plan = shared.value

        def work(batch: pa.RecordBatch) -> list:
            kind, i = (batch.column(c).to_numpy() for c in ("kind", "i"))
            window, offset = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
            rest = np.zeros(len(i), dtype=bool)
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                if k == SLOTS:
                    window[at] = i[at]
                elif k > CRUMB:
                    window[at], offset[at] = plan.crumb(int(k) - CRUMB, i[at])
                else:
                    inside = at[i[at] < plan.taken[k]]
                    if len(inside):
                        window[inside], unit = plan.whole(int(k), i[inside])
                        offset[inside] = unit * UNIT
                    outside = at[i[at] >= plan.taken[k]]
                    units = plan.rest_base[k] + (i[outside] - plan.taken[k]) * k
                    window[outside] = plan.rest_window + units // SLOTS
                    offset[outside] = units % SLOTS * UNIT
                    rest[outside] = True
            crcs = batch.column("crcs")
            ends = crcs.offsets.to_numpy()
            flat = crcs.values.to_numpy()
            start, length = (batch.column(c).to_numpy() for c in ("start", "length"))
            crc = flat[ends[1:] - 1].copy()
            over = np.flatnonzero(rest & (offset + length > WINDOW))  # the few that are cut again
            room = (WINDOW - offset[over]) // UNIT
            tails = []
            for row, units in zip(over, room, strict=True):
                head = int(flat[ends[row] + units - 1])
                tails.append(_tail_crc(int(crc[row]), head, int(length[row]) // UNIT - int(units)))
                crc[row] = head
            more = np.concatenate([np.arange(len(i)), over])
            starts = np.concatenate([start, start[over] + room * UNIT])
            lengths = np.concatenate([length, length[over] - room * UNIT])
            lengths[over] = room * UNIT
            return [
                batch.column("doc_id").take(pa.array(more)), starts, lengths,
                np.concatenate([crc, np.array(tails, dtype=np.int64)]),
                batch.column("doc_tokens").take(pa.array(more)),
                batch.column("doc_crc32").take(pa.array(more)),
                np.concatenate([window, window[over] + 1]),
                np.concatenate([offset, np.zeros(len(over), dtype=np.int64)]),
            ]

        return work

    return build


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, doc_crc32 (the checksum of all ids
    of its document), sequence_id, offset.

    ``path`` is the vocabulary file, which every executor must have. A document's ids are those of its
    whole text (null: empty) and ``END``; each lies in one piece. Sequences hold at most 4096 ids.

    Documents are cut into whole windows, then a piece of whole units of 64 ids, then a crumb. The
    histogram of the pieces, 63 numbers, is matched with all combinations of up to four pieces that fill
    a window exactly: least squares says how often each is used. What rounding leaves over is laid end
    to end and cut where a window is full. The task that cuts a document numbers its pieces by kind, so
    a sum over (task, kind) counts numbers every piece of a kind, and its place follows from its number:
    no sort over documents, no group of any size. Padding is left in the last window of the rest and,
    on average 32 ids, in each window of crumbs. Repeated rows are documents of their own.
    """
    pieces = stage(cut(docs, path), "pack-pieces")
    counts = stage(
        pieces.groupBy("kind", "part").agg(F.count("*").alias("n"), F.max("nth").alias("last")),
        "pack-counts",
    )
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(Plan(totals))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    numbered = pieces.join(begins, ["kind", "part"]).withColumn("i", F.col("begin") + F.col("nth"))
    return over_batches(numbered, _place(plan), PACKED)


def tokens(docs: DataFrame, packed: DataFrame, path: str) -> DataFrame:
    """``packed`` with the ids of every piece (array<long>), for writing the sequences out.

    Ids may be null or repeated: a piece belongs to the rows with its doc_id, number of ids and checksum,
    which all have the same ids.
    """

    def build():
        words = Words.of_worker(path)

        def work(batch: pa.RecordBatch) -> list:
            ids = [token_bytes(t.as_py(), words) for t in batch.column("text")]
            return [batch.column("doc_id"), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], ids]

        return work

    key = ["doc_id", "doc_tokens", "doc_crc32"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    whole = over_batches(rows, build, "doc_id long, doc_tokens long, doc_crc32 long, all binary")
    whole = whole.dropDuplicates(key).alias("w")
    both = packed.alias("p").join(
        whole,
        F.col("p.doc_id").eqNullSafe(F.col("w.doc_id"))
        & (F.col("p.doc_tokens") == F.col("w.doc_tokens"))
        & (F.col("p.doc_crc32") == F.col("w.doc_crc32")),
    )
    cut_out = both.select("p.*", F.expr("substring(w.all, 4 * p.start + 1, 4 * p.length)").alias("part"))

    def unpack():
        def work(batch: pa.RecordBatch) -> list:
            ids = [np.frombuffer(x.as_py(), dtype="<u4").astype(np.int64) for x in batch.column("part")]
            return [batch.column("sequence_id"), batch.column("offset"), batch.column("doc_id"), ids]

        return work

    return over_batches(cut_out, unpack, "sequence_id long, offset long, doc_id long, ids array<long>")
