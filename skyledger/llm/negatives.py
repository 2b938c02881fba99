"""Hard negatives: exact inner-product search with length buckets and coordinate pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import _arrow_schema, over_batches
from skyledger.session import stage

TILE = 16_384  # queries, and vectors, that meet in one group of a task
BUCKET = 2048  # vectors of similar length that share sorted coordinate lists
FOCUS = 4  # coordinates of a query whose feasible ranges are intersected
DENSE = 0.5  # share of a bucket past which ranges no longer pay and the bucket is verified whole
SLACK = 1e-6  # widens ranges against rounding; scores are exact integers
LONGEST = float(1 << 31)  # a longer vector takes no part: its scores don't fit 64 bits
NEVER = np.int64(1) << np.int64(62)  # above every score

ROWS = "vec_id long, label {label}, anchor boolean, dim int, length double, digest binary, raw binary"
HITS = "node long, slot long, score long, vec_id long, row long"


def _quantise(scale: float):
    def build():
        def work(batch: pa.RecordBatch) -> list:
            dims, lengths, digests, raws = [], [], [], []
            for v in batch.column("embedding"):
                q = None
                if v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all():
                        x = np.floor(scale * x)
                        length = float(np.sqrt((x * x).sum()))
                        q = x.astype(np.int32).tobytes() if length < LONGEST else None
                dims.append(0 if q is None else len(x))
                lengths.append(0.0 if q is None else length)
                digests.append(None if q is None else xxhash.xxh3_128_digest(q))
                raws.append(q)
            return [batch.column("vec_id"), batch.column("label"), batch.column("anchor"),
                    dims, lengths, digests, raws]

        return work

    return build


class Bucket:
    """Vectors of similar length: unit vectors, and for every coordinate the sorted list of its values."""

    def __init__(self, ints: np.ndarray):
        self.ints = ints.astype(np.float64)
        length = np.sqrt((self.ints * self.ints).sum(axis=1))
        self.top = float(length.max())
        self.unit = self.ints / np.where(length > 0, length, 1.0)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)


class Search:
    """Queries of a tile and, for each of their slots, the best ``k`` scores so far.

    A slot wants the highest scores from ``lo`` to ``hi``; ``lo`` rises as better ones are known.
    """

    def __init__(self, ints: np.ndarray, lo: np.ndarray, hi: np.ndarray, labels: np.ndarray, k: int):
        self.q = ints.astype(np.float64)
        self.length = np.sqrt((self.q * self.q).sum(axis=1))
        unit = self.q / np.where(self.length > 0, self.length, 1.0)[:, None]
        count = min(FOCUS, ints.shape[1])
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :count]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))
        self.lo, self.hi, self.labels, self.k = lo, hi, labels, k
        self.best = [np.empty(0, dtype=np.int64) for _ in range(5)]  # slot, score, no id, id, row
        self.verified = 0  # scores that were computed

    def ranges(self, at: np.ndarray, cosine: np.ndarray, b: Bucket):
        """Per query and focus coordinate: the feasible values, and where they stand in the sorted list.

        A vector within the angle of the threshold around the query has, in a coordinate, an angle to
        the axis that differs from the query's by no more than that.
        """
        reach, angle = np.arccos(np.clip(cosine, -1, 1))[:, None], self.angle[at]
        low = np.cos(np.minimum(np.pi, angle + reach)) - SLACK
        high = np.cos(np.maximum(0, angle - reach)) + SLACK
        start, end = np.zeros(low.shape, dtype=np.int64), np.zeros(low.shape, dtype=np.int64)
        focus = self.focus[at]
        for c in np.unique(focus):
            here = focus == c
            start[here] = np.searchsorted(b.lists[:, c], low[here], side="left")
            end[here] = np.searchsorted(b.lists[:, c], high[here], side="right")
        return low, high, start, end

    def meet(self, b: Bucket, labels: np.ndarray, ids: tuple) -> None:
        """Offers the rows of a bucket; ``ids`` are (no id, id, row) of its rows."""
        need = self.lo.min(axis=1).astype(np.float64)
        at = np.flatnonzero(need <= self.length * b.top * (1 + 1e-9))
        if not len(at):
            return
        size = len(b.ints)
        span = self.length[at] * b.top
        # no positive threshold: the sign of a cosine bounds nothing
        cosine = np.where(need[at] > 0, need[at] / np.where(span > 0, span, 1.0), -1.0)
        sparse = np.zeros(len(at), dtype=bool)
        if self.focus.shape[1]:
            low, high, start, end = self.ranges(at, cosine, b)
            width = end - start
            lead = width.argmin(axis=1)
            sparse = (width.min(axis=1) <= DENSE * size) & (need[at] > 0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sparse):
            f, k = self.focus[at[i]], lead[i]
            rows = b.order[start[i, k] : end[i, k], f[k]]
            for j in range(len(f)):
                if j != k and len(rows):
                    values = b.unit[rows, f[j]]
                    rows = rows[(values >= low[i, j]) & (values <= high[i, j])]
            if len(rows):
                score = self.scores(b.ints[rows], self.q[at[i]], self.length[at[i]] * b.top)
                found.append((np.full(len(rows), at[i]), rows, score))
        items = [self.fitting(*map(np.concatenate, zip(*found, strict=True)), labels)] if found else []
        dense = at[~sparse]
        for s in range(0, len(dense), 128):
            items += self.whole(dense[s : s + 128], b, labels)
        items = [x for x in items if len(x[0])]
        if items:
            slot, rows, score = map(np.concatenate, zip(*items, strict=True))
            self.keep([slot, score, *(x[rows] for x in ids)])

    def scores(self, rows: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
        """Exact inner products: in doubles while every partial sum is below 2**53, else in integers."""
        self.verified += len(rows) * (len(q) if q.ndim == 2 else 1)
        if bound < float(1 << 53):
            return np.rint(rows @ q.T).astype(np.int64)
        return rows.astype(np.int64) @ q.T.astype(np.int64)

    def fitting(self, qi: np.ndarray, rows: np.ndarray, score: np.ndarray, labels) -> tuple:
        """(slot, row, score) of the slots that a score fits."""
        slots, wide = [], self.lo.shape[1]
        ok = self.labels[qi] != labels[rows] if self.labels is not None else np.ones(len(qi), dtype=bool)
        for j in range(wide):
            fits = np.flatnonzero(ok & (score >= self.lo[qi, j]) & (score <= self.hi[qi, j]))
            slots.append((qi[fits] * wide + j, rows[fits], score[fits]))
        return tuple(map(np.concatenate, zip(*slots, strict=True)))

    def whole(self, at: np.ndarray, b: Bucket, labels) -> list:
        """All rows of a bucket against some queries, less those below the k-th of a slot."""
        score = self.scores(b.ints, self.q[at], float(self.length[at].max()) * b.top).T
        out, wide = [], self.lo.shape[1]
        for j in range(wide):
            fits = (score >= self.lo[at, j, None]) & (score <= self.hi[at, j, None])
            if self.labels is not None:
                fits &= self.labels[at][:, None] != labels[None, :]
            if score.shape[1] > self.k:
                masked = np.where(fits, score, -NEVER)
                cut = np.partition(masked, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
                fits &= score >= cut[:, None]
            i, rows = np.nonzero(fits)
            out.append((at[i] * wide + j, rows, score[i, rows]))
        return out

    def keep(self, new: list[np.ndarray]) -> None:
        """Merges offers (slot, score, no id, id, row) into the best ``k`` and raises full slots."""
        slot, score, absent, ident, row = (
            np.concatenate([x, y]) for x, y in zip(self.best, new, strict=True)
        )
        order = np.lexsort((row, ident, absent, -score, slot))
        first = np.flatnonzero(np.diff(slot[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        stay, last = order[rank < self.k], order[rank == self.k - 1]
        self.best = [x[stay] for x in (slot, score, absent, ident, row)]
        lo = self.lo.reshape(-1)
        lo[slot[last]] = np.maximum(lo[slot[last]], score[last])


def _tile(same: bool, k: int, low: int, high: int):
    arrow = _arrow_schema(None, HITS)

    def ints(rows: pa.Table, dim: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(rows.column("raw").to_pylist()), dtype=np.int32)
        return flat.reshape(rows.num_rows, dim)

    def run(batches):
        now, own, search, nodes, wants, known = None, [], None, None, None, {}
        pending: list[pa.Table] = []
        names = ("grp", "dim", "slice", "lane") if same else ("dim", "slice", "lane")

        def labels_of(rows: pa.Table) -> np.ndarray:
            if same:
                return np.zeros(rows.num_rows, dtype=np.int64)
            return np.array([known.setdefault(x, len(known)) for x in rows.column("grp").to_pylist()], np.int64)

        def open_tile():
            nonlocal search, nodes, wants
            rows = pa.concat_tables(own)
            nodes = rows.column("row").to_numpy()
            slots = rows.column("slots").to_pylist()
            wide = max(map(len, slots)) if slots else 0
            wide = max(wide, 1)
            lo = np.full((len(nodes), wide), NEVER)
            hi, wants = np.full((len(nodes), wide), NEVER), np.zeros((len(nodes), wide), dtype=np.int64)
            for i, values in enumerate(slots):
                for j, p in enumerate(values):
                    wants[i, j] = p
                    lo[i, j], hi[i, j] = (-NEVER, NEVER) if same else (-(-low * p // 100), high * p // 100)
            search = Search(ints(rows, now[-3]), lo, hi, None if same else labels_of(rows), k)

        def bucket():
            rows = pa.concat_tables(pending)
            pending.clear()
            ids = rows.column("vec_id")
            absent = ids.is_null().to_numpy().astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            search.meet(Bucket(ints(rows, now[-3])), labels_of(rows), (absent, ids, rows.column("row").to_numpy()))

        def close():
            nonlocal search, known
            if search is not None:
                if pending:
                    bucket()
                slot, score, absent, ident, row = search.best
                wide = search.lo.shape[1]
                if len(slot):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(nodes[slot // wide]), pa.array(wants[slot // wide, slot % wide]),
                            pa.array(score), pa.array(ident, mask=absent == 1), pa.array(row),
                        ],
                        schema=arrow,
                    )
            own.clear()
            pending.clear()
            search, known = None, {}

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, dtype=bool)
            change[0] = True
            for c in (*names, "own"):
                codes = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            bounds = np.append(np.flatnonzero(change), batch.num_rows)
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                piece = pa.Table.from_batches([batch.slice(int(s), int(e - s))])
                key = tuple(piece.column(c)[0].as_py() for c in names)
                if key != now:
                    yield from close()
                    now = key
                if piece.column("own")[0].as_py() == 1:
                    own.append(piece)
                    continue
                if not own:
                    continue
                if search is None:
                    open_tile()
                size = max(64, min(BUCKET, (1 << 22) // max(now[-3], 1)))
                while piece.num_rows:
                    room = size - sum(p.num_rows for p in pending)
                    pending.append(piece.slice(0, room))
                    piece = piece.slice(room)
                    if sum(p.num_rows for p in pending) >= size:
                        bucket()
        yield from close()

    return run


def _best(queries: DataFrame, vectors: DataFrame, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """The ``k`` best vectors of each (query, slot): columns of ``HITS``.

    Queries and vectors of a group are dealt over a grid of tiles of at most ``TILE`` of each, so no task
    holds a group, however large. In a tile the vectors come by falling length and are cut into buckets.
    """
    group = ["grp", "dim"] if same else ["dim"]
    asked = queries.groupBy(*group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("slices"))
    there = vectors.groupBy(*group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("lanes"))
    grid = stage(asked.join(there, group), "negatives-grid")
    columns = ["grp", "dim", "slice", "lane", "own", "length", "row", "vec_id", "slots", "raw"]
    q = (
        queries.join(grid, group)
        .withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
        .withColumn("own", F.lit(1))
        .select(*columns)
    )
    v = (
        vectors.join(grid, group)
        .withColumn("lane", F.pmod(F.xxhash64("row"), F.col("lanes")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("own", F.lit(0))
        .withColumn("slots", F.lit(None).cast("array<long>"))
        .select(*columns)
    )
    tile = [*group, "slice", "lane"]
    hits = (
        q.unionByName(v)
        .repartition(*tile)
        .sortWithinPartitions(*tile, F.desc("own"), F.desc("length"), "row")
        .mapInArrow(_tile(same, k, low, high), HITS)
    )
    order = Window.partitionBy("node", "slot").orderBy(
        F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"
    )
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id,
    embedding, label); ``anchor`` is the condition that makes a row an anchor.

    A component x counts as floor(scale * x), a score is the inner product of such vectors. The
    positives of an anchor are its ``positives`` best other rows of the same label; for each, the
    negatives are the ``negatives`` best rows of other labels whose score lies between ``low`` and
    ``high`` per cent of the positive's. Higher scores come first, then smaller vec_id (null last).

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do
    vectors longer than 2**31 after scaling (scores are 64 bits), and vectors of different length don't
    meet; empty vectors meet each other with score 0. A null vec_id is an id like others, unless ``anchor``
    asks about it. Rows with equal ids are rows of their own. Other columns are ignored. No rows: no rows.

    Equal vectors of one label are one query, and of their rows only the first few by id can be among
    the best, so copies cost nothing further.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    picked = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(anchor, F.lit(False)).alias("anchor"),
        "embedding",
    )
    rows = stage(
        over_batches(picked.where(F.col("label").isNotNull()), _quantise(scale), ROWS.format(label=kind))
        .where("raw IS NOT NULL")
        .withColumnRenamed("label", "grp")
        .withColumn("row", F.monotonically_increasing_id()),
        "negatives-rows",
    )
    equal = Window.partitionBy("grp", "dim", "digest").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = F.row_number().over(equal)
    probes = stage(
        rows.withColumn("copy", first).where(F.col("copy") <= max(positives + 1, negatives))
        .select("grp", "dim", "length", "row", "vec_id", "raw"),
        "negatives-vectors",
    )
    queries = stage(
        rows.where("anchor").withColumn("copy", first).where("copy = 1")
        .select("grp", "dim", "digest", "length", "row", F.lit(None).cast("long").alias("vec_id"), "raw"),
        "negatives-queries",
    )
    # one more than asked for: the anchor may be among them
    one = queries.drop("digest").withColumn("slots", F.array(F.lit(0).cast("long")))
    tops = _best(one, probes, True, positives + 1)
    best = F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "row")))
    liked = stage(
        tops.groupBy(F.col("node").alias("row")).agg(best.alias("best")), "negatives-liked"
    )
    slots = F.array_distinct(F.transform("best", lambda x: x["score"]))
    asking = queries.drop("digest").join(liked, "row").withColumn("slots", F.filter(slots, lambda p: p >= 0))
    found = _best(asking.drop("best").where(F.size("slots") > 0), probes, False, negatives, low, high)
    hard = found.groupBy(F.col("node").alias("row"), "slot").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), "score"))).alias("hard")
    )
    hard = hard.groupBy("row").agg(F.collect_list(F.struct("slot", "hard")).alias("slots"))
    answers = stage(
        queries.select("grp", "dim", "digest", "row").join(liked, "row").join(hard, "row").drop("row"),
        "negatives-answers",
    )
    pairs = (
        rows.where("anchor")
        .select("grp", "dim", "digest", F.col("vec_id").alias("anchor_id"), "row")
        .join(answers, ["grp", "dim", "digest"])
        .withColumn("others", F.expr("slice(filter(best, x -> x.row <> row), 1, %d)" % positives))
        .withColumn("p", F.explode("others"))
        .withColumn("n", F.explode(F.expr("flatten(transform(filter(slots, x -> x.slot = p.score), x -> x.hard))")))
    )
    return pairs.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("n.rank").alias("rank"),
        F.col("n.negative_id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("n.score").alias("negative_score"),
    )
