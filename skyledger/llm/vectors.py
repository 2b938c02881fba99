"""Near-duplicate embeddings by collision counting over many one-dimensional projections."""

from __future__ import annotations

import functools
import math
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import _arrow_schema, over_batches
from skyledger.llm.components import components
from skyledger.session import stage

LEAST = 0.93  # cosine of a link
LINES = 16  # projections over which collisions are counted
WIDE = 0.9  # half a window: a pair at 0.93 falls into one with probability 0.984
MEETS = 0.9998  # chance that a pair at the threshold shares a cell and a window in some table
RECALL = 0.9995  # of the collision count, for such a pair
QUERIES = 2048  # vectors of a cell that one task compares with all of the cell
SMALL = 64  # vectors of a cell up to which many cells are compared at once

ROWS = "vec_id long, label {label}, valid boolean, dim int, digest binary, raw binary"
CELLS = "label {label}, dim int, turn int, cell long, node long, n long, key double, raw binary, cells binary"


def inside(cosine: float = LEAST) -> float:
    """The chance that one projection of a pair of unit vectors at ``cosine`` differs by a window."""
    return math.erf(WIDE / math.sqrt(2 - 2 * cosine) / math.sqrt(2))


def needed() -> int:
    """The largest count that a pair at the threshold reaches with ``RECALL``, once one line collides."""
    p, free, tail = inside(), LINES - 1, 0.0
    for k in range(free, -1, -1):
        tail += math.comb(free, k) * p**k * (1 - p) ** (free - k)
        if tail >= RECALL:
            return 1 + k
    return 1


@functools.cache
def directions(dim: int) -> np.ndarray:
    """The lines of the collision count, the same for every vector of a length."""
    return np.random.default_rng([20240611, dim]).standard_normal((dim, LINES))


def axes(dim: int, turn: int, lead: int) -> np.ndarray:
    """The orthonormal projections of one lead of a table."""
    draw = np.random.default_rng([20240612, dim, turn, lead])
    return np.linalg.qr(draw.standard_normal((dim, min(dim, 64))))[0]


def farthest(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The projection in which a vector lies farthest out, and on which side: the end of the sorted list of
    that projection where the vector stands."""
    p = unit @ basis
    at = np.abs(p).argmax(axis=1)
    return 2 * at + (np.take_along_axis(p, at[:, None], axis=1)[:, 0] < 0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(cosine: float, count: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at a cosine."""
    a, b = np.random.default_rng([seed, dim]).standard_normal((2, count, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


class Tables:
    """How vectors of a length are cut into cells, for a corpus of ``count`` vectors.

    A table has ``leads`` independent sets of projections; a cell takes the vectors that are farthest out
    in the same projection of each. There are about as many cells as vectors, so those of unlike vectors
    are small at every size. How often a pair at the threshold shares a cell is measured on random pairs
    of this length, and as many tables are made as the promised chance of a meeting takes.
    """

    def __init__(self, dim: int, count: int):
        self.dim, self.ends = dim, 2 * min(dim, 64)
        self.leads = max(1, round(math.log(max(count, 2)) / math.log(max(self.ends, 2))))
        a, b = pairs_at(LEAST, 4000, dim, 7) if dim > 1 else (np.ones((1, 1)), np.ones((1, 1)))
        same = [(farthest(a, x) == farthest(b, x)).mean() for x in (axes(dim, t, 99) for t in range(6))]
        meets = min(float(np.mean(same)) ** self.leads * inside(), 1 - 1e-9)
        self.count = max(1, math.ceil(math.log(1 - MEETS) / math.log(1 - meets)))
        self.bases = [[axes(dim, t, k) for k in range(self.leads)] for t in range(self.count)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """One column of cell numbers a table."""
        out = np.zeros((len(unit), self.count), dtype=np.int64)
        for t, bases in enumerate(self.bases):
            for basis in bases:
                out[:, t] = out[:, t] * self.ends + farthest(unit, basis)
        return out


def _project():
    def work(batch: pa.RecordBatch) -> list:
        valid, dims, digests, raws = [], [], [], []
        for v in batch.column("embedding"):
            x = raw = None
            if v.is_valid and v.values.null_count == 0 and len(v.values):
                raw = v.values.to_numpy(zero_copy_only=False)
                x = raw.astype(np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            valid.append(x is not None)
            dims.append(0 if x is None else len(x))
            digests.append(None if x is None else xxhash.xxh3_128_digest(x.tobytes()))
            raws.append(None if x is None else raw.tobytes())
        return [batch.column("vec_id"), batch.column("label"), valid, dims, digests, raws]

    return work


def matrix(raws: pa.Array, dim: int) -> np.ndarray:
    """The unit vectors of stored ones, in the precision they came in."""
    joined = b"".join(raws.to_pylist())
    kind = np.float32 if len(joined) == 4 * dim * len(raws) else np.float64
    return unit_rows(np.frombuffer(joined, dtype=kind).reshape(len(raws), dim))


def _spread(count: int, label):
    """Every vector in its cell of each table; ``key`` is the line by which the cell is sorted."""
    arrow = pa.schema(
        [("label", label), ("dim", pa.int32()), ("turn", pa.int32()), ("cell", pa.int64()), ("node", pa.int64()),
         ("n", pa.int64()), ("key", pa.float64()), ("raw", pa.binary()), ("cells", pa.binary())]
    )

    def run(batches):
        known: dict[int, tuple[Tables, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in known:
                    known[dim] = Tables(int(dim), count), directions(int(dim))
                tables, lines = known[dim]
                unit = matrix(rows.column("raw"), int(dim))
                cells, p = tables.cells(unit), unit @ lines
                packed = pa.array([x.tobytes() for x in cells])
                for t in range(tables.count):
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("label"), rows.column("dim"),
                            pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(cells[:, t]),
                            rows.column("node"), rows.column("n"), pa.array(p[:, t % LINES]),
                            rows.column("raw"), packed,
                        ],
                        schema=arrow,
                    )

    return run


class _Piece:
    """Rows of one cell as arrays, in the order of their sort key."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        n = batch.num_rows
        self.node, self.n, self.key = (batch.column(c).to_numpy() for c in ("node", "n", "key"))
        self.unit = matrix(batch.column("raw"), dim)
        self.lines = (self.unit @ directions(dim)).astype(np.float32)
        self.cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), dtype=np.int64).reshape(n, -1)


class _Cell:
    """The queries of a cell against its members, which pass by piece by piece."""

    def __init__(self, table: int, queries: _Piece):
        self.table, self.q = table, queries
        self.links = np.zeros(len(queries.node), dtype=np.int64)
        self.root = np.arange(len(queries.node))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.admitted = 0  # pairs whose collisions were counted

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def meet(self, m: _Piece, least: int) -> None:
        """Counts collisions in the window of the sorted line around each block of queries, and verifies
        the pairs that reach the calibrated count."""
        q, line = self.q, self.table % LINES
        for a in range(0, len(q.node), 256):
            b = min(a + 256, len(q.node))
            lo = np.searchsorted(m.key, q.key[a] - WIDE)
            hi = np.searchsorted(m.key, q.key[b - 1] + WIDE, side="right")
            for s in range(int(lo), int(hi), 4096):
                e = min(s + 4096, int(hi))
                self.admitted += (b - a) * (e - s)
                count = np.zeros((b - a, e - s), dtype=np.int8)
                for k in range(LINES):
                    count += np.abs(q.lines[a:b, k, None] - m.lines[None, s:e, k]) <= WIDE
                passed = count >= least
                passed &= np.abs(q.lines[a:b, line, None] - m.lines[None, s:e, line]) <= WIDE
                passed &= q.node[a:b, None] != m.node[None, s:e]
                i, j = np.nonzero(passed)
                if not len(i):
                    continue
                i, j = i + a, j + s
                if len(i) * 8 > (b - a) * (e - s):
                    near = (q.unit[a:b] @ m.unit[s:e].T)[i - a, j - s] >= LEAST
                else:
                    near = np.einsum("ij,ij->i", q.unit[i], m.unit[j]) >= LEAST
                i, j = i[near], j[near]
                self.link(i, j, m)

    def link(self, i: np.ndarray, j: np.ndarray, m: _Piece) -> None:
        """Counts links that met in no earlier table, and keeps a forest of them."""
        keep = np.ones(len(i), dtype=bool)
        for t in range(self.table):
            line = t % LINES
            met = np.abs(self.q.lines[i, line] - m.lines[j, line]) <= WIDE
            keep &= ~(met & (self.q.cells[i, t] == m.cells[j, t]))
        i, j = i[keep], j[keep]
        if not len(i):
            return
        np.add.at(self.links, i, m.n[j])
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(j, prepend=-1))
        self.edges.append((m.node[j[first]], self.q.node[i[first]]))
        lead = np.repeat(i[first], np.diff(np.append(first, len(j))))
        for pair in np.unique(np.stack([lead, i]), axis=1).T:
            x, y = self.find(pair[0]), self.find(pair[1])
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, n): links of a vector as (a, a, n), edges of the forest as (a, b, 0)."""
        linked = np.flatnonzero(self.links)
        tied = np.flatnonzero(self.root != np.arange(len(self.root)))
        a = [self.q.node[linked], self.q.node[tied], *(e[0] for e in self.edges)]
        b = [self.q.node[linked], self.q.node[self.root[tied]], *(e[1] for e in self.edges)]
        n = np.zeros(sum(map(len, a)), dtype=np.int64)
        n[: len(linked)] = self.links[linked]
        return np.concatenate(a), np.concatenate(b), n


def small_cells(rows: pa.Table, group: np.ndarray, least: int) -> list[np.ndarray]:
    """(a, b, n) as ``_Cell.result`` gives them, for whole cells of one length at once.

    In the order of the rows (by cell, then by line) the s-th neighbours of all rows are compared in one
    step, for s = 1, 2, ... as long as neighbours share a cell.
    """
    dim = rows.column("dim")[0].as_py()
    at = _Piece(rows.combine_chunks().to_batches()[0], dim)
    turn = rows.column("turn").to_numpy()
    line = turn % LINES
    found = []
    for s in range(1, SMALL):
        i = np.flatnonzero(group[s:] == group[:-s])
        if not len(i):
            break
        i = i[at.key[i + s] - at.key[i] <= WIDE]
        j = i + s
        apart = np.abs(at.lines[i] - at.lines[j]) <= WIDE
        passed = (apart.sum(axis=1) >= least) & apart[np.arange(len(i)), line[i]]
        i, j = i[passed], j[passed]
        near = np.einsum("ij,ij->i", at.unit[i], at.unit[j]) >= LEAST
        found.append((i[near], j[near]))
    i, j = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    keep = np.ones(len(i), dtype=bool)
    for t in range(int(turn.max())):
        met = (turn[i] > t) & (at.cells[i, t] == at.cells[j, t])
        keep &= ~(met & (np.abs(at.lines[i, t % LINES] - at.lines[j, t % LINES]) <= WIDE))
    i, j = i[keep], j[keep]
    links = np.zeros(len(group), dtype=np.int64)
    np.add.at(links, i, at.n[j])
    np.add.at(links, j, at.n[i])
    root, tied = list(range(len(group))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            tied.append((x, y))
    linked = np.flatnonzero(links)
    x, y = (np.array([t[k] for t in tied], dtype=np.int64) for k in (0, 1))
    nothing = np.zeros(len(x), dtype=np.int64)
    return [
        np.concatenate([at.node[linked], at.node[x]]), np.concatenate([at.node[linked], at.node[y]]),
        np.concatenate([links[linked], nothing]),
    ]


def _compare():
    arrow = _arrow_schema(None, "a long, b long, n long")
    least = needed()
    names = ("label", "dim", "turn", "cell", "slice")

    def run(batches):
        now, own, cell = None, [], None

        def emit(columns):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

        def close():
            nonlocal cell
            if cell is None and own and sum(b.num_rows for b in own) > 1:
                open_cell()
            if cell is not None:
                yield from emit(cell.result())
            cell = None

        def open_cell():
            nonlocal cell
            rows = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            queries = _Piece(rows, now[1])
            cell = _Cell(now[2], queries)
            cell.meet(queries, least)

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, dtype=bool)
            change[0] = True
            for c in (*names, "own"):
                codes = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            sizes = np.diff(np.append(starts, batch.num_rows))
            # cells that begin and end in this batch and are not dealt over tasks
            whole = (batch.column("slices").to_numpy()[starts] == 1) & (sizes <= SMALL)
            whole[[0, -1]] = False
            for dim in np.unique(batch.column("dim").to_numpy()[starts[whole & (sizes > 1)]]):
                mine = whole & (sizes > 1) & (batch.column("dim").to_numpy()[starts] == dim)
                rows = np.flatnonzero(np.repeat(mine, sizes))
                table = pa.Table.from_batches([batch]).take(pa.array(rows))
                yield from emit(small_cells(table, np.repeat(np.arange(len(starts)), sizes)[rows], least))
            for s, size in zip(starts[~whole], sizes[~whole], strict=True):
                piece = batch.slice(int(s), int(size))
                key = tuple(piece.column(c)[0].as_py() for c in names)
                if key != now:
                    yield from close()
                    now, own = key, []
                if piece.column("own")[0].as_py() == 1:
                    own.append(piece)
                elif own:
                    if cell is None:
                        open_cell()
                    cell.meet(_Piece(piece, now[1]), least)
        yield from close()

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with the same label (not null) link if their cosine, in double precision, is 0.93 or more.
    A vector that is null, empty or zero, or holds a null or a number that isn't finite, links with
    nothing, nor do vectors of different length. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id that links reach. A repeated vec_id is a vector a row.

    Every table cuts the vectors into cells by the projections in which they lie farthest out (``Tables``).
    Inside a cell the rows are sorted by one of sixteen more projections; for the window around each query
    the collisions over all sixteen are counted, and pairs that reach the calibrated count are verified. A
    pair that met in an earlier table is left alone. Pairs never leave a task: it returns the links of
    each query as a number, and a forest of them. Equal vectors are one row with a count. The queries of
    a large cell are dealt over several tasks, past which its members stream, so no task holds a cell.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = stage(
        over_batches(picked, _project, ROWS.format(label=kind)).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "vector-rows",
    )
    usable = F.col("valid") & F.col("label").isNotNull()
    classes = stage(
        rows.where(usable)
        .groupBy("label", "digest")
        .agg(
            F.min("row").alias("node"), F.min("vec_id").alias("low"), F.count("*").alias("n"),
            F.any_value("dim").alias("dim"), F.any_value("raw").alias("raw"),
        ),
        "vector-classes",
    )
    label = _arrow_schema(None, f"label {kind}").field("label").type
    cells = classes.mapInArrow(_spread(classes.count(), label), CELLS.format(label=kind))
    group = ["label", "dim", "turn", "cell"]
    large = (
        cells.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > QUERIES)
        .select(*group, F.ceil(F.col("size") / QUERIES).cast("int").alias("slices"))
    )
    dealt = (
        cells.join(large, group, "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn(
            "own", (F.pmod(F.xxhash64("node"), F.col("slices")) == F.col("slice")).cast("int")
        )
    )
    sorted_cells = dealt.repartition(*group, "slice").sortWithinPartitions(
        *group, "slice", F.desc("own"), "key"
    )
    found = stage(sorted_cells.mapInArrow(_compare(), "a long, b long, n long"), "vector-links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("a <> b").select("a", "b")).withColumnRenamed("component", "root")
    named = stage(
        classes.select("label", "digest", "node", "low", "n")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "vector-named",
    )
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = named.join(smallest, "root").select(
        "label", "digest", "component_id",
        (F.coalesce(F.col("links"), F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    out = (
        rows.where(usable)
        .select("vec_id", "label", "digest")
        .join(groups, ["label", "digest"])
        .select("vec_id", "n_links", "component_id")
        .unionByName(
            rows.where(~usable).select(
                "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
            )
        )
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
