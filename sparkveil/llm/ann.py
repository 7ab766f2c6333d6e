"""Approximate nearest neighbours: NN-descent graphs of cells and greedy graph search, by inner product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Neighbours of a node in the graph, for cells of up to NODES nodes; see grown().
DEGREE, NODES = 40, 50_000
#: Cells are fitted on about so many rows at most, in so many rounds of k-means; every row is indexed.
FIT_ROWS, FIT_ROUNDS = 40_000, 8
#: Least number of cells (of 64 nodes or more); beyond, a cell for each so many square roots of the nodes.
CELLS, ROOTS = 16, 25
#: Up to so many nodes a search visits every cell; beyond, a share that falls with the fourth root.
WHOLE = 131_072
#: Random orders that give the first lists, hyperplanes that make one, and vectors that are compared all with
#: all in it: at most CHUNK and a sixteenth of the cell, at least a little over twice the degree.
ORDERS, SPLITS, CHUNK = 3, 8, 256
#: Rounds of neighbours of neighbours end when fewer than this share of all entries are new.
SETTLED = 0.03
#: Nodes around one pivot that are compared at once; more are dealt to shares of about so many.
GROUP = 128
#: Products that are made before the lists, and so the bounds, are brought up to date.
PRODUCTS = 4_000_000
#: Width of a search beam in a cell of up to NODES nodes, nodes of it that are expanded in one hop, nodes of
#: a cell at which searches begin, and searches that go together.
BEAM, EXPANDED, BEGUN, TOGETHER = 64, 8, 1024, 16_384

_LIST = "array<struct<d:double,w:long>>"
#: The same with a mark on entries that were not yet compared.
_MARKED = "array<struct<d:double,w:long,open:boolean>>"
#: An empty place in a list of keys.
_NONE = 0x7FFFFFFF_7FFFFFFF


@dataclass
class Index:
    """nodes (id, v): one row per distinct vector; members (vec_id, id); graph (id, near); and code, in graph
    with cell where there are cells, else in nodes. d of ``near`` is minus the inner product.

    code: three doubles (scale of this vector, and two terms of the component that would make all of
    one length), then the vector in two bytes a component. Each vector has its own scale, so one long
    vector takes no precision from the others. Building and searching compare codes; answers are
    scored on v. A graph joins nodes of one cell; without ``cells`` all are one.
    """

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame
    dim: int
    degree: int = DEGREE
    beam: int = BEAM
    cells: Cells | None = None


@dataclass
class Cells:
    """k-means cells: vectors over ``unit`` in length are dealt to the nearest of ``centres``.

    A cell of more than twice the mean is dealt to ``shares`` by id; share s of cell c has the number
    c + s * len(centres). ``spread`` is the deviation of a cell's vectors in one direction.
    """

    unit: float
    centres: np.ndarray
    spread: np.ndarray
    shares: np.ndarray
    nodes: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        half = 0.5 * (self.centres * self.centres).sum(axis=1)
        parts = [np.argmax(x[lo : lo + 4096] @ self.centres.T - half, axis=1) for lo in range(0, len(x), 4096)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def dealt(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of the shares that hold these vectors."""
        cell = self.of(x)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return cell + len(self.centres) * (mixed % self.shares[cell].astype(np.uint64)).astype(np.int64)

    def visited(self) -> int:
        """Cells that a search visits: those where the nearest may be, best first."""
        return int(np.ceil(len(self.centres) * min(1.0, (max(self.nodes, 1) / WHOLE) ** -0.25)))

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and share number of all visits: by the product with the centre and three deviations of the cell."""
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        first = np.argsort(-(x @ self.centres.T + 3 * length * self.spread), axis=1, kind="stable")[:, : self.visited()]
        row, cell = np.repeat(np.arange(len(x)), first.shape[1]), first.ravel()
        times = self.shares[cell]
        share = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(row, times), np.repeat(cell, times) + len(self.centres) * share


def grown(nodes: int) -> tuple[int, int]:
    """Degree and beam for so many nodes: beyond NODES, 8 neighbours more for each doubling, and a beam
    that grows with the square root."""
    times = max(1.0, nodes / NODES)
    return DEGREE + 8 * round(float(np.log2(times))), round(BEAM * float(np.sqrt(times)))


def usable(v: Column) -> Column:
    """Not null, not empty, not all zero, and every component finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) heads and (n, dim) whole numbers."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, :24]).view(np.float64), np.ascontiguousarray(raw[:, 24:]).view(np.int16)


def _plain(head: np.ndarray, q: np.ndarray, unit: float) -> np.ndarray:
    """The vectors over ``unit``, in floats."""
    return np.clip(q * (head[:, :1] / unit), -1e15, 1e15).astype(np.float32)


def _sides(head: np.ndarray, x: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Two factors whose product over all pairs is minus the inner products, with the component that
    makes all vectors of one length, less its constant part."""
    short, lost = (np.minimum(head[:, i : i + 1] / unit / (unit if i == 2 else 1), 1e15).astype(np.float32) for i in (1, 2))
    one = np.ones_like(lost)
    return np.concatenate([-x, -short, lost, one], axis=1), np.concatenate([x, short, one, lost], axis=1)


def _lists(sizes: np.ndarray, d: np.ndarray, w: np.ndarray, fresh: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(d.astype(np.float64)), pa.array(w.astype(np.int64)), pa.array(fresh.astype(bool))], ["d", "w", "open"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, and the flat columns, of marked lists (null: empty)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return sizes, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)


def _best(owner: np.ndarray, d: np.ndarray, w: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The nearest ``most`` of each owner without repeats, nearest first, ties by id.

    Of repeats the one that is no longer open stays.
    """
    order = np.lexsort((fresh, w, owner))
    owner, d, w, fresh = owner[order], d[order], w[order], fresh[order]
    first = np.ones(len(w), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (w[1:] != w[:-1])
    owner, d, w, fresh = owner[first], d[first], w[first], fresh[first]
    order = np.lexsort((w, d, owner))
    owner, d, w, fresh = owner[order], d[order], w[order], fresh[order]
    if len(owner):
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
        keep = place < most
        owner, d, w, fresh = owner[keep], d[keep], w[keep], fresh[keep]
    return owner, d, w, fresh


def _edges_of(*keys: np.ndarray) -> np.ndarray:
    """Places where sorted rows change any of their keys."""
    change = np.zeros(max(0, len(keys[0]) - 1), dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[len(keys[0]) > 0], change]))


def _merge(lists: DataFrame, most: int, *more: str) -> DataFrame:
    """(id, near) marked lists of the same id (and of ``more`` columns) merged to their nearest ``most``.

    A task reads its ids one after the other and holds no more of one than a batch and its best so far.
    """
    keys = ["id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def shorten(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = [rows.column(i).to_numpy() for i in range(len(keys))]
            start = _edges_of(*columns)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, rows.num_rows)))
            sizes, d, w, fresh = _flat(rows.column(len(keys)))
            owner, d, w, fresh = _best(np.repeat(group, sizes), d, w, fresh, most)
            return pa.RecordBatch.from_arrays([*(pa.array(c[start]) for c in columns), _lists(np.bincount(owner, minlength=len(start)), d, w, fresh)], names=[*keys, "near"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = shorten(b if held is None else pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0])
            if rows.num_rows > 1:
                yield rows.slice(0, rows.num_rows - 1)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield held

    rows = lists.select(*keys, "near").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + f", near {_MARKED}").select("id", "near")


def top_per_key(df: DataFrame, key: str, order: list[str], most: int, spread: str, salts: int = 32) -> DataFrame:
    """The first ``most`` rows of each key, ranked in shares first so that no key is one task."""
    by = ", ".join(order)
    some = df.withColumn("__share", F.pmod(F.xxhash64(spread), F.lit(salts))).withColumn("__n", F.expr(f"row_number() over (partition by {key}, __share order by {by})"))
    some = some.where(F.col("__n") <= most).withColumn("__n", F.expr(f"row_number() over (partition by {key} order by {by})"))
    return some.where(F.col("__n") <= most).drop("__share", "__n")


def _square() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _coded(nodes: DataFrame, longest: float) -> DataFrame:
    """Add ``code``; ``longest`` is the largest squared length.

    With R the largest length, the component that fills a vector up to R is R - short; the product of
    two such is R * R - (lost + lost') + short * short', where lost = R * short.
    """
    most = float(np.sqrt(longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            scale = np.maximum(np.abs(x).max(axis=1) / 32767, np.finfo(np.float64).tiny)
            q = np.rint(x / scale[:, None]).astype(np.int16)
            square = np.minimum((x * x).sum(axis=1), longest)
            short = square / (most + np.sqrt(longest - square))
            head = np.stack([scale, short, most * short], axis=1)
            raw = np.concatenate([head.view(np.uint8), q.view(np.uint8)], axis=1)
            ends = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
            code = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code], names=["id", "v", "code"])

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("id", "v").mapInArrow(run, f"id long, v {kind}, code binary")


def _keys(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Nearness (30 bits), node (30 bits) and a mark that it is open as one number that sorts."""
    i = d.astype(np.float32).view(np.int32)
    return (((i ^ ((i >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31) >> 2) << 32) | (w.astype(np.int64) << 1) | 1


def _nearness(keys: np.ndarray) -> np.ndarray:
    i = np.clip(((keys >> 32) << 2) - (1 << 31), -(2**31), 2**31 - 1).astype(np.int32)
    return np.where(keys == _NONE, np.float32(np.inf), (i ^ ((i >> 31) & 0x7FFFFFFF)).view(np.float32))


def _node(keys: np.ndarray) -> np.ndarray:
    return (keys >> 1) & 0x3FFFFFFF


def _order(numbers: np.ndarray, below: int) -> np.ndarray:
    """A stable order; numbers of two bytes are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _enter(near: np.ndarray, row: np.ndarray, keys: np.ndarray) -> None:
    """Put keys into the sorted lists ``near[row]``, which keep their nearest, each node once.

    Of repeats, which may differ in the last bits of the nearness, the one that is no longer open stays.
    """
    order = _order(row, len(near))
    row, keys = row[order], keys[order]
    start = _edges_of(row)
    size, most = np.diff(np.append(start, len(row))), near.shape[1]
    last, width = 0, 4
    while last < size.max(initial=0):
        mine = np.flatnonzero((size > last) & (size <= width))  # lists that get about as many
        for some in np.array_split(mine, max(1, len(mine) * (most + width) // 500_000)):
            at = start[some][:, None] + np.arange(width)
            new = np.where(np.arange(width) < size[some][:, None], keys[np.minimum(at, len(keys) - 1)], _NONE)
            rows = np.concatenate([near[row[start[some]]], new], axis=1)
            rows = (rows & 0xFFFFFFFF) << 31 | rows >> 32  # by node first
            rows.sort(axis=1)
            again = (rows[:, 1:] >> 32) == (rows[:, :-1] >> 32)
            rows = (rows & 0x7FFFFFFF) << 32 | rows >> 31
            rows[:, 1:][again] = _NONE
            rows.sort(axis=1)
            near[row[start[some]]] = rows[:, :most]
        last, width = width, 4 * width


def _met(left: np.ndarray, right: np.ndarray, node: np.ndarray, start: np.ndarray, size: np.ndarray, news: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys: what nodes find in each other, where the groups ``node[start : start + size]`` meet.

    The first ``news`` of a group are new to it and are compared with all of it; only what is nearer than
    the last neighbour that a node has (its bound) is given out.
    """
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    step = 16
    for width in np.unique(-(-size // step)) * step:  # groups of about one size together
        mine = np.flatnonzero((size <= width) & (size > width - step))
        mine = mine[np.argsort(news[mine], kind="stable")]
        for some in np.array_split(mine, max(1, int(width * news[mine].sum()) // 250_000)):
            full = np.arange(width) < size[some][:, None]
            who = node[np.where(full, start[some][:, None] + np.arange(width), 0)]
            to = who[:, : news[some].max(initial=0)]  # the new ones, and others where a group has fewer
            d = left[who] @ right[to].swapaxes(-1, -2)
            d[:, np.arange(to.shape[1]), np.arange(to.shape[1])] = np.inf
            limit = np.where(full, bound[who], -np.inf).astype(np.float32)
            ok = d < limit[:, :, None]
            if not full.all():
                ok &= full[:, None, : to.shape[1]]
            g, i, j = np.nonzero(ok)
            found.append((who[g, i], _keys(d[g, i, j], to[g, j])))
            least = news[some].min(initial=width)
            if least < width:  # what the new ones find in the others
                ok = d[:, least:] < limit[:, None, : to.shape[1]]
                ok &= (full & (np.arange(width) >= news[some][:, None]))[:, least:, None]
                g, i, j = np.nonzero(ok)
                found.append((to[g, j], _keys(d[g, i + least, j], who[g, i + least])))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _descend(left: np.ndarray, right: np.ndarray, degree: int, seed: int) -> np.ndarray:
    """(n, degree) keys: NN-descent within one cell.

    The first lists are those of vectors that lie close in random orders, by the sides of hyperplanes
    through the medians and then by a projection. In each round the neighbours of a node, both ways, are
    compared with each other where any is new; those around a popular node in shares of about GROUP, dealt
    anew each round. It ends when few entries are new, which must be: a list only ever takes nearer nodes.
    """
    n, rng = len(left), np.random.default_rng(seed)
    near = np.full((n, degree), _NONE)
    chunk = max(2 * degree + 16, min(CHUNK, n // 16))

    def meet(node: np.ndarray, start: np.ndarray, size: np.ndarray, news: np.ndarray) -> None:
        for some in np.array_split(rng.permutation(len(start)), max(1, int((size * news).sum() / PRODUCTS))):
            _enter(near, *_met(left, right, node, start[some], size[some], news[some], _nearness(near[:, -1])))

    for _ in range(ORDERS if n > chunk else 1):
        side = right[:, :-3] @ rng.normal(size=(right.shape[1] - 3, SPLITS + 1)).astype(np.float32)
        side -= np.median(side, axis=0)
        places = np.linspace(0, n, max(1, round(n / chunk)) + 1).astype(int)
        meet(np.lexsort((side[:, SPLITS], (side[:, :SPLITS] > 0) @ (1 << np.arange(SPLITS)))), places[:-1], np.diff(places), np.diff(places))
    while True:
        known = near != _NONE
        opened = known & ((near & 1) == 1)
        if opened.sum() <= SETTLED * known.sum():
            return near
        u, at = np.nonzero(known)
        w, old = _node(near[u, at]), ~opened[u, at]
        near[opened] -= 1
        both = np.sort(np.concatenate([u << 33 | w << 1 | old, w << 33 | u << 1 | old]))
        both = both[_edges_of(both >> 1)]
        share = rng.integers(0, 1 << 30, len(both)) % -(-np.bincount(both >> 33, minlength=n) // GROUP)[both >> 33]
        order = np.lexsort((both & 1, share, both >> 33))  # the new ones first in each share
        both, share = both[order], share[order]
        start = _edges_of(both >> 33, share)
        size, news = np.diff(np.append(start, len(both))), np.add.reduceat(1 - (both & 1), start)
        meet((both >> 1) & 0xFFFFFFFF, start[news > 0], size[news > 0], news[news > 0])


def _by_cell(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Rows of one cell (first column) after the other, whole or, with ``most``, cut off after about so many."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        edges = [*_edges_of(b.column(0).to_numpy()), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if held and (held[0].column(0)[0].as_py() != b.column(0)[int(lo)].as_py() or most and count >= most):
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
            held.append(b.slice(lo, hi - lo))
            count += hi - lo
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _unit(head: np.ndarray, q: np.ndarray) -> float:
    """Median length of coded vectors."""
    return float(np.median(head[:, 0] * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)))) or 1.0


def _fit(rows: DataFrame, total: int) -> Cells | None:
    """k-means cells of about FIT_ROWS rows, chosen by a hash of their ids; copies count once."""
    share = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000)) < round(1_000_000 * min(1.0, FIT_ROWS / max(total, 1)))
    found = rows.where(share).select("v").toArrow().column("v").combine_chunks()
    if not len(found):
        return None
    x = np.unique(_matrix(found), axis=0)
    unit = float(np.median(np.sqrt((x * x).sum(axis=1)))) or 1.0
    x = np.clip(x / unit, -1e15, 1e15).astype(np.float32)
    count = min(max(CELLS, round(float(np.sqrt(total)) / ROOTS)), max(1, len(x) // 64))
    rng = np.random.default_rng(5)
    cells = Cells(unit, x[rng.permutation(len(x))[:count]].copy(), np.zeros(count, dtype=np.float32), np.ones(count, dtype=np.int64))
    for _ in range(FIT_ROUNDS):
        at = cells.of(x)
        size = np.bincount(at, minlength=count)
        total_of = np.zeros((count, x.shape[1]))
        np.add.at(total_of, at, x)
        cells.centres = np.where(size[:, None] > 0, total_of / np.maximum(size, 1)[:, None], cells.centres).astype(np.float32)
    at = cells.of(x)
    off = ((x - cells.centres[at]).astype(np.float64) ** 2).mean(axis=1)
    cells.spread = np.sqrt(np.bincount(at, weights=off, minlength=count) / np.maximum(np.bincount(at, minlength=count), 1)).astype(np.float32)
    return cells


def _dealt(cells: Cells | None):
    """(id, code) to (cell, id, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                cell = np.zeros(len(ids), dtype=np.int64) if cells is None else cells.dealt(_plain(*_codes(b.column(1)), cells.unit), ids)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", "id", "code"])

    return run


def _graphs(degree: int, seed: int):
    """(cell, id, code) by cell to (cell, id, code, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            head, q = _codes(rows.column(2).chunk(0))
            ids, unit = rows.column(1).to_numpy(), _unit(head, q)
            x = _plain(head, q, unit)
            near = _descend(*_sides(head, x, unit), degree, seed)
            u, at = np.nonzero(near != _NONE)
            w = _node(near[u, at])
            d = np.concatenate([-np.einsum("ij,ij->i", x[u[lo : lo + 8192]], x[w[lo : lo + 8192]]) for lo in range(0, max(1, len(u)), 8192)]).astype(np.float64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(ids)))]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array((d * unit * unit).astype(np.float32)), pa.array(ids[w])], ["d", "w"])
            table = pa.table([rows.column(0), rows.column(1), rows.column(2), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["cell", "id", "code", "near"])
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def _sweep(df: DataFrame) -> None:
    """Have Spark delete the shuffle files of what is written, which else stay until the driver collects its garbage."""
    df.sparkSession._jvm.System.gc()


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", degree: int | None = None, seed: int = 11) -> Index:
    """Index every usable row; equal vectors are one node, so copies crowd nobody out.

    Nodes are dealt to cells, and a task makes the graph of a cell by itself.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dim = sizes["size"] if sizes else 0
    rows = rows.where(F.size("v") == dim)
    total, longest = rows.agg(F.count(F.lit(1)), F.max(_square())).first()
    cells = _fit(rows, total)
    nodes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("id")), "nodes")
    coded = _coded(nodes, longest or 1.0).select("id", "code")
    mixed = F.xxhash64("v").alias("h")  # sorted by that, arrays are seldom compared
    members = cut(rows.select("*", mixed).join(nodes.select("v", "id", mixed), ["h", "v"]).select("vec_id", "id"), "members")
    kind = "cell long, id long, code binary"
    if cells is not None:
        size = np.zeros(len(cells.centres), dtype=np.int64)
        for c, n in coded.mapInArrow(_dealt(cells), kind).groupBy("cell").count().collect():
            size[c] = n
        cells.nodes = int(size.sum())
        cells.shares = np.maximum(1, -(-size * len(size) // (2 * cells.nodes)))
        least, beam = grown(int((size / cells.shares).max()))
    else:
        least, beam = grown(0)
    degree = degree or least
    parts = 2 * int(cells.shares.sum()) if cells is not None else 1
    _sweep(nodes)
    dealt = coded.mapInArrow(_dealt(cells), kind).repartition(parts, "cell").sortWithinPartitions("cell", "id")
    graph = cut(dealt.mapInArrow(_graphs(degree, seed), f"{kind}, near array<struct<d:float,w:long>>"), "graph")
    _sweep(nodes)
    return Index(nodes, members, graph, dim, degree, beam, cells)


def _scored(state: DataFrame, pairs: DataFrame, nodes: DataFrame, column: str, read, dots, most: int) -> DataFrame:
    """(id, near): the beams of ``state`` with the nodes w of ``pairs`` (id, w) in them, nearest ``most``.

    ``read`` makes factors and vectors of ``column``, ``dots`` their products. The first row of an id
    brings the query and its beam, the others the candidates, a batch at a time.
    """
    base = state.join(nodes.select("id", column), "id").select("id", F.lit(None).cast("long").alias("w"), column, "near")
    there = pairs.join(nodes.select(F.col("id").alias("w"), column), "w").select("id", "w", column, F.lit(None).cast(_MARKED).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            if held is not None:
                rows = pa.concat_tables([held, rows.cast(held.schema)]).combine_chunks()
            ids = rows.column(0).to_numpy()
            start = _edges_of(ids)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
            asked = np.flatnonzero(rows.column(1).is_valid().to_numpy())  # the row of the query has no w
            factor, x = read(rows.column(2).combine_chunks())
            to = start[group[asked]]
            d = -(dots(x, asked, to) * factor[asked] * factor[to])
            sizes, d0, w0, fresh0 = _flat(rows.column(3).combine_chunks())
            targets = pc.fill_null(rows.column(1), 0).to_numpy()[asked]
            owner = np.concatenate([np.repeat(group, sizes), group[asked]])
            owner, d, w, fresh = _best(owner, np.concatenate([d0, d]), np.concatenate([w0, targets]), np.concatenate([fresh0, np.ones(len(asked), dtype=bool)]), most)
            near = _lists(np.bincount(owner, minlength=len(start)), d, w, fresh)
            done = pa.table([pa.array(ids[start]), near], names=["id", "near"])
            if len(start) > 1:
                yield from done.slice(0, len(start) - 1).combine_chunks().to_batches()
            last = rows.slice(int(start[-1]), 1)
            held = pa.table([last.column(0), last.column(1), last.column(2), near.slice(len(start) - 1)], names=rows.schema.names)
        if held is not None:
            yield from held.select([0, 3]).combine_chunks().to_batches()

    rows = base.union(there).repartition("id").sortWithinPartitions("id", F.col("w").asc_nulls_first())
    return rows.mapInArrow(run, f"id long, near {_MARKED}")


def _in_order(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows in doubles, summed in order."""
    total = np.zeros(len(left))
    for i in range(x.shape[1]):
        column = np.ascontiguousarray(x[:, i])
        total += column[left] * column[right]
    return total


def _read_vector(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(column)), _matrix(column)


def _roads(near: pa.ListArray, ids: np.ndarray, most: int) -> np.ndarray:
    """(n, most) places: the neighbours of each node of a cell, whose ids are sorted, then other nodes that
    have it as a neighbour, nearest in rank first; its own place where there are fewer."""
    n = len(ids)
    sizes = pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = near.flatten()
    u = np.repeat(np.arange(n), sizes)
    w = np.searchsorted(ids, flat.field(1).to_numpy(zero_copy_only=False))
    at = np.arange(len(u)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places, ranks = max(n, 1), 2 * int(sizes.max(initial=0)) + 1
    ways = np.sort(np.concatenate([(u * places + w) * ranks + at, (w * places + u) * ranks + ranks // 2 + at]))
    ways = ways[_edges_of(ways // ranks)]  # each once, with its better rank
    pair = ways // ranks
    ways = np.sort((pair // places * ranks + ways % ranks) * places + pair % places)
    owner = ways // places // ranks
    place = np.arange(len(ways)) - np.searchsorted(owner, np.arange(n))[owner]
    out = np.repeat(np.arange(n)[:, None], most, axis=1)
    out[owner[place < most], place[place < most]] = (ways % places)[place < most]
    return out


def _walk(x: np.ndarray, roads: np.ndarray, q: np.ndarray, home: np.ndarray, begun: np.ndarray, beam: int) -> np.ndarray:
    """(m, beam) keys: greedy searches of a cell's graph for the vectors ``q`` together.

    They begin at the places ``begun`` and at the ``home`` of a query (-1: in another cell). In a hop the
    nearest EXPANDED nodes of a beam that were not expanded yet bring their roads, and the beam keeps the
    nearest. It ends when every node of every beam is expanded, which it must, as a beam only ever takes
    nearer nodes.
    """
    near = np.full((len(q), beam), _NONE)
    d = -(q @ x[begun].T)
    k = min(beam, len(begun))
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    near[:, :k] = _keys(np.take_along_axis(d, at, axis=1), begun[at])
    near.sort(axis=1)
    mine = np.flatnonzero(home >= 0)
    _enter(near, mine, _keys(-np.einsum("ij,ij->i", q[mine], x[home[mine]]), home[mine]))
    while True:
        opened = (near != _NONE) & ((near & 1) == 1)
        opened &= np.cumsum(opened, axis=1) <= EXPANDED
        row, at = np.nonzero(opened)
        if not len(row):
            return near
        w = _node(near[row, at])
        near[row, at] -= 1
        bound = _nearness(near[:, -1])
        order = _order(w, len(x))
        row, w = row[order], w[order]
        start = _edges_of(w)
        size = np.diff(np.append(start, len(w)))
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        last, width = 0, 1
        while last < size.max():
            mine = np.flatnonzero((size > last) & (size <= width))  # nodes that about as many beams expand
            for some in np.array_split(mine, max(1, len(mine) * (width + roads.shape[1]) // 16_000)):
                full = np.arange(width) < size[some][:, None]
                who = row[np.where(full, start[some][:, None] + np.arange(width), start[some][:, None])]
                at = w[start[some]][:, None]
                to = roads[at[:, 0]]
                d = -(q[who] @ x[to].swapaxes(-1, -2))
                ok = d < np.where(full, bound[who], -np.inf).astype(np.float32)[:, :, None]
                ok &= (to != at)[:, None, :]
                g, i, j = np.nonzero(ok)
                found.append((who[g, i], _keys(d[g, i, j], to[g, j])))
            last, width = width, 2 * width
        _enter(near, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _walks(beam: int, ways: int, most: int):
    """(cell, asks, id, code, near, bound) by cell, nodes before queries, to (id, near) of each query and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for rows in _by_cell(batches, TOGETHER):
            asks = rows.column(1).to_numpy()
            split = int(np.searchsorted(asks, 1))
            if rows.column(0)[0].as_py() != cell:
                cell, held, made = rows.column(0)[0].as_py(), [], False
            if split:
                held.append(rows.slice(0, split))
            rows = rows.slice(split)
            if not rows.num_rows or not held:
                continue
            if not made:
                nodes, made = pa.concat_tables(held).combine_chunks(), True
                ids = nodes.column(2).to_numpy()
                head, q = _codes(nodes.column(3).chunk(0))
                unit = _unit(head, q)
                x = _plain(head, q, unit)
                roads = _roads(nodes.column(4).chunk(0), ids, ways)
                long = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=1), kind="stable")
                begun = np.concatenate([long[:DEGREE], np.random.default_rng(3).permutation(long[DEGREE:])[: BEGUN - DEGREE]])
            asked = rows.column(2).to_numpy()
            rows = rows.combine_chunks()
            head, q = _codes(rows.column(3).chunk(0))
            length = head[:, 0] * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            q = (q * (head[:, :1] / length[:, None])).astype(np.float32)
            at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            near = _walk(x, roads, q, np.where(ids[at] == asked, at, -1), begun, beam)[:, :most]
            d = _nearness(near) * (length * unit)[:, None]
            bound = rows.column(5).to_numpy()[:, None]
            keep = (near != _NONE) & (d <= bound + 1e-3 * np.abs(np.where(np.isinf(bound), 0.0, bound)))
            some = keep.any(axis=1)
            found = pa.RecordBatch.from_arrays([pa.array(asked[some]), _lists(keep.sum(axis=1)[some], d[keep], ids[_node(near[keep])], np.zeros(int(keep.sum()), dtype=bool))], names=["id", "near"])
            yield found

    return run


def search(index: Index, starts: DataFrame, beam: int = BEAM, most: int | None = None) -> DataFrame:
    """(id, near): greedy search from each node of ``starts`` (id): the ``most`` (or ``beam``) nearest found,
    by code.

    A query goes to the cells that may hold its nearest (see Cells.visited), and is searched in the graph
    of each. What is farther than the ``most`` nearest that its own list has does not leave a cell.
    """
    most = most or beam
    graph = index.graph
    if "cell" not in graph.columns:
        graph = index.nodes.select("id", "code").join(graph, "id", "left").select(F.lit(0).cast("long").alias("cell"), "id", "code", "near")
    cells = index.cells

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                row, cell = cells.routes(_plain(*_codes(some.column(1)), cells.unit)) if cells is not None else (np.arange(some.num_rows), np.zeros(some.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *some.take(pa.array(row)).columns], names=["cell", "id", "code", "bound"])

    order = F.array_sort(F.transform("near", lambda e: e["d"].cast("double")))
    bound = F.when(F.size("near") >= most, F.element_at(order, most)).otherwise(F.lit(float("inf")))
    asked = graph.join(starts.select("id").distinct(), "id", "left_semi").select("id", "code", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    asked = asked.mapInArrow(routed, "cell long, id long, code binary, bound double")
    known = graph.select("cell", F.lit(0).alias("asks"), "id", "code", "near", F.lit(0.0).alias("bound"))
    both = known.union(asked.select("cell", F.lit(1).alias("asks"), "id", "code", F.lit(None).cast(graph.schema["near"].dataType).alias("near"), "bound"))
    parts = 2 * int(cells.shares.sum()) if cells is not None else 1
    found = both.repartition(parts, "cell").sortWithinPartitions("cell", "asks", "id").mapInArrow(_walks(beam, index.degree * 5 // 4, most), f"id long, near {_MARKED}")
    beams = cut(_merge(found, most), "beams")
    return beams.select("id", F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["w"].alias("w"))).alias("near"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id ``every`` divides.

    Vectors that are null, empty, zero, of another dimension than most, or with null or non-finite
    components take no part, nor do rows with a null id. Equal vectors are found once and given
    out as all their ids, smallest first; repeated rows of an id count once. Fewer candidates than
    ``k`` are all returned; an empty table gives no rows.
    """
    index = index or build(vectors, id_col, vector_col)
    members = index.members.distinct()
    queries = members.where(F.col("vec_id") % every == 0)
    beams = search(index, queries.select("id").distinct(), max(index.beam, 2 * k), k + 1 + k // 4)
    copies = top_per_key(members, "id", ["vec_id"], k + 1, "vec_id").groupBy("id").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    empty = beams.select("id", F.array().cast(_MARKED).alias("near"))
    exact = _scored(empty, beams.select("id", F.explode("near.w").alias("w")), index.nodes, "v", _read_vector, _in_order, k + 1)
    found = exact.select("id", F.explode("near").alias("e")).select("id", F.col("e.d").alias("d"), F.col("e.w").alias("w"))
    given = found.join(copies.withColumnRenamed("id", "w"), "w").select("id", F.transform("ids", lambda v: F.struct(F.col("d").alias("d"), v.alias("vec_id"))).alias("hits"))
    listed = given.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    mine = queries.join(listed, "id").select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k)).alias("at", "hit")
    )
    return mine.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.d")).alias("score"))
