"""Embedding near-duplicates by cells around centroids, searched by inverted lists.

Equal vectors are one. At most ``sample`` vectors (smallest hashes) are halved
again and again at medians; the parts' means are the centroids of cells: one
for about ``leaf`` vectors where ``CELLS`` of them suffice, or else so few that
a cell's vectors fill about 64 MB. A vector is held by the cell of its nearest
centroid, and asks there and in the other cells whose centroid is less near by
at most ``spill``. So a pair is found if either asks where the other is held.
Unless given, ``spill`` is about 3.5 deviations of half of what two vectors at
the threshold differ by along the line between two centroids.

A task holds a cell's vectors once, in lists around centroids of its own, one
for about ``leaf`` vectors whatever the cell's size; those that ask stream past
them and read the lists that are near enough. Cosines are bounded by matrix
products, and taken in double precision where they come near the threshold. A
pair is counted for both its vectors, in one cell: where they ask each other's,
in the one of the smaller number. So link counts need no list of pairs; only a
forest of the links leaves the task. Cells with more than ``block`` vectors are
dealt out in blocks, each of which meets all that ask, so none is capped.

Null and zero vectors and those holding null or non-finite components link
with nothing, nor do vectors of different lengths. Repeated rows count as
vectors of their own. An empty table gives an empty result; further columns
are ignored. Vectors are told apart by a 64-bit hash of their bytes. The table
is read three times, as copies of its vectors would take more room.

Pairs at the threshold are found with probability over 0.99 in tests against
brute force; none below it is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.ann import Lists
from larkspur.llm.common import components, drop, store
from larkspur.llm.vectors import encoded, flat, matrix, smallest_hashes, streamed

#: So many cells at most have about ``leaf`` vectors each; tables that need more have cells of some 64 MB, this number's quarter at least.
CELLS = 256

#: About how many bytes of vectors a cell of a larger table has.
CELL_BYTES = 64 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that the squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Cells:
    """Unit centroids, and those that are near to unit vectors."""

    def __init__(self, x: np.ndarray, size: int, rng: np.random.Generator):
        c = Lists(x, size, rng).centroids
        norm = np.sqrt((c * c).sum(1, keepdims=True))
        self.centroids = (c / np.maximum(norm, 1e-9)).astype(np.float32)

    def near(self, x: np.ndarray, margin: float, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's nearest centroid, and pairs (row, centroid) of those nearer than the nearest less ``margin``, by row."""
        home, rows, found = np.zeros(len(x), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(self.centroids)
        step = max(1, cells // n)
        for i in range(0, len(x), step):
            a = x[i : i + step].astype(np.float32, copy=False) @ self.centroids.T
            home[i : i + step] = a.argmax(1)
            r, c = np.divmod(np.flatnonzero(a >= a.max(1, keepdims=True) - np.float32(margin)), n)
            rows.append(r + i)
            found.append(c)
        return home, np.concatenate(rows), np.concatenate(found)


def _post(cells: dict[int, tuple[Cells, int, float]], kind: type):
    """Rows of the cells that hold vectors and of those where they ask; a batch's equal vectors are one."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, first, copies = np.unique(batch.column("node").to_numpy(), return_index=True, return_counts=True)
            some = batch.take(pa.array(first))
            blobs = some.column("vec").to_pylist()
            length = np.array([len(b) // size for b in blobs])
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                if int(d) in cells:
                    index, base, margin = cells[int(d)]
                    home, rows, leaf = index.near(_unit(matrix([blobs[i] for i in at], kind)), margin)
                    home, leaf = home + base, leaf + base
                else:  # a length that the sample lacks: one cell for it
                    home, rows, leaf = np.full(len(at), -d), np.arange(len(at)), np.full(len(at), -d)
                cuts = np.searchsorted(rows, np.arange(len(at) + 1))
                asks = leaf != home[rows]
                full = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(leaf, pa.int64()))
                # Only where a vector is held, all cells where it asks come with it.
                lists = full.take(pa.array(rows, pa.int64(), mask=asks))
                own = some.take(pa.array(at[rows]))
                columns = [own.column("node"), pa.array(copies[at[rows]]), own.column("vec"), pa.array(home[rows]), pa.array(leaf), pa.array(asks), lists]
                yield pa.RecordBatch.from_arrays(columns, ["node", "copies", "vec", "home", "leaf", "asks", "lists"])

    return run


class _Held:
    """A cell's vectors, in lists; ``answer`` counts the links of those that ask, and their own."""

    def __init__(self, table: pa.Table, kind: type, least: float, leaf: int, spill: float | None):
        self.kind, self.least, self.last = kind, least, None
        node = table.column("node").to_numpy()  # rising
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        copies = np.add.reduceat(table.column("copies").to_numpy(), first)
        table = table.take(pa.array(first)).combine_chunks()
        self.cell = table.column("leaf")[0].as_py()
        x = flat(table.column("vec"), kind)
        u = np.empty(x.shape, np.float32)
        for i in range(0, len(x), 8192):
            u[i : i + 8192] = _unit(x[i : i + 8192].astype(np.float64))
        self.margin = 1.75 * (spill or _spill(least, x.shape[1]))
        some = u[:: max(1, len(u) // 20_000)]
        self.lists = Cells(some.astype(np.float64), max(2, leaf * len(some) // len(u)) if len(u) > 4 * leaf else len(u), np.random.default_rng(len(u)))
        home, _, _ = self.lists.near(u, 0.0)
        order = np.argsort(home, kind="stable")
        self.node, self.copies, self.x, self.u = node[first][order], copies[order], x[order], u[order]
        self.starts = np.searchsorted(home[order], np.arange(len(self.lists.centroids) + 1))
        lists = table.column("lists").combine_chunks().take(pa.array(order))
        # Pairs (vector, cell where it asks) as sorted numbers.
        cell = lists.flatten().to_numpy()
        self.asked, cell = np.unique(cell, return_inverse=True)
        self.pairs = np.sort(np.repeat(np.arange(len(order)), lists.value_lengths().to_numpy()) * len(self.asked) + cell)
        self.label = np.arange(len(order))

    def own(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.node), 8192):
            at = np.arange(i, min(i + 8192, len(self.node)))
            yield from self._links(self.node[at], self.copies[at], self.x[at], self.u[at], np.full(len(at), self.cell), at)

    def answer(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = flat(batch.column("vec"), self.kind)
        u = _unit(x.astype(np.float64)).astype(np.float32)
        node = batch.column("node").to_numpy()
        yield from self._links(node, batch.column("copies").to_numpy(), x, u, batch.column("home").to_numpy(), None)

    def _links(self, node, copies, x, u, home, own, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        again = np.zeros(len(node), bool)  # an asking vector that comes in parts is told its links once
        if own is None:
            again = np.append(node[0] == self.last, node[1:] == node[:-1])
            self.last = node[-1]
        n = len(self.node)
        place = n + np.arange(len(node)) if own is None else own
        label = np.concatenate((self.label, n + np.arange(len(node)))) if own is None else self.label
        mine, theirs = np.zeros(len(node), np.int64), np.zeros(n, np.int64)
        us: list[int] = []
        vs: list[int] = []
        _, rows, lists = self.lists.near(u, self.margin)
        order = np.argsort(lists, kind="stable")
        rows, lists = rows[order], lists[order]
        other = np.searchsorted(self.asked, home)
        known = np.append(self.asked, np.iinfo(np.int64).max)[other] == home
        for l in np.unique(lists):
            a, b = int(self.starts[l]), int(self.starts[l + 1])
            if a == b:
                continue
            asks = rows[np.searchsorted(lists, l) : np.searchsorted(lists, l, "right")]
            step = max(1, cells // (b - a))
            for i in range(0, len(asks), step):
                q = asks[i : i + step]
                v = u[q] @ self.u[a:b].T
                hit = np.flatnonzero(v >= np.float32(self.least - 1e-5))
                if not len(hit):
                    continue
                p, e = np.divmod(hit, b - a)
                v, p, e = v.ravel()[hit], q[p], e + a
                close = np.flatnonzero(v <= self.least + 1e-5)
                if len(close):
                    good = np.ones(len(p), bool)
                    for j in range(0, len(close), 8192):
                        at = close[j : j + 8192]
                        good[at] = np.einsum("ij,ij->i", _unit(x[p[at]].astype(np.float64)), _unit(self.x[e[at]].astype(np.float64))) >= self.least
                    p, e = p[good], e[good]
                inside = home[p] == self.cell
                there = np.zeros(len(p), bool)  # counted in the cell of the one that asks
                out = np.flatnonzero(~inside & known[p] & (home[p] < self.cell))
                if len(out):
                    key = e[out] * len(self.asked) + other[p[out]]
                    at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                    there[out] = self.pairs[at] == key
                keep = np.where(inside, self.node[e] < node[p], ~there)
                p, e = p[keep], e[keep]
                theirs += np.bincount(e, copies[p], n).astype(np.int64) if len(e) else 0
                mine += np.bincount(p, self.copies[e] * ~again[p], len(node)).astype(np.int64) if len(p) else 0
                for s in range(0, len(p), 1 << 18):
                    f, t = _forest(place[p[s : s + (1 << 18)]], e[s : s + (1 << 18)], label)
                    us += f
                    vs += t
        self.label = label[:n]
        every = np.concatenate((self.node, node)) if own is None else self.node
        got, has = np.flatnonzero(mine), np.flatnonzero(theirs)
        if len(got) or len(has):
            a, b = every[np.array(us, np.int64)], every[np.array(vs, np.int64)]
            names = np.concatenate((node[got], self.node[has], a))
            links = np.concatenate((mine[got], theirs[has], np.zeros(len(a), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(links), pa.array(np.concatenate((node[got], self.node[has], b)))], ["node", "links", "other"])


def _forest(p: np.ndarray, q: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join parts not joined before; label (changed in place) tells the parts."""
    us, vs = [], []
    while len(p):
        lp, lq = label[p], label[q]
        fresh = lp != lq
        p, q, lp, lq = p[fresh], q[fresh], lp[fresh], lq[fresh]
        if not len(p):
            break
        high, low = np.maximum(lp, lq), np.minimum(lp, lq)
        order = np.lexsort((low, high))
        first = np.concatenate(([True], high[order][1:] != high[order][:-1]))
        take = order[first]  # each part joins its smallest neighbour
        us += p[take].tolist()
        vs += q[take].tolist()
        parent = np.arange(len(label))
        parent[high[take]] = low[take]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label[:] = parent[label]
    return us, vs


def _spill(least: float, dimension: int) -> float:
    return 2.25 * float(np.sqrt((2 - 2 * least) / dimension))


def _blocks(held: DataFrame, block: int) -> DataFrame:
    """The number of blocks (leaf, blocks) that each cell's vectors (leaf, …) are dealt out to."""
    return held.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    least: float = 0.95,
    leaf: int = 512,
    spill: float | None = None,
    sample: int = 20_000,
    block: int | None = None,
    seed: int = 9,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of df; see the module's notes."""
    rows, kind = encoded(df, id_col, vector_col)
    valid = rows.where("vec is not null").select("node", "vec")
    rows = store(rows.select("vec_id", "node"))
    n = rows.where("node is not null").count()
    nodes = rows.where("node is not null").select("node").distinct()
    chosen = store(smallest_hashes(nodes, nodes.count(), sample, seed, "node"))
    drawn = {r.node: bytes(r.vec) for r in valid.join(F.broadcast(chosen), "node").groupBy("node").agg(F.min("vec").alias("vec")).orderBy("node").collect()}
    item, rng, cells, base = np.dtype(kind).itemsize, np.random.default_rng(seed), {}, 0
    widest = max(map(len, drawn.values()), default=item)
    wanted = n / leaf if n <= CELLS * leaf else max(CELLS // 4, n * widest / CELL_BYTES)
    for width in sorted({len(v) for v in drawn.values()}):
        x = _unit(matrix([v for v in drawn.values() if len(v) == width], kind))
        index = Cells(x, max(1, -int(-len(drawn) // max(wanted, 1))), rng)
        cells[width // item] = (index, base, spill or _spill(least, x.shape[1]))
        base += len(index.centroids)
    posted = valid.mapInArrow(_post(cells, kind), "node long, copies long, vec binary, home long, leaf long, asks boolean, lists array<long>")
    sizes = store(_blocks(posted.where("not asks"), block or max(4096, 2 * CELL_BYTES // widest)))
    side = F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")
    dealt = posted.join(F.broadcast(sizes), "leaf").withColumn("side", side)
    # Where a cell has several blocks, a vector that one of them holds asks in the others.
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("side"))))
    dealt = dealt.withColumn("asks", F.col("asks") | (F.col("part") != F.col("side"))).select("leaf", "part", "asks", "node", "copies", "vec", "home", "lists")
    run = streamed(["leaf", "part"], lambda table: _Held(table, kind, least, leaf, spill), lambda held, batch: held.answer(batch), lambda held: held.own())
    found = store(dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks", "node").mapInArrow(run, "node long, links long, other long"))
    roots = components(found.where("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    labelled = classes.join(links, "node", "left").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    labelled = labelled.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    label = store(labelled.join(smallest, "root").select("node", "n_links", "component"))
    for t in (chosen, sizes, found, roots):
        drop(t)
    component = F.coalesce("component", "vec_id")
    return rows.join(label, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
