"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Every text becomes its set of word 5-gram hashes. Texts with the same set
   form one class (an aggregation); only one signature a class goes on.
2. A signature has ``coords`` minima. Each (coordinate, value) pair is a
   posting list; lists of one class are dropped. A class with fewer than
   ``matches`` remaining coordinates has no partner and leaves.
3. Prefix: two signatures with ``matches`` equal coordinates share one among
   the ``coords - matches + 1`` rarest of each, so classes are posted under
   these only, rarest lists first; very common values are never posted unless
   a signature has nothing rarer.
4. Counting: a list's classes are posted anew by all their coordinates. For a
   class in turn, the postings of its ``coords - matches + 1`` rarest values
   are merged, which counts the collisions of every class that can still get
   to ``matches``; the long postings are skipped and only looked up for those
   candidates. What is connected already leaves the postings. Out come stars
   (each member with its group's smallest class), never all pairs. Lists of
   more than ``64 * block`` classes are dealt out as pairs of blocks.
5. The stars' components are families, which are confirmed on full shingle
   sets. A family of more than ``block`` sets is dealt out in blocks, each with
   the family's first set; only sets that this leaves outside the family's
   largest component then meet all its blocks.
6. Components of the exact links label the classes, and so the rows.

At similarity 0.75 a pair has 48 of 64 equal coordinates in the mean and fewer
than 32 with probability 6e-6; such a pair would be missed unless other links
connect it. No pair below the threshold is ever linked.

Null or empty texts (or white space only) have an empty set and link with
nothing. Rows with a null id take part; they are never kept, and a component
of only such rows has a null component_id. Repeated rows each come back. An
empty table gives an empty result; columns other than id and text are ignored.
Sets are told apart by a 64-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded, components, drop, parts, store
from larkspur.llm.textkernel import buffer_of, mix64, shingles, word_hashes

U64 = np.uint64
_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def signature(values: np.ndarray, coords: int) -> np.ndarray:
    """The 32-bit minima of ``coords`` permutations of a set of 64-bit hashes."""
    least = np.full(coords, ~U64(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 4096):
            part = (values[i : i + 4096, None] ^ _XOR[:coords]) * _MUL[:coords]
            np.minimum(least, part.min(0), out=least)
    return (least >> U64(32)).astype(np.uint32)


def fingerprint(values: np.ndarray) -> int:
    """A 64-bit fingerprint of a sorted set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix64(values ^ U64(0x5851F42D4C957F2D))) + U64(len(values)) * U64(0x9E3779B97F4A7C15)
    return int(mix64(np.array([total]))[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    base = 0
    for part in parts(batch):
        raw, off = buffer_of(part.column("text"))
        hashes, at = word_hashes(raw, off)
        for i in range(part.num_rows):
            yield base + i, shingles(hashes[at[i] : at[i + 1]], width)
        base += part.num_rows


def _describe(width: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, sig = [], [], []
            for _, values in _sets(batch, width):
                n.append(len(values))
                fp.append(fingerprint(values) if len(values) else None)
                sig.append(signature(values, coords).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("own"), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "own", "n_shingles", "fp", "sig"],
            )

    return run


def _walk(n: int, reach) -> np.ndarray:
    """Component numbers of a graph on 0..n-1: reach(i, rest) gives the mask of rest linked with i."""
    label, rest = np.arange(n), np.arange(n)
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            hit = reach(front.pop(), rest)
            if hit.any():
                new = rest[hit]
                label[new] = root
                front += list(new)
                rest = rest[~hit]
    return label


class _Parts:
    """Parts of 0..n-1 that grow together; the smaller one takes the larger one's label."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        self.members = {int(label[m[0]]): m for m in np.split(order, cuts)} if len(label) else {}

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            moved = self.members.pop(b)
            self.label[moved] = a
            self.members[a] = np.concatenate((self.members[a], moved))


def _across(left: np.ndarray, right: np.ndarray, label: np.ndarray, reach) -> np.ndarray:
    """Component numbers after the links between two sides; label has those known before."""
    parts = _Parts(label)
    for i in left:
        rest = right[parts.label[right] != parts.label[i]]
        if len(rest):
            for j in rest[reach(i, rest)]:
                parts.join(i, j)
    return parts.label


def _blocks(df: DataFrame, key: list[str], size: str, member: str, block: int) -> DataFrame:
    """Deal the rows of each key out to pairs of blocks (bi <= bj); ``side`` tells a row's own block.

    A key of n rows has ceil(n / block) blocks; with one block nothing is repeated.
    """
    nb = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("nb")).cast("int")
    spread = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda x: F.struct(F.least(x, F.col("side")).alias("bi"), F.greatest(x, F.col("side")).alias("bj")),
    )
    return df.withColumn("nb", nb).withColumn("side", own).withColumn("at", F.explode(spread)).select("*", "at.bi", "at.bj").drop("at", "nb")


def _grouped(keys: list[str], fn):
    """A mapInArrow function on rows sorted by keys: fn gets each group as a table."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        out = fn(pa.Table.from_batches(held).combine_chunks())
        return out if out is not None and out.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            if last is not None:
                change[0] = any(c[0] != x for c, x in zip(cols, last))
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i < batch.num_rows and change[i] and held:
                    if (out := flush(held)) is not None:
                        yield out
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
            last = [c[-1] for c in cols]
        if held and (out := flush(held)) is not None:
            yield out

    return run


def _stars(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    """Each id with the smallest of its component, where that is another."""
    _, part = np.unique(label, return_inverse=True)
    least = np.full(part.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids)
    root = least[part]
    some = root != ids
    if not some.any():
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some])], ["a", "b"])


class Postings:
    """Classes posted by the coordinates and values of their signatures."""

    def __init__(self, sig: np.ndarray, rows: np.ndarray):
        self.sig, self.alive = sig, np.zeros(len(sig), bool)
        self.alive[rows] = True
        self.at = np.arange(sig.shape[1], dtype=np.uint64) << U64(32)
        keys = (self.at | sig[rows].astype(np.uint64)).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.who = keys[order], np.repeat(rows, sig.shape[1])[order]

    def collisions(self, i: int, matches: int) -> np.ndarray:
        """The classes alive that collide with class i in at least ``matches`` coordinates."""
        want = self.at | self.sig[i].astype(np.uint64)
        lo, hi = np.searchsorted(self.keys, want), np.searchsorted(self.keys, want, side="right")
        order = np.argsort(hi - lo, kind="stable")
        merged, skipped = order[: len(order) - matches + 1], order[len(order) - matches + 1 :]
        found = np.concatenate([self.who[lo[c] : hi[c]] for c in merged])
        found, count = np.unique(found[self.alive[found]], return_counts=True)
        count += (self.sig[np.ix_(found, skipped)] == self.sig[i, skipped]).sum(1)
        return found[count >= matches]


def _collided(sig: np.ndarray, matches: int, small: int = 48) -> np.ndarray:
    """Component numbers of signatures linked by at least ``matches`` collisions."""
    n = len(sig)
    label = np.arange(n)
    if n <= small:
        linked = (sig[:, None, :] == sig[None, :, :]).sum(2) >= matches
        return _walk(n, lambda i, rest: linked[i, rest])
    postings, left = Postings(sig, label), n
    for root in range(n):
        if not postings.alive[root]:
            continue
        postings.alive[root] = False
        front, left = [root], left - 1
        while front and left:
            new = postings.collisions(front.pop(), matches)
            label[new] = root
            postings.alive[new] = False
            front += new.tolist()
            left -= len(new)
            if 2 * left < len(postings.keys) // sig.shape[1] and left:
                postings = Postings(sig, np.flatnonzero(postings.alive))
    return label


def _collided_across(sig: np.ndarray, left: np.ndarray, right: np.ndarray, matches: int) -> np.ndarray:
    postings, parts = Postings(sig, right), _Parts(np.arange(len(sig)))
    for i in left:
        postings.alive[right] = parts.label[right] != parts.label[i]
        for j in postings.collisions(i, matches):
            parts.join(i, j)
    return parts.label


def _count(coords: int, matches: int):
    def run(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        ids = group.column("fp").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, coords)
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        if bi == bj:
            return _stars(ids, _collided(sig, matches))
        side = group.column("side").to_numpy()
        return _stars(ids, _collided_across(sig, np.flatnonzero(side == bi), np.flatnonzero(side == bj), matches))

    return run


def _reach(sets: list[np.ndarray], percent: int):
    """reach(i, rest): which of the sets rest are similar enough to set i."""
    size = np.array([len(x) for x in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    at = [flat[start[i] : start[i + 1]] for i in range(len(sets))]

    def reach(i: int, rest: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])).nonzero()[0]
        hit = np.zeros(len(rest), bool)
        if len(fits):
            mark[at[i]] = 1
            use = rest[fits]
            both = np.add.reduceat(mark[np.concatenate([at[j] for j in use])], np.concatenate(([0], np.cumsum(size[use])[:-1])))
            mark[at[i]] = 0
            hit[fits] = 100 * both >= percent * (size[use] + size[i] - both)
        return hit

    return reach


def _confirm(percent: int):
    """Exact links within a block of a family."""

    def run(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        ids = group.column("fp").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        return _stars(ids, _walk(len(ids), _reach(sets, percent)))

    return run


def _confirm_rest(percent: int):
    """Exact links between a block of a family's sets outside its largest component and one of all its sets."""

    def run(group: pa.Table) -> pa.RecordBatch | None:
        outside = group.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        if outside.all() or not outside.any():
            return None
        ids = group.column("fp").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        _, label = np.unique(group.column("part").to_numpy(), return_inverse=True)
        return _stars(ids, _across(np.flatnonzero(outside), np.flatnonzero(~outside), label, _reach(sets, percent)))

    return run


def _dealt(rows: DataFrame, keys: list[str], columns: list[str], fn) -> DataFrame:
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_grouped(keys, fn), "a long, b long")


def _links(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join whatever exact links join, for sets (family, fp, shingles)."""
    # A family counts by its sets and by their size (512 shingles as one set), so long texts make smaller blocks.
    sizes = store(sets.groupBy("family").agg(F.ceil(F.greatest(F.count("*"), F.ceil(F.sum(F.length("shingles")) / 4096)) / F.lit(block)).cast("int").alias("blocks")).where("blocks > 0"))
    own = lambda n: F.pmod(F.xxhash64(F.col("fp"), F.lit(17)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    first = F.when(F.col("fp") == F.col("family"), every(F.col("blocks"))).otherwise(F.array(own(F.col("blocks"))))
    dealt = sets.join(sizes, "family").withColumn("block", F.explode(first))
    links = store(_dealt(dealt, ["family", "block"], ["fp", "shingles"], _confirm(percent)))
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return links
    member = sets.join(large, "family").select("family", "fp", "blocks", F.length("shingles").alias("bytes"))
    roots = components(links)
    parted = member.join(roots, F.col("fp") == roots.node, "left").select("family", "fp", "blocks", "bytes", F.coalesce("root", "fp").alias("part"))
    counts = parted.groupBy("family", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select(F.col("family").alias("f"), "main")
    parted = store(parted.join(main, F.col("family") == F.col("f")).withColumn("apart", F.col("part") != F.col("main")).select("family", "fp", "blocks", "bytes", "part", "apart"))
    outside = parted.where("apart").groupBy("family").agg(F.ceil(F.greatest(F.count("*"), F.ceil(F.sum("bytes") / 4096)) / F.lit(block)).cast("int").alias("columns"))
    parted = parted.join(outside.withColumnRenamed("family", "g"), F.col("family") == F.col("g"))
    parted = parted.select(F.col("fp").alias("who"), "family", "blocks", "columns", "part", "apart")
    have = sets.select("fp", "shingles").join(parted, F.col("fp") == F.col("who"))
    inner = have.select("*", F.lit(False).alias("outside"), own(F.col("blocks")).alias("block"), F.explode(every(F.col("columns"))).alias("column"))
    outer = have.where("apart").select("*", F.lit(True).alias("outside"), F.explode(every(F.col("blocks"))).alias("block"), own(F.col("columns")).alias("column"))
    rest = _dealt(inner.union(outer), ["family", "block", "column"], ["fp", "shingles", "part", "outside"], _confirm_rest(percent))
    return links.union(store(rest))


def _fetch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want").to_numpy()
            at, fps, values = [], [], []
            for i, own in _sets(batch, width):
                if len(own) and (fp := fingerprint(own)) == want[i]:
                    at.append(i)
                    fps.append(fp)
                    values.append(own.tobytes())
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("family").take(pa.array(at)), pa.array(fps, pa.int64()), pa.array(values, pa.binary())], ["family", "fp", "shingles"]
                )

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    percent: int = 75,
    coords: int = 64,
    matches: int = 32,
    block: int = 1024,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs; see the module's notes."""
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("own", F.xxhash64("text"))
    described = store(texts.mapInArrow(_describe(width, coords), "doc_id long, own long, n_shingles long, fp long, sig binary"))
    classes = store(
        described.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"), F.min(F.struct("doc_id", "own")).alias("rep"))
    )
    # Postings as one long each: the coordinate and the value, from the signature's hex digits.
    values = F.transform(
        F.sequence(F.lit(0), F.lit(coords - 1)),
        lambda j: F.xxhash64(j, F.substring(F.col("sig"), j * 4 + 1, F.lit(4))),
    )
    posts = classes.select("fp", F.explode(values).alias("list"))
    lists = posts.groupBy("list").agg(F.count("*").alias("n_list")).where("n_list > 1")
    ranked = (
        posts.join(lists, "list")
        .groupBy("fp")
        .agg(F.array_sort(F.collect_list(F.struct("n_list", "list"))).alias("all"))
        .where(F.size("all") >= matches)
    )
    # coords - matches + 1 rarest of all coordinates; those in lists of one class come first and are spent.
    left = F.size("all") - (matches - 1)
    prefix = ranked.select("fp", F.explode(F.slice("all", F.lit(1), left)).alias("p")).select("fp", "p.list", "p.n_list")
    prefix = prefix.join(classes.select("fp", "sig"), "fp")
    dealt = _blocks(prefix, ["list"], "n_list", "fp", 64 * block)
    families = components(_dealt(dealt, ["list", "bi", "bj"], ["side", "fp", "sig"], _count(coords, matches)))
    rooted = families.union(families.select("root", "root")).distinct().toDF("fp", "family")
    # One row of each class is fetched, by id and text hash: rows that share an id, or have none, are told apart.
    wanted = rooted.join(classes.select("fp", "rep"), "fp").select(F.col("rep.doc_id").alias("at_id"), F.col("rep.own").alias("at_own"), F.col("fp").alias("want"), "family")
    fetched = texts.join(wanted, (texts.own == F.col("at_own")) & texts.doc_id.eqNullSafe(F.col("at_id"))).groupBy("want", "family").agg(F.min("text").alias("text"))
    sets = store(fetched.mapInArrow(_fetch(width), "family long, fp long, shingles binary"))
    links = _links(sets, percent, block)
    roots = components(links)
    drop(families)
    drop(sets)
    reached = classes.select("fp", F.col("doc_id").alias("least")).join(roots, F.col("fp") == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = reached.groupBy("root").agg(F.min("least").alias("component"))
    label = store(reached.join(smallest, "root").select("fp", "component"))
    drop(classes)
    drop(roots)
    out = described.select("doc_id", "n_shingles", "fp").join(label, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
