"""Scoring texts with context-tree weighting over bytes.

A text is scored as its lower-cased words, each followed by a blank, and an
end byte. Every byte is eight binary decisions; a decision is predicted from
the bit path so far within each context of the last 0 to ``depth`` bytes by a
Krichevsky-Trofimov estimate, and context-tree weighting mixes all depths: the
weighted probability of a node is half its own block probability plus half the
product of its children's. Block probabilities depend on counts only, so the
model is fitted from counts over all training texts and then frozen.

The tree has every context seen, whatever its count. The byte strings of the
scored texts stand in it too, with the count 0, which changes nothing: what was
never seen predicts 1/2. Tasks count the byte strings of chunks of rows in
sorted arrays, which meet in the bucket of their last ``TOP`` context bytes. A
bucket has whole subtrees; of the depths above, bounded by the number of byte
strings that short, the driver gets sums and gives back mixtures. Each chunk is
then sent the costs of its own byte strings, and its rows are summed up. No
task and not the driver holds the whole tree.

Beside it stands a unigram base over words and an end token, whose counts are
gathered and sent back to the chunks in the same way. Words are told apart by
64-bit hashes.

A null text is an empty one: its end token alone. Without training texts every
bit costs one bit. Repeated rows each count and come back; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded, parts, store
from larkspur.llm.minhash_dedup import _grouped
from larkspur.llm.textkernel import _LOWER, _WORD, _word_spans, buffer_of, word_hashes

END = 10
_END_HASH = 0x1F83D9ABFB41BD6B


def stream(raw: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scored bytes of rows, each led by ``depth`` end bytes as context: bytes, row starts, counted positions."""
    inside = _WORD[raw]
    starts, ends = _word_spans(raw, off)
    n = len(off) - 1
    letters = np.concatenate(([0], np.cumsum(inside)))
    words_before = np.searchsorted(starts, off)
    base = letters[off] + words_before + np.arange(n + 1) * (depth + 1)
    out = np.full(base[-1], 32, np.uint8)
    lead = base[:-1, None] + np.arange(depth)
    out[lead.ravel()] = END
    out[base[1:] - 1] = END
    at = np.flatnonzero(inside)
    word = np.searchsorted(starts, at, side="right") - 1
    row = np.searchsorted(off, at, side="right") - 1
    out[letters[at] + word + row * (depth + 1) + depth] = _LOWER[raw[at]]
    counted = np.ones(len(out), bool)
    counted[lead.ravel()] = False
    return out, base, np.flatnonzero(counted)


#: Bytes from which on a text is gone through in segments.
LONG = 4 << 20


def streams(raw: np.ndarray, off: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`stream` of rows; of one long text segment by segment, each led by the last bytes of the one before."""
    if len(off) != 2 or len(raw) <= LONG:
        yield stream(raw, off, depth)
        return
    lead, at = np.full(depth, END, np.uint8), 0
    while at < len(raw):
        end = at + LONG
        while end < len(raw) and not (hit := np.flatnonzero(~_WORD[raw[end : end + LONG]])).size:
            end += LONG
        end = len(raw) if end >= len(raw) else end + int(hit[0])
        out, base, counted = stream(raw[at:end], np.array([0, end - at]), depth)
        out[:depth] = lead
        if end < len(raw):  # the end byte is the last segment's
            out, base, counted = out[:-1], base - np.array([0, 1]), counted[:-1]
        yield out, base, counted
        lead, at = out[len(out) - depth :].copy(), end


def grams(out: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each position its byte (lowest) and the ``depth`` bytes before, the nearest lowest."""
    key = out[at].astype(np.uint64)
    for k in range(1, depth + 1):
        key |= out[at - k].astype(np.uint64) << np.uint64(8 * k)
    return key


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


_CODEC = pa.Codec("zstd", 1)


def _squeeze(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Integers as compressed byte planes; sorted ones as their differences."""
    v = values.astype(np.uint64)
    if sorted_ and len(v):
        v = np.concatenate((v[:1], np.diff(v)))
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    return len(v).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def _expand(blob: bytes, sorted_: bool = False) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(blob[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    v = np.ascontiguousarray(planes.T).view(np.uint64).reshape(n)
    return np.cumsum(v, dtype=np.uint64) if sorted_ else v.astype(np.int64)


def _squeeze_costs(costs: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(costs.astype(np.float32).view(np.uint8).reshape(-1, 4).T)
    return _CODEC.compress(planes.tobytes(), asbytes=True)


def _expand_costs(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(blob, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.float32).reshape(n)


#: Depths below this are mixed on the driver, the subtrees from it on in buckets.
TOP = 3

_BLOCKS = "kind int, bucket int, chunk long, keys binary, counts binary"
_GATHERED = "kind int, bucket int, total long, distinct long, keys binary, counts binary, chunks array<long>, asked array<binary>"


def _low(n: int) -> np.uint64:
    """A mask of the lowest n bytes."""
    return np.uint64((1 << 8 * n) - 1)


def _add(pieces: list, keys: np.ndarray, counts: np.ndarray) -> None:
    """One more sorted piece; pieces of like size are merged at once, so few are held."""
    pieces.append((keys, counts))
    while len(pieces) > 1 and len(pieces[-2][0]) < 2 * len(pieces[-1][0]):
        b, a = pieces.pop(), pieces.pop()
        pieces.append(_merge([a[0], b[0]], [a[1], b[1]]))


def _count(depth: int, buckets: int, chunk_bytes: int):
    """Chunks of rows (kind 2) and their byte strings (kind 0) and words (kind 1) with training counts, in blocks a bucket."""
    top = min(TOP, depth)

    def blocks(chunk: int, rows: list, held: list[list]) -> Iterator[pa.RecordBatch]:
        for kind, pieces in enumerate(held):
            keys, counts = _merge([p[0] for p in pieces], [p[1] for p in pieces])
            pieces.clear()
            where = (keys >> np.uint64(8)) & _low(top) if kind == 0 else keys
            bucket = ((where * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            del where
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield _block_rows([kind] * len(own), [b for b, _ in own], [chunk] * len(own), [_squeeze(keys[i], True) for _, i in own], [_squeeze(counts[i]) for _, i in own])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in rows:
                out.write_batch(part)
        yield _block_rows([2], [chunk % buckets], [chunk], [sink.getvalue().to_pybytes()], [b""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        rows, held = [], [[], []]
        for batch in batches:
            for part in parts(batch, 1 << 20):
                for train in (True, False):
                    some = part.filter(pc.equal(part.column("train"), train))
                    if not some.num_rows:
                        continue
                    raw, off = buffer_of(some.column("text"))
                    words, _ = word_hashes(raw, off)
                    found = [(1, np.append(words, np.full(len(off) - 1, _END_HASH, np.uint64)))]
                    del words
                    for kind, strings in itertools.chain(found, ((0, grams(out, at, depth)) for out, _, at in streams(raw, off, depth))):
                        keys, counts = _counted(strings)
                        _add(held[kind], keys, counts * train)
                    size += len(raw)
                rows.append(part.select(["doc_id", "text"]))
                if size >= chunk_bytes:
                    yield from blocks(chunk, rows, held)
                    chunk, size = chunk + 1, 0
                    rows, held = [], [[], []]
        if rows:
            yield from blocks(chunk, rows, held)

    return run


def _block_rows(*columns: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "bucket", "chunk", "keys", "counts"])


def _gather(group: pa.Table) -> pa.RecordBatch:
    """A bucket's counts in all, and what each chunk asks of it; chunks of rows stay as they are."""
    kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
    chunks, asked = group.column("chunk").to_pylist(), group.column("keys").to_pylist()
    if kind == 2:
        n = len(chunks)
        columns = [[2] * n, [bucket] * n, [0] * n, [0] * n, [b""] * n, [b""] * n, [[c] for c in chunks], [[a] for a in asked]]
    else:
        pieces: list = []
        for a, c in zip(asked, group.column("counts")):
            _add(pieces, _expand(a, True), _expand(c.as_py()))
        keys, counts = _merge([p[0] for p in pieces], [p[1] for p in pieces])
        columns = [[kind], [bucket], [int(counts.sum())], [int(np.count_nonzero(counts))], [_squeeze(keys, True)], [_squeeze(counts)], [chunks], [asked]]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "bucket", "total", "distinct", "keys", "counts", "chunks", "asked"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 by Stirling's series at x + 8."""
    y = x + 8
    down = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    i = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i / 1260)) - down


class _Subtree:
    """The nodes of sorted (context, byte) strings at the depths from ``top`` to ``depth``, one bit of the byte at a time.

    A node is a context with the first ``k`` bits of a byte; those of a depth
    are runs of its strings. ``sums`` says what the depth below ``depth`` adds.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, depth: int):
        self.top, self.depth = top, depth
        self.keys, self.counts, self.up = {depth: keys}, {depth: counts}, {}
        for d in range(depth, top, -1):
            self.keys[d - 1], self.up[d] = np.unique(self.keys[d] & _low(d), return_inverse=True)
            self.counts[d - 1] = np.bincount(self.up[d], self.counts[d], len(self.keys[d - 1])).astype(np.int64)

    def runs(self, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes start, and the node of each string."""
        node = self.keys[d] >> np.uint64(8 - k)
        new = np.concatenate(([True], node[1:] != node[:-1]))
        return np.flatnonzero(new), np.cumsum(new) - 1

    def bit(self, d: int, k: int) -> np.ndarray:
        return (self.keys[d] >> np.uint64(7 - k)) & np.uint64(1) > 0

    def climb(self, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        """log weighted probabilities of the nodes at ``top``; by depth (parents, weights, estimates of a one, node of each string)."""
        nodes, weighted, above = {}, np.empty(0), None
        starts, run = self.runs(self.depth, k)
        for d in range(self.depth, self.top - 1, -1):
            one = np.add.reduceat(self.counts[d] * self.bit(d, k), starts)
            zero = np.add.reduceat(self.counts[d], starts) - one
            own = _lgamma(zero + 0.5) + _lgamma(one + 0.5) - _lgamma(zero + one + 1.0) - np.log(np.pi)
            below = sums if d == self.depth else np.bincount(above, weighted, len(starts))
            if below is None:
                weighted, weight = own, np.ones(len(own))
            else:
                weighted = np.logaddexp(own, below) - np.log(2)
                weight = np.exp(own - np.log(2) - weighted)
            kt = (one + 0.5) / (zero + one + 1)
            if d > self.top:
                up_starts, up_run = self.runs(d - 1, k)
                above = up_run[self.up[d][starts]]
            nodes[d] = (above if d > self.top else None, weight, kt, run)
            if d > self.top:
                starts, run = up_starts, up_run
        return weighted, nodes

    def descend(self, nodes: dict, mixed: np.ndarray | float = 0.0, left: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Estimates mixed so far and the weight left at the nodes of ``depth``, from those above the nodes of ``top``."""
        for d in range(self.top, self.depth + 1):
            above, weight, kt, _ = nodes[d]
            if above is not None:
                mixed, left = mixed[above], left[above]
            mixed, left = mixed + left * weight * kt, left * (1 - weight)
        return mixed, left


def _subtrees(keys: np.ndarray, counts: np.ndarray, top: int, depth: int, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, _Subtree]]:
    """The subtrees of a bucket, some contexts of length ``top`` at a time: which strings, and their tree."""
    context = (keys >> np.uint64(8)) & _low(top)
    order = np.argsort(context, kind="stable")
    context = context[order]
    at = 0
    while at < len(order):
        upto = int(np.searchsorted(context, context[min(at + size, len(order)) - 1], side="right"))
        which = np.sort(order[at:upto])
        yield which, _Subtree(keys[which], counts[which], top, depth)
        at = upto


def _rise(depth: int):
    """Of each bucket the strings one byte shorter than its subtrees' roots, their counts, and by bit what the subtrees add to their nodes."""
    top = min(TOP, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = (_expand(batch.column(c)[i].as_py(), c == "keys") for c in ("keys", "counts"))
                held: list[list] = [[] for _ in range(9)]
                for _, tree in _subtrees(keys, counts, top, depth):
                    held[8].append((tree.keys[top] & _low(top), tree.counts[top]))
                    for k in range(8):
                        starts, _ = tree.runs(top, k)
                        held[k].append(((tree.keys[top][starts] & _low(top)) >> np.uint64(8 - k), tree.climb(k)[0]))
                for k, pieces in enumerate(held):
                    nodes, values = _merge([p[0] for p in pieces], [p[1] for p in pieces])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["k", "nodes", "sums"])

    return run


def _mix_top(rows: Iterator, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bit: the nodes above the buckets' subtrees, what is mixed there and the weight left."""
    held: list[list] = [[] for _ in range(9)]
    for r in rows:
        _add(held[r.k], np.frombuffer(r.nodes, np.uint64), np.frombuffer(r.sums, np.int64 if r.k == 8 else np.float64))
    merged = [_merge([p[0] for p in h], [p[1] for p in h]) if h else (np.empty(0, np.uint64), np.empty(0)) for h in held]
    top = min(TOP, depth)
    if not top or not len(merged[8][0]):
        return []
    tree = _Subtree(*merged[8], 0, top - 1)
    return [(merged[k][0], *tree.descend(tree.climb(k, merged[k][1])[1])) for k in range(8)]


def _string_costs(keys: np.ndarray, counts: np.ndarray, depth: int, above: list) -> np.ndarray:
    """log10 probability of each string's byte after its context."""
    top = min(TOP, depth)
    out = np.zeros(len(keys))
    for which, tree in _subtrees(keys, counts, top, depth):
        for k in range(8):
            _, nodes = tree.climb(k)
            mixed, left = 0.0, 1.0
            if top:
                starts, _ = tree.runs(top, k)
                at = np.searchsorted(above[k][0], (tree.keys[top][starts] & _low(top)) >> np.uint64(8 - k))
                mixed, left = above[k][1][at], above[k][2][at]
            one = np.clip(tree.descend(nodes, mixed, left)[0], 1e-12, 1 - 1e-12)[nodes[depth][3]]
            out[which] += np.log10(np.where(tree.bit(depth, k), one, 1 - one))
    return out


def _answer(shared, depth: int):
    """To each chunk the costs of its byte strings and the counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kind, chunks, asked = (batch.column(c)[i].as_py() for c in ("kind", "chunks", "asked"))
                keys, counts = (_expand(batch.column(c)[i].as_py(), c == "keys") for c in ("keys", "counts"))
                values = _string_costs(keys, counts, depth, shared.value) if kind == 0 else counts
                for chunk, blob in zip(chunks, asked):
                    own = values[np.searchsorted(keys, _expand(blob, True))]
                    own = _squeeze_costs(own) if kind == 0 else _squeeze(own)
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary()), pa.array([own], pa.binary())], ["kind", "chunk", "keys", "answers"])

    return run


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where in sorted keys each asked one is; asking in order reads memory in order."""
    order = np.argsort(asked)
    out = np.empty(len(asked), np.int64)
    out[order] = np.searchsorted(keys, asked[order])
    return out


def _score(depth: int, norm: float):
    def known(group: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = group.filter(pc.equal(group.column("kind"), kind))
        keys = [_expand(b, True) for b in rows.column("keys").to_pylist()]
        blobs = rows.column("answers").to_pylist()
        if kind == 0:
            values = [_expand_costs(b, len(k)) for k, b in zip(keys, blobs)]
        else:
            values = [_expand(b) for b in blobs]
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        return keys[order], values[order]

    def fn(group: pa.Table) -> pa.RecordBatch:
        strings, costs = known(group, 0)
        vocabulary, counts = known(group, 1)
        logs = np.log10((counts + 0.1) / norm)
        blob = group.filter(pc.equal(group.column("kind"), 2)).column("keys")[0].as_buffer()
        found = []
        for part in pa.ipc.open_stream(blob):
            raw, off = buffer_of(part.column("text"))
            cost, size = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
            for out, base, at in streams(raw, off, depth):
                total = np.concatenate(([0.0], np.cumsum(costs[_find(strings, grams(out, at, depth))].astype(np.float64))))
                upto = np.searchsorted(at, base)
                cost, size = cost + np.diff(total[upto]), size + np.diff(upto)
            words, wo = word_hashes(raw, off)
            words = np.insert(words, wo[1:], np.uint64(_END_HASH))
            wo = wo + np.arange(len(wo))
            pos = _find(vocabulary, words)
            upto_logs = np.concatenate(([0.0], np.cumsum(logs[pos])))
            hits = np.concatenate(([0], np.cumsum(counts[pos] > 0)))
            found.append(
                pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(wo), pa.int64()), pa.array(np.diff(hits[wo]), pa.int64()), pa.array(np.diff(upto_logs[wo])), pa.array(cost), pa.array(size, pa.int64())],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                )
            )
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    return fn


def score(docs: DataFrame, train: Column, *, depth: int = 6, frequent: int = 1 << 17, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one for each row of docs.

    ``frequent`` has no effect any more: all words are looked up alike.
    """
    spark = docs.sparkSession
    texts = bounded(docs).select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["kind", "bucket"]
    merged = store(texts.mapInArrow(_count(depth, buckets, chunk_bytes), _BLOCKS).repartition(buckets, *keys).sortWithinPartitions(*keys).mapInArrow(_grouped(keys, _gather), _GATHERED))
    totals = {r.kind: (r.total, r["distinct"]) for r in merged.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect()}
    tokens, words = totals.get(1, (0, 0))
    norm = tokens + 0.1 * (words + 1)
    risen = merged.where("kind = 0").select("keys", "counts").mapInArrow(_rise(depth), "k int, nodes binary, sums binary")
    shared = spark.sparkContext.broadcast(_mix_top(risen.toLocalIterator(), depth))
    answers = merged.where("kind < 2").mapInArrow(_answer(shared, depth), "kind int, chunk long, keys binary, answers binary")
    rows = merged.where("kind = 2").select("kind", F.col("chunks")[0].alias("chunk"), F.col("asked")[0].alias("keys"), F.lit(b"").alias("answers"))
    scored = (
        answers.union(rows).repartition(2 * buckets, "chunk").sortWithinPartitions("chunk", "kind")
        .mapInArrow(_grouped(["chunk"], _score(depth, norm)), "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    )
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.col("n_bytes") / F.log10(F.lit(2.0))).alias("bits_per_byte"),
    )
