"""Reading embedding columns: valid vectors as bytes, matrices from bytes; splitting lists of vectors that are too long."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded, store
from larkspur.llm.textkernel import mix64


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("v")
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        off = column.offsets.to_numpy().astype(np.int64)
        a = column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros; nulls are NaN
        off -= off[0]
        counts = [np.append(0, np.cumsum(some)) for some in (~np.isfinite(a), a != 0)]
        broken, other = (c[off[1:]] - c[off[:-1]] for c in counts)
        fit = column.is_valid().to_numpy(zero_copy_only=False) & (broken == 0) & (other > 0)
        buffers = [pa.array(fit, pa.bool_()).buffers()[1], pa.py_buffer((off * a.itemsize).astype(np.int32)), pa.py_buffer(a)]
        vec = pa.Array.from_buffers(pa.binary(), len(fit), buffers)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec], ["vec_id", "vec"])


def encoded(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, type]:
    """Rows (vec_id, vec, node): the vector's bytes and their hash, null where a vector takes no part.

    Arrays of float stay single, others become double; also the numpy type.
    """
    single = df.schema[vector_col].dataType.elementType.typeName() == "float"
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    out = bounded(df).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).mapInArrow(_encode, "vec_id long, vec binary")
    return out.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))), np.float32 if single else np.float64


def matrix(blobs: list[bytes], kind: type) -> np.ndarray:
    """Vectors of one length as doubles."""
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


#: About how many bytes of vectors a task holds at once, while others stream past them.
GROUP_BYTES = 48 << 20


def grouping(lists: int, size: int, first: int, least: int = 24) -> tuple[np.ndarray, int]:
    """Group numbers, from ``first`` on, of neighbouring lists that hold ``size`` bytes of vectors; also the next free number."""
    n = min(lists, max(least, -(-size // GROUP_BYTES)))
    return first + np.arange(lists) * n // lists, first + n


def flat(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Vectors of one length, as they are stored."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    count = int(off[-1] - off[0]) // np.dtype(kind).itemsize
    return np.frombuffer(a.buffers()[2], kind, count, int(off[0])).reshape(len(a), -1)


def smallest_hashes(df: DataFrame, n: int, most: int, seed: int, *keys: str) -> DataFrame:
    """The ``most`` of n rows with the smallest hashes of keys. Rows that can hardly be among them are left out
    first: else each task would send the driver as many."""
    h = F.xxhash64(*keys, F.lit(seed))
    share = (most + 6 * most**0.5 + 50) / max(n, 1)
    few = df.where(h <= F.lit(int(share * 2**64) - 2**63)) if share < 1 else df
    return few.orderBy(h, *keys).limit(most)


def streamed(keys: list[str], hold: Callable, answer: Callable, own: Callable | None = None) -> Callable:
    """A mapInArrow function on rows sorted by keys and ``asks``: ``hold`` gets a group's rows that don't ask as a
    table, ``answer`` what it gave and the group's asking rows, batch by batch; ``own`` what it gave, once, before
    them. Groups without rows to hold are passed over, and without ``own`` also those without any that asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "asks")]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                key = tuple(c[i] for c in cols[:-1])
                if key != now:
                    if rows and own:
                        yield from own(hold(pa.Table.from_batches(rows)))
                    now, rows, held = key, [], None
                part = batch.slice(i, j - i)
                if not cols[-1][i]:
                    rows.append(part)
                    continue
                if rows:
                    table, rows = pa.Table.from_batches(rows).combine_chunks(), []
                    held = hold(table)
                    del table
                    if own:
                        yield from own(held)
                if held is not None:
                    yield from answer(held, part)
        if rows and own:
            yield from own(hold(pa.Table.from_batches(rows)))

    return run


def grouped(keys: list[str], fn: Callable) -> Callable:
    from larkspur.llm.minhash_dedup import _grouped

    return _grouped(keys, fn)


def fit_lists(posted: DataFrame, large: DataFrame, fit: Callable, kind: type, sample: int, seed: int) -> DataFrame:
    """A model (list, model) of each long list, by ``fit(matrix, rows of the list)`` on about ``sample`` of its rows, those of smallest hash."""
    drawn = posted.join(large.withColumnRenamed("list", "l"), F.col("list") == F.col("l"))
    drawn = drawn.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.col("n")) < sample).select("list", "n", "vec")

    def run(group: pa.Table) -> pa.RecordBatch:
        blobs = group.column("vec").to_pylist()
        model = pickle.dumps(fit(matrix(sorted(blobs), kind), group.column("n")[0].as_py()))
        return pa.RecordBatch.from_arrays([group.column("list").combine_chunks().slice(0, 1), pa.array([model], pa.binary())], ["list", "model"])

    return store(drawn.repartition("list").sortWithinPartitions("list").mapInArrow(grouped(["list"], run), "list long, model binary"))


def place(rows: DataFrame, models: DataFrame, names: list[str], kind: type, pick: Callable, block: int = 8192) -> DataFrame:
    """Rows (names, list, vec) in long lists, in the lists that their list's model deals them to: (names, vec, list, done).

    ``pick(model, matrix)`` gives each row's places, and whether the model splits at all.
    A list's rows are dealt out in blocks, each with the model.
    """
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).withColumnRenamed("list", "l")
    wide = rows.select("list", "vec", *names).join(counts, F.col("list") == F.col("l"))
    wide = wide.select("list", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("binary").alias("model"), "vec", *names)
    schema = dict(wide.dtypes)
    heads = models.join(counts, F.col("list") == F.col("l")).select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "model", F.lit(None).cast("binary").alias("vec"), *(F.lit(None).cast(schema[c]).alias(c) for c in names)
    )

    def run(group: pa.Table) -> pa.RecordBatch | None:
        has = group.column("model").is_valid().to_numpy()
        at = np.flatnonzero(~has)
        if not len(at) or not has.any():
            return None
        model = pickle.loads(group.column("model")[int(np.flatnonzero(has)[0])].as_py())
        own = group.take(pa.array(at))
        places, splits = pick(model, matrix(own.column("vec").to_pylist(), kind))
        back = np.repeat(np.arange(len(at)), [len(p) for p in places])
        # A new list's number: a hash of the old one's and the place in it.
        old = own.column("list").to_numpy().astype(np.int64).view(np.uint64)[back]
        new = old if not splits else mix64(mix64(old) ^ np.concatenate(places).astype(np.uint64)) >> np.uint64(1)
        taken = own.take(pa.array(back)).combine_chunks()
        columns = [*(taken.column(c) for c in (*names, "vec")), pa.array(new.view(np.int64)), pa.array(np.full(len(back), not splits))]
        return pa.table(columns, [*names, "vec", "list", "done"]).combine_chunks().to_batches()[0]

    keys = ["list", "part"]
    out = ", ".join([*(f"{c} {schema[c]}" for c in names), "vec binary", "list long", "done boolean"])
    return wide.union(heads).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(grouped(keys, run), out)
