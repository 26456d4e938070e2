"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's tokens, hashed to ``bins`` counts, are projected to three
dimensions; their cell on a Hilbert curve is the document's key. Documents are
range-sorted by key (ties by a hash, so that copies spread over partitions),
stand end to end along the curve, and this line of tokens is cut every
``length`` tokens. So neighbours share sequences, a document is cut only at
sequence ends, and only the very last sequence can need padding.

The line's positions come from token counts alone: sums within range
partitions, then sums of the partitions. Token ids move once, to meet their
positions.

A null text counts as empty; an empty text is its end token. Repeated rows are
documents of their own. An empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bounded, parts, store
from larkspur.llm.textkernel import buffer_of
from larkspur.llm.tokens import load

DIMS, BITS = 3, 10


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n x d, each below 2**bits).

    Works down from the top bit, undoing the reflections and axis exchanges of
    the curve's orthants, then Gray-decodes the interleaved bits.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, bins: int = 512, seed: int = 3) -> np.ndarray:
    """Hilbert keys of documents given their token ids, row after row."""
    rng = np.random.default_rng(seed)
    project = rng.standard_normal((bins, DIMS))
    hashed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % bins
    n = len(counts)
    at = np.concatenate(([0], np.cumsum(counts)))
    vectors = np.zeros((n, DIMS))
    for i in range(0, n, 256):
        j = min(i + 256, n)
        row = np.repeat(np.arange(j - i), counts[i:j])
        x = np.sqrt(np.bincount(row * bins + hashed[at[i] : at[j]], minlength=(j - i) * bins).reshape(j - i, bins))
        vectors[i:j] = x @ project / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    cells = np.clip((np.arctan(vectors) / np.pi + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def _tokenise(path: str, end: int, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, specials)
        kind = np.uint16 if encoder.size <= 1 << 16 and end < 1 << 16 else np.uint32
        for batch in batches:
            for part in parts(batch):
                raw, off = buffer_of(part.column("text"))
                got, counts = encoder.encode(raw, off)
                keys = curve_keys(got, counts)
                upto = np.cumsum(counts)
                ids = np.insert(got, upto, end).astype(kind)  # the end token after each document
                at = np.concatenate(([0], upto + np.arange(1, len(upto) + 1)))
                data = ids.tobytes()
                blobs = [data[kind().itemsize * a : kind().itemsize * b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts + 1, pa.int64()), pa.array(keys), pa.array([kind().itemsize] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())],
                    ["doc_id", "doc_tokens", "key", "width", "ids"],
                )

    return run


def _cut(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            position, total = batch.column("position").to_numpy(), batch.column("doc_tokens").to_numpy()
            width = batch.column("width").to_numpy()
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for i, blob in enumerate(batch.column("ids")):
                ids = np.frombuffer(blob.as_buffer(), np.uint16 if width[i] == 2 else np.uint32).astype("<u4")
                p, n = int(position[i]), int(total[i])
                at = 0
                while at < n:
                    seq, off = divmod(p + at, length)
                    size = min(n - at, length - off)
                    piece = ids[at : at + size].tobytes()
                    for k, v in zip(out, (doc[i], at, size, zlib.crc32(piece), n, seq, off, piece if with_ids else None)):
                        out[k].append(v)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, end: int = 1, specials: bool = True, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    ``specials`` says whether strings of special tokens in texts become those tokens.
    """
    spark = docs.sparkSession
    tokenised = bounded(docs).select("doc_id", "text").mapInArrow(_tokenise(tokenizer, end, specials), "doc_id long, doc_tokens long, key long, width int, ids binary")
    tokenised = store(tokenised.withColumn("uid", F.monotonically_increasing_id()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = tokenised.select("uid", "doc_tokens", "key", F.xxhash64("uid").alias("tie"))
    line = store(line.repartitionByRange(n, "key", "tie").withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = line.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("key", "tie", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = line.withColumn("inner", F.coalesce(F.sum("doc_tokens").over(inner), F.lit(0))).join(bases, "part")
    placed = placed.select(F.col("uid").alias("u"), (F.col("base") + F.col("inner")).alias("position"))
    pieces = tokenised.join(placed, F.col("uid") == F.col("u")).select("doc_id", "doc_tokens", "position", "width", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    out = pieces.mapInArrow(_cut(length, with_ids), schema)
    return out if with_ids else out.drop("ids")
