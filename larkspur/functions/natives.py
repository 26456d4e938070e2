"""Functions with semantics of their own: greatest, least, hash_int."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(args: tuple[Column, ...], better: Callable[[Column, Column], Column]) -> Column:
    if not args:
        raise ValueError("at least one argument is needed")
    return reduce(lambda a, b: F.when(better(a, b), a).otherwise(b), args)


def greatest(*args: Column) -> Column:
    """A left fold: of two values the first if it is greater, else the second; a null on either side yields the second."""
    return _fold(args, lambda a, b: a > b)


def least(*args: Column) -> Column:
    """A left fold as :func:`greatest`, by ``<``."""
    return _fold(args, lambda a, b: a < b)


def greatest_literals(*args: Column) -> Column:
    """The greatest of literal values, nulls passed over."""
    return F.greatest(*args) if len(args) > 1 else args[0]


def least_literals(*args: Column) -> Column:
    return F.least(*args) if len(args) > 1 else args[0]


def _sip13(messages: list[bytes]) -> np.ndarray:
    """SipHash-1-3 with a zero key of each message, one block of all messages at a time."""
    n = len(messages)
    size = np.array([len(m) for m in messages], np.int64)
    blocks = size // 8 + 1
    words = np.zeros((n, int(blocks.max(initial=1))), np.uint64)
    flat = words.view(np.uint8).reshape(n, -1)
    for i, m in enumerate(messages):
        flat[i, : len(m)] = np.frombuffer(m, np.uint8)
    words[np.arange(n), blocks - 1] |= (size.astype(np.uint64) & np.uint64(255)) << np.uint64(56)
    v = [np.full(n, k, np.uint64) for k in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]
    rot = lambda x, b: (x << np.uint64(b)) | (x >> np.uint64(64 - b))

    def turn(v: list[np.ndarray]) -> list[np.ndarray]:
        a, b, c, d = v
        a, c = a + b, c + d
        b, d = rot(b, 13) ^ a, rot(d, 16) ^ c
        a = rot(a, 32)
        c, a = c + b, a + d
        b, d = rot(b, 17) ^ c, rot(d, 21) ^ a
        return [a, b, rot(c, 32), d]

    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            on = k < blocks
            w = np.where(on, words[:, k], np.uint64(0))
            new = turn([v[0], v[1], v[2], v[3] ^ w])
            new[0] = new[0] ^ w
            v = [np.where(on, x, y) for x, y in zip(new, v)]
        v[2] = v[2] ^ np.uint64(0xFF)
        for _ in range(3):
            v = turn(v)
        return (v[0] ^ v[1] ^ v[2] ^ v[3]).view(np.int64)


def hash_strings(column: pa.Array) -> pa.Array:
    """64-bit hashes of a string array; a null has a hash too, so the result has none."""
    coded = column.dictionary_encode()
    some = b"\x01" + bytes(7)
    hashes = _sip13([some + s.encode() + b"\xff" for s in coded.dictionary.to_pylist()] + [bytes(8)])
    at = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    return pa.array(hashes[at])


def hash_int_udf():
    """hash_int as an Arrow function of Spark."""
    return F.arrow_udf(hash_strings, "bigint")


def hash_int(column: Column) -> Column:
    return hash_int_udf()(column)
