"""User-defined functions that the registered queries use."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

from larkspur.userfunctions import Accumulator, AggregateUDF, WindowEvaluator, WindowUDF, udaf, udwf


class Total(Accumulator):
    def __init__(self):
        self.value = 0

    def state(self) -> list[pa.Scalar]:
        return [pa.scalar(self.value)]

    def update(self, values: pa.Array) -> None:
        self.value += pc.sum(values).as_py() or 0

    def merge(self, states: pa.Array) -> None:
        self.value += pc.sum(states).as_py() or 0

    def evaluate(self) -> pa.Scalar:
        return pa.scalar(self.value)


class Running(WindowEvaluator):
    def evaluate_all(self, values: list[pa.Array], num_rows: int) -> pa.Array:
        return pc.cumulative_sum(values[0].cast(pa.int64()))


class Framed(WindowEvaluator):
    def uses_window_frame(self) -> bool:
        return True

    def evaluate(self, values: list[pa.Array], eval_range: tuple[int, int]) -> pa.Scalar:
        start, stop = eval_range
        return pc.sum(values[0].slice(start, stop - start).cast(pa.int64()))


class PeerRank(WindowEvaluator):
    def include_rank(self) -> bool:
        return True

    def evaluate_all_with_rank(self, num_rows: int, ranks_in_partition: list[tuple[int, int]]) -> pa.Array:
        return pa.array([i + 1 for i, (a, b) in enumerate(ranks_in_partition) for _ in range(a, b)], pa.int64())


def total() -> AggregateUDF:
    return udaf(Total, pa.int64(), pa.int64(), [pa.int64()], "immutable", "int_total")


def running() -> WindowUDF:
    return udwf(Running(), pa.int64(), pa.int64(), "immutable", "running_total")


def framed() -> WindowUDF:
    return udwf(Framed(), pa.int64(), pa.int64(), "immutable", "frame_total")


def ranked() -> WindowUDF:
    return udwf(PeerRank(), pa.int64(), pa.int64(), "immutable", "peer_rank")
