"""A quality score from regularised quadratic discriminant analysis.

Each whole text becomes a vector of transformed statistics (lengths, shares of
character classes, repetition of words and lines). Class means and covariances
come from sums over all labelled training rows, gathered per partition; each
covariance is shrunk towards the pooled one and towards a multiple of the
identity. A score is the logistic function of the log-density difference of
the classes (from Mahalanobis distances by cached inverse Cholesky factors)
and the log prior odds, divided by ``temperature``.

Null texts count as empty ones; empty texts get the score of the all-zero
statistics. Without labels of both classes every score is the share of label 1
(0.5 without any label). Labels that are null or rows without a document are
unused, and a repeated label counts as often as it occurs. Repeated documents
each come back; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_rows, bounded, parts, store
from larkspur.llm.textkernel import buffer_of, word_hashes

#: Character classes that are counted, each by its bytes.
_CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".,;:?", "loud": b"!", "bar": b"|", "mark": b"#$%&*@^~=+<>{}[]\\_", "other": b"\"'()-/`", "wide": bytes(range(128, 256)),
}
_TABLE = np.zeros(256, np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars)] = _i
FEATURES = ["length", "words", "word", "upper", "digit", "wide", "stop", "loud", "bar", "mark", "other", "lines", "distinct", "top", "repeat", "pair"]


def statistics(column: pa.Array) -> np.ndarray:
    """The feature matrix (rows x FEATURES) of a string column."""
    raw, off = buffer_of(column)
    n, k = len(off) - 1, len(_CLASSES)
    counts = np.zeros((n, k))
    step = 1 << 20
    for i in range(0, len(raw), step):  # the rows that a step touches
        a, b = int(np.searchsorted(off, i, side="right")) - 1, int(np.searchsorted(off, min(i + step, len(raw)), side="left"))
        row = np.repeat(np.arange(b - a), np.diff(np.clip(off[a : b + 1], i, i + step)))
        counts[a:b] += np.bincount(row * k + _TABLE[raw[i : i + step]], minlength=(b - a) * k).reshape(b - a, k)
    c = dict(zip(_CLASSES, counts.T))
    size = np.diff(off).astype(np.float64)
    hashes, at = word_hashes(raw, off)
    words = np.diff(at).astype(np.float64)
    distinct, top, again, pair = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        own = hashes[at[i] : at[i + 1]]
        if len(own):
            s = np.sort(own)
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            distinct[i] = len(starts) / len(s)
            top[i] = np.diff(np.concatenate((starts, [len(s)]))).max() / len(s)
            again[i] = (own[1:] == own[:-1]).mean() if len(own) > 1 else 0
            two = own[1:] * np.uint64(3) + own[:-1]
            pair[i] = 1 - len(np.unique(two)) / len(two) if len(two) else 0
    per_word = lambda x: np.sqrt(x / np.maximum(words, 1))
    letters = np.maximum(c["lower"] + c["upper"], 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p((size - c["blank"] - c["line"]) / np.maximum(words, 1)), np.sqrt(c["upper"] / letters),
        per_word(c["digit"]), np.sqrt(c["wide"] / np.maximum(size, 1)), per_word(c["stop"]), per_word(c["loud"]), per_word(c["bar"]), per_word(c["mark"]),
        per_word(c["other"]), per_word(c["line"]), distinct, np.sqrt(top), np.sqrt(again), np.sqrt(pair),
    ])


class Discriminant:
    """Class means and cached inverse Cholesky factors of the shrunk covariances."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.8, ridge: float = 0.02, temperature: float = 4.0):
        total = {k: v for k, v in sums.items() if v[0] > 0}
        n = sum(v[0] for v in total.values())
        self.prior = total[1][0] / n if 1 in total and n else (0.5 if not n else 0.0)
        self.temperature = temperature
        self.parts = {}
        if len(total) < 2:
            return
        mean = sum(v[1] for v in total.values()) / n
        spread = sum(np.diag(v[2]) for v in total.values()) / n - mean**2
        self.shift, self.scale = mean, np.sqrt(np.maximum(spread, 1e-9))
        own = {}
        for k, (m, s, q) in total.items():
            mu = s / m
            own[k] = (m, (mu - self.shift) / self.scale, (q / m - np.outer(mu, mu)) / np.outer(self.scale, self.scale))
        together = sum(m * cov for m, _, cov in own.values()) / n
        d = len(mean)
        for k, (_, mu, cov) in own.items():
            cov = (1 - pooled) * cov + pooled * together
            cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d) + 1e-9 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.parts[k] = (mu, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.prior)
        z = (x - self.shift) / self.scale
        log = {k: -0.5 * ((((z - mu) @ inverse.T) ** 2).sum(1) + det) for k, (mu, inverse, det) in self.parts.items()}
        odds = (log[1] - log[0] + np.log(self.prior / (1 - self.prior))) / self.temperature
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(p.column("text")) for p in parts(batch)]
        if x:
            flat = pa.array(np.concatenate(x).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES), flat)], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    sums = {k: [0.0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column("x")), batch.column("label").to_numpy()
            for k, s in sums.items():
                own = x[y == k]
                s[0] += len(own)
                s[1] += own.sum(0)
                s[2] += own.T @ own
    rows = [(k, s[0], np.concatenate((s[1], s[2].ravel())).tolist()) for k, s in sums.items() if s[0]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["label", "n", "sums"])


def classify(docs: DataFrame, labels: DataFrame, train: Column, *, label_col: str = "quality", threshold: float = 0.3, **regularisation: float) -> DataFrame:
    """Rows (doc_id, score, predicted) for each row of docs.

    ``train`` selects, by doc_id, the rows whose labels may be learned.
    """
    x = store(bounded(docs).select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>"))
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    d = len(FEATURES)
    gathered = (
        x.where(train).join(known, "doc_id").select("label", "x").mapInArrow(_moments, "label int, n double, sums array<double>")
        .select("label", "n", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
    )
    sums = {k: [0.0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
    for r in gathered:
        sums[r.label][0] = r.n
        if r.at < d:
            sums[r.label][1][r.at] = r.value
        else:
            sums[r.label][2][divmod(r.at - d, d)] = r.value
    model = Discriminant({k: tuple(v) for k, v in sums.items()}, **regularisation)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(_matrix(batch.column("x")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return x.mapInArrow(arrow_rows(run), "doc_id long, score double, predicted int")
