"""Language identification with blended-spectrum string kernels.

The kernel of two texts counts the byte n-grams (n = 2, 3, 4; ASCII letters in
lower case, white space as one blank) present in both, hashed to ``bins``,
over the geometric mean of how many each has. ``landmarks`` texts span the
Nyström space; one-versus-rest ridge regression is solved in it. As the kernel
is linear in the presence vector, landmarks, whitening and weights fold into
one (bins x languages) matrix, and a batch of texts is scored as one matrix
product of its presence vectors.

Fitting takes at most ``per_language`` distinct labelled texts of each language
(those with the smallest hash), ``most`` texts and ``most_bytes`` bytes in all,
shared out evenly by language; a text beyond its language's share of bytes is
passed over. These are documented bounds of the sample; everything else covers
all rows and whole texts.

Ridge outputs do not tell a text of no known language from others (their best
is near 0.45 for either), so :func:`identify` can add a likeness: the n-grams
of the text's words without digits, letters only, have on average this root of
the share of pieces of labelled texts that hold them, in the language where
that is most. It is taken over pieces of ``PIECE`` bytes, so that long texts
compare with short ones; a text without such an n-gram has none (null).

A null text, an empty one and one without any letter gives ``und`` and score
0, as does every text when nothing was labelled. Ties go to the language first
in code-point order. Repeated rows each come back and count once in fitting;
rows with a null text or lang teach nothing. An empty table gives an empty
result; other columns pass by unread, whatever their names: ``prefix`` goes
before the names of the added columns, and a column of docs that has such a
name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import bounded, map_arrow, prefix_for, quoted
from larkspur.llm.textkernel import _LOWER, _WORD, SLICE, _word_spans, buffer_of, slices

GRAMS = (2, 3, 4)
_FOLD = np.where(_WORD, _LOWER, 32).astype(np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Bytes of a text over which n-grams are compared for the likeness.
PIECE = 2048
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray  # bins x languages
    bins: int


def _mark(present: np.ndarray, raw: np.ndarray, off: np.ndarray, bits: int) -> None:
    """Set present[row, bin] for every n-gram of the rows of a slice."""
    folded = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64) << bits, np.diff(off))
    flat = present.reshape(-1)
    for n in GRAMS:
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n * 0x51ED27, np.uint32)
        for k in range(n):
            code = (code ^ folded[k : len(raw) - n + 1 + k]) * _MUL[k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        whole = row[: len(code)] == row[n - 1 :]
        flat[(row[: len(code)] + (code >> np.uint32(32 - bits)))[whole]] = 1


def presence(raw: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """The rows' n-gram presence vectors; a very long text is marked piece by piece."""
    bits = bins.bit_length() - 1
    out = np.zeros((len(off) - 1, bins), np.float32)
    for i, j in slices(raw, off, SLICE // 4):
        if j - i == 1 and off[j] - off[i] > SLICE:
            for at in range(int(off[i]), int(off[j]), SLICE):
                piece = raw[at : min(at + SLICE + max(GRAMS) - 1, off[j])]
                _mark(out[i : i + 1], piece, np.array([0, len(piece)]), bits)
        else:
            _mark(out[i:j], raw[off[i] : off[j]], off[i : j + 1] - off[i], bits)
    return out


def fit_kernel(texts: list[str], labels: list[str], *, landmarks: int = 160, bins: int = 1 << 15, ridge: float = 1e-2) -> KernelModel | None:
    """Nyström kernel ridge regression, one language against the rest."""
    if not texts:
        return None
    languages = sorted(set(labels))
    turn = {}
    order = sorted(range(len(texts)), key=lambda i: (turn.setdefault(labels[i], []).append(i) or len(turn[labels[i]]), i))
    marks = order[:landmarks]  # the languages in turn

    def vectors(at: list[int]) -> np.ndarray:
        raw, off = buffer_of(pa.array([texts[i] for i in at], pa.large_string()))
        x = presence(raw, off, bins)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    base = vectors(marks)
    values, basis = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-8 * max(values.max(), 1e-12)
    if not keep.any():
        return None
    whiten = basis[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([(vectors(list(range(i, min(i + 64, len(texts))))) @ base.T).astype(np.float64) @ whiten for i in range(0, len(texts), 64)])
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([labels.count(x) for x in labels], np.float64)
    balance = (len(texts) / len(languages) / share)[:, None]  # each language weighs the same
    gram = features.T @ (features * balance) + ridge * len(texts) * np.eye(features.shape[1]) / features.shape[1]
    solved = np.linalg.solve(gram, features.T @ (target * balance))
    return KernelModel(languages, (base.T @ (whiten @ solved).astype(np.float32)).astype(np.float32), bins)


def scores(model: KernelModel, column: pa.Array, rows: int = 64) -> np.ndarray:
    """Ridge outputs (rows x languages) of a string column."""
    raw, off = buffer_of(column)
    out = np.zeros((len(off) - 1, len(model.languages)), np.float32)
    for i in range(0, len(out), rows):
        j = min(i + rows, len(out))
        x = presence(raw[off[i] : off[j]], off[i : j + 1] - off[i], model.bins)
        out[i:j] = (x @ model.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return out


def _letters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the letters of their words without digits, runs of all else as one blank."""
    starts, ends = _word_spans(raw, off)
    digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57), dtype=np.int32)))
    letter = _LETTER[raw]
    letter[_WORD[raw]] &= np.repeat(digits[ends] == digits[starts], ends - starts)
    after = np.zeros(len(raw), bool)
    after[1:] = letter[:-1]
    after[off[:-1][off[:-1] < len(raw)]] = False
    keep = letter | after
    return np.where(letter, raw, 32).astype(np.uint8)[keep], np.concatenate(([0], np.cumsum(keep, dtype=np.int32)))[off]


def _pieces(column: pa.Array, bins: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Presence vectors of the pieces of texts, and the row of each."""
    raw, off = _letters(*buffer_of(column))
    many = np.maximum(-(-np.diff(off) // PIECE), 1)
    row = np.repeat(np.arange(len(many)), many)
    cuts = np.append(off[row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)), off[-1])
    for i in range(0, len(row), rows):
        j = min(i + rows, len(row))
        yield presence(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], bins), row[i:j]


def fit_likeness(texts: list[str], labels: list[str], languages: list[str], bins: int) -> np.ndarray:
    """By n-gram bin and language, the root of the share of labelled pieces that hold it."""
    held, number = np.zeros((bins, len(languages))), np.zeros(len(languages))
    for i, language in enumerate(languages):
        for x, _ in _pieces(pa.array([t for t, y in zip(texts, labels) if y == language], pa.large_string()), bins):
            held[:, i] += x.sum(0)
            number[i] += len(x)
    return np.sqrt(held / np.maximum(number, 1)).astype(np.float32)


def likeness(share: np.ndarray, column: pa.Array) -> np.ndarray:
    """Of each text its likeness to the nearest language; nan without an n-gram."""
    total, grams = np.zeros((len(column), share.shape[1])), np.zeros(len(column))
    for x, row in _pieces(column, len(share)):
        np.add.at(total, row, x @ share)
        np.add.at(grams, row, x.sum(1))
    return np.where(grams > 0, total.max(1) / np.maximum(grams, 1), np.nan)


def labelled_sample(docs: DataFrame, train: Column, per_language: int, most: int = 20_000, most_bytes: int = 64 << 20) -> list:
    """Distinct (text, lang) rows within the bounds that the module's notes state, by smallest hash of the text.

    The choice is made on labels, hashes and lengths alone, first within 64 and
    then 8 salts of each language, so that no task gathers a frequent language. What
    is sent to the tasks to fetch the texts has at most ``most`` rows (or one a
    language, if there are more languages).
    """
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    h = F.xxhash64(F.col("text"), F.lit(5))
    kinds = known.groupBy("lang", h.alias("h")).agg(F.max(F.octet_length("text")).alias("bytes"))
    kinds = kinds.withColumn("langs", F.lit(max(1, kinds.select("lang").distinct().count())))
    share = F.least(F.lit(per_language), F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("langs"))))
    room = F.floor(F.lit(most_bytes) / F.col("langs"))
    chosen = kinds.where(F.col("bytes") <= room)
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang", F.pmod("h", F.lit(8))], ["lang"]):
        w = Window.partitionBy(*by).orderBy("h")
        chosen = chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= share).withColumn("upto", F.sum("bytes").over(w)).where(F.col("upto") <= room).drop("rank", "upto")
    chosen = chosen.select(F.col("lang").alias("label"), F.col("h").alias("hash"))
    found = known.join(F.broadcast(chosen), (F.col("lang") == F.col("label")) & (h == F.col("hash"))).groupBy("label", "hash").agg(F.min("text").alias("text")).collect()
    return sorted(({"lang": r.label, "text": r.text, "h": r.hash} for r in found), key=lambda r: (r["h"], r["lang"], r["text"]))


def identify(
    docs: DataFrame, train: Column, *, per_language: int = 400, landmarks: int = 160, bins: int = 1 << 15, with_likeness: bool = False, prefix: str = "", most: int = 20_000, most_bytes: int = 64 << 20
) -> DataFrame:
    """The columns of docs and ``lang_pred``, ``score`` (0 to 1), ``likeness`` if asked; learns from rows where ``train`` holds."""
    rows = labelled_sample(docs, train, per_language, most, most_bytes)
    texts, labels = [r["text"] for r in rows], [r["lang"] for r in rows]
    model = fit_kernel(texts, labels, landmarks=landmarks, bins=bins)
    share = fit_likeness(texts, labels, model.languages, bins) if with_likeness and model else None
    more = [prefix + c for c in ("lang_pred", "score", *(["likeness"] if with_likeness else []))]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {c.lower() for c in more}]
    # Columns go by position: the kept ones, the text, and whether it has a letter.
    p = prefix_for(docs.columns)
    reading = bounded(docs).select(*(F.col(quoted(f.name)) for f in kept), F.col("text").alias(p + "text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(p + "letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts, letter = batch.column(len(kept)), batch.column(len(kept) + 1).to_numpy(zero_copy_only=False).astype(bool)
            if model is None or n == 0:
                pred, score = ["und"] * n, np.zeros(n)
            else:
                s = scores(model, texts)
                best = s.argmax(1)
                score = np.where(letter, np.clip((s.max(1).astype(np.float64) + 1) / 2, 0, 1), 0.0)
                pred = [model.languages[b] if ok else "und" for b, ok in zip(best, letter)]
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if with_likeness:
                like = np.full(n, np.nan) if share is None or n == 0 else likeness(share, texts)
                added.append(pa.array(like, pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], [*(f.name for f in kept), *more])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return map_arrow(reading, run, T.StructType([*kept, *(T.StructField(c, k) for c, k in zip(more, kinds))]))
