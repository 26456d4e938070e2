"""The language and quality models against plain definitions."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_id, quality
from larkspur.llm.common import remainder
from tests.llm.test_operators import DOCS, WORDS, clashing


def gram_bins(text: str, bits: int) -> set[int]:
    """Bins of the byte n-grams (n = 2, 3, 4) of a text: ASCII in lower case, white space as a blank."""
    folded = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c < 91 else c for c in text.encode())
    multipliers, out = [int(m) for m in language_id._MUL], set()
    for n in (2, 3, 4):
        for i in range(len(folded) - n + 1):
            code = n * 0x51ED27
            for k in range(n):
                code = ((code ^ folded[i + k]) * multipliers[k]) & 0xFFFFFFFF
            code ^= code >> 15
            code = (code * 0x2C1B3C6D) & 0xFFFFFFFF
            out.add(code >> (32 - bits))
    return out


def kernel(a: set, b: set) -> float:
    return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))


def test_kernel_ridge_by_definition():
    rng = np.random.default_rng(1)
    vocabulary = {"en": ["the", "Thing", "with", "that"], "de": ["der", "nicht", "schön", "über"], "fr": ["le", "être", "vous", "déjà"]}
    labels = [["en", "de", "fr", "en"][i % 4] for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary[y], 25)) + ["\n", "", "\tx"][i % 3] for i, y in enumerate(labels)]
    bins, marks_n, ridge = 1 << 10, 24, 1e-2
    model = language_id.fit_kernel(texts, labels, landmarks=marks_n, bins=bins, ridge=ridge)
    sets = [gram_bins(t, 10) for t in texts]
    turn, order = collections.Counter(), []
    for i, y in enumerate(labels):
        turn[y] += 1
        order.append((turn[y], i))
    marks = [i for _, i in sorted(order)][:marks_n]
    among = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, basis = np.linalg.eigh(among)
    keep = values > 1e-8 * values.max()
    whiten = basis[:, keep] / np.sqrt(values[keep])
    features = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ whiten
    languages = sorted(set(labels))
    share = collections.Counter(labels)
    weight = np.diag([len(labels) / len(languages) / share[y] for y in labels])
    target = np.array([[1.0 if y == x else -1.0 for x in languages] for y in labels])
    solved = np.linalg.solve(features.T @ weight @ features + ridge * len(labels) * np.eye(features.shape[1]) / features.shape[1], features.T @ weight @ target)
    others = [*texts[:5], "the Thing über", "être", "a", "vous with that " * 9000]
    want = np.array([[kernel(gram_bins(t, 10), sets[j]) for j in marks] for t in others]) @ whiten @ solved
    assert model.languages == languages and np.allclose(language_id.scores(model, pa.array(others)), want, atol=2e-3)


def plain_statistics(text: str) -> dict[str, float]:
    raw = text.encode()
    own = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    n, count = max(len(own), 1), lambda chars: sum(c in chars for c in raw)
    blank = count(b" \t\r\x0b\x0c") + count(b"\n")
    upper, lower = sum(65 <= c < 91 for c in raw), sum(97 <= c < 123 for c in raw)
    pairs = list(zip(own, own[1:]))
    return {
        "length": np.log1p(len(raw)), "words": np.log1p(len(own)), "word": np.log1p((len(raw) - blank) / n), "upper": np.sqrt(upper / max(upper + lower, 1)), "digit": np.sqrt(count(b"0123456789") / n), "wide": np.sqrt(sum(c >= 128 for c in raw) / max(len(raw), 1)),
        "stop": np.sqrt(count(b".,;:?") / n), "loud": np.sqrt(count(b"!") / n), "bar": np.sqrt(count(b"|") / n), "lines": np.sqrt(count(b"\n") / n), "distinct": len(set(own)) / len(own) if own else 0.0, "top": np.sqrt(max(collections.Counter(own).values(), default=0) / n),
        "repeat": np.sqrt(np.mean([a == b for a, b in pairs])) if pairs else 0.0, "pair": np.sqrt(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0,
    }


def test_statistics_by_definition():
    texts = ["", "one", "One one TWO two! a|b", "é à la\n\nligne, 12 34", " \t ", "same same same same", "x " * 700_000 + "END!"]
    got = quality.statistics(pa.array(texts))
    for text, row in zip(texts, got):
        for name, value in plain_statistics(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value, abs=1e-9), (name, text[:20])


def test_discriminant_by_definition(spark):
    """Scores of classify, from class densities written out with covariances and determinants."""
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(WORDS, int(rng.integers(20, 60)))) + ".\nA second line, " + " ".join(rng.choice(WORDS, 10))
    bad = lambda: "!! ".join(w.upper() for w in rng.choice(WORDS, int(rng.integers(5, 40)))) + " | 12"
    rows = [(i, bad() if i % 3 == 0 else good(), "en", "s", 0) for i in range(240)] + [rows_ for rows_ in [(7, "a repeated id", "en", "s", 0), (None, None, "en", "s", 0), (900, "", "en", "s", 0), (901, "word " * 400_000, "en", "s", 0)]]
    docs = clashing(spark, rows, ["x", "label", "Score", "predicted"])
    marks = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(200)] + [(5, 1, 0), (5000, 1, 0), (8, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    pooled, ridge, temperature = 0.8, 0.02, 4.0
    x = quality.statistics(pa.array([t for _, t, *_ in rows], pa.string()))
    own = collections.defaultdict(list)
    for i, y, _ in marks:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            own[y] += [x[j] for j, r in enumerate(rows) if r[0] == i]
    every = np.array(own[0] + own[1])
    shift, scale = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-9))
    z = {k: (np.array(v) - shift) / scale for k, v in own.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    together = sum(len(z[k]) * cov[k] for k in z) / len(every)

    def density(k, row):
        c = (1 - pooled) * cov[k] + pooled * together
        c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        d = row - z[k].mean(0)
        return -0.5 * (d @ np.linalg.solve(c, d) + np.linalg.slogdet(c)[1]) + np.log(len(z[k]) / len(every))

    want = [1 / (1 + np.exp(-np.clip((density(1, r) - density(0, r)) / temperature, -30, 30))) for r in (x - shift) / scale]
    got = quality.classify(docs, labels, remainder(F.col("doc_id"), 5) != 0).collect()
    assert sorted((str(r.doc_id), round(r.score, 6), r.predicted) for r in got) == sorted((str(r[0]), round(float(s), 6), int(s >= 0.3)) for r, s in zip(rows, want))


def test_language_repeated_rows(spark):
    """A row that is repeated thousands of times neither crowds the sample nor is lost."""
    rows = [(1, "the thing with that", "en", "s", 0)] * 3000 + [(i, f"der nicht schön {i}", "de", "s", 0) for i in range(2, 90)]
    docs = spark.createDataFrame(rows, DOCS)
    assert len(language_id.labelled_sample(docs, F.lit(True), 400)) == 89
    out = collections.Counter((r.doc_id, r.lang_pred) for r in language_id.identify(docs, F.lit(True)).select("doc_id", "lang_pred").collect())
    assert out[1, "en"] == 3000 and sum(out.values()) == len(rows)
