"""The pipeline, stage by stage, on a small table, against brute force."""

from __future__ import annotations

import collections
import hashlib

import numpy as np

import corpus_pipeline
from larkspur.llm import common
from larkspur.llm.common import store

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    rng = np.random.default_rng(5)
    vocabulary = {"en": ["the", "thing", "with", "that", "other", "house"], "de": ["der", "nicht", "schön", "über", "haus", "andere"]}
    rows = []
    for i in range(200):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(vocabulary[lang], 40)), lang, f"s{i % 4}", 0))
    rows += [(300, rows[7][1], "en", "s0", 0), (301, rows[7][1] + " end", "en", "s1", 0), (302, None, "en", "s0", 0), (303, "1234 !!", "en", "s0", 0)]
    key = hashlib.sha1(b"x").hexdigest()
    rows.append((304, " ".join(rng.choice(vocabulary["en"], 30)) + f' token = "{key}"', "en", "s2", 0))
    docs = spark.createDataFrame(rows, DOCS)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, ""))
        held[name] = out
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    ids = {name: collections.Counter(r.doc_id for r in df.collect()) for name, df in held.items()}
    assert set(ids["language"]) == {r[0] for r in rows} - {302, 303}
    assert set(ids["near_duplicates"]) == set(ids["language"]) - {300, 301} and max(ids["near_duplicates"].values()) == 1
    assert ids["secrets"] == ids["near_duplicates"]
    assert not held["secrets"].where(f"text LIKE '%{key}%'").count() and held["secrets"].where("text LIKE '%[SECRET]%'").count() == 1
    assert set(ids["mixing"]) <= set(ids["secrets"]) and max(ids["mixing"].values()) <= 3
    pieces = held["packing"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(ids["mixing"])


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_language_rejects_unlike_texts(spark):
    rng = np.random.default_rng(6)
    vocabulary = {"en": ["the", "thing", "with", "that", "other", "house"], "de": ["der", "nicht", "schön", "über", "haus", "andere"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 40)), lang, "s", 0) for i in range(200) for lang in [["en", "de"][i % 2]]]
    good = [(300, "The other house!! 123", None, "s", 0), (301, "that *** thing 4f9a0c77e1 " * 2000, None, "s", 0), (302, "nicht", None, "s", 0), (303, "x", None, "s", 0)]
    bad = [(400, "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan", None, "s", 0), (401, "все люди рождаются свободными", None, "s", 0), (402, "zqxjk vwpfq " * 3000, None, "s", 0), (403, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz  "), 400)), None, "s", 0)]
    out = corpus_pipeline.language(spark, spark.createDataFrame([*rows, *good, *bad], DOCS), "")
    assert {r.doc_id for r in out.collect()} == {r[0] for r in [*rows, *good]}


def test_deduplicate_repeated_and_null_ids(spark):
    rng = np.random.default_rng(7)
    a, b, c, d = (" ".join(rng.choice([f"w{i}" for i in range(60)], 40)) for _ in range(4))
    rows = [(1, b), (5, a), (5, b), (5, b + " end"), (6, a), (7, c), (7, d), (None, c), (None, d + " end"), (None, "one two three four five six"), (None, "one two three four five six"), (8, d)]
    rows = [(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows)]
    want = collections.Counter([(1, b), (5, a), (7, c), (7, d), (None, "one two three four five six")])
    held = []
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.deduplicate(spark, spark.createDataFrame(order, DOCS).repartition(3), "").collect()
        assert collections.Counter((r.doc_id, r.text) for r in out) == want
        held.append(sorted(map(tuple, out), key=str))
    assert held[0] == held[1]


def test_stages_with_any_columns_and_rows(spark):
    """Columns named like internal ones, null and repeated ids, repeated rows, and empty tables, stage by stage."""
    from tests.llm.test_operators import clashing

    rng = np.random.default_rng(9)
    word = {"en": ["the", "thing", "with", "that", "other", "house"], "de": ["der", "nicht", "schön", "über", "haus", "andere"]}
    rows = [(i, " ".join(rng.choice(word[y], 30)), y, f"s{i % 3}", 0) for i in range(120) for y in [["en", "de"][i % 2]]]
    rows += [rows[3], (5, "another the thing with that text of five", "en", "s1", 0), (None, "house with that thing the other", "en", None, 0), (None, None, None, None, None), (200, "", "en", "s1", 0)]
    docs = clashing(spark, rows)
    columns, there = docs.columns, {tuple(r)[:1] + tuple(r)[2:4] + tuple(r)[5:] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, ""))
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] > 0
            break
        assert out.columns == columns
        assert {tuple(r)[:1] + tuple(r)[2:4] + tuple(r)[5:] for r in out.collect()} <= there, name
        docs = out
    empty = clashing(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_no_text_of_an_id_is_lost(spark):
    """Two texts of one id are two documents until mixing chooses among them."""
    rows = [(5, "the thing with that other house " * 3, "en", "a", 0), (5, "with house other the that thing over " * 3, "en", "a", 0)] + [(i, f"the {i} thing with number {i} of that other house {i * 7}", "en", "a", 0) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = store(stage(spark, docs, ""))
        assert sum(r.doc_id == 5 for r in docs.collect()) == 2, name


def test_run_leaves_no_tables(spark, tmp_path, monkeypatch):
    import os

    (tmp_path / "in").mkdir()
    rows = [(i, f"the {i} thing with number {i} of that other house {i * 7}", "en", f"s{i % 2}", 0) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert out.count() > 0 and len(os.listdir(tmp_path / "shared" / "larkspur")) <= 4  # the last stage's input and what it stored itself
