"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, ctw, embedding_dedup, language_id, mixing, packing, quality
from larkspur.llm.chat import digests, format_conversations, read_back
from larkspur.llm.common import components, remainder
from larkspur.llm.minhash_dedup import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_set(text: str | None) -> set:
    w = words(text)
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids: list, linked) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, short, empty, null and long ones."""
    rng = np.random.default_rng(0)
    make = lambda n: " ".join(rng.choice(WORDS, n))
    base = [make(int(rng.integers(6, 80))) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        w = t.split()
        for _ in range(int(rng.integers(1, 5))):
            v = list(w)
            for _ in range(int(rng.integers(0, 4))):
                v[int(rng.integers(len(v)))] = "zz"
            texts.append(" ".join(v))
    passage = make(40)
    texts += [passage + " " + make(15) for _ in range(12)] + [base[0]] * 10
    texts += [None, "", "  \n", "one two", "One  TWO", "three", make(30000), "Ünïcode ß été à la", "ünïcode ß été à la"]
    return [(i, t, ["en", "fr"][i % 2], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e})
    have = {frozenset(e) for e in edges}
    want = brute_components(ids, lambda a, b: frozenset((a, b)) in have)
    assert {i: got.get(i, i) for i in ids} == want


def test_minhash(spark, corpus):
    out = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(corpus, DOCS), block=2).collect()}
    sets = {d[0]: shingle_set(d[1]) for d in corpus}
    want = brute_components(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0)
    assert {i: r.component_id for i, r in out.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in out.items())


def test_minhash_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "x", 1), (3, "a b c d e f", "x", 1), (3, "a b c d e f", "x", 1), (None, None, "x", 1)], "doc_id long, text string, fp string, sig int")
    rows = sorted(near_duplicates(docs).collect(), key=str)
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2 and all(r.component_id == 3 for r in rows if r.n_shingles)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_minhash_null_ids(spark):
    """Many rows without an id: classes of their own meet one text each."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, 30)) for _ in range(40)]
    texts += [t + " end" for t in texts[:20]]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, texts[0]), (8, texts[21] + " end")], "doc_id long, text string")
    out = near_duplicates(docs).collect()
    assert len(out) == 62 and sum(r.component_id == 7 for r in out) == 3 and sum(r.component_id == 8 for r in out) == 2 and sum(r.component_id is None for r in out) == 57


def test_minhash_large_families(spark):
    """Families of many blocks whose sets don't all reach the first one."""
    rng = np.random.default_rng(12)
    base = [f"v{i}" for i in range(60)]
    rows, chain = [], list(base)
    for i in range(120):  # a chain that drifts: neighbours are alike, the ends aren't
        chain[int(rng.integers(60))] = f"c{i}"
        rows.append((i, " ".join(chain)))
    rows += [(200 + i, " ".join(base[:40] + [f"x{i}_{k}" for k in range(6)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    want = brute_components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    for block in (3, 1024):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, block=block).collect()} == want


def test_collision_counting():
    """Merged postings link what whole signatures link."""
    from larkspur.llm import minhash_dedup as m

    rng = np.random.default_rng(13)
    for n, changes in ((300, 40), (120, 30), (30, 36)):
        base = rng.integers(0, 50, (12, 64)).astype(np.uint32)
        sig = base[rng.integers(0, 12, n)]
        for row in sig:
            at = rng.permutation(64)[: rng.integers(0, changes)]
            row[at] = rng.integers(0, 9, len(at))
        pairs = (sig[:, None] == sig[None]).sum(2) >= 32
        want = m._walk(n, lambda i, rest: pairs[i, rest])
        same = lambda x: {frozenset(np.flatnonzero(x == v)) for v in np.unique(x)}
        assert same(m._collided(sig, 32)) == same(want)
        left, right = np.arange(n // 2), np.arange(n // 2, n)
        across = pairs.copy()
        across[: n // 2, : n // 2] = across[n // 2 :, n // 2 :] = False
        assert same(m._collided_across(sig, left, right, 32)) == same(m._walk(n, lambda i, rest: across[i, rest]))


def test_language(spark):
    rng = np.random.default_rng(2)
    vocabulary = {"en": ["the", "and", "thing", "with", "that"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "être", "vous", "déjà", "très"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 30)), lang, "s", 0) for i in range(240) for lang in [list(vocabulary)[i % 3]]]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 34 !!", "en", "s", 0), (903, "und nicht " * 40000, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    train = remainder(F.col("doc_id"), 5) != 0
    out = {r.doc_id: r for r in language_id.identify(docs, train, per_language=40, landmarks=30).collect()}
    held = [r for r in rows if r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(out[r[0]].lang_pred == r[2] for r in held) and out[903].lang_pred == "de"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), train).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(WORDS, 50)) + ".\n" + " ".join(rng.choice(WORDS, 30)) + "."
    bad = lambda: "!! ".join(w.upper() for w in rng.choice(WORDS, 40))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "s", 0) for i in range(300)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(250)] + [(5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels, remainder(F.col("doc_id"), 5) != 0).collect()}
    right = np.mean([out[i].predicted == (i % 4 != 0) for i in range(250, 300)])
    assert right > 0.95 and out[900].score == out[901].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert {r.score for r in quality.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_ctw(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    train = remainder(F.col("doc_id"), 10) != 0
    out = {r.doc_id: r for r in ctw.score(docs, train, frequent=50).collect()}
    tokens = {d[0]: words(d[1]) + [b"\n"] for d in corpus}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n = sum(counts.values())
    norm = n + 0.1 * (len(counts) + 1)
    for i, t in tokens.items():
        assert out[i].n_tokens == len(t) and out[i].n_known == sum(w in counts for w in t) and out[i].train_tokens == n
        assert out[i].base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / norm) for w in t))
    for r in ctw.score(docs, F.lit(False)).collect():
        assert r.score == pytest.approx(-8 * np.log10(2) * (sum(len(w) + 1 for w in tokens[r.doc_id]) - 1))
    assert ctw.score(docs.limit(0), train).count() == 0


def test_mixing(spark, corpus):
    docs = spark.createDataFrame([*corpus, (1000, "a b c", "en", None, 5), (None, "a b", "en", "src1", 3)], DOCS)
    rows = mixing.mix(docs, salts=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, salts=3).collect()))
    assert len(rows) == len(corpus) + 2 and all(r.taken <= 3 * r.size for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total, weights = sum(r.size for r in rows), {s: i % 3 + 1 for i, s in enumerate([*sorted(s for s in by if s is not None), None])}
    left, targets = dict(weights), {}
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    while left:
        level = (total - sum(targets.values())) / sum(left.values())
        full = [s for s in left if level * left[s] >= 3 * sizes[s]]
        for s in full or list(left):
            targets[s] = 3 * sizes[s] if full else level * left[s]
            del left[s]
    for s, v in by.items():
        assert v[0].target == pytest.approx(targets[s]) and v[0].source_size == sizes[s]
        assert abs(sum(r.copies for r in v) - len(v) * targets[s] / max(sizes[s], 1)) <= 1
    taken = mixing.mixed(docs, salts=3).collect()
    assert collections.Counter(r.source for r in taken) == collections.Counter({s: sum(r.copies for r in v) for s, v in by.items()})
    assert max(collections.Counter(r.doc_id for r in taken).values()) <= 3
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


CLASHES = ["id", "of", "copies", "rows", "words", "__n", "__copy", "_i", "n", "i", "tie", "a.b", "ahead", "salt", "band", "score", "lang_pred", "likeness", "__letter", "letter", "key", "member", "hash", "_key", "Size"]


def clashing(spark, rows, names=CLASHES):
    """Documents with further columns of awkward names, each of which says which row it is of."""
    schema = DOCS + "".join(f", `{c}` string" for c in names)
    return spark.createDataFrame([(*r, *(f"{c}{n}" for c in names)) for n, r in enumerate(rows)], schema)


def test_mixing_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 5 + [(2, "", "en", "t", 0)], DOCS)
    assert sum(r.copies for r in mixing.mix(docs).where("source = 's'").collect()) == mixing.mixed(docs).where("source = 's'").count() == 5


def test_mixing_numbered(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 10), (4, 9)], "id long, n long")
    assert collections.Counter(r.id for r in mixing._numbered(rows, F.col("n"), "i", 3).collect()) == {2: 1, 3: 10, 4: 9}


def test_mixing_clashing_columns(spark, corpus):
    """Columns of any name come through; rows of one id with unlike texts are told apart; repeats count."""
    rows = [*corpus, (5, "another text of id five", "en", "src2", 0), (None, "a b c", "en", None, 0), (None, "x y", "en", None, 0)]
    docs = clashing(spark, rows)
    for some in (docs, docs.union(docs.where("doc_id < 3"))):
        out = mixing.mixed(some, salts=3)
        assert out.columns == docs.columns
        taken = collections.Counter(tuple(r) for r in out.collect())
        there = collections.Counter(tuple(r) for r in some.collect())
        assert set(taken) <= set(there) and all(taken[r] <= 3 * there[r] for r in taken)
        sizes = collections.Counter()
        for r, n in taken.items():
            sizes[r[3]] += n * len(words(r[1]))
        for r in mixing.mix(some, salts=3).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert sizes[r.source] == pytest.approx(r.taken, rel=0.1, abs=90)
    assert collections.Counter(map(tuple, mixing.mixed(docs).collect())) == collections.Counter(map(tuple, mixing.mixed(docs.repartition(5)).collect()))


def test_language_clashing_columns(spark, corpus):
    docs = clashing(spark, corpus)
    out = language_id.identify(docs, F.lit(True), with_likeness=True, prefix="p_")
    assert out.columns == [*docs.columns, "p_lang_pred", "p_score", "p_likeness"] and sorted(map(str, out.select(*(f"`{c}`" for c in docs.columns)).collect())) == sorted(map(str, docs.collect()))
    plain = language_id.identify(docs, F.lit(True))
    assert plain.columns == [*(c for c in docs.columns if c not in ("score", "lang_pred")), "lang_pred", "score"]


def test_language_sample(spark):
    """The sample is of distinct texts within its bounds; nulls and repeats use up no place."""
    rows = [(1, f"text number {i % 7}", "en", "s", 0) for i in range(3000)] + [(i, None, "en", "s", 0) for i in range(50)] + [(i, f"ein text {i}", "de", "s", 0) for i in range(30)] + [(9, "x" * 5000, "fr", "s", 0), (9, "petit", "fr", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = collections.Counter(r["lang"] for r in language_id.labelled_sample(docs, F.lit(True), 20))
    assert got == {"en": 7, "de": 20, "fr": 2}
    assert [r["text"] for r in language_id.labelled_sample(docs, F.lit(True), 20, most_bytes=3000) if r["lang"] == "fr"] == ["petit"]
    assert collections.Counter(r["lang"] for r in language_id.labelled_sample(docs, F.lit(True), 20, most=12)) == {"en": 4, "de": 4, "fr": 2}
    assert sum(len(r["text"]) for r in language_id.labelled_sample(docs, F.lit(True), 20, most_bytes=300) if r["lang"] == "de") <= 100
    assert language_id.labelled_sample(docs.limit(0), F.lit(True), 20) == []


@pytest.mark.parametrize("specials", [True, False])
def test_packing(spark, corpus, specials):
    """Pieces hold the ids of the tokenizer itself, special tokens in texts, at cuts and in texts beyond a slice included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = not specials
    mark = "<|endoftext|>"
    own = [
        (2000, f"{mark} 's  x\n\n y　 z"), (2001, "é" * 5000), (2002, f"{mark} x"), (2003, mark), (2004, f"x {mark}{mark}  {mark[:-1]} {mark[1:]}"), (2005, "<|endoftext|"), (2006, ">a"),
        (2007, f"the quick brown {mark}fox " * 60000), (2008, "ab" * 700000 + mark + " c"),
    ]
    docs = spark.createDataFrame([*corpus, *((i, t, "en", "s", 0) for i, t in own)], DOCS)
    rows = packing.pack(docs, path, length=256, specials=specials).collect()
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(dict)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.start] = r
    filled = []
    for at in sequences.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        filled.append(end)
    assert sorted(sequences) == list(range(len(sequences))) and sum(n < 256 for n in filled) <= 1 and max(filled) <= 256
    for i, text in [*((d[0], d[1]) for d in corpus), *own]:
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        got = b"".join(bytes(pieces[i][s].ids) for s in sorted(pieces[i]))
        assert got == ids.tobytes() and all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces[i].values())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_repeated_rows_and_columns(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "c", 6, None), (None, None, 7, "y")], "doc_id long, text string, uid int, key string")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert sorted((r.offset, r.offset + r.length) for r in rows)[-1][1] == 9


def test_tokens_without_byte_level_bpe():
    """A file with other rules is used as it is."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from larkspur.llm.textkernel import buffer_of
    from larkspur.llm.tokens import load

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  <|endoftext|> World's", "", "ÉTÉ 12"]
    ids, counts = load(path).encode(*buffer_of(pa.array(texts)))
    exact = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert not load(path).plain and counts.tolist() == [len(e) for e in exact] and ids.tolist() == sum(exact, [])


def test_hilbert_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512)) and np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).max() == 1


@pytest.fixture(scope="module")
def vectors():
    """Clusters, exact and scaled copies, and vectors that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    x = [centres[i % 30] + rng.standard_normal(16) * (0.1 if i % 3 else 1.5) for i in range(600)]
    x += [x[0]] * 40 + [2 * x[5], -x[5]]
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    return [*rows, (700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [None] + [1.0] * 15, 0), (800, [1.0, 2.0], 0), (801, [2.0, 4.0], 0)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_embedding_dedup(spark, vectors):
    for block, leaf, sample in ((4096, 64, 20000), (16, 2000, 20000), (4096, 16, 40)):
        out = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors, VECTORS), block=block, leaf=leaf, sample=sample).collect()}
        valid = {i: np.array(v, float) for i, v, _ in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
        unit = {i: v / np.linalg.norm(v) for i, v in valid.items()}
        linked = lambda a, b: len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
        want = brute_components(sorted(unit), linked)
        links = {a: sum(linked(a, b) for b in unit if b != a) for a in unit}
        assert {i: out[i].component_id for i in unit} == want and {i: out[i].n_links for i in unit} == links
        assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in (700, 701, 702, 703))
    assert embedding_dedup.near_duplicates(spark.createDataFrame(vectors, VECTORS).limit(0)).count() == 0


def test_embedding_dedup_deals_out_few_copies(spark, monkeypatch):
    """A vector goes to a bounded number of tasks, however finely the table is split; links are whole."""
    rng = np.random.default_rng(17)
    x = rng.standard_normal((4000, 64))
    x[2000:3000] = x[:1000] + 0.25 * rng.standard_normal((1000, 64))  # cosines about 0.97
    x[3000:3100] = x[1500]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], VECTORS)
    dealt = []

    def repartition(self, *keys, inner=type(df).repartition):
        if "vec" in self.columns:
            dealt.append(self.count())
        return inner(self, *keys)

    monkeypatch.setattr(type(df), "repartition", repartition)
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf=16).collect()}
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert [out[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [out[i].component_id for i in range(len(x))] == near.argmax(1).tolist()
    assert sum(dealt) < 12 * len(x), dealt


def test_ann(spark, vectors):
    df = spark.createDataFrame(vectors, VECTORS)
    rows = ann.search(df, F.col("vec_id") % 20 == 0, size=32, block=64).collect()
    valid = {i: np.array(v, float) for i, v, _ in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.query_id][r.rank] = (r.score, r.vec_id)
    hit = total = 0
    for q in (i for i in valid if i % 20 == 0):
        near = sorted((float(np.sqrt(((valid[i] - valid[q]) ** 2).sum())), i) for i in valid if i != q and len(valid[i]) == len(valid[q]))[:10]
        assert sorted(got[q]) == list(range(1, len(near) + 1)) and [got[q][k] for k in sorted(got[q])] == sorted(got[q].values())
        hit, total = hit + len({i for _, i in near} & {i for _, i in got[q].values()}), total + len(near)
        assert all(s == pytest.approx(np.sqrt(((valid[i] - valid[q]) ** 2).sum())) for s, i in got[q].values())
    assert hit / total >= 0.9
    assert ann.search(df.limit(0), F.lit(True)).count() == 0 and ann.search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("n", [1500, 6000])
def test_lists_grow_in_number(spark, n, monkeypatch):
    """With a sample that is small beside the table, lists and leaves are split level by level; recall holds."""
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((n // 20, 16))
    x = (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.standard_normal((n, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS).cache()
    sizes = {}
    for module, name, most in ((ann, "_found", 4 * 32), (embedding_dedup, "_blocks", 4 * 32)):
        inner = getattr(module, name)

        def seen(first, *rest, inner=inner, name=name):
            column = "list" if name == "_found" else "leaf"
            sizes[name] = max(r["count"] for r in first.groupBy(column).count().collect())
            return inner(first, *rest)

        monkeypatch.setattr(module, name, seen)
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, size=32, sample=150).collect():
        got[r.query_id].add(r.vec_id)
    wide = x.astype(float)
    hit = 0
    for q in range(0, n, 50):
        d = ((wide - wide[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert len(got[q]) == 10
    assert hit / (10 * len(range(0, n, 50))) >= 0.9
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf=32, sample=150).collect()}
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    assert sum(out[i].n_links for i in range(n)) >= 0.99 * links.sum() and all(out[i].n_links <= links[i] for i in range(n))
    assert sizes["_found"] <= 128 and sizes["_blocks"] <= 128
    df.unpersist()


def test_ann_driver_memory(spark):
    """What the driver holds for two thousand lists doesn't grow with lists times queries times neighbours."""
    x = np.random.default_rng(16).standard_normal((12_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], VECTORS)
    tracemalloc.start()
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, size=8).collect():
        got[r.query_id].add(r.vec_id)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hit = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert peak < 200e6, peak
    assert hit / (10 * len(got)) >= 0.9 and len(got) == 120


def test_ann_short_lists_are_topped_up(spark):
    """Small groups far apart: lists hold fewer rows than are asked for."""
    rng = np.random.default_rng(15)
    x = np.repeat(100 * rng.standard_normal((100, 8)), 4, axis=0) + rng.standard_normal((400, 8))
    rows = [(i, v.astype(np.float32).astype(float).tolist(), 0) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, size=4, replicas=1, target=0.2).collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 400, 20)) and all(len(v) == 10 for v in got.values())


def test_ann_repeated_ids(spark):
    """Every pair of a query row and a row of another id, as in the SQL's join."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8)).astype(np.float32).astype(float)
    rows = [(i % 40, x[i].tolist(), 0) for i in range(60)] + [(0, x[0].tolist(), 0)] + [(7, x[7].tolist(), 0)] * 3 + [(0, rng.standard_normal(8).astype(np.float32).astype(float).tolist(), 0) for _ in range(15)]
    got = collections.defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    for q in (0, 20):
        pairs = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for i, v, _ in rows if i == q for j, w, _ in rows if j != q)[:10]
        assert got[q] == [(j, round(s, 9)) for s, j in pairs]


def test_chat(spark):
    trap = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", trap), (1, 0, "user", trap), (2, 0, "sys:tem\\", "####\n### user: x</turn>\n"), (2, 1, "assistant", None), (2, 2, "assistant", "\\"), (3, 0, None, "a" * 200000), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    formatted = format_conversations(df, part_chars=50)
    out = {r.conv_id: r for r in digests(formatted).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        learned = "".join(t for r, t in turns if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got.loss_chars == len(learned) and got.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    whole = "".join(r.formatted for r in sorted((r for r in formatted.collect() if r.conv_id == 1), key=lambda r: r.part))
    assert list(read_back(iter([whole]))) == [("user", trap), ("assistant", trap)] and out[1].formatted_chars == len(whole)
    assert digests(format_conversations(df.limit(0))).count() == 0


def test_chat_long_texts(spark, monkeypatch):
    """Long texts are escaped and read back piece by piece, wherever pieces and parts end."""
    from larkspur.llm import chat

    monkeypatch.setattr(chat, "PIECE", 16)
    rng = np.random.default_rng(11)
    bits = ["#", "##", "###", "####" * 9, "\\", "\\\\", "</turn>", "</turn", "<", "</", ">", "\n", ": ", "é", "\U0001f600", "abcdefgh", "### user: ", "</turn>\n### assistant: "]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 60)))) for _ in range(300)]
    for t in texts:
        plain = re.sub(r"\\|#{3,}|<(?=/turn>)", lambda m: "".join("\\" + c for c in m[0]), t)
        assert "".join(chat.escape(t)) == plain and re.sub(r"(?s)\\(.)", r"\1", plain) == chat.unescape("".join(chat.escape(t))) == t
    rows = [(i // 6, i % 6, ["user", "assistant", "a:b\\"][i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for part_chars in (1, 7, 1000):
        out = {r.conv_id: r for r in digests(format_conversations(df, part_chars=part_chars)).collect()}
        for conv in range(50):
            turns = [(r, t) for c, _, r, t in rows if c == conv]
            learned = "".join(t for r, t in turns if r == "assistant")
            assert out[conv].n_turns == 6 and out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            assert out[conv].loss_chars == len(learned) and out[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    with pytest.raises(ValueError):
        list(read_back(iter(["### user: x"])))
    with pytest.raises(ValueError):
        list(read_back(iter(["nothing of the kind"])))


@pytest.mark.parametrize("depth", [0, 2, 6])
def test_ctw_segments_of_long_texts(depth, monkeypatch):
    """Segments of a long text have the strings, in order, that it has as a whole."""
    rng = np.random.default_rng(16)
    monkeypatch.setattr(ctw, "LONG", 50)
    for text in (b"", b" ", b"x" * 500, b"a b" * 200, b"  lead " + bytes(rng.choice(list(b"abc \n"), 900).astype(np.uint8)) + b"tail", b"y" * 49 + b" " * 80 + b"z", b"w " * 25):
        raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        out, base, at = ctw.stream(raw, off, depth)
        parts = [(ctw.grams(o, a, depth), np.diff(np.searchsorted(a, b))) for o, b, a in ctw.streams(raw, off, depth)]
        assert np.array_equal(np.concatenate([g for g, _ in parts]), ctw.grams(out, at, depth)) and sum(int(n[0]) for _, n in parts) == len(at)


def test_ctw_keeps_every_context(spark):
    """Scores equal a tree of all contexts by brute force, one seen once among 100,000 positions too."""
    depth, lgamma = 6, np.vectorize(math.lgamma)
    texts = ["ab ba " * 12000, "abra cadabra", "quartz", "zu quartz", None, "abracadabra quark", "ab"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    held = {5, 6}
    stream = lambda t: [10] * depth + [b for w in words(t) for b in w + b" "] + [10]
    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in enumerate(texts):
        s = stream(t)
        for p in range(depth, len(s)) if i not in held else ():
            for d in range(depth + 1):
                for k in range(8):
                    counts[tuple(s[p - d : p]), k, s[p] >> (8 - k)][s[p] >> (7 - k) & 1] += 1
    below = collections.defaultdict(float)
    share = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        zero, one = counts[node]
        own = float(lgamma(zero + 0.5) + lgamma(one + 0.5) - lgamma(zero + one + 1) - np.log(np.pi))
        weighted = own if len(node[0]) == depth else np.logaddexp(own, below[node]) - np.log(2)
        share[node] = np.exp(own - (0 if len(node[0]) == depth else np.log(2)) - weighted)
        if node[0]:
            below[node[0][1:], node[1], node[2]] += weighted
    def cost(s, p, k):
        mixed, left = 0.0, 1.0
        for d in range(depth + 1):
            node = tuple(s[p - d : p]), k, s[p] >> (8 - k)
            zero, one = counts.get(node, (0, 0))
            w = 1.0 if d == depth else share.get(node, 0.5)
            mixed, left = mixed + left * w * (one + 0.5) / (zero + one + 1), left * (1 - w)
        return np.log10(mixed if s[p] >> (7 - k) & 1 else 1 - mixed)
    docs = spark.createDataFrame(rows, DOCS)
    for chunk_bytes in (16 << 20, 10):
        out = {r.doc_id: r for r in ctw.score(docs, ~F.col("doc_id").isin(*held), chunk_bytes=chunk_bytes).collect()}
        assert len(out) == len(rows)
        for i in range(1, len(texts)):
            s = stream(texts[i])
            assert out[i].score == pytest.approx(sum(cost(s, p, k) for p in range(depth, len(s)) for k in range(8)), rel=1e-5)
