"""Secret scanning with a random forest that removes false positives.

Candidates, found in whole texts, are of five kinds: runs of at least
``SHORTEST`` key-like characters that aren't words of the dictionary and don't
look like any word (they have digits, change between capital and small letters
more than once, or hold ``WORD`` letters on end); whatever
is assigned to a name (wide alphabet, at least ``ASSIGNED`` characters);
passwords of addresses (``scheme://user:password@host``); strings of letters,
digits and marks between blanks; and whole PEM blocks. An equals sign belongs
to a run only as padding at its end, so that of ``API_KEY=value`` the value
alone is one. Kinds may overlap; inside a PEM block there is no other.

A forest trained from labelled findings decides which of them are secrets, from
their length, character classes and transitions, the share that dictionary
words cover, the document's path, and the neighbouring words. The odds of
transitions and of neighbouring words are learned from the findings; the
dictionary is learned from the corpus (:func:`dictionary`): the words of at
least ``spread`` documents, at most ``most`` of them (those in most documents,
words of about the same count together), beside a short fixed list. These two
are documented bounds.

Labelled findings come from :func:`labelled_findings`, a seeded generator of
lines in which keys occur and of what is mistaken for them; a table (value,
before, after, label, perhaps path) can take its place, of which at most
``most`` rows of smallest hash are used.

Null and empty texts have no candidates. Repeated rows are scanned each. An
empty table gives an empty result; columns other than id, text and path are
ignored by :func:`scan` and kept by :func:`redact`, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded, cols, map_arrow, parts, prefix_for, store
from larkspur.llm.textkernel import _BYTE, _COEF, _WORD, _power_tables, buffer_of, mix64

SHORTEST, ASSIGNED, WORD = 8, 6, 18
BEFORE, AFTER = 64, 16
#: Bytes of text that are looked at together.
PART = 1 << 20
#: Common words beside those learned from a corpus, and what the keys of some services start with.
DICTIONARY = (
    "about access account address admin after again alpha always application archive array article author available basic before between blank block board "
    "book border bottom branch button cache change channel check class clean client close code command comment common config contact content control copy "
    "core count create current customer data database date default delete demo design detail device document domain down download edit email empty english "
    "error event example export external false field figure file filter final first folder font form format foobar general global group handle header "
    "height help hello here hidden history home horizontal host html image import index info input insert internal issue item json label language layout "
    "length library license line link list local login mail manager master member message method middle model module money mouse name network none null "
    "object option order output page parent part password path people person photo placeholder port position press private product profile project property "
    "public query random record redacted replace report request reset response save script search secret section server service session shared source state "
    "static status string system table target template test text theme this thumb time title token"
).split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "rk_live_", "AIza", "eyJ", "npm_", "hf_", "SG.", "dop_v1_")

_KEYCHAR = np.zeros(256, bool)
_KEYCHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-."]] = True
_EQUALS = ord("=")
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 digit, 2 capital, 3 small
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"!@#$%^&*~?")] = True
_STRING = np.ones(256, bool)
_STRING[list(b" \t\n\x0b\x0c\r\"'`<>()[]{},;")] = False
_NAMECHAR = np.zeros(256, bool)
_NAMECHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *b"_\"'`] \t"]] = True

_NAMED = re.compile(rb"([?&]?)([A-Za-z_][A-Za-z0-9_.\-]*)[\"'`\]]{0,2}[ \t]{0,4}$")
_VALUE = re.compile(rb"(?:=|>|:=)?[ \t]{0,4}(?:(?i:bearer|basic|token)[ \t]+)?(?:\"([^\"\s]+)\"|'([^'\s]+)'|`([^`\s]+)`|([^\s\"'`,;<>]+))")
_USERINFO = re.compile(rb"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----[A-Za-z0-9+/=\s:,\-]*?-----END \1-----|-----BEGIN [A-Z0-9 ]+-----(?:[\r\n]+[A-Za-z0-9+/=]{16,})+")
_MAIL = re.compile(rb"[\w.+\-]+@[\w.\-]+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_TOKENS = re.compile(r"[A-Za-z0-9_.\-]+")
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PATHLIKE = re.compile(rb"^[/~]|://|\.[a-zA-Z]{2,4}$|/.*[a-z]{3,}.*/")
_TRIM = b":"
FEATURES = [
    "length", "entropy", "digits", "capitals", "small", "symbols", "switches", "transitions", "hex", "uuid", "covered", "distinct", "prefix", "separators", "assigned", "quoted",
    "best_word", "worst_word", "words", "path", "address", "repeats", "vowels", "pem", "test_file", "settings_file",
]


def word_hash(starts: np.ndarray, ends: np.ndarray, raw: np.ndarray, size: int = PART) -> np.ndarray:
    """64-bit hashes of spans of a buffer (sorted by their starts), whatever the case of ASCII letters; some bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, first + size)))
        last = int(ends[i:j].max())
        up, down = _power_tables(last - first + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(last - first + 1, np.uint64)
            np.cumsum(_BYTE[raw[first:last]] * up[: last - first], out=total[1:])
            s, e = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix64(((total[e] - total[s]) * down[s]) ^ ((e - s).astype(np.uint64) * _COEF[15]))
        i = j
    return out


def _upto(mask: np.ndarray) -> np.ndarray:
    """Sums of what is before each place."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:], dtype=np.int32)
    return out


def _one_buffer(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
    return np.frombuffer(b"".join(values), np.uint8), off


def _fixed() -> np.ndarray:
    raw, off = _one_buffer([w.encode() for w in DICTIONARY if len(w) >= 4])
    return np.unique(word_hash(off[:-1], off[1:], raw))


def _is_in(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _letter_runs(raw: np.ndarray, off: np.ndarray, camel: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ASCII letters within rows; with ``camel`` a capital after a small letter starts another."""
    kind = _KIND[raw]
    letter = kind >= 2
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    edge[1:-1] |= letter[1:] != letter[:-1]
    if camel:
        edge[1:-1] |= (kind[1:] == 2) & (kind[:-1] == 3)
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = letter[starts] if len(starts) else np.empty(0, bool)
    return starts[keep], ends[keep]


def dictionary(docs: DataFrame, *, spread: int = 8, most: int = 1 << 16, shortest: int = 4, longest: int = 24) -> np.ndarray:
    """Sorted hashes of the words (runs of ASCII letters, whatever their case) of at least ``spread`` documents, and of the fixed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held))
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, n, len(u)).astype(np.int64)

        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            for part in parts(batch, PART):
                raw, off = buffer_of(part.column("text"))
                if not len(raw):
                    continue
                starts, ends = _letter_runs(raw, off, camel=False)
                fit = (ends - starts >= shortest) & (ends - starts <= longest)
                starts, ends = starts[fit], ends[fit]
                h, row = word_hash(starts, ends, raw), np.searchsorted(off, starts, side="right")
                with np.errstate(over="ignore"):  # a word counts once a document
                    _, first = np.unique(mix64(h ^ (row.astype(np.uint64) * _COEF[3])), return_index=True)
                u, n = np.unique(h[first], return_counts=True)
                held.append((u, n))
                size += len(u)
                if size > 1 << 20:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    counted = bounded(docs).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= spread)
    counted = store(counted.withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 32).cast("int")))
    # Words of one level of counts (32 a doubling) come or stay away together, so that tasks send the driver what it keeps.
    held, least = 0, 0
    for r in counted.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += r.words
        if held > most:
            least = r.level + 1
            break
    rows = counted.where(F.col("level") >= least).select("h").collect()
    return np.unique(np.concatenate((_fixed(), np.array([r.h for r in rows], np.int64).view(np.uint64))))


def coverage(raw: np.ndarray, off: np.ndarray, known: np.ndarray, longest: int = 16) -> np.ndarray:
    """Of each row's letters the share that lies in dictionary words of four letters or more."""
    n, letter = len(raw), _KIND[raw] >= 2
    end_of_run = np.zeros(n, np.int64)
    starts, ends = _letter_runs(raw, off, camel=False)
    for s, e in zip(starts, ends):
        end_of_run[s:e] = e
    mark = np.zeros(n + 1, np.int32)
    for size in range(4, longest + 1):
        at = np.flatnonzero(end_of_run - np.arange(n) >= size)
        if not len(at):
            break
        at = at[_is_in(known, word_hash(at, at + size, raw))]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
    inside, letters = _upto(np.cumsum(mark[:-1]) > 0), _upto(letter)
    return (inside[off[1:]] - inside[off[:-1]]) / np.maximum(letters[off[1:]] - letters[off[:-1]], 1)


# Candidates


def _key_characters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which bytes are key-like; equals signs only in a run that ends a run of others."""
    inside = _KEYCHAR[raw]
    sign = raw == _EQUALS
    at = np.flatnonzero(sign)
    if not len(at):
        return inside
    row = np.searchsorted(off, at, side="right")
    first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])))
    run = np.cumsum(first) - 1
    start, end = at[first], at[np.append(first[1:], True)]
    row = row[first]
    leads = (start > off[row - 1]) & inside[np.maximum(start - 1, 0)]
    follows = (end + 1 < off[row]) & inside[np.minimum(end + 1, len(raw) - 1)]
    inside[at] = (leads & ~follows & (end - start < 2))[run]
    return inside


def _runs(raw: np.ndarray, off: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Runs of key characters that look like no word and of which at least 6 are digits or letters outside dictionary words; full stops at an end don't belong to one."""
    inside = _key_characters(raw, off)
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = inside[start] & (end - start >= SHORTEST)
    start, end = start[keep], end[keep]
    while len(start) and (dot := raw[end - 1] == 46).any():
        end = end - dot
        keep = end - start >= SHORTEST
        start, end = start[keep], end[keep]
    if not len(start):
        return []
    kind = _KIND[raw]
    s, e = _letter_runs(raw, off, camel=True)
    turns = np.zeros(len(raw), np.uint8)
    turns[1:] = (kind[1:] == 2) & (kind[:-1] == 3)
    turns[s[e - s >= WORD]] += 2
    digits, letters, unlike = _upto(kind == 1), _upto(kind >= 2), _upto(turns)
    n_digits, n_letters = digits[end] - digits[start], letters[end] - letters[start]
    row = np.searchsorted(off, start, side="right") - 1
    wide = (start > off[row]) & (raw[np.maximum(start - 1, 0)] >= 128) | (end < off[row + 1]) & (raw[np.minimum(end, len(raw) - 1)] >= 128)
    # What stands beside other letters is part of a word.
    fit = ((n_digits > 0) | (unlike[end] - unlike[start] > 1)) & ((n_letters > 0) | (end - start >= 16)) & ~(wide & (n_digits == 0) & (end - start < 16))
    start, end, n_digits = start[fit], end[fit], n_digits[fit]
    if not len(start):
        return []
    # Only of what is left are the letters looked up.
    own, cut = _one_buffer([raw[i:j].tobytes() for i, j in zip(start, end)])
    s, e = _letter_runs(own, cut, camel=True)
    unknown = (e - s < 4) | ~_is_in(known, word_hash(s, e, own))
    odd = n_digits + np.bincount(np.searchsorted(cut, s[unknown], side="right") - 1, (e - s)[unknown], len(start))
    return list(zip(start[odd >= 6].tolist(), end[odd >= 6].tolist()))


def _assigned(raw: np.ndarray, off: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero((raw == _EQUALS) | (raw == 58))
    at = at[at > 0]
    at = at[_NAMECHAR[raw[at - 1]]]
    row = np.searchsorted(off, at, side="right") - 1
    data, found = raw.tobytes(), []
    for i, r in zip(at.tolist(), row.tolist()):
        low, high = int(off[r]), int(off[r + 1])
        if data[i + 1 : i + 3] == b"//":
            continue
        name = _NAMED.search(data, max(low, i - BEFORE), i)
        if not name:
            continue
        m = _VALUE.match(data, i + 1, high)
        if not m:
            continue
        s, e = m.span(m.lastindex)
        if m.lastindex == 4:
            if name[1] and (cut := data.find(b"&", s, e)) >= 0:
                e = cut
            while e > s and data[e - 1] in b".,;:)]}":
                e -= 1
        if e - s >= ASSIGNED and data.find(b"://", s, e) < 0:
            found.append((s, e))
    if not found:
        return []
    # What is all dictionary words is none.
    own, cut = _one_buffer([data[s:e] for s, e in found])
    s, e = _letter_runs(own, cut, camel=True)
    plain = np.zeros(len(own), np.int32)
    plain[s] = np.where((e - s < 4) | _is_in(known, word_hash(s, e, own)), 0, e - s)
    plain += (_KIND[own] == 1) | _SYMBOL[own]
    upto = _upto(plain)
    return [f for f, odd in zip(found, upto[cut[1:]] - upto[cut[:-1]]) if odd > 0]


def _marked(raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """Strings between blanks, quotes and brackets with letters, digits and marks."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    inside = _STRING[raw]
    edge[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    starts, ends = starts[inside[starts]], ends[inside[starts]]
    fit = ends - starts >= SHORTEST
    starts, ends = starts[fit], ends[fit]
    for some in (_SYMBOL, _KIND == 1, _KIND >= 2):
        upto = _upto(some[raw])
        fit = upto[ends] > upto[starts]
        starts, ends = starts[fit], ends[fit]
    found = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        word = raw[s:e].tobytes()
        left = len(word) - len(word.lstrip(_TRIM))
        word = word.strip(_TRIM)
        if len(word) >= SHORTEST and b"=" not in word and b"://" not in word and not _MAIL.fullmatch(word) and any(c in b"!@#$%^&*~?" for c in word.rstrip(b".!?")):
            found.append((s + left, s + left + len(word)))
    return found


def candidates(raw: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and end bytes of the candidates of a batch, by place."""
    if not len(raw):
        return (np.empty(0, np.int64),) * 3
    spans = {*_runs(raw, off, known), *_assigned(raw, off, known), *_marked(raw, off)}
    data = raw.tobytes()
    within = lambda s, e: np.searchsorted(off, s, side="right") == np.searchsorted(off, e - 1, side="right")
    spans |= {m.span(1) for m in _USERINFO.finditer(data) if m.end(1) - m.start(1) >= 4 and within(*m.span())} if b"://" in data else set()
    blocks = []
    if b"-----BEGIN" in data:
        for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
            blocks += [m.span() for m in _PEM.finditer(data, i, j)]
    if blocks:
        first, last = (np.array(x) for x in zip(*blocks))
        for s, e in list(spans):
            k = int(np.searchsorted(first, e, side="left")) - 1
            if k >= 0 and s < last[k]:
                spans.discard((s, e))
        spans |= set(blocks)
    at = np.array(sorted(spans), np.int64).reshape(-1, 2)
    return np.searchsorted(off, at[:, 0], side="right") - 1, at[:, 0], at[:, 1]


def _blank_from(raw: np.ndarray, at: int, high: int) -> int:
    """The first white space from a place on, or the end."""
    while at < high:
        hit = np.flatnonzero(~_WORD[raw[at : min(at + PART, high)]])
        if len(hit):
            return at + int(hit[0])
        at += PART
    return high


# Features


@dataclass
class Finding:
    value: bytes
    before: bytes = b""
    after: bytes = b""
    path: str = ""


def _neighbours(f: Finding) -> set[str]:
    """The last five words before a finding, the first after it, and those of a block's header; names fall into their words, other values have none."""
    lead = f.value.split(b"\n")[0] if f.value.startswith(b"-----BEGIN") else f.before
    tokens = _TOKENS.findall(lead.decode("utf-8", "replace"))[-5:]
    words = [w for t in tokens if len(t) < 12 or not any(c.isdigit() for c in t) for w in _WORDS.findall(t)][-5:]
    return {w.lower() for w in [*words, *("after " + w for w in _WORDS.findall(f.after.decode("utf-8", "replace"))[:1])]}


def _odds(present: list[set], labels: np.ndarray, least: int = 10, smooth: float = 4.0) -> dict[str, float]:
    """Log odds of words near secrets against words near the rest, smoothed; of words seen ``least`` times."""
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    seen = [Counter(w for p, y in zip(present, labels) if y == k for w in p) for k in (0, 1)]
    return {w: float(np.log((seen[1][w] + smooth) / (n[1] + 2 * smooth)) - np.log((seen[0][w] + smooth) / (n[0] + 2 * smooth))) for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= least}


def _transition_odds(values: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Log odds of character transitions in secrets against the rest, add-one smoothed."""
    counts = np.ones((2, 128, 128))
    for s, y in zip(values, labels):
        a = np.frombuffer(s, np.uint8) & 127
        np.add.at(counts[int(y)], (a[:-1], a[1:]), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    return p[1] - p[0]


def features(found: list[Finding], transitions: np.ndarray, words: dict[str, float], known: np.ndarray) -> np.ndarray:
    """One row of FEATURES each; what grows with a value's length is worked out on one buffer of all."""
    raw, off = _one_buffer([f.value for f in found])
    n, size = len(found), np.diff(off)
    row = np.repeat(np.arange(n), size)
    kind = _KIND[raw]
    share = lambda mask: np.bincount(row, mask, n) / size
    letters = np.maximum(np.bincount(row, kind >= 2, n), 1)
    inner = row[1:] == row[:-1]
    between = lambda x: np.bincount(row[1:][inner], x[inner], n) / np.maximum(size - 1, 1)
    counts = np.zeros((n, 256))
    np.add.at(counts, (row, raw), 1)
    p = counts / size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    # The longest run of one character.
    new = np.ones(len(raw), bool)
    new[1:] = (raw[1:] != raw[:-1]) | ~inner
    first = np.flatnonzero(new)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row[first], np.diff(np.append(first, len(raw))))
    low = transitions[(raw & 127)[:-1], (raw & 127)[1:]] if len(raw) > 1 else np.empty(0)
    hexa = share((kind == 1) | np.isin(raw, list(b"abcdefABCDEF"))) == 1
    own = []
    for f in found:
        odds = [words.get(w, 0.0) for w in _neighbours(f)] or [0.0]
        tail = f.before[-12:].rstrip(b" \t\"'`").lower()
        value, path = f.value[:256], f.path.lower()
        own.append((
            float(bool(_UUID.fullmatch(f.value))), float(value.startswith(tuple(x.encode() for x in PREFIXES))), float(tail.endswith((b"=", b":", b"=>", b"bearer", b"basic"))),
            float(f.before[-1:] in (b'"', b"'", b"`") and f.before[-1:] == f.after[:1]), max(odds), min(odds), sum(odds), float(bool(_PATHLIKE.search(value)) and not value.endswith(b"=")),
            float(f.before[-1:] == b"@") - float(f.after[:1] == b"@"), float(value.startswith(b"-----BEGIN")),
            float(any(w in path for w in ("test", "spec", "example", "sample", "mock", "fixture", "doc"))), float(any(w in path for w in ("env", "conf", "setting", "secret", "credential", ".yml", ".yaml", ".tf"))),
        ))
    own = np.array(own)
    return np.column_stack([
        np.log(size), entropy, share(kind == 1), share(kind == 2), share(kind == 3), share(_SYMBOL[raw]), between(kind[1:] != kind[:-1]), between(low), hexa, own[:, 0],
        coverage(raw, off, known), (counts > 0).sum(1) / size, own[:, 1], share(np.isin(raw, list(b"-_./"))), own[:, 2], own[:, 3], own[:, 4], own[:, 5], own[:, 6], own[:, 7], own[:, 8],
        longest / size, np.bincount(row, _VOWEL[raw], n) / letters, own[:, 9], own[:, 10], own[:, 11],
    ])


# Labelled findings


def labelled_lines(n: int = 8000, seed: int = 5) -> list[tuple[str, list[str], str]]:
    """Lines of the kinds that scanners meet: (line, the secrets in it, path of the file)."""
    rng = random.Random(seed)
    hexa, small, base62 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick, upto = rng.choice, rng.randrange
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    words = lambda k, sep=" ": sep.join(pick(DICTIONARY) for _ in range(k))
    made = lambda k: "".join(draw("bcdfghlmnprst", 1) + draw("aeiou", 1) + draw("lnrst ", 1).strip() for _ in range(k))
    title = lambda k, sep: sep.join(w.title() for w in words(k).split())
    digits = lambda k: draw("0123456789", k)
    prose = lambda: " ".join(made(upto(2, 5)) for _ in range(upto(2, 6)))
    uuid = lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12))
    coded = lambda k: draw(base62 + "+/", k)

    def password() -> str:
        marks = draw("!@#$%^&*?~", upto(1, 3))
        base = pick([lambda: draw(base62, upto(6, 14)), lambda: made(upto(2, 4)).title() + digits(upto(1, 4)), lambda: pick(DICTIONARY)[:3] + digits(1) + made(2) + digits(1), lambda: made(3)])()
        at = upto(1, len(base))
        return pick([base[:at] + marks + base[at:], base + marks, marks + base + digits(2), base[:at] + digits(2) + base[at:] + draw("ABCDEFGH", 1)])

    def key() -> str:
        return pick([
            lambda: draw(hexa, pick([32, 40, 40, 64])), lambda: draw(hexa, pick([32, 40, 64])).upper(), lambda: draw(base62, upto(18, 64)), lambda: draw(small, upto(18, 40)), lambda: draw(small + "0123456789", upto(16, 40)),
            lambda: coded(upto(22, 60)) + pick(["", "=", "=="]), lambda: pick(PREFIXES) + draw(base62, upto(16, 40)), lambda: "eyJ" + draw(base62, 20) + ".eyJ" + draw(base62, 40) + "." + draw(base62 + "-_", 30),
            lambda: draw(base62 + "-_", upto(20, 44)), lambda: draw(base62, upto(9, 16)),
        ])()

    def name() -> str:
        parts_ = pick([["api", "key"], ["access", "token"], ["secret"], ["client", "secret"], ["password"], ["db", "password"], ["auth", "token"], ["secret", "key"], ["private", "key"], ["token"], ["passwd"], ["pwd"], ["webhook", "secret"], ["signing", "key"], ["encryption", "key"], ["bearer"], ["credential"], ["session", "secret"], ["smtp", "pass"], ["access", "key"]])
        if rng.random() < 0.4:
            parts_ = [pick(DICTIONARY), *parts_]
        return pick([lambda: "_".join(parts_), lambda: "_".join(parts_).upper(), lambda: "-".join(parts_), lambda: parts_[0] + "".join(p.title() for p in parts_[1:]), lambda: ".".join(parts_)])()

    def shown(label: str, value: str) -> str:
        return pick([
            f'{label} = "{value}"', f'{label}="{value}"', f"{label}={value}", f"{label}: {value}", f"{label}: '{value}'", f'"{label}": "{value}",', f"export {label}={value}", f"  {label} => '{value}',", f'const {label} := "{value}"',
            f"curl https://{words(1)}.example/{words(1)}?{label}={value}&page={upto(1, 9)}", f"-D{label}={value}", f"{words(2)} {label}: {value}", f'self.{label} = "{value}"  # {words(2)}', f"{label} is {value}",
        ])

    def secret() -> tuple[str, list[str]]:
        value = pick([key, key, password])()
        lead = pick([words(3), prose(), prose() + ".", "", "x = 1\n", "# " + words(2) + "\n", prose() + pick([" ###", " ***", "!!!", " |"])])
        lead += " " if lead and lead[-1] != "\n" else ""
        line = pick([
            lambda: shown(name(), value), lambda: shown(name(), value), lambda: shown(name(), value),
            lambda: pick(["Authorization: Bearer ", "curl -H 'Authorization: Bearer ", "authorization: token "]) + value + pick(["", "'"]),
            lambda: f"{pick(['postgres', 'mysql', 'https', 'redis', 'amqp', 'mongodb+srv'])}://{pick(['admin', 'root', words(1), made(2)])}:{value.replace('/', 'x').replace('@', 'y')}@{words(1)}.{pick(['internal', 'example.com', 'local'])}:{upto(1000, 9999)}/{words(1)}",
            lambda: f"{pick(['the', 'my', 'our', 'temporary', 'root'])} {pick(['password', 'token', 'api key', 'passphrase'])} {pick(['is', 'was', '-', 'changed to'])} {value} {words(2)}",
            lambda: "-----BEGIN " + (k := pick(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY"])) + "-----\n" + "\n".join(coded(64) for _ in range(upto(1, 6))) + "\n" + coded(20) + "==\n-----END " + k + "-----",
            lambda: pick(PREFIXES[:5]) + draw(base62, upto(20, 36)),
        ])()
        if m := _USERINFO.search(line.encode()):
            value = m[1].decode()
        elif line.startswith("-----"):
            value = line
        elif line.startswith(PREFIXES[:5]):
            value = line
        return lead + line + pick(["", "\n", "\n" + words(2), " " + words(1)]), [value]

    def other() -> str:
        if rng.random() < 0.15:
            return prose() + pick([" ", ". ", ", "]) + pick([digits(upto(8, 20)), made(3) + "." + digits(2), made(2) + digits(upto(1, 4)), "-".join(digits(4) for _ in range(4)), made(upto(6, 9)), title(1, "") + made(6)]) + pick([" ", ".", ", "]) + prose()
        h = draw(hexa, pick([7, 12, 32, 40, 40, 64]))
        return pick([
            lambda: words(2) + pick([" commit ", " sha1: ", ' sha256 = "', " md5: ", " checksum ", ' digest: "', " revision ", ' etag: "', " tree ", ' hash = "', "@", " fixed in ", " parent "]) + h,
            lambda: '"integrity": "sha512-' + coded(86) + '=="', lambda: f"{words(1)}@sha256:{draw(hexa, 64)}", lambda: f"{words(1)}=={upto(1, 9)}.{upto(0, 30)} --hash=sha256:{draw(hexa, 64)}",
            lambda: words(2) + pick([' uuid = "', " id: ", " guid ", ' "request_id": "', " trace "]) + uuid() + pick(["", '"']),
            lambda: words(2) + f" mail{upto(1, 99)}.{words(1)}@{words(1)}.{pick(['com', 'org', 'example.com'])} " + words(1), lambda: f"contact {draw(hexa, 4)}@mail{upto(1, 99)}.{words(1)}.example.com now",
            lambda: f"https://{words(1)}.example.com/{words(1)}/{words(1)}{upto(1, 999)}/{words(2, '-')}.{pick(['html', 'png', 'js', 'php'])}?{pick(['page', 'id', 'lang', 'ref'])}={upto(1, 9999)}", lambda: f"see {'/'.join(words(1) for _ in range(4))}/{words(1)}{upto(1, 999)}.{pick(['py', 'java', 'go', 'c'])}:{upto(1, 99)}",
            lambda: shown(name(), pick([words(2, "_") + str(upto(1, 99)), "your_token_here", "YOUR-API-KEY-HERE", "xxxxxxxxxxxxxxxx", "x" * upto(6, 30), "changeme", "CHANGE_ME_123", "EXAMPLE_KEY_000", "${" + name().upper() + "}", "os.environ['" + words(1).upper() + "']", "<" + words(1) + ">", "********", "null", "None", "{{ " + words(1) + " }}", "process.env." + words(1).upper(), "getToken(" + words(1) + ")", "REDACTED_1", "test1234", "REPLACE_WITH_YOUR_KEY", "1234567890", "config." + words(2, "."), "string", "placeholder"])),
            lambda: shown(pick(["name", "title", "version", "color", "path", "class", "id", "lang", "author", "label", "width", "user", "host", "file", "key_name", "token_type", "encoding"]), pick([words(2, pick(["-", "_", ""])) + str(upto(1, 999)), made(4), title(3, ""), f"v{upto(1, 9)}.{upto(0, 99)}.{upto(0, 9)}-{words(1)}", "#" + draw(hexa, 6), f"{words(1)}/{words(1)}:{upto(1, 9)}.{upto(1, 9)}", digits(upto(6, 14)), uuid(), made(3) + "." + made(2), "utf-8", "application/json"])),
            lambda: f"{title(4, '')}{pick(['', '2'])}Handler({words(1)}{title(1, '')})", lambda: f"def {words(3, '_')}_{upto(1, 99)}(self, {words(1)}_{words(1)}):", lambda: words(2) + " " + pick(["number ", "order ", "isbn ", "+", "card ", "tel: "]) + digits(upto(10, 20)),
            lambda: " ".join(made(upto(2, 6)) for _ in range(6)).title() + pick([".", "!", "?"]), lambda: " ".join(made(upto(4, 8)) + pick(["", ".", ":", ","]) for _ in range(4)), lambda: f"{upto(2000, 2030)}-{upto(10, 13)}-{upto(10, 29)}T{upto(10, 24)}:{upto(10, 60)}:{upto(10, 60)}Z {words(2)} {words(1)}={upto(1, 9999)}",
            lambda: "<img src=\"data:image/png;base64," + coded(200) + '=="/>', lambda: f"{words(1)}-v{upto(1, 9)}.{upto(1, 99)}.{upto(1, 99)}-{words(2, '-')}.tar.gz", lambda: "-----BEGIN " + (k := pick(["CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST"])) + "-----\n" + "\n".join(coded(64) for _ in range(upto(1, 5))) + "\n-----END " + k + "-----",
            lambda: f"ssh-rsa AAAAB3NzaC1yc2E{coded(120)} {words(1)}@{words(1)}", lambda: f"{words(1).upper()}_{words(1).upper()}_{upto(1, 99)} = {upto(100, 999)}", lambda: f"wow!!! {made(3)}{digits(2)}!!! {pick(['100%', '50%', '#1', '@' + made(2) + digits(2), '$' + digits(4)])} {words(2)}", lambda: f"{words(1)}({words(1)}1&{words(1)}2?{words(1)}3)",
            lambda: f"the {pick(['token', 'password', 'secret', 'key'])} {pick(['was', 'is', 'of'])} {made(upto(3, 6))} {words(3)}", lambda: f"#{words(1)}{upto(1, 99)} @{made(3)}{upto(1, 999)} {words(2)}", lambda: f"{pick(['postgres', 'https', 'redis'])}://{words(1)}:{pick(['password', '${PASSWORD}', '<password>', 'xxxx', '****'])}@{words(1)}.example/{words(1)}",
        ])()

    path = lambda: pick(["", "", "", f"src/{words(1)}.py", f"config/{words(1)}.yml", ".env", f"docs/{words(1)}.md", f"tests/test_{words(1)}.py", "package-lock.json", f"{words(1)}/settings.json"])
    out = []
    for i in range(n):
        if i % 2:
            line, values = secret()
            out.append((line, values, path()))
        else:
            out.append((pick([words(3) + " ", prose() + " ", prose() + ". ", ""]) + other() + pick(["", "\n", " " + words(1)]), [], path()))
    return out


def findings_of(lines: list[tuple[str, list[str], str]], known: np.ndarray) -> list[tuple[Finding, int]]:
    """The candidates in labelled lines; those that hold most of a secret, or are most of one, have the label 1."""
    raw, off = buffer_of(pa.array([t for t, _, _ in lines], pa.large_string()))
    row, start, end = candidates(raw, off, known)
    out = []
    for r, s, e in zip(row, start, end):
        text, label = raw[off[r] : off[r + 1]].tobytes(), 0
        for value in lines[r][1]:
            at = text.find(value.encode()) + off[r]
            both = min(e, at + len(value)) - max(s, at)
            label |= both >= 0.75 * max(len(value), e - s)
        out.append((_finding(raw, off, r, s, e, lines[r][2]), int(label)))
    return out


def _finding(raw: np.ndarray, off: np.ndarray, r: int, s: int, e: int, path: str | None) -> Finding:
    return Finding(raw[s:e].tobytes(), raw[max(off[r], s - BEFORE) : s].tobytes(), raw[e : min(off[r + 1], e + AFTER)].tobytes(), path or "")


def labelled_findings(n: int = 8000, seed: int = 5, known: np.ndarray | None = None) -> list[tuple[Finding, int]]:
    return findings_of(labelled_lines(n, seed), _fixed() if known is None else known)


# The forest


@dataclass
class Forest:
    """Decision trees as arrays; a leaf's feature is -1."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                step = np.where(x[rows, f] <= self.split[at], self.left[at], self.right[at])
                at = np.where(inner, step, at)
            total += self.value[at]
        return total / len(self.roots)


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 48, depth: int = 12, leaf: int = 3, bins: int = 32, seed: int = 1) -> Forest:
    """Bagged trees; each split looks at a random third of the features, at quantile cuts, by Gini impurity."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    feature, split, left, right, value, roots = [], [], [], [], [], []

    def node(at: np.ndarray, level: int) -> int:
        here = len(feature)
        for column, v in ((feature, -1), (split, 0.0), (left, 0), (right, 0), (value, float(y[at].mean()))):
            column.append(v)
        if level == depth or len(at) < 2 * leaf or value[here] in (0.0, 1.0):
            return here
        best = (-1.0, -1, 0)
        for j in rng.permutation(d)[: max(1, d // 3)]:
            if not len(cuts[j]):
                continue
            b = binned[at, j]
            total, ones = np.bincount(b, minlength=len(cuts[j]) + 1).cumsum()[:-1], np.bincount(b, y[at], len(cuts[j]) + 1).cumsum()[:-1]
            rest, rest_ones = len(at) - total, y[at].sum() - ones
            fits = (total >= leaf) & (rest >= leaf)
            gain = np.where(fits, ones**2 / np.maximum(total, 1) + rest_ones**2 / np.maximum(rest, 1) + (total - ones) ** 2 / np.maximum(total, 1) + (rest - rest_ones) ** 2 / np.maximum(rest, 1), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), k)
        if best[1] < 0:
            return here
        _, j, k = best
        go = binned[at, j] <= k
        feature[here], split[here] = j, float(cuts[j][k])
        left[here] = node(at[go], level + 1)
        right[here] = node(at[~go], level + 1)
        return here

    for _ in range(trees):
        roots.append(node(rng.integers(n, size=n), 0))
    return Forest(np.array(feature), np.array(split), np.array(left), np.array(right), np.array(value), roots)


@dataclass
class Scanner:
    forest: Forest
    transitions: np.ndarray
    words: dict[str, float]
    known: np.ndarray = field(default_factory=_fixed)

    @classmethod
    def fit(cls, findings: list[tuple[Finding, int]], known: np.ndarray | None = None, **settings: int) -> "Scanner":
        known = _fixed() if known is None else known
        found, y = [f for f, _ in findings], np.array([label for _, label in findings], np.float64)
        transitions, words = _transition_odds([f.value for f in found], y), _odds([_neighbours(f) for f in found], y)
        return cls(grow_forest(features(found, transitions, words, known), y, **settings), transitions, words, known)

    def scores(self, found: list[Finding]) -> np.ndarray:
        out = [self.forest.predict(features(found[i : i + 4096], self.transitions, self.words, self.known)) for i in range(0, len(found), 4096)]
        return np.concatenate(out) if out else np.empty(0)

    def candidates(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of a batch; a text far beyond PART is gone through in windows that end at white space, each with what surrounds it."""
        if len(raw) <= 8 * PART:
            return candidates(raw, off, self.known)
        found = []
        for r, (low, high) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            at = low
            while at < high:
                cut = at + 4 * PART
                end = high if cut + PART >= high else _blank_from(raw, cut + PART, high)
                cut = high if end == high else cut
                first = max(low, at - PART)
                _, s, e = candidates(raw[first:end], np.array([0, end - first]), self.known)
                own = (s + first >= at) & (s + first < cut)
                found.append((np.full(own.sum(), r), s[own] + first, e[own] + first))
                at = cut
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def find(self, raw: np.ndarray, off: np.ndarray, paths: list[str | None] | None = None, threshold: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, first and end bytes, and scores of a batch's candidates; of those at the threshold that overlap only the best (then longest) stays."""
        row, start, end = self.candidates(raw, off)
        score = self.scores([_finding(raw, off, r, s, e, paths[r] if paths else "") for r, s, e in zip(row, start, end)])
        keep = np.ones(len(row), bool)
        hits = np.flatnonzero(score >= threshold)
        if len(hits):
            reach = np.maximum.accumulate(end[hits])
            groups = np.split(hits, np.flatnonzero(start[hits[1:]] >= reach[:-1]) + 1)  # spans that overlap in a chain
            for group in groups:
                chosen: list[int] = []
                for k in sorted(group, key=lambda k: (-score[k], start[k] - end[k], start[k])) if len(group) > 1 else ():
                    if all(end[k] <= start[c] or start[k] >= end[c] for c in chosen):
                        chosen.append(k)
                    else:
                        keep[k] = False
        return row[keep], start[keep], end[keep], score[keep]


def trained(labelled: DataFrame | None = None, most: int = 20_000, known: np.ndarray | None = None) -> Scanner:
    if labelled is None:
        return Scanner.fit(labelled_findings(known=known), known)
    path = F.col("path") if "path" in labelled.columns else F.lit("")
    rows = labelled.select("value", "before", "after", "label", path.cast("string").alias("path")).where("value <> '' and label is not null")
    rows = rows.orderBy(F.xxhash64("value", "before"), "value", "before", "after").limit(most).collect()
    return Scanner.fit([(Finding(r.value.encode(), (r.before or "").encode(), (r.after or "").encode(), r.path or ""), int(r.label)) for r in rows], known)


def scan(docs: DataFrame, scanner: Scanner | None = None, *, threshold: float = 0.5, path_col: str | None = None) -> DataFrame:
    """Rows (doc_id, start, length, score, is_secret, shown), one a candidate; start and length in code points, shown tells only its kinds of characters."""
    scanner = scanner or trained(known=dictionary(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, PART):
                raw, off = buffer_of(part.column("text"))
                row, start, end, score = scanner.find(raw, off, part.column("path").to_pylist(), threshold)
                if not len(row):
                    continue
                points = _upto((raw & 0xC0) != 0x80)
                shown = ["".join("*9Aa"[k] for k in _KIND[raw[s : min(e, s + 64)]]) for s, e in zip(start, end)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array((points[start] - points[off[row]]).astype(np.int64)), pa.array((points[end] - points[start]).astype(np.int64)), pa.array(score), pa.array(score >= threshold), pa.array(shown)],
                    ["doc_id", "start", "length", "score", "is_secret", "shown"],
                )

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path")).mapInArrow(run, "doc_id long, start long, length long, score double, is_secret boolean, shown string")


def _hidden(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, upto: int, mark: bytes) -> bytes:
    """A text's bytes with its (sorted, maybe overlapping) spans replaced."""
    pieces = []
    for s, e in zip(start.tolist(), end.tolist()):
        if s >= at:
            pieces += [raw[at:s].tobytes(), mark]
        at = max(at, e)
    return b"".join([*pieces, raw[at:upto].tobytes()])


def redact(docs: DataFrame, scanner: Scanner | None = None, *, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every secret in text replaced by ``mark``; an n_chars column is brought up to date where a text changes."""
    scanner = scanner or trained(known=dictionary(docs))
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    last = len(names)  # the text once more, under a name of its own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, PART, batch.schema.names[last]):
                raw, off = buffer_of(part.column(last))
                row, start, end, score = scanner.find(raw, off, threshold=threshold)
                hit = score >= threshold
                columns = list(part.columns[:last])
                if hit.any():
                    row, start, end = row[hit], start[hit], end[hit]
                    cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True])))
                    changed = {int(row[a]): _hidden(raw, start[a:b], end[a:b], int(off[row[a]]), int(off[row[a] + 1]), mark.encode()).decode() for a, b in zip(cuts[:-1], cuts[1:])}
                    texts = columns[text_at].to_pylist()
                    for r, t in changed.items():
                        texts[r] = t
                    columns[text_at] = pa.array(texts, columns[text_at].type)
                    if chars_at is not None:
                        columns[chars_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[chars_at].to_pylist())], columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:last])

    p = prefix_for(names)
    return map_arrow(bounded(docs).select(*cols(docs), F.col("text").alias(p + "text")), run, docs.schema)
