"""Token ids of whole batches of texts under a byte-level BPE vocabulary.

A text may be cut before any blank that stands before a visible character:
the splitting pattern of byte-level BPE always starts a piece there. So texts
are cut with numpy, only segments not met before are encoded (joined into one
string and cut again by the tokens' byte lengths), and ids are gathered from a
bounded cache. The ids are those of the ``tokenizers`` file: where it declares
a plain byte-level BPE (:func:`_plain`), a faster encoder is built from its
merges; any other file is used as it is, text by text.

The strings of special tokens in a text become those tokens, as
``encode(text, add_special_tokens=False)`` has it; with ``specials=False`` they
are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from larkspur.llm.textkernel import mix64, slices

U64 = np.uint64
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0xA0761D6478BD642F
_SLICE = 1 << 20
#: First bytes after which a blank surely starts a piece: visible ASCII, and the lead of U+00C0 to U+00FF.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3] = True
#: The byte-level alphabet maps each byte to a printable character.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The splitting pattern of this kind of vocabulary.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _alphabet() -> dict[str, int]:
    out, extra = {chr(b): b for b in _PRINTABLE}, 0
    for b in range(256):
        if b not in _PRINTABLE:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def _plain(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE without further rules, its merges in the order of their tokens' ids."""
    model, vocab = spec["model"], spec["model"].get("vocab", {})
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    rules = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in rules) or any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        return False
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    return all(a < b for a, b in zip(merged, merged[1:])) and len(set(vocab.values()) - set(merged) - {t["id"] for t in spec.get("added_tokens", [])}) == 256


@lru_cache(4)
def load(path: str, specials: bool = True) -> "Encoder":
    return Encoder(path, specials)


class Encoder:
    """Batch encoding with a cache of at most ``most`` segments."""

    def __init__(self, path: str, specials: bool = True, most: int = 600_000):
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        exact.encode_special_tokens = not specials
        spec = json.load(open(path, encoding="utf-8"))
        added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", []) if t["content"] and (specials or not t.get("special"))}
        self.added = added
        # The longest of those that start at the first place where one does.
        self._marks = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.plain = _plain(spec)
        self._exact = lambda s: exact.encode(s, add_special_tokens=False).ids
        ranks: dict[bytes, int] = {}
        if self.plain:
            letters, special = _alphabet(), {t["id"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
            self._encode = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = exact.get_vocab_size()
        self._bytes = np.zeros(self.size + 1, np.int64)
        for token, i in ranks.items():
            self._bytes[i] = len(token)
        self.most = most
        n = _SLICE + 1
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self._reset()

    def _reset(self) -> None:
        """Two sorted runs of keys, a large and a recent one, with where their ids start and how many they are."""
        none = (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))
        self._runs = [none, none]
        self._ids, self._used = np.empty(1 << 16, np.uint32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are known, where their ids start, and how many there are."""
        known, at, length = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for run, starts, lengths in self._runs:
            if len(run):
                i = np.minimum(np.searchsorted(run, keys), len(run) - 1)
                hit = run[i] == keys
                known |= hit
                at = np.where(hit, starts[i], at)
                length = np.where(hit, lengths[i], length)
        return known, at, length

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New keys with their ids; the recent run joins the large one once it is a quarter of it."""
        need = self._used + len(ids)
        if need > len(self._ids):
            grown = np.empty(max(need, 2 * len(self._ids)), np.uint32)
            grown[: self._used] = self._ids[: self._used]
            self._ids = grown
        self._ids[self._used : need] = ids
        fresh = (keys, (self._used + np.cumsum(lengths) - lengths).astype(np.int32), lengths.astype(np.int32))
        self._used = need
        self._runs[1] = self._joined(self._runs[1], fresh)
        if 4 * len(self._runs[1][0]) > len(self._runs[0][0]):
            self._runs = [self._joined(*self._runs), tuple(x[:0] for x in fresh)]

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate((a[0], b[0]))
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate((a[1], b[1]))[order], np.concatenate((a[2], b[2]))[order]

    def _learn(self, keys: np.ndarray, segments: list[bytes]) -> None:
        """Add segments (each starts with a blank and a visible character) to the cache."""
        ids, lengths = [], []
        for i in range(0, len(segments), 20_000):
            some = segments[i : i + 20_000]
            got = np.array(self._encode(b"".join(some).decode("utf-8", "replace")), np.uint32)
            ends = np.cumsum(self._bytes[got])
            cut = np.searchsorted(ends, np.cumsum([len(s) for s in some]), side="right")
            ids.append(got)
            lengths.append(np.diff(np.concatenate(([0], cut))))
        self._add(keys, np.concatenate(ids), np.concatenate(lengths))

    def _slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        first = off[:-1][np.diff(off) > 0]
        cut = np.zeros(n, bool)
        cut[:-1] = (raw[:-1] == 32) & _VISIBLE[raw[1:]]
        cut[off[1:][off[1:] > 0] - 1] = False  # a blank at a text's end has nothing after it
        plain = cut.copy()
        cut[first] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        ends = np.append(starts[1:], n)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[raw] * self._up[:n], out=total[1:])
            key = (total[ends] - total[starts]) * self._down[starts]
            # What isn't led by a cut blank is kept apart from what is.
            key = mix64(key ^ ((ends - starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15)) ^ np.where(plain[starts], U64(0), U64(0xDEADBEEF12345678)))
        uniq, where, back = np.unique(key, return_index=True, return_inverse=True)
        if sum(len(r[0]) for r in self._runs) + len(uniq) > self.most:
            self._reset()
        known, at, length = self._find(uniq)
        if not known.all():
            new = ~known
            w = where[new]
            data = raw.tobytes()
            led = plain[starts[w]]
            if led.any():
                self._learn(uniq[new][led], [data[starts[i] : ends[i]] for i in w[led]])
            if not led.all():
                got = [np.array(self._encode(data[starts[i] : ends[i]].decode("utf-8", "replace")), np.uint32) for i in w[~led]]
                self._add(uniq[new][~led], np.concatenate(got), np.array([len(g) for g in got]))
            _, at, length = self._find(uniq)
        at, length = at[back], length[back]
        ends_at = np.cumsum(length)
        ids = self._ids[np.arange(ends_at[-1]) + np.repeat(at - (ends_at - length), length)]
        before = np.concatenate(([0], ends_at))[np.searchsorted(starts, off)]
        return ids, np.diff(before)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each row has."""
        if not self.plain:
            got = [np.array(self._exact(raw[i:j].tobytes().decode("utf-8", "replace")), np.uint32) for i, j in zip(off[:-1], off[1:])]
            return (np.concatenate(got) if got else np.empty(0, np.uint32)), np.array([len(g) for g in got], np.int64)
        marked = self._marked(raw, off)
        if marked is None:
            return self._rows(raw, off)
        # Rows fall into the texts between special tokens, which are encoded alone, and those tokens.
        cuts, row, special = marked
        ids, counts = self._rows(raw, cuts)
        keep = np.repeat(special < 0, counts)
        kept = np.where(special < 0, counts, 0)
        at = np.flatnonzero(special >= 0)
        ids = np.insert(ids[keep], np.cumsum(kept)[at], special[at].astype(np.uint32))
        return ids, np.bincount(row, np.where(special < 0, counts, 1), len(off) - 1).astype(np.int64)

    def _marked(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows cut at special tokens: the cuts, each part's row, and its special token or -1."""
        if self._marks is None or not len(raw):
            return None
        data = raw.data
        if not self._marks.search(data):
            return None
        cuts, row, special = [0], [], []
        for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            at = lo
            for m in self._marks.finditer(data[lo:hi]) if hi > lo else ():
                for end, kind in ((lo + m.start(), -1), (lo + m.end(), self.added[m[0]])):
                    if end > at:
                        cuts.append(end)
                        row.append(i)
                        special.append(kind)
                        at = end
            if hi > at:
                cuts.append(hi)
                row.append(i)
                special.append(-1)
        return np.array(cuts, np.int64), np.array(row, np.int64), np.array(special, np.int64)

    def _rows(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for i, j in slices(raw, off, _SLICE // 2):
            if off[j] - off[i] > _SLICE:  # one very long text
                got = self._long(raw[off[i] : off[j]])
                ids.append(got)
                counts.append(np.array([len(got)]))
            else:
                got, count = self._slice(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                ids.append(got)
                counts.append(count)
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), (np.concatenate(counts) if counts else np.empty(0, np.int64))

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """A text beyond a slice: parts between cut blanks; without such blanks it is encoded whole."""
        marks = np.flatnonzero((raw[:-1] == 32) & _VISIBLE[raw[1:]])
        out, at, n = [], 0, len(raw)
        while at < n:
            end = n
            if n - at > _SLICE // 2:
                k = np.searchsorted(marks, at + _SLICE // 2)
                end = int(marks[k]) if k < len(marks) else n
            part = raw[at:end]
            if len(part) > _SLICE:
                out.append(np.array(self._encode(part.tobytes().decode("utf-8", "replace")), np.uint32))
            else:
                out.append(self._slice(part, np.array([0, len(part)]))[0])
            at = end
        return np.concatenate(out)
