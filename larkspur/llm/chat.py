"""Formatting conversations with a compiled template, and reading them back.

Rows of a conversation are sorted by turn (ties by role, then text) and
rendered by :mod:`larkspur.llm.template`. The default template marks a turn as
``### role: text</turn>``; the filters ``escape`` and ``escape_role`` put a
backslash before whatever in a text could be taken for a marker, so formatted
texts read back to exactly what went in.

Output comes in parts of about ``part_chars`` characters, so neither rendering
nor reading back holds a conversation whole: a task streams through sorted
rows and keeps one turn's text, which it escapes piece by piece; reading back
looks for the next mark and feeds what is before it to the digests, in time
and memory that don't depend on what the text holds. (A conversation's digest
is sequential by nature; one conversation is read by one task.)

A null text or role counts as empty, null turns come first, and all rows of
null ids are one conversation. Repeated rows are turns of their own. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import bounded
from larkspur.llm.template import Slices, compile_template

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' ~ '\\n' }}{% endfor %}"
)
_RUN = re.compile(r"#{3,}")
_HASHES = re.compile("#+")
_END = "</turn>"


def _guarded(text: str) -> str:
    """A backslash before every backslash, every hash sign of a run of three or more, and every end mark."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if _END in text:
        text = text.replace(_END, "\\" + _END)
    return _RUN.sub(lambda m: "\\#" * len(m[0]), text) if "###" in text else text


#: Characters of a text that are escaped at once.
PIECE = 1 << 18


def escape(text: str | None) -> str | Slices:
    text = text or ""
    return _guarded(text) if len(text) <= PIECE else Slices(lambda: _escaped(text))


def _escaped(text: str) -> Iterator[str]:
    """A long text escaped piece by piece; no piece ends within a run of hash signs or an end mark."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and text[end - 1] == text[end] == "#":
            head = text[at:end].rstrip("#")
            run = _HASHES.match(text, at + len(head)).end()
            yield _guarded(head)
            first = at + len(head)
            for i in range(first, run, PIECE):  # the run itself, of any length
                part = text[i : min(i + PIECE, run)]
                yield part if run - first < 3 else part.replace("#", "\\#")
            at = run
            continue
        cut = text.rfind("<", max(at, end - len(_END)), end)  # maybe the start of a mark
        if cut > at and end < len(text):
            end = cut
        yield _guarded(text[at:end])
        at = end


def escape_role(text: str | None) -> str:
    return _guarded(text or "").replace(":", "\\:")


def unescape(text: str) -> str:
    """Each backslash goes, and what it guards stays; two of them are one."""
    return "\\".join(p.replace("\\", "") for p in text.split("\\\\")) if "\\" in text else text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        yield from zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


_SCHEMA = "conv_id long, part int, formatted string, mask array<struct<start:int,stop:int>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _short(pieces: Iterator[tuple[str, bool]], most: int) -> Iterator[tuple[str, bool]]:
    for piece, learn in pieces:
        if len(piece) <= most:
            yield piece, learn
        else:
            for i in range(0, len(piece), most):
                yield piece[i : i + most], learn


def _render(source: str, part_chars: int, rows_out: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(source, {"escape": escape, "escape_role": escape_role})
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            a, b, c, d = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, _MASK)], ["conv_id", "part", "formatted", "mask"])

        for conv, rows in _runs(_conversations(batches)):
            messages = ({"role": r or "", "text": t or ""} for _, r, t in rows)
            part, at, text, mask = 0, 0, [], []
            for piece, learn in _short(render({"messages": messages}), part_chars):
                if learn and piece:
                    if mask and mask[-1]["stop"] == at and text:
                        mask[-1]["stop"] = at + len(piece)
                    else:
                        mask.append({"start": at, "stop": at + len(piece)})
                text.append(piece)
                at += len(piece)
                if at >= part_chars:
                    held.append((conv, part, "".join(text), mask))
                    size += at
                    part, at, text, mask = part + 1, 0, [], []
                    if size >= 4 * part_chars:
                        yield flush()
                        held, size = [], 0
            if text or not part:
                held.append((conv, part, "".join(text), mask))
                size += at
            if len(held) >= rows_out or size >= 4 * part_chars:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def format_conversations(rows: DataFrame, template: str = TEMPLATE, *, part_chars: int = 1 << 20) -> DataFrame:
    """Rows (conv_id, part, formatted, mask): parts of a conversation follow each other in one partition.

    ``mask`` has the spans of ``formatted`` (in code points) that lie under generation markers.
    """
    compile_template(template, {"escape": escape, "escape_role": escape_role})  # errors show here
    sorted_rows = bounded(rows).selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(_render(template, part_chars), _SCHEMA)


def _guards(text: str, i: int, at: int) -> int:
    """How many backslashes stand on end before i, none before at."""
    size = 16
    while True:
        some = text[max(at, i - size) : i]
        n = len(some) - len(some.rstrip("\\"))
        if n < len(some) or len(some) == i - at:
            return n
        size *= 8


def _next(text: str, mark: str, at: int) -> int:
    """Where the next mark that no backslash guards begins, or -1."""
    while (i := text.find(mark, at)) >= 0:
        if _guards(text, i, at) % 2 == 0:
            return i
        at = i + 1
    return -1


def _open_end(text: str, mark: str, at: int) -> int:
    """How far text is surely before a mark: what may be a mark's start, and a guard without what it guards, stay."""
    end = len(text)
    for k in range(min(len(mark) - 1, end - at), 0, -1):
        if mark.startswith(text[end - k :]):
            end -= k
            break
    return end - _guards(text, end, at) % 2


def _events(parts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Formatted parts as events: ("role", role), ("text", piece) any number of times, ("end", "")."""
    rest, inside = "", False
    for part in parts:
        rest, at = rest + part, 0
        while True:
            if not inside:
                if len(rest) - at < 4 and "### ".startswith(rest[at:]):
                    break
                if not rest.startswith("### ", at):
                    raise ValueError(f"not a formatted conversation: {rest[at : at + 80]!r}")
                colon = _next(rest, ":", at + 4)
                if colon < 0 or colon + 2 > len(rest):
                    break
                yield "role", unescape(rest[at + 4 : colon])
                at, inside = colon + 2, True
            end = _next(rest, _END, at)
            if end < 0:
                upto = _open_end(rest, _END, at)
                yield "text", unescape(rest[at:upto])
                at = upto
                break
            yield "text", unescape(rest[at:end])
            if end + len(_END) + 1 > len(rest):  # the line's end is still to come
                at = end
                break
            yield "end", ""
            at, inside = end + len(_END) + 1, False
        rest = rest[at:]
    if rest or inside:
        raise ValueError(f"not a formatted conversation: {rest[:80]!r}")


def read_back(parts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of formatted parts, as they become complete."""
    role, text = "", []
    for kind, value in _events(parts):
        if kind == "role":
            role, text = value, []
        elif kind == "text":
            text.append(value)
        else:
            yield role, "".join(text)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")))

    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if n.endswith("sha256") else pa.int64()) for n, v in zip(names, zip(*out))], names)

    for conv, rows in _runs(parts()):
        turns, loss, n, chars, learned = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def texts() -> Iterator[str]:
            nonlocal chars, learned
            guard = ""  # a backslash whose character is in the next part
            for _, text, mask in rows:
                chars += len(text)
                for m in mask:
                    own = guard + text[m["start"] : m["stop"]]
                    guard = own[_open_end(own, "", 0) :]
                    own = unescape(own[: len(own) - len(guard)])
                    learned += len(own)
                    loss.update(own.encode())
                yield text

        for kind, value in _events(texts()):
            turns.update(f"{value}\n".encode() if kind == "role" else value.encode() if kind == "text" else b"\n")
            n += kind == "end"
        out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
        if len(out) >= 1000:
            yield flush()
            out = []
    if out:
        yield flush()


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations read back to: one row each, with digests of turns and of learned text."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
