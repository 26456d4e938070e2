"""A small sandboxed template language, compiled to Python closures.

Text stands for itself. ``{{ expr }}`` prints, ``{# … #}`` is a comment, and
the statements are ``{% for x in expr %} … {% endfor %}``, ``{% if expr %}``
with ``elif`` and ``else``, ``{% set x = expr %}``, and
``{% generation %} … {% endgeneration %}``, which marks what a model is to
learn. Expressions have strings, integers, true, false, none, names, ``a.b``
and ``a[b]`` on mappings only, ``+ - ~ == != < <= > >= in and or not``,
parentheses, and filters ``x | name``. There are no calls, no methods and no
Python attributes, so a template reaches nothing but the values it is given.

Source -> tokens -> syntax tree -> folded tree -> closures. Rendering yields
(string, is_generation) pieces, so a long conversation is never held whole.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple = ()


@dataclass
class Text:
    text: str


@dataclass
class Print:
    expr: Any


@dataclass
class Set:
    name: str
    expr: Any


@dataclass
class For:
    name: str
    over: Any
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list  # of (condition, body)


@dataclass
class Generation:
    body: list = field(default_factory=list)


_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+~<>|.,()\[\]=])|([A-Za-z_]\w*))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_LEVELS = [("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-")]
_OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "-": operator.sub,
    "in": lambda a, b: a in b, "~": lambda a, b: _show(a) + _show(b),
}


def _show(v: Any) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) != isinstance(b, str):
        raise TemplateError("+ joins two strings or adds two numbers")
    return a + b


_OPS["+"] = _add
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _show(v).strip(), "upper": lambda v: _show(v).upper(), "lower": lambda v: _show(v).lower(), "title": lambda v: _show(v).title(),
    "string": _show, "length": lambda v: len(v), "default": lambda v, other: other if v is None else v,
}


class _Expr:
    """A precedence-climbing parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = next(i for i, g in enumerate(m.groups()) if g is not None)
            self.tokens.append((("int", "str", "op", "name")[kind], m.group(kind + 1)))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def expect(self, text: str) -> None:
        if self.next()[1] != text:
            raise TemplateError(f"expected {text!r}")

    def whole(self) -> Any:
        out = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def level(self, k: int) -> Any:
        if k == len(_LEVELS):
            return self.unary()
        if k == 2 and self.peek() == ("name", "not"):
            self.next()
            return Unary("not", self.level(2))
        left = self.level(k + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in _LEVELS[k]:
            op = self.next()[1]
            left = Binary(op, left, self.level(k + 1))
        return left

    def unary(self) -> Any:
        if self.peek() == ("op", "-"):
            self.next()
            return Unary("-", self.unary())
        return self.filtered(self.atom())

    def filtered(self, out: Any) -> Any:
        while self.peek()[1] in (".", "[", "|") and self.peek()[0] == "op":
            op = self.next()[1]
            if op == "[":
                out = Item(out, self.level(0))
                self.expect("]")
                continue
            kind, name = self.next()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"not a name: {name!r}")
            if op == ".":
                out = Item(out, Const(name))
            else:
                args = []
                if self.peek()[1] == "(":
                    self.next()
                    while self.peek()[1] != ")":
                        args.append(self.level(0))
                        if self.peek()[1] == ",":
                            self.next()
                    self.expect(")")
                out = Filter(name, out, tuple(args))
        return out

    def atom(self) -> Any:
        kind, text = self.next()
        if kind == "int":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            if text.startswith("_"):
                raise TemplateError(f"not a name: {text!r}")
            return Const(_WORDS[text]) if text in _WORDS else Name(text)
        if text == "(":
            out = self.level(0)
            self.expect(")")
            return out
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    for part in _PART.split(source):
        body = stack[-1][2]
        if part.startswith("{#") and part.endswith("#}"):
            continue
        if part.startswith("{{") and part.endswith("}}"):
            body.append(Print(_Expr(part[2:-2]).whole()))
        elif part.startswith("{%") and part.endswith("%}"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError("for x in expr")
                node = For(m[1], _Expr(m[2]).whole())
                body.append(node)
                stack.append(("for", node, node.body))
            elif word == "if":
                node = If([(_Expr(rest).whole(), [])])
                body.append(node)
                stack.append(("if", node, node.arms[0][1]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                node = stack.pop()[1]
                node.arms.append((_Expr(rest).whole() if word == "elif" else Const(True), []))
                stack.append(("if", node, node.arms[-1][1]))
            elif word == "generation":
                node = Generation()
                body.append(node)
                stack.append(("generation", node, node.body))
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError("set x = expr")
                body.append(Set(m[1], _Expr(m[2]).whole()))
            elif word.startswith("end") and word[3:] == stack[-1][0] != "":
                stack.pop()
            else:
                raise TemplateError(f"unexpected statement {word!r}")
        elif part:
            body.append(Text(part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return root


def fold_expr(e: Any, filters: dict[str, Callable]) -> Any:
    """The expression with every part that depends on nothing worked out."""
    if isinstance(e, Item):
        return Item(fold_expr(e.of, filters), fold_expr(e.key, filters))
    if isinstance(e, Unary):
        of = fold_expr(e.of, filters)
        e = Unary(e.op, of)
        return Const(expression(e, filters)({})) if isinstance(of, Const) else e
    if isinstance(e, Binary):
        left, right = fold_expr(e.left, filters), fold_expr(e.right, filters)
        if isinstance(left, Const) and (isinstance(right, Const) or e.op == "and" and not left.value or e.op == "or" and left.value):
            return Const(expression(Binary(e.op, left, right), filters)({}))
        return Binary(e.op, left, right)
    if isinstance(e, Filter):
        of, args = fold_expr(e.of, filters), tuple(fold_expr(a, filters) for a in e.args)
        if e.name not in filters:
            raise TemplateError(f"no filter {e.name!r}")
        e = Filter(e.name, of, args)
        return Const(expression(e, filters)({})) if all(isinstance(a, Const) for a in (of, *args)) else e
    return e


def fold(body: list, filters: dict[str, Callable]) -> list:
    """The tree with constants folded, dead branches gone and neighbouring texts joined."""
    out: list = []
    for node in body:
        new: list = [node]
        if isinstance(node, Print):
            e = fold_expr(node.expr, filters)
            new = [Text(_show(e.value))] if isinstance(e, Const) else [Print(e)]
        elif isinstance(node, Set):
            new = [Set(node.name, fold_expr(node.expr, filters))]
        elif isinstance(node, For):
            new = [For(node.name, fold_expr(node.over, filters), fold(node.body, filters))]
        elif isinstance(node, Generation):
            new = [Generation(fold(node.body, filters))]
        elif isinstance(node, If):
            arms = []
            for condition, arm in node.arms:
                condition = fold_expr(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, fold(arm, filters)))
                if isinstance(condition, Const):
                    break
            new = arms[0][1] if arms and isinstance(arms[0][0], Const) else [If(arms)] if arms else []
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return out


class Slices:
    """A long text that a filter gives piece by piece."""

    def __init__(self, pieces: Callable[[], Iterator[str]]):
        self.pieces = pieces

    def __iter__(self) -> Iterator[str]:
        return self.pieces()

    def __str__(self) -> str:
        return "".join(self)


Scope = dict[str, Any]


def expression(e: Any, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    """A closure that evaluates an expression."""
    if isinstance(e, Const):
        value = e.value
        return lambda scope: value
    if isinstance(e, Name):
        name = e.name
        return lambda scope: scope.get(name)
    if isinstance(e, Item):
        of, key = expression(e.of, filters), expression(e.key, filters)

        def item(scope: Scope) -> Any:
            v, k = of(scope), key(scope)
            if isinstance(v, dict):
                return v.get(k)
            if isinstance(v, list | str) and isinstance(k, int):
                return v[k] if -len(v) <= k < len(v) else None
            return None

        return item
    if isinstance(e, Unary):
        of = expression(e.of, filters)
        return (lambda scope: not of(scope)) if e.op == "not" else (lambda scope: -of(scope))
    if isinstance(e, Filter):
        raw = _filtered(e, filters)

        def filtered(scope: Scope) -> Any:
            v = raw(scope)
            return str(v) if isinstance(v, Slices) else v

        return filtered
    left, right = expression(e.left, filters), expression(e.right, filters)
    if e.op == "and":
        return lambda scope: left(scope) and right(scope)
    if e.op == "or":
        return lambda scope: left(scope) or right(scope)
    op = _OPS[e.op]
    return lambda scope: op(left(scope), right(scope))


def _filtered(e: Filter, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    of, args, fn = expression(e.of, filters), [expression(a, filters) for a in e.args], filters[e.name]
    return (lambda scope: fn(of(scope), *(a(scope) for a in args))) if args else (lambda scope: fn(of(scope)))


Pieces = Iterator[tuple[str, bool]]
Renderer = Callable[[Scope, bool], Pieces]


def _block(body: list, filters: dict[str, Callable]) -> Renderer:
    steps = [_statement(x, filters) for x in body]
    if len(steps) == 1:
        return steps[0]

    def run(scope: Scope, learn: bool) -> Pieces:
        for step in steps:
            yield from step(scope, learn)

    return run


def _statement(node: Any, filters: dict[str, Callable]) -> Renderer:
    if isinstance(node, Text):
        text = node.text

        def write(scope: Scope, learn: bool) -> Pieces:
            yield text, learn

        return write
    if isinstance(node, Print):
        value = _filtered(node.expr, filters) if isinstance(node.expr, Filter) else expression(node.expr, filters)

        def show(scope: Scope, learn: bool) -> Pieces:
            v = value(scope)
            if isinstance(v, Slices):
                for piece in v:
                    yield piece, learn
            else:
                yield _show(v), learn

        return show
    if isinstance(node, Set):
        name, value = node.name, expression(node.expr, filters)

        def assign(scope: Scope, learn: bool) -> Pieces:
            scope[name] = value(scope)
            yield from ()

        return assign
    if isinstance(node, Generation):
        inner = _block(node.body, filters)
        return lambda scope, learn: inner(scope, True)
    if isinstance(node, If):
        arms = [(expression(c, filters), _block(b, filters)) for c, b in node.arms]

        def choose(scope: Scope, learn: bool) -> Pieces:
            for condition, body in arms:
                if condition(scope):
                    yield from body(scope, learn)
                    return

        return choose
    name, over, body = node.name, expression(node.over, filters), _block(node.body, filters)

    def loop(scope: Scope, learn: bool) -> Pieces:
        items = iter(over(scope) or ())
        missing = object()
        now, i, outer = next(items, missing), 0, (scope.get(name), scope.get("loop"))
        while now is not missing:
            after = next(items, missing)
            scope[name] = now
            scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is missing}
            yield from body(scope, learn)
            now, i = after, i + 1
        scope[name], scope["loop"] = outer

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[Scope], Pieces]:
    """A renderer of the template: scope -> pieces (string, under a generation marker)."""
    known = {**FILTERS, **(filters or {})}
    run = _block(fold(parse(source), known), known)
    return lambda scope: run(dict(scope), False)
