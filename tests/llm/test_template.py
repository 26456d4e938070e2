"""The template compiler."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm.chat import escape, escape_role, read_back, unescape
from larkspur.llm.template import Slices, Text, TemplateError, compile_template, fold, parse


def render(source: str, **scope) -> str:
    return "".join(p for p, _ in compile_template(source)(scope))


def test_language():
    assert render("{% for m in ms %}{{ loop.index }}{{ m.a | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "1X, 2Y"
    assert render("{# no #}{% set n = 1 + 2 %}{{ n }}{{ 'a' ~ n }}{{ x | default('d') }}{{ none }}{{ true and 'z' in 'xyz' }}") == "3a3dtrue"
    assert render("{% if a == 1 %}one{% elif a > 1 %}more{% else %}less{% endif %}", a=0) == "less"
    assert render("{{ a['b'][0] }}{{ a.c }}{{ -2 - (1 - 4) }}", a={"b": ["q"]}) == "q1"
    pieces = list(compile_template("u{% generation %}{{ t }}{% endgeneration %}v")({"t": "x"}))
    assert pieces == [("u", False), ("x", True), ("v", False)]


def test_long_values_come_in_pieces():
    filters = {"long": lambda v: Slices(lambda: iter([v, v]))}
    assert list(compile_template("{% generation %}{{ t | long }}{% endgeneration %}", filters)({"t": "x"})) == [("x", True), ("x", True)]
    assert list(compile_template("{{ t | long | upper }}{{ (t | long) ~ 1 }}", filters)({"t": "x"})) == [("XX", False), ("xx1", False)]


def test_folding():
    body = fold(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}no{% else %}c{% endif %}{{ 'd' | upper }}"), {"upper": str.upper})
    assert len(body) == 1 and isinstance(body[0], Text) and body[0].text == "ab2cD"


@pytest.mark.parametrize("bad", ["{{ a.__class__ }}", "{{ __import__ }}", "{{ f(1) }}", "{% for x in y %}", "{{ a | nope }}", "{% endif %}", "{{ 1 + }}", "{% import os %}", "{{ a ; b }}"])
def test_sandbox(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_no_python_attributes():
    assert render("{{ a.upper }}{{ a.format }}", a="text") == ""


@given(st.text(), st.text())
def test_escapes_are_reversible(role, text):
    line = f"### {escape_role(role)}: {escape(text)}</turn>\n"
    assert list(read_back(iter([line]))) == list(read_back(iter(line))) == [(role, text)] and unescape(escape(text)) == text


@given(st.text(alphabet="#\\<>/turn: \n"), st.text(alphabet="#\\<>/turn: \n"))
def test_escapes_of_marks(role, text):
    test_escapes_are_reversible.hypothesis.inner_test(role, text)
