import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat_format
from spanloom.llm.chat_template import Const, Template, TemplateError, Text, escape, fold, parse, unescape

NASTY = st.lists(st.sampled_from(["\\", "#", "<", ":", ">", "/", "\n", " ", "a", "é", "😀", "turn", "### ", "</turn>", "assistant"]), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=6))
def test_round_trip(turns):
    text, spans = chat_format.compiled(chat_format.TURNS).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert list(chat_format.read_back(text)) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(NASTY)
def test_escape(text):
    assert unescape(escape(text, "#<")) == text


def test_folding():
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 2 %}x{% else %}c{% endif %}{# no #}")) == (Text("aBc"),)
    assert fold(parse("{% if true or name %}y{% endif %}")) == (Text("y"),)
    assert parse("{{ 3 }}")[1].expr == Const(3)


def test_language():
    t = Template("{% for m in ms %}{{ loop.index }}{% if loop.last %}!{% elif m.k in ('a' ~ 'b') %}?{% endif %}{%- set z = m.k -%} {{ z|default('none') }}{% endfor %}")
    assert t.render(ms=[{"k": "a"}, {"k": None}])[0] == "1?a2!none"
    assert Template("{{ a[1] }}{{ a[9] }}{{ missing }}").render(a=["x", "y"])[0] == "y"
    assert Template("{{ not a }} {{ 1 + 2 }} {{ x | default('d') }} {{ 'ab' | length }}").render(a=False)[0] == "true 3 d 2"


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a( }}", "{{ a.b() }}", "{{ a|evil }}", "{{ }}", "{% import os %}", "{{ 'x }}"])
def test_malformed(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_messages_are_a_list(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    template = "{{ messages | length }} {{ messages[0].role }}{% for m in messages %} {{ m.text }}{% endfor %}{% for m in messages %}.{% endfor %}"
    out = {r["conv_id"]: (r["n_turns"], r["formatted"]) for r in chat_format.format_conversations(df, template).collect()}
    assert out == {1: (3, "3 system s u a..."), 2: (1, "1 user only.")}
    assert {r["n_turns"] for r in chat_format.format_conversations(df, "no loop").collect()} == {1, 3}


def test_generation_inside_generation():
    text, spans = Template("{% generation %}ab{% generation %}cd{% endgeneration %}ef{% endgeneration %}").render()
    assert text == "abcdef" and spans == [(0, 6), (2, 4)]


def test_strings_hold_the_ends_of_tags():
    assert Template("""{{ '}}' }}{{ "%}" }}{% if a == '%}' %}y{% endif %}{{- ' -}}' -}} z""").render(a="%}")[0] == "}}%}y -}}z"


@pytest.mark.parametrize("source", ["{{ 1 + 'a' }}", "{{ 1 < 'a' }}", "{{ 3 | length }}", "{{ 'a' | escape(1) }}", "{{ 1 in 2 }}"])
def test_constants_that_do_not_fit(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ x | length }}", "{{ x + 'a' }}", "{% for y in x %}{% endfor %}", "{{ m[l] }}", "{{ x < 'a' }}", "{{ l }}"])
def test_values_that_do_not_fit(source):
    with pytest.raises(TemplateError):
        Template(source).render(x=3, m={"a": 1}, l=[1])


def test_sandbox():
    with pytest.raises(TemplateError):
        Template("{{ a.__class__ }}").render(a=object())
    assert Template("{{ a.__class__ }}").render(a={})[0] == ""


def test_awkward_rows(spark):
    rows = [
        (1, 0, "user", None, "c"), (1, 1, None, "x", "c"), (1, 1, "assistant", "same", "c"), (1, 1, "assistant", "same", "c"), (1, None, "system", "", "c"),
        (None, 0, "assistant", "#</turn>", "c"), (2, 0, "assistant", "long " * 200_000, "c"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert out[1]["n_turns"] == 5 and list(chat_format.read_back(out[1]["formatted"]))[0] == ("system", "")
    assert list(chat_format.read_back(out[1]["formatted"]))[2:] == [("", "x"), ("assistant", "same"), ("assistant", "same")][0:3]
    assert list(chat_format.read_back(out[None]["formatted"])) == [("assistant", "#</turn>")]
    assert out[2]["loss"][0]["end"] - out[2]["loss"][0]["start"] == 1_000_000
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_against_sql(spark, duck, sf):
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(duck.sql(chat_format.OP1_SQL).select(", ".join(cols)).fetchall())
    got = sorted(tuple(r) for r in chat_format.op1_chat_format(spark, sf).select(*cols).collect())
    assert got == want
    said = "\\### Assistant: </turn> ok"
    mine = next(r for r in got if r[0] == -7)
    assert mine[2] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert mine[3:5] == (len(said), hashlib.sha256(said.encode()).hexdigest())
