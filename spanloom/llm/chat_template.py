"""A sandboxed template language: parser, constant folding, and compilation to Python closures.

Text stands for itself. ``{{ expr }}`` prints, ``{# #}`` is a comment, and the statements are
``{% for x in e %}``, ``{% if e %}`` with elif and else, ``{% set x = e %}`` and ``{% generation %}``,
each but set with its end. A dash inside a tag strips the white space on that side. Expressions have
strings, integers, true, false, none, names, ``a.b`` and ``a[b]`` on mappings and lists, ``loop.first``,
``loop.last``, ``loop.index`` and ``loop.index0``, comparison, ``in``, and, or, not, ``+``, ``~`` and
filters. There are no calls and no attributes of Python objects, so a template reaches nothing but
the values it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

BEGIN, END = object(), object()
"""Marks in the output stream around generated text."""


class TemplateError(ValueError):
    """The template is malformed, or reaches for what the sandbox does not have."""


# ---------------------------------------------------------------- syntax tree


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
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any
    extra: tuple = ()


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Print:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def escape(text: str, chars: str) -> str:
    """A backslash before each backslash and each of ``chars``; :func:`unescape` undoes it."""
    for c in ("\\", *chars):
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "default": lambda v, other="": other if v is None else v,
    "escape": lambda v, chars="": escape(_text(v), chars),
}
_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b, "not": lambda a: not a,
}


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"can't print a {type(value).__name__}")


def _apply(f: Callable, *args: Any) -> Any:
    """A filter or an operator on values; what they can't be applied to is an error of the template."""
    try:
        return f(*args)
    except (TypeError, AttributeError, ValueError) as e:
        raise e if isinstance(e, TemplateError) else TemplateError(str(e)) from e


# ---------------------------------------------------------------- parser

_STRING = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
# Strings are read whole, so the end of a tag may stand inside one.
_TAG = re.compile(
    rf"\{{\{{(-?)((?:{_STRING}|(?!-?\}}\}}).)*)(-?)\}}\}}|\{{%(-?)((?:{_STRING}|(?!-?%\}}).)*)(-?)%\}}|\{{#.*?#\}}", re.DOTALL
)
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~|.\[\](),]))""", re.DOTALL)
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else value

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return True
        return False

    def need(self, kind: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a {kind} is missing")

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.joined()
        while self.peek() in ("==", "!=", "<", ">", "<=", ">=", "in"):
            op = self.peek()
            self.at += 1
            out = Op(op, (out, self.joined()))
        return out

    def joined(self) -> Any:
        out = self.filtered()
        while self.peek() in ("+", "~"):
            op = self.peek()
            self.at += 1
            out = Op(op, (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.item()
        while self.take("|"):
            name, extra = self.need("name"), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.take("("):
                while not self.take(")"):
                    extra.append(self.either())
                    self.take(",")
                    if self.at >= len(self.tokens):
                        raise TemplateError("a ) is missing")
            out = Filter(name, out, tuple(extra))
        return out

    def item(self) -> Any:
        out = self.atom()
        while True:
            if self.take("."):
                out = Item(out, Const(self.need("name")))
            elif self.take("["):
                out = Item(out, self.either())
                if not self.take("]"):
                    raise TemplateError("a ] is missing")
            else:
                return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "name":
            return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(value) or Name(value)
        raise TemplateError(f"unexpected {value!r}")


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content) with kind text, print or tag."""
    out, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] else text
        out.append(("text", text))
        if m[2] is not None:
            out.append(("print", m[2]))
        elif m[5] is not None:
            out.append(("tag", m[5].strip()))
        strip, at = bool(m[3] or m[6]), m.end()
    return [*out, ("text", source[at:].lstrip() if strip else source[at:])]


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = _pieces(source), 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        body = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                body.append(Text(content))
            elif kind == "print":
                body.append(Print(_Expression(content).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in ends:
                    return tuple(body), word, rest
                body.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), "", ""

    def condition(rest: str) -> If:
        test = _Expression(rest).whole()
        then, word, more = block("elif", "else", "endif")
        if word == "elif":
            return If(test, then, (condition(more),))
        return If(test, then, block("endif")[0] if word == "else" else ())

    def statement(word: str, rest: str) -> Any:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError("malformed for")
            over = _Expression(m[2]).whole()
            return For(m[1], over, block("endfor")[0])
        if word == "if":
            return condition(rest)
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError("malformed set")
            return Set(name.strip(), _Expression(value).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# ---------------------------------------------------------------- folding


def fold_expression(e: Any) -> Any:
    """The expression with its constant parts evaluated."""
    if isinstance(e, Item):
        e = Item(fold_expression(e.of), fold_expression(e.key))
    elif isinstance(e, Filter):
        e = Filter(e.name, fold_expression(e.arg), tuple(map(fold_expression, e.extra)))
        if all(isinstance(x, Const) for x in (e.arg, *e.extra)):
            return Const(_apply(FILTERS[e.name], e.arg.value, *[x.value for x in e.extra]))
    elif isinstance(e, Op):
        e = Op(e.op, tuple(map(fold_expression, e.args)))
        first = e.args[0]
        if e.op in ("and", "or") and isinstance(first, Const):
            return e.args[1] if bool(first.value) == (e.op == "and") else first
        if e.op not in ("and", "or") and all(isinstance(x, Const) for x in e.args):
            return Const(_apply(_OPS[e.op], *[x.value for x in e.args]))
    return e


def fold(body: tuple) -> tuple:
    """The tree with constants printed, decided branches taken, and neighbouring texts joined."""
    out: list = []
    for node in body:
        if isinstance(node, Print):
            e = fold_expression(node.expr)
            node = Text(_text(e.value)) if isinstance(e, Const) else Print(e)
        elif isinstance(node, For):
            node = For(node.name, fold_expression(node.over), fold(node.body))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body))
        elif isinstance(node, Set):
            node = Set(node.name, fold_expression(node.expr))
        elif isinstance(node, If):
            test = fold_expression(node.test)
            if isinstance(test, Const):
                for x in fold(node.then if test.value else node.other):
                    out.append(x)
                continue
            node = If(test, fold(node.then), fold(node.other))
        out.append(node)
    joined: list = []
    for node in out:
        if isinstance(node, Text) and joined and isinstance(joined[-1], Text):
            joined[-1] = Text(joined[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            joined.append(node)
    return tuple(joined)


# ---------------------------------------------------------------- closures


def _lookup(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    if of is None:
        return None
    raise TemplateError(f"a {type(of).__name__} has no items for the template")


def _expression(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name
        return lambda env: env.get(name)
    if isinstance(e, Item):
        of, key = _expression(e.of), _expression(e.key)
        return lambda env: _apply(_lookup, of(env), key(env))
    if isinstance(e, Filter):
        f, arg, extra = FILTERS[e.name], _expression(e.arg), [_expression(x) for x in e.extra]
        return lambda env: _apply(f, arg(env), *[x(env) for x in extra])
    args = [_expression(x) for x in e.args]
    if e.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.op == "or":
        return lambda env: args[0](env) or args[1](env)
    op = _OPS[e.op]
    return lambda env: _apply(op, *[a(env) for a in args])


def _with_loop(items: Any) -> Iterator[tuple[Any, dict]]:
    """Items with their loop variable."""
    if not isinstance(items, (list, tuple, str, Mapping)):
        raise TemplateError(f"a {type(items).__name__} is no list")
    for k, item in enumerate(items):
        yield item, {"first": k == 0, "last": k + 1 == len(items), "index": k + 1, "index0": k}


def _body(body: tuple) -> Callable[[dict], Iterator]:
    parts = [_node(n) for n in body]

    def run(env: dict) -> Iterator:
        for part in parts:
            yield from part(env)

    return run


def _node(node: Any) -> Callable[[dict], Iterator]:
    if isinstance(node, Text):
        value = (node.value,)
        return lambda env: value
    if isinstance(node, Print):
        e = _expression(node.expr)
        return lambda env: (_text(e(env)),)
    if isinstance(node, Set):
        e, name = _expression(node.expr), node.name

        def assign(env: dict) -> tuple:
            env[name] = e(env)
            return ()

        return assign
    if isinstance(node, If):
        test, then, other = _expression(node.test), _body(node.then), _body(node.other)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Generation):
        inner = _body(node.body)

        def marked(env: dict) -> Iterator:
            yield BEGIN
            yield from inner(env)
            yield END

        return marked
    over, inner, name = _expression(node.over), _body(node.body), node.name

    def loop(env: dict) -> Iterator:
        for item, state in _with_loop(over(env) or ()):
            yield from inner(env | {name: item, "loop": state})

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _body(self.tree)

    def stream(self, **values: Any) -> Iterator:
        """Strings and the marks BEGIN and END, in order."""
        return self._run(values)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the (start, end) code points of its generated parts in order; parts inside parts have their own."""
        out, spans, at, begun = [], [], 0, []
        for part in self.stream(**values):
            if part is BEGIN:
                begun.append(at)
            elif part is END:
                spans.append((begun.pop(), at))
            else:
                out.append(part)
                at += len(part)
        return "".join(out), sorted(spans)
