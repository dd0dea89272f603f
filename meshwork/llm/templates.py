"""A small sandboxed template language, compiled to Python closures.

    {{ expr }}                         output
    {% for x in expr %} ... {% endfor %}
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% set name = expr %}
    {% generation %} ... {% endgeneration %}   output under the loss mask
    {# comment #}, and - inside a tag's edge to strip white space

Expressions: literals, names, ``a.b`` and ``a[b]`` (mappings and lists only: no attribute of a Python
object can be reached), ``or and not == != < <= > >= in + - * // % ~``, ``x if c else y``, and filters
from a fixed table. Text becomes a syntax tree, constants are folded, and each node becomes one
closure. Rendering yields (string, under mask) pieces lazily, so a conversation's messages can be a
stream of any length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import pairwise


class TemplateError(ValueError):
    """The template is not of this language, or reaches for what it may not."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    op: str
    x: object


@dataclass(frozen=True)
class Binary:
    op: str
    a: object
    b: object


@dataclass(frozen=True)
class Choice:
    cond: object
    a: object
    b: object


@dataclass(frozen=True)
class Filter:
    name: str
    x: object
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    x: object


@dataclass(frozen=True)
class For:
    var: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    cond: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    x: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*%~<>()\[\].,|]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}

FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "default": lambda x, d="": d if x is None else x,
    "string": str,
}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b,
    "~": lambda a, b: _show(a) + _show(b),
    "in": lambda a, b: a in b,
}


def _show(x: object) -> str:
    return "" if x is None else str(x)


class _Expression:
    """Recursive descent over one expression."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, text: str):
        self.toks, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.toks[self.at] if self.at < len(self.toks) else (None, None)
        return None if kind == "str" else value

    def take(self, want: str | None = None):
        if self.at >= len(self.toks) or want is not None and self.peek() != want:
            raise TemplateError(f"expected {want or 'more'}")
        self.at += 1
        return self.toks[self.at - 1]

    def whole(self):
        x = self.choice()
        if self.at != len(self.toks):
            raise TemplateError(f"left over: {self.toks[self.at:]}")
        return x

    def choice(self):
        x = self.level(0)
        if self.peek() == "if":
            self.take()
            c = self.level(0)
            self.take("else")
            x = Choice(c, x, self.choice())
        return x

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.postfix()
        ops = self.LEVELS[k]
        if ops == ("not",):
            if self.peek() == "not":
                self.take()
                return Unary("not", self.level(k))
            return self.level(k + 1)
        x = self.level(k + 1)
        while self.peek() in ops:
            x = Binary(self.take()[1], x, self.level(k + 1))
        return x

    def postfix(self):
        x = self.primary()
        while self.peek() in (".", "[", "|"):
            op = self.take()[1]
            if op == ".":
                x = Item(x, Const(self.take()[1]))
            elif op == "[":
                x = Item(x, self.choice())
                self.take("]")
            else:
                name, args = self.take()[1], []
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        args.append(self.choice())
                        if self.peek() == ",":
                            self.take()
                    self.take(")")
                x = Filter(name, x, tuple(args))
        return x

    def primary(self):
        kind, v = self.take()
        if kind == "num":
            return Const(int(v))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1], flags=re.DOTALL))
        if kind == "name":
            return Const(_WORDS[v]) if v in _WORDS else Name(v)
        if v == "(":
            x = self.choice()
            self.take(")")
            return x
        if v == "-":
            return Unary("-", self.postfix())
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    marks = [(m.start(), m.end(), m) for m in _TAG.finditer(source)]
    edges = [(0, 0, None), *marks, (len(source), len(source), None)]
    for (_, end, before), (start, _, after) in pairwise(edges):
        text = source[end:start]
        if before and re.search(r"-[}%]\}$", before[0]):
            text = text.lstrip()
        if after and re.match(r"\{[{%]-", after[0]):
            text = text.rstrip()
        if text:
            stack[-1][2].append(Text(text))
        if after is None or after[0].startswith("{#"):
            continue
        if after["out"] is not None:
            stack[-1][2].append(Output(_Expression(after["out"]).whole()))
            continue
        word, _, rest = after["tag"].strip().partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"for {rest}")
            stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
        elif word in ("if", "generation"):
            stack.append((word, _Expression(rest).whole() if word == "if" else None, []))
        elif word in ("elif", "else") and stack[-1][0] in ("if", "elif"):
            stack.append(("elif" if word == "elif" else "else", _Expression(rest).whole() if word == "elif" else None, []))
        elif word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.*)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"set {rest}")
            stack[-1][2].append(Assign(m[1], _Expression(m[2]).whole()))
        elif word == "endif":
            other: tuple = ()
            while stack[-1][0] in ("else", "elif"):
                kind, cond, body = stack.pop()
                other = tuple(body) if kind == "else" else (If(cond, tuple(body), other),)
            kind, cond, body = stack.pop()
            if kind != "if":
                raise TemplateError("endif without if")
            stack[-1][2].append(If(cond, tuple(body), other))
        elif word in ("endfor", "endgeneration") and stack[-1][0] == word[3:]:
            kind, head, body = stack.pop()
            stack[-1][2].append(For(*head, tuple(body)) if kind == "for" else Generation(tuple(body)))
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(root)


def fold(node, filters: Mapping[str, Callable] = FILTERS):
    """The tree with constant parts computed, dead branches gone and neighbouring texts joined."""
    go = lambda x: fold(x, filters)
    match node:
        case tuple():
            out: list = []
            for x in node:
                y = go(x)
                for z in y if isinstance(y, tuple) else (y,):
                    if isinstance(z, Text) and out and isinstance(out[-1], Text):
                        out[-1] = Text(out[-1].value + z.value)
                    else:
                        out.append(z)
            return tuple(out)
        case Unary(op, x):
            x = go(x)
            return Const(not x.value if op == "not" else -x.value) if isinstance(x, Const) else Unary(op, x)
        case Binary(op, a, b):
            a, b = go(a), go(b)
            if op in ("and", "or") and isinstance(a, Const):
                return b if bool(a.value) == (op == "and") else a
            if op in _BINARY and isinstance(a, Const) and isinstance(b, Const):
                return Const(_BINARY[op](a.value, b.value))
            return Binary(op, a, b)
        case Choice(c, a, b):
            c = go(c)
            return (go(a) if c.value else go(b)) if isinstance(c, Const) else Choice(c, go(a), go(b))
        case Filter(name, x, args):
            if name not in filters:
                raise TemplateError(f"no filter {name!r}")
            x, args = go(x), go(args)
            if all(isinstance(y, Const) for y in (x, *args)):
                return Const(filters[name](x.value, *(y.value for y in args)))
            return Filter(name, x, args)
        case Item(of, key):
            return Item(go(of), go(key))
        case Output(x):
            x = go(x)
            return Text(_show(x.value)) if isinstance(x, Const) else Output(x)
        case If(c, body, other):
            c = go(c)
            return (go(body) if c.value else go(other)) if isinstance(c, Const) else If(c, go(body), go(other))
        case For(var, over, body):
            return For(var, go(over), go(body))
        case Assign(name, x):
            return Assign(name, go(x))
        case Generation(body):
            return Generation(go(body))
    return node


def _lookup(of, key):
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, list | tuple | str) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"no item {key!r}")


def _value(node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    match node:
        case Const(v):
            return lambda env: v
        case Name(n):
            return lambda env: env.get(n)
        case Item(of, key):
            f, k = _value(of, filters), _value(key, filters)
            return lambda env: _lookup(f(env), k(env))
        case Unary("not", x):
            f = _value(x, filters)
            return lambda env: not f(env)
        case Unary(_, x):
            f = _value(x, filters)
            return lambda env: -f(env)
        case Binary("and", a, b):
            f, g = _value(a, filters), _value(b, filters)
            return lambda env: f(env) and g(env)
        case Binary("or", a, b):
            f, g = _value(a, filters), _value(b, filters)
            return lambda env: f(env) or g(env)
        case Binary(op, a, b):
            f, g, h = _value(a, filters), _value(b, filters), _BINARY[op]
            return lambda env: h(f(env), g(env))
        case Choice(c, a, b):
            q, f, g = _value(c, filters), _value(a, filters), _value(b, filters)
            return lambda env: f(env) if q(env) else g(env)
        case Filter(name, x, args):
            f, gs, h = _value(x, filters), [_value(y, filters) for y in args], filters[name]
            return lambda env: h(f(env), *(g(env) for g in gs))
    raise TemplateError(f"not an expression: {node!r}")


Pieces = Iterator[tuple[str, bool]]


def _block(body: tuple, filters: Mapping[str, Callable], masked: bool) -> Callable[[dict], Pieces]:
    parts = [_statement(x, filters, masked) for x in body]

    def run(env: dict) -> Pieces:
        for p in parts:
            yield from p(env)

    return run


def _statement(node, filters: Mapping[str, Callable], masked: bool) -> Callable[[dict], Pieces]:
    match node:
        case Text(v):
            return lambda env: iter(((v, masked),))
        case Output(x):
            f = _value(x, filters)
            return lambda env: iter(((_show(f(env)), masked),))
        case Assign(name, x):
            f = _value(x, filters)

            def assign(env: dict) -> Pieces:
                env[name] = f(env)
                return iter(())

            return assign
        case If(c, a, b):
            q, f, g = _value(c, filters), _block(a, filters, masked), _block(b, filters, masked)
            return lambda env: f(env) if q(env) else g(env)
        case For(var, over, inner):
            f, g = _value(over, filters), _block(inner, filters, masked)

            def loop(env: dict) -> Pieces:
                for k, x in enumerate(f(env) or ()):
                    yield from g({**env, var: x, "loop": {"index0": k, "index": k + 1, "first": k == 0}})

            return loop
        case Generation(inner):
            return _block(inner, filters, True)
    raise TemplateError(f"not a statement: {node!r}")


@dataclass
class Template:
    """A compiled template; ``filters`` adds to the fixed table."""

    source: str
    filters: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        table = {**FILTERS, **self.filters}
        self.tree = fold(parse(self.source), table)
        self._run = _block(self.tree, table, False)

    def pieces(self, **variables) -> Pieces:
        """Rendered strings in order, each with whether it is under the loss mask."""
        return self._run(dict(variables))

    def render(self, **variables) -> tuple[str, list[tuple[int, int]]]:
        """The whole string, and the spans (code points, end exclusive) under the loss mask."""
        out, spans, at = [], [], 0
        for s, masked in self.pieces(**variables):
            if masked and s:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(s))
                else:
                    spans.append((at, at + len(s)))
            out.append(s)
            at += len(s)
        return "".join(out), spans
