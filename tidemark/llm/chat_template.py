"""A sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}   {% if %} {% elif %} {% else %} {% endif %}   {% set name = expression %}
    {% for m in messages %} ... {% endfor %}   {% generation %} ... {% endgeneration %}   {# comment #}

A minus sign inside a mark (`{%-`, `-%}`) drops the white space beside it. Expressions have strings,
whole numbers, true, false, none, names, `m.role` and `m['role']`, `loop.first`, `loop.last`,
`loop.index`, `loop.index0`, `loop.length`, comparisons, `in`, `not`, `and`, `or`, `a if c else b`,
`+`, `-`, `~` (joins texts) and filters. There are no calls and no attributes of Python objects, a
loop runs over messages only and once, and nothing multiplies: output is linear in its input.

A template is parsed into a syntax tree, constants are folded (names given when compiling are some),
and each node becomes a closure. What a `generation` block writes is marked: those are the spans
that a model is trained on.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

MARK = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+\-~|().,\[\]]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None}
RESERVED = {"if", "else", "and", "or", "not", "in", "messages", "loop"} | set(WORDS)
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}
FIELDS = {"loop": {"first", "last", "index", "index0", "length"}}
MAX_LENGTH, MAX_DEPTH = 1 << 16, 32


class TemplateError(ValueError):
    """What a template may not say."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Apply:
    """A pure function of expressions: an operator or a filter. Only such nodes fold."""

    function: Callable
    args: tuple


@dataclass(frozen=True)
class Choice:
    """kind `and`, `or` or `if`: expressions of which not all are evaluated."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs
    otherwise: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


def plain(value: Any) -> str:
    if isinstance(value, dict):
        raise TemplateError("a message or loop is no text")
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def add(a: Any, b: Any) -> Any:
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


FILTERS: dict[str, Callable] = {"trim": lambda x: plain(x).strip(), "upper": lambda x: plain(x).upper(), "lower": lambda x: plain(x).lower(), "length": lambda x: len(plain(x)), "default": lambda x, other: other if x is None else x}


class Expression:
    """A parser of one expression, by precedence."""

    def __init__(self, text: str, constants: dict[str, Any], filters: dict[str, Callable]) -> None:
        self.constants, self.filters, self.tokens, at = constants, filters, [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self):
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is unexpected")
        return found

    def choice(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        value = self.any_of()
        if self.take("if"):
            condition = self.any_of()
            self.need("else")
            value = Choice("if", (condition, value, self.choice()))
        self.depth -= 1
        return fold(value)

    def any_of(self):
        value = self.all_of()
        while self.take("or"):
            value = fold(Choice("or", (value, self.all_of())))
        return value

    def all_of(self):
        value = self.negated()
        while self.take("and"):
            value = fold(Choice("and", (value, self.negated())))
        return value

    def negated(self):
        count = 0
        while self.take("not"):
            count += 1
        value = self.compared()
        for _ in range(count):
            value = fold(Apply(operator.not_, (value,)))
        return value

    def compared(self):
        value = self.joined()
        while True:
            sign = self.take(*COMPARE)
            if not sign and self.peek("not"):
                self.at += 1
                self.need("in")
                sign = "not in"
            if not sign:
                return value
            value = fold(Apply(COMPARE[sign], (value, self.joined())))

    def joined(self):
        value = self.summed()
        while self.take("~"):
            value = fold(Apply(lambda a, b: plain(a) + plain(b), (value, self.summed())))
        return value

    def summed(self):
        value = self.filtered()
        while sign := self.take("+", "-"):
            value = fold(Apply(add if sign == "+" else operator.sub, (value, self.filtered())))
        return value

    def filtered(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = self.field(value, self.word())
            elif self.take("["):
                key = self.choice()
                self.need("]")
                if not isinstance(key, Const) or not isinstance(key.value, str):
                    raise TemplateError("only a text in quotes may stand in brackets")
                value = self.field(value, key.value)
            elif self.take("|"):
                name, args = self.word(), [value]
                if name not in self.filters:
                    raise TemplateError(f"there is no filter {name}")
                if name == "default":
                    self.need("(")
                    args.append(self.choice())
                    self.need(")")
                value = fold(Apply(self.filters[name], tuple(args)))
            else:
                return value

    def field(self, of, name: str):
        if not isinstance(of, Name):
            raise TemplateError("only messages and loop have fields")
        if of.name == "loop" and name not in FIELDS["loop"]:
            raise TemplateError(f"loop has no {name}")
        return Field(of, name)

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            if value in WORDS or value in self.constants:
                return Const(WORDS.get(value, self.constants.get(value)))
            if value in RESERVED - {"loop"}:
                raise TemplateError(f"{value} can't stand here")
            return Name(value)
        if value == "(":
            found = self.choice()
            self.need(")")
            return found
        if value == "-":
            return fold(Apply(operator.neg, (self.atom(),)))
        raise TemplateError(f"{value!r} is unexpected")


def fold(node):
    """The node, or the constant that it always is."""
    if isinstance(node, Apply) and all(isinstance(a, Const) for a in node.args):
        try:
            return Const(node.function(*(a.value for a in node.args)))
        except TypeError as e:
            raise TemplateError(str(e)) from e
    if isinstance(node, Choice) and isinstance(node.args[0], Const):
        first, *rest = node.args
        if node.kind == "if":
            return rest[0] if first.value else rest[1]
        return rest[0] if bool(first.value) == (node.kind == "and") else first
    return node


def folded(body: list) -> tuple:
    """A body with neighbouring texts joined, and branches that constants decide resolved."""
    out: list = []
    for node in body:
        parts = [node]
        if isinstance(node, If):
            open_, parts = [], None
            for condition, inner in node.branches:
                if isinstance(condition, Const):
                    if condition.value:
                        parts = inner if not open_ else (If(tuple(open_), inner),)
                        break
                else:
                    open_.append((condition, inner))
            if parts is None:
                parts = (If(tuple(open_), node.otherwise),) if open_ else node.otherwise
        for part in parts:
            if isinstance(part, Write) and isinstance(part.value, Const):
                text = plain(part.value.value)
                if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Write(Const(text)))
            else:
                out.append(part)
    return tuple(out)


class Parser:
    def __init__(self, source: str, constants: dict[str, Any], filters: dict[str, Callable]) -> None:
        if len(source) > MAX_LENGTH:
            raise TemplateError("longer than a template may be")
        self.expression = lambda text: Expression(text, constants, filters).whole()
        self.constants, self.items, self.at, self.loops, strip = constants, [], 0, 0, False
        for i, part in enumerate(MARK.split(source)):
            if i % 2 == 0:
                self.items.append(("text", part.lstrip() if strip else part))
                strip = False
                continue
            kind, inner = part[:2], part[2:-2]
            if inner.startswith("-") and kind != "{#":
                inner = inner[1:]
                self.items[-1] = ("text", self.items[-1][1].rstrip())
            if inner.endswith("-") and kind != "{#":
                inner, strip = inner[:-1], True
            if kind != "{#":
                self.items.append((kind, inner.strip()))

    def body(self, ends: tuple[str, ...], depth: int = 0) -> tuple[tuple, str]:
        """Nodes up to one of the words in `ends`, and the mark that has it."""
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        out: list = []
        while self.at < len(self.items):
            kind, text = self.items[self.at]
            self.at += 1
            if kind == "text":
                out.append(Write(Const(text)))
            elif kind == "{{":
                out.append(Write(self.expression(text)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return folded(out), text
                out.append(self.statement(word, rest, depth))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return folded(out), ""

    def statement(self, word: str, rest: str, depth: int):
        if word == "if":
            branches, otherwise, condition = [], (), self.expression(rest)
            while True:
                inner, end = self.body(("elif", "else", "endif"), depth + 1)
                branches.append((condition, inner))
                if end.startswith("elif"):
                    condition = self.expression(end[4:])
                    continue
                if end == "else":
                    otherwise, _ = self.body(("endif",), depth + 1)
                return If(tuple(branches), otherwise)
        if word == "set":
            name, sign, value = rest.partition("=")
            name = name.strip()
            if not sign or not name.isidentifier() or name in RESERVED or name in self.constants:
                raise TemplateError(f"can't set {name!r}")
            return Set(name, self.expression(value))
        if word == "generation":
            return Generation(self.body(("endgeneration",), depth + 1)[0])
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
            self.loops += 1
            if not m or m[1] in RESERVED or depth or self.loops > 1:
                raise TemplateError("a template has one loop, over messages, inside nothing else")
            return For(m[1], self.body(("endfor",), depth + 1)[0])
        raise TemplateError(f"{word!r} is no statement")


@dataclass
class Output:
    parts: list = field(default_factory=list)
    size: int = 0
    spans: list = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def valued(node) -> Callable[[dict], Any]:
    """The closure that evaluates an expression against the names of a place in the template."""
    if isinstance(node, Const):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Field):
        of, name = node.of.name, node.name

        def read(names):
            held = names.get(of)
            if not isinstance(held, dict) or name not in held:
                raise TemplateError(f"{of} has no {name}")
            return held[name]

        return read
    args = [valued(a) for a in node.args]
    if isinstance(node, Apply):
        function = node.function
        if len(args) == 1:
            (one,) = args
            return lambda names: function(one(names))
        one, other = args
        return lambda names: function(one(names), other(names))
    if node.kind == "if":
        condition, yes, no = args
        return lambda names: yes(names) if condition(names) else no(names)
    one, other = args
    return (lambda names: one(names) and other(names)) if node.kind == "and" else (lambda names: one(names) or other(names))


def written(body: Sequence) -> Callable[[dict, Output], None]:
    """The closure that renders nodes."""
    steps = [step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(names, out):
        for s in steps:
            s(names, out)

    return run


def step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda names, out: out.write(text)
        value = valued(node.value)
        return lambda names, out: out.write(plain(value(names)))
    if isinstance(node, If):
        branches, otherwise = [(valued(c), written(b)) for c, b in node.branches], written(node.otherwise)

        def choose(names, out):
            for condition, body in branches:
                if condition(names):
                    return body(names, out)
            return otherwise(names, out)

        return choose
    if isinstance(node, Set):
        name, value = node.name, valued(node.value)

        def put(names, out):
            names[name] = value(names)

        return put
    if isinstance(node, Generation):
        body = written(node.body)

        def mark(names, out):
            start = out.size
            body(names, out)
            out.spans.append((start, out.size))

        return mark
    raise TemplateError("a loop stands where none may")


class Template:
    """A compiled template. Pickles as its source, so that tasks compile their own closures."""

    def __init__(self, source: str, constants: dict[str, Any] | None = None, filters: dict[str, Callable] | None = None) -> None:
        self.given = (source, dict(constants or {}), dict(filters or {}))
        bad = set(self.given[1]) & RESERVED
        if bad:
            raise TemplateError(f"reserved: {sorted(bad)}")
        self.tree = Parser(source, self.given[1], FILTERS | self.given[2]).body(())[0]
        loops = [i for i, node in enumerate(self.tree) if isinstance(node, For)]
        at = loops[0] if loops else len(self.tree)
        self.before, self.after = written(self.tree[:at]), written(self.tree[at + 1 :])
        self.name, self.each = (self.tree[at].name, written(self.tree[at].body)) if loops else ("", None)

    def __reduce__(self):
        return Template, self.given

    def render(self, messages: Sequence[dict], start: int = 0, total: int | None = None) -> tuple[str, list[tuple[int, int]]]:
        """The text of messages and its marked spans, in code points.

        Of a conversation of `total` messages these may be a part, from number `start` on: what
        stands before and after the loop is written with its first and its last message only, and
        the parts' texts joined are the text of the whole. What an iteration sets ends with it.
        """
        total = len(messages) if total is None else total
        names: dict[str, Any] = {}
        out = Output()
        self.before(names, out if start == 0 else Output())
        if self.each:
            for i, m in enumerate(messages, start):
                self.each({**names, self.name: m, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == total - 1, "length": total}}, out)
        if start + len(messages) == total:
            self.after(names, out)
        return "".join(out.parts), out.spans
