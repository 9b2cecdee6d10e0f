"""A small sandboxed template language: text to syntax tree, constants folded, tree to Python closures.

Marks: ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in xs %} {% endfor %}``,
``{% set name = expression %}`` (also ``{% set box.name = ... %}`` on a ``namespace()``), ``{% generation %} ...
{% endgeneration %}`` around what the model is to produce, ``{# comment #}``; a ``-`` inside a mark strips the white
space on that side. Expressions: literals, lists, names, ``a.b``, ``a[b]``, ``a[b:c]``, arithmetic, ``~``, comparisons,
``in``, ``and or not``, ``x if c else y``, ``| filter``, ``is test``, calls of the names in FUNCTIONS and METHODS.

Sandbox: values are strings, numbers, booleans, None, lists and dictionaries; an attribute is a dictionary's key, never
a Python attribute; nothing but the named filters, functions and methods can be called; strings can't be multiplied,
strings and lists that are built hold LONGEST elements at most; loops are over finite lists, and a rendering makes at most
``steps`` loop turns for each message.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


class TemplateError(ValueError):
    """The template is not well formed, does what the sandbox forbids, or called ``raise_exception``."""


#: Characters or elements of a value that an expression builds.
LONGEST = 1 << 26

# --- syntax tree --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    first: Any
    last: Any


@dataclass(frozen=True)
class Apply:
    """An operator, filter, test, function or method (``kind``) on values."""

    kind: str
    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """``kind``: and, or, if (condition, then, else)."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    condition: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    key: str | None
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- what expressions may do --------------------------------------------------------------------------------------


def _bounded(value):
    if isinstance(value, (str, list)) and len(value) > LONGEST:
        raise TemplateError("a value became too long")
    return value


def _text(value) -> str:
    return "" if value is None else str(value)


def _plus(a, b):
    if type(a) is not type(b) and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
        raise TemplateError("'+' takes two strings, two lists or two numbers")
    return _bounded(a + b)


def _number(f):
    def run(a, b):
        if not (isinstance(a, (int, float)) and isinstance(b, (int, float))) or abs(a) > 1 << 62 or abs(b) > 1 << 62:
            raise TemplateError("a number was expected")
        return f(a, b)

    return run


def _replaced(value, old, new):
    value = _text(value)
    if len(value) + value.count(old) * (len(new) - len(old)) > LONGEST:
        raise TemplateError("a value became too long")
    return value.replace(old, new)


def _refuse(message):
    raise TemplateError(str(message))


def _range(*args):
    out = range(*args)
    if len(out) > 10_000:
        raise TemplateError("range is too long")
    return list(out)


def _index(value, key):
    try:
        return value[key] if not isinstance(value, dict) or key in value else None
    except (IndexError, TypeError, KeyError):
        return None


OPERATORS: dict[str, Callable] = {
    "+": _plus, "-": _number(operator.sub), "*": _number(operator.mul), "//": _number(operator.floordiv), "%": _number(operator.mod), "~": lambda a, b: _bounded(_text(a) + _text(b)),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": operator.not_, "negative": lambda a: -a,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v), "string": _text, "replace": _replaced,
    "default": lambda v, other="": other if v is None else v, "first": lambda v: _index(v, 0), "last": lambda v: _index(v, -1), "join": lambda v, by="": _bounded(_text(by).join(map(_text, v))),
    "tojson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True), "int": lambda v: int(v),
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: v is not None, "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 == 1, "mapping": lambda v: isinstance(v, dict),
}
FUNCTIONS: dict[str, Callable] = {"range": _range, "raise_exception": _refuse, "namespace": lambda **start: dict(start)}
METHODS: dict[str, Callable] = {
    "strip": lambda v: _text(v).strip(), "lstrip": lambda v: _text(v).lstrip(), "rstrip": lambda v: _text(v).rstrip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "startswith": lambda v, s: _text(v).startswith(s), "endswith": lambda v, s: _text(v).endswith(s), "split": lambda v, by=None: _text(v).split(by), "replace": _replaced,
}
#: Folding leaves these to the rendering.
NOT_PURE = {("function", "raise_exception"), ("function", "namespace")}

# --- parsing ------------------------------------------------------------------------------------------------------

_MARK = re.compile(r"(?s)(\s*)\{%-(.*?)(-?)%\}|(\s*)\{\{-(.*?)(-?)\}\}|\{%(.*?)(-?)%\}|\{\{(.*?)(-?)\}\}|\{#.*?#\}")
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|//|[-+*%~<>()\[\],.|=:]))", re.S)
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one mark."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        kind, text = self.tokens[self.at]
        return "" if kind == "string" else text

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.tokens[self.at][0] != "end":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, {self.peek()!r} found")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name" or text.startswith("_"):
            raise TemplateError(f"a name expected, {text!r} found")
        self.at += 1
        return text

    def end(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def expression(self):
        value = self.either()
        if self.take("if"):
            condition = self.either()
            value = Choice("if", (condition, value, self.expression() if self.take("else") else Const("")))
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Choice("or", (value, self.both()))
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Choice("and", (value, self.negated()))
        return value

    def negated(self):
        return Apply("operator", "not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                value = Apply("operator", sign, (value, self.joined()))
            elif self.peek() == "not" and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                value = Apply("operator", "not in", (value, self.joined()))
            elif self.take("is"):
                turned, test = self.take("not"), self.name()
                if test == "undefined":
                    turned, test = not turned, "defined"
                value = Apply("test", self.known(test, TESTS), (value,))
                value = Apply("operator", "not", (value,)) if turned else value
            else:
                return value

    def joined(self):
        value = self.summed()
        while self.take("~"):
            value = Apply("operator", "~", (value, self.summed()))
        return value

    def summed(self):
        value = self.product()
        while sign := self.take("+", "-"):
            value = Apply("operator", sign, (value, self.product()))
        return value

    def product(self):
        value = self.signed()
        while sign := self.take("*", "//", "%"):
            value = Apply("operator", sign, (value, self.signed()))
        return value

    def signed(self):
        return Apply("operator", "negative", (self.signed(),)) if self.take("-") else self.filtered()

    @staticmethod
    def known(name: str, names: dict) -> str:
        if name not in names:
            raise TemplateError(f"{name!r} is not allowed here")
        return name

    def arguments(self, close: str = ")") -> tuple:
        out = []
        while not self.take(close):
            out.append(self.expression())
            if not self.take(","):
                self.need(close)
                break
        return tuple(out)

    def filtered(self):
        value = self.primary()
        while True:
            if self.take("."):
                name = self.name()
                value = Apply("method", self.known(name, METHODS), (value, *self.arguments())) if self.take("(") else Item(value, Const(name))
            elif self.take("["):
                first = None if self.peek() == ":" else self.expression()
                if self.take(":"):
                    value = Slice(value, first or Const(None), Const(None) if self.peek() == "]" else self.expression())
                else:
                    value = Item(value, first)
                self.need("]")
            elif self.take("|"):
                name = self.name()
                value = Apply("filter", name, (value, *(self.arguments() if self.take("(") else ())))
            else:
                return value

    def primary(self):
        kind, text = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Const(float(text) if "." in text else int(text))
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"(?s)\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), text[1:-1]))
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("["):
            return ListOf(self.arguments("]"))
        name = self.name()
        if name in _WORDS:
            return Const(_WORDS[name])
        if not self.take("("):
            return Name(name)
        self.known(name, FUNCTIONS)
        if name != "namespace":
            return Apply("function", name, self.arguments())
        pairs = []
        while not self.take(")"):
            key = self.name()
            self.need("=")
            pairs += [Const(key), self.expression()]
            if not self.take(","):
                self.need(")")
                break
        return Apply("function", "namespace", tuple(pairs))


def _marks(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "output" | "statement", content), white space stripped where a mark says so."""
    at, strip = 0, False
    for m in _MARK.finditer(source):
        text = source[at : m.start()]
        yield "text", text.lstrip() if strip else text
        if m[0].startswith("{#"):
            strip = False
        else:
            body = next(x for x in (m[2], m[5], m[7], m[9]) if x is not None)
            strip = any(m[k] == "-" for k in (3, 6, 8, 10))
            yield ("output" if m[5] is not None or m[9] is not None else "statement"), body
        at = m.end()
    yield "text", source[at:].lstrip() if strip else source[at:]


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of statements."""
    marks = [(kind, text) for kind, text in _marks(source) if kind != "text" or text]
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out: list = []
        while at < len(marks):
            kind, text = marks[at]
            at += 1
            if kind == "text":
                out.append(Text(text))
                continue
            e = _Expression(text)
            if kind == "output":
                out.append(Output(e.expression()))
                e.end()
                continue
            word = e.name()
            if word in ends:
                at -= 1
                return tuple(out), word
            out.append(statement(word, e))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), ""

    def follow(*ends: str) -> tuple[_Expression, str]:
        nonlocal at
        e = _Expression(marks[at][1])
        at += 1
        return e, e.name()

    def branch(e: _Expression) -> If:
        condition = e.expression()
        e.end()
        then, _ = block("elif", "else", "endif")
        e, word = follow()
        if word == "elif":
            return If(condition, then, (branch(e),))
        other: tuple = ()
        if word == "else":
            other, _ = block("endif")
            follow()
        return If(condition, then, other)

    def statement(word: str, e: _Expression):
        if word == "if":
            return branch(e)
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.expression()
            e.end()
            body, end = block("else", "endfor")
            follow()
            other: tuple = ()
            if end == "else":
                other, _ = block("endfor")
                follow()
            return For(name, over, body, other)
        if word == "set":
            name = e.name()
            key = e.name() if e.take(".") else None
            e.need("=")
            value = e.expression()
            e.end()
            return Assign(name, key, value)
        if word == "generation":
            e.end()
            body, _ = block("endgeneration")
            follow()
            return Generation(body)
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# --- folding ------------------------------------------------------------------------------------------------------


def fold(node, filters: dict[str, Callable] = FILTERS):
    """The same tree with constant expressions worked out, dead branches left out, and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x, filters)
            if isinstance(x, Output) and isinstance(x.value, Const):
                x = Text(_text(x.value.value))
            if isinstance(x, If) and isinstance(x.condition, Const):
                new = list(x.then if x.condition.value else x.other)
            elif isinstance(x, For) and isinstance(x.over, Const) and not x.over.value:
                new = list(x.other)
            else:
                new = [x]
            for y in new:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Const) or not is_dataclass(node):
        return node
    node = replace(node, **{f.name: fold(v, filters) for f in fields(node) if isinstance(v := getattr(node, f.name), tuple) or is_dataclass(v)})
    if isinstance(node, Choice) and isinstance(node.args[0], Const):
        first = node.args[0].value
        if node.kind == "if":
            return node.args[1] if first else node.args[2]
        return node.args[1] if bool(first) == (node.kind == "and") else node.args[0]
    values = [getattr(node, f.name) for f in fields(node)]
    parts = [x for v in values for x in (v if isinstance(v, tuple) else (v,)) if is_dataclass(x)]
    whole = isinstance(node, (Apply, ListOf, Item, Slice)) and all(isinstance(x, Const) for x in parts)
    if whole and not (isinstance(node, Apply) and (node.kind, node.name) in NOT_PURE):
        try:
            return Const(expression(node, filters)({}))
        except (TemplateError, TypeError, ValueError, ZeroDivisionError):
            return node  # fails when it is rendered, if it ever is
    return node


# --- closures -----------------------------------------------------------------------------------------------------


class Turns:
    """Messages that are read once, in order: iterated, asked for the first, or cut at the front without being held.

    Whatever else is asked (length, other places, a second reading) holds those of this one conversation.
    """

    def __init__(self, messages: Iterator[dict]):
        self.source, self.front = iter(messages), []

    def _fill(self, n: int | None) -> None:
        while n is None or len(self.front) < n:
            item = next(self.source, None)
            if item is None:
                return
            self.front.append(item)

    def __iter__(self) -> Iterator[dict]:
        front, self.front = self.front, []
        yield from front
        yield from self.source

    def tail(self, n: int) -> Turns:
        self._fill(n)
        held, self.front = self.front[n:], []
        return Turns(iter([*held])) if held else Turns(self.source)

    def __len__(self) -> int:
        self._fill(None)
        return len(self.front)

    def __bool__(self) -> bool:
        self._fill(1)
        return bool(self.front)

    def __getitem__(self, key):
        if not isinstance(key, int):
            raise TypeError(key)
        self._fill(None if key < 0 else key + 1)
        return self.front[key]


class Uses:
    """What a template asks of ``messages``: read once in order (``streams``), or more, so that they must be held."""

    def __init__(self, tree: tuple):
        self.reads, self.other = 0, 0
        self.visit(tree, False)
        self.streams = self.reads <= 1 and not self.other

    def visit(self, node, looped: bool) -> None:
        if isinstance(node, tuple):
            for x in node:
                self.visit(x, looped)
        elif isinstance(node, For):
            over = node.over
            while isinstance(over, Slice) and isinstance(over.first, Const) and over.last == Const(None) and isinstance(over.first.value, int) and over.first.value >= 0:
                over = over.of
            if over == Name("messages"):
                self.reads += 1 + looped
                self.visit(node.body, True)
                self.visit(node.other, True)
            else:
                for part in (node.over, node.body, node.other):
                    self.visit(part, True)
        elif isinstance(node, Name) and node.name == "messages":
            self.other += 1
        elif is_dataclass(node):
            for f in fields(node):
                self.visit(getattr(node, f.name), looped)


def expression(node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure that works the expression out of an environment."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, ListOf):
        items = [expression(x, filters) for x in node.items]
        return lambda env: [x(env) for x in items]
    if isinstance(node, Item):
        of = expression(node.of, filters)
        if isinstance(node.key, Const) and isinstance(node.key.value, str):
            key = node.key.value
            return lambda env: v.get(key) if isinstance(v := of(env), dict) else None
        key_of = expression(node.key, filters)
        return lambda env: _index(of(env), key_of(env))
    if isinstance(node, Slice):
        of, first, last = (expression(x, filters) for x in (node.of, node.first, node.last))

        def cut(env):
            value, a, b = of(env), first(env), last(env)
            if isinstance(value, Turns):
                return value.tail(a or 0) if b is None and (a or 0) >= 0 else list(value)[a:b]
            return value[a:b]

        return cut
    if isinstance(node, Choice):
        parts = [expression(x, filters) for x in node.args]
        if node.kind == "if":
            condition, then, other = parts
            return lambda env: then(env) if condition(env) else other(env)
        a, b = parts
        return (lambda env: a(env) and b(env)) if node.kind == "and" else (lambda env: a(env) or b(env))
    names = {"operator": OPERATORS, "filter": filters, "test": TESTS, "function": FUNCTIONS, "method": METHODS}[node.kind]
    if node.name not in names:
        raise TemplateError(f"unknown {node.kind} {node.name!r}")
    call, args = names[node.name], [expression(x, filters) for x in node.args]
    if (node.kind, node.name) == ("function", "namespace"):
        return lambda env: {args[k](env): args[k + 1](env) for k in range(0, len(args), 2)}
    if len(args) == 1:
        only = args[0]
        return lambda env: call(only(env))
    if len(args) == 2:
        a, b = args
        return lambda env: call(a(env), b(env))
    return lambda env: call(*[x(env) for x in args])


def statements(nodes: tuple, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A closure that yields (text, whether it is under a generation mark)."""
    parts = [statement(x, filters, marked) for x in nodes]

    def run(env):
        for part in parts:
            yield from part(env)

    return run


def statement(node, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    if isinstance(node, Text):
        piece = (node.text, marked)
        return lambda env: (piece,)
    if isinstance(node, Output):
        value = expression(node.value, filters)
        return lambda env: ((_text(value(env)), marked),)
    if isinstance(node, Generation):
        return statements(node.body, filters, True)
    if isinstance(node, If):
        condition, then, other = expression(node.condition, filters), statements(node.then, filters, marked), statements(node.other, filters, marked)
        return lambda env: then(env) if condition(env) else other(env)
    if isinstance(node, Assign):
        name, key, value = node.name, node.key, expression(node.value, filters)

        def assign(env):
            if key is None:
                env[name] = value(env)
            elif isinstance(box := env.get(name), dict):
                box[key] = value(env)
            else:
                raise TemplateError(f"{name!r} is no namespace")
            return ()

        return assign
    name, over, body, other = node.name, expression(node.over, filters), statements(node.body, filters, marked), statements(node.other, filters, marked)

    def loop(env):
        items = over(env)
        if not isinstance(items, (list, tuple, Turns)):
            raise TemplateError("a loop goes over a list")
        items, k = iter(items), 0
        before, now, after = None, next(items, None), None
        while now is not None:
            env["_steps"][0] -= 1
            if env["_steps"][0] < 0:
                raise TemplateError("too many loop turns")
            after = next(items, None)
            place = {"index0": k, "index": k + 1, "first": k == 0, "last": after is None, "previtem": before, "nextitem": after}
            yield from body({**env, name: now, "loop": place})
            before, now, k = now, after, k + 1
        if not k:
            yield from other(env)

    return loop


class Template:
    """A compiled template; ``filters`` add to FILTERS."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None, steps: int = 1000):
        self.filters, self.steps = FILTERS | (filters or {}), steps
        self.tree = fold(parse(source), self.filters)
        self.streams = Uses(self.tree).streams
        self.run = statements(self.tree, self.filters, False)

    def render(self, messages: Iterator[dict], **variables: Any) -> Iterator[tuple[str, bool]]:
        """Pieces of text in order, each with its generation mark. Messages are read as they are needed."""
        budget = [self.steps]

        def counted():
            for message in messages:
                budget[0] += self.steps
                yield message

        env = {**variables, "messages": Turns(counted()) if self.streams else list(counted()), "_steps": budget}
        for text, marked in self.run(env):
            if text:
                yield text, marked
