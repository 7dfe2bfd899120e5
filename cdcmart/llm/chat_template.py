"""Compiler of a sandboxed chat-template language.

    {{ expression }}            output
    {% for m in messages %}     ... {% endfor %}
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}    text that the model generates
    {# comment #}

``-`` beside a delimiter strips the white space on that side. Expressions have
literals, names, ``a.key`` and ``a[key]`` (keys of mappings and places of lists
only), ``+ - // %`` on integers, ``~`` (joins texts), comparisons, ``in``,
``and or not``, ``x if c else y``, ``is defined`` and the filters of
:data:`FILTERS`. There are no calls, no attributes of Python objects, no way to
repeat a text, and loops run over given lists only, so a template can neither
reach the interpreter nor run for ever.

A source is parsed into a syntax tree of frozen dataclasses, constant parts of the
tree are folded, and every node becomes a Python closure.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

MAX_DEPTH = 60


class TemplateError(ValueError):
    """A template that does not compile, or an expression without a value."""


# --- syntax tree ------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
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
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Defined:
    of: object
    wanted: bool


@dataclass(frozen=True)
class Filter:
    name: str
    of: object
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class If:
    arms: tuple  # of (test, body)
    other: tuple


@dataclass(frozen=True)
class For:
    var: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser -----------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(==|!=|<=|>=|//|[-+%~<>()\[\].,|=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("//", "%"))


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if m is None:
            raise TemplateError(f"cannot read {source[at:].strip()!r}")
        number, word, text, sign = m.groups()
        if number is not None:
            out.append(("literal", int(number)))
        elif word is not None:
            out.append(("word", word))
        elif text is not None:
            out.append(("literal", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str) -> None:
        self.tokens, self.at, self.depth = _tokens(source), 0, 0

    def peek(self) -> tuple[str | None, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, value: object = None) -> object:
        kind, found = self.peek()
        if kind is None or (value is not None and (kind == "literal" or found != value)):
            raise TemplateError(f"{value or 'an expression'} expected, found {found!r}")
        self.at += 1
        return found

    def has(self, *values: str) -> str | None:
        kind, found = self.peek()
        if kind in ("word", "sign") and found in values:
            self.at += 1
            return str(found)
        return None

    def name(self) -> str:
        kind, found = self.peek()
        if kind != "word" or found in _WORDS:
            raise TemplateError(f"a name expected, found {found!r}")
        self.at += 1
        return str(found)

    def whole(self) -> object:
        value = self.expression()
        if self.peek()[0] is not None:
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return value

    def expression(self) -> object:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        value = self.level(0)
        if self.has("if"):
            test = self.level(0)
            self.take("else")
            value = Choice(test, value, self.expression())
        self.depth -= 1
        return value

    def level(self, n: int) -> object:
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while True:
            kind, found = self.peek()
            if kind not in ("word", "sign"):
                return left
            if found == "not" and n == 2 and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                op = "not in"
            elif found in _LEVELS[n]:
                self.at += 1
                op = str(found)
            else:
                return left
            left = Binary(op, left, self.level(n + 1))

    def unary(self) -> object:
        op = self.has("not", "-")
        if op == "not":
            return Unary(op, self.level(2))
        if op:
            return Unary(op, self.unary())
        value = self.atom()
        while True:
            if self.has("."):
                value = Item(value, Lit(self.name()))
            elif self.has("["):
                value = Item(value, self.expression())
                self.take("]")
            elif self.has("|"):
                name, args = self.name(), ()
                if self.has("("):
                    args = self.listed(")")
                if name not in FILTERS and name != "escape":
                    raise TemplateError(f"no filter {name!r}")
                value = Filter(name, value, args)
            elif self.has("is"):
                wanted = self.has("not") is None
                self.take("defined")
                value = Defined(value, wanted)
            else:
                return value

    def listed(self, close: str) -> tuple:
        out: list = []
        while not self.has(close):
            if out:
                self.take(",")
            out.append(self.expression())
        return tuple(out)

    def atom(self) -> object:
        kind, found = self.peek()
        if kind == "literal":
            self.at += 1
            return Lit(found)
        if kind == "word":
            if found in _WORDS:
                self.at += 1
                return Lit(_WORDS[str(found)])
            return Name(self.name())
        if self.has("("):
            value = self.expression()
            self.take(")")
            return value
        raise TemplateError(f"an expression expected, found {found!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        left, right = (m[1] or m[4]), (m[3] or m[6])
        pieces.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            pieces.append(("print", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(right)
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    nodes, at, end = _body(pieces, 0, (), 0)
    return nodes


def _body(pieces: list[tuple[str, str]], at: int, ends: tuple[str, ...], depth: int) -> tuple[tuple, int, str]:
    if depth > MAX_DEPTH:
        raise TemplateError("nested too deeply")
    nodes: list = []
    while at < len(pieces):
        kind, content = pieces[at]
        at += 1
        if kind == "text":
            if content:
                nodes.append(Text(content))
            continue
        if kind == "print":
            nodes.append(Print(_Expression(content).whole()))
            continue
        word, _, rest = content.partition(" ")
        if word in ends:
            return tuple(nodes), at, content
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not name.strip().isidentifier():
                raise TemplateError(f"cannot read {content!r}")
            nodes.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "for":
            head = _Expression(rest)
            var = head.name()
            head.take("in")
            over = head.whole()
            body, at, _ = _body(pieces, at, ("endfor",), depth + 1)
            nodes.append(For(var, over, body))
        elif word == "generation":
            body, at, _ = _body(pieces, at, ("endgeneration",), depth + 1)
            nodes.append(Generation(body))
        elif word == "if":
            arms, other, test = [], (), rest
            while True:
                body, at, end = _body(pieces, at, ("elif", "else", "endif"), depth + 1)
                arms.append((_Expression(test).whole(), body))
                if end.startswith("elif"):
                    test = end.partition(" ")[2]
                    continue
                if end == "else":
                    other, at, _ = _body(pieces, at, ("endif",), depth + 1)
                break
            nodes.append(If(tuple(arms), other))
        else:
            raise TemplateError(f"unknown tag {content!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), at, ""


# --- values -----------------------------------------------------------------


def _text(value: object) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, (bool, int)):
        return str(value).lower() if isinstance(value, bool) else str(value)
    raise TemplateError(f"a {type(value).__name__} is no text")


def _whole(value: object) -> int:
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    raise TemplateError(f"{value!r} is no integer")


#: Filters besides ``escape``, whose control strings belong to a compiled template.
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "capitalize": lambda v: _text(v).capitalize(),
    "string": _text,
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else _whole(v),
    "default": lambda v, other="": other if v is None else v,
}


def _contains(item: object, box: object) -> bool:
    if isinstance(box, str):
        return _text(item) in box
    if isinstance(box, (list, dict)):
        return item in box
    raise TemplateError(f"nothing is in a {type(box).__name__}")


def _order(compare: Callable) -> Callable:
    def run(a: object, b: object) -> bool:
        if isinstance(a, str) and isinstance(b, str):
            return compare(a, b)
        return compare(_whole(a), _whole(b))

    return run


def _nonzero(divide: Callable) -> Callable:
    def run(a: object, b: object) -> int:
        if _whole(b) == 0:
            raise TemplateError("division by zero")
        return divide(_whole(a), b)

    return run


_OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "in": _contains, "not in": lambda a, b: not _contains(a, b),
    "<": _order(operator.lt), "<=": _order(operator.le), ">": _order(operator.gt), ">=": _order(operator.ge),
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _whole(a) + _whole(b),
    "-": lambda a, b: _whole(a) - _whole(b), "//": _nonzero(operator.floordiv), "%": _nonzero(operator.mod),
}


def escaper(controls: tuple[str, ...]) -> Callable:
    """``escape(text, *more)``: a backslash before every backslash and every
    control string; :func:`unescape` is its inverse."""
    held: dict[tuple[str, ...], re.Pattern] = {}

    def escape(value: object, *more: object) -> str:
        key = tuple(_text(m) for m in more)
        if key not in held:
            strings = sorted({*controls, *key}, key=lambda s: (-len(s), s))
            held[key] = re.compile("|".join([r"\\", *map(re.escape, strings)]))
        return held[key].sub(r"\\\g<0>", _text(value))

    return escape


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# --- constant folding -------------------------------------------------------


def fold(node: object, escape: Callable) -> object:
    """``node`` with every constant part replaced by its value."""
    if isinstance(node, tuple):
        return _fold_body(node, escape)
    if isinstance(node, Unary):
        of = fold(node.of, escape)
        if isinstance(of, Lit):
            return Lit(not of.value if node.op == "not" else -_whole(of.value))
        return Unary(node.op, of)
    if isinstance(node, Binary):
        left, right = fold(node.left, escape), fold(node.right, escape)
        if isinstance(left, Lit) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Lit) and isinstance(right, Lit):
            return Lit(_OPS[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Choice):
        test = fold(node.test, escape)
        if isinstance(test, Lit):
            return fold(node.yes if test.value else node.no, escape)
        return Choice(test, fold(node.yes, escape), fold(node.no, escape))
    if isinstance(node, Item):
        return Item(fold(node.of, escape), fold(node.key, escape))
    if isinstance(node, Filter):
        of, args = fold(node.of, escape), tuple(fold(a, escape) for a in node.args)
        if isinstance(of, Lit) and all(isinstance(a, Lit) for a in args):
            run = escape if node.name == "escape" else FILTERS[node.name]
            return Lit(run(of.value, *[a.value for a in args]))
        return Filter(node.name, of, args)
    return node


def _fold_body(nodes: tuple, escape: Callable) -> tuple:
    out: list = []

    def add(node: object) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            out.append(node)

    for node in nodes:
        if isinstance(node, Print):
            value = fold(node.value, escape)
            add(Text(_text(value.value)) if isinstance(value, Lit) else Print(value))
        elif isinstance(node, If):
            arms, other = [], fold(node.other, escape)
            for test, body in node.arms:
                test = fold(test, escape)
                if isinstance(test, Lit) and not test.value:
                    continue
                if isinstance(test, Lit):
                    other = fold(body, escape)
                    break
                arms.append((test, fold(body, escape)))
            if arms:
                add(If(tuple(arms), other))
            else:
                for inner in other:
                    add(inner)
        elif isinstance(node, For):
            add(For(node.var, fold(node.over, escape), fold(node.body, escape)))
        elif isinstance(node, Set):
            add(Set(node.name, fold(node.value, escape)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body, escape)))
        else:
            add(node)
    return tuple(out)


# --- closures ---------------------------------------------------------------


@dataclass
class Output:
    """Rendered text; ``spans`` are the code-point ranges of generated text."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


_MISSING = object()


def _item(of: object, key: object) -> object:
    if isinstance(of, dict) and isinstance(key, (str, int)):
        return of.get(key, _MISSING)
    if isinstance(of, list) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else _MISSING
    raise TemplateError(f"{key!r} of a {type(of).__name__}")


def _value(node: object, escape: Callable) -> Callable[[dict], object]:
    """A closure from variables to the value; a missing name raises."""
    run = _lookup(node, escape)
    if not isinstance(node, (Name, Item)):
        return run

    def checked(env: dict) -> object:
        value = run(env)
        if value is _MISSING:
            raise TemplateError(f"{node} has no value")
        return value

    return checked


def _lookup(node: object, escape: Callable) -> Callable[[dict], object]:
    if isinstance(node, Lit):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n, _MISSING)
    if isinstance(node, Item):
        of, key = _value(node.of, escape), _value(node.key, escape)
        return lambda env: _item(of(env), key(env))
    if isinstance(node, Defined):
        of, wanted = _lookup(node.of, escape), node.wanted
        return lambda env: (of(env) is not _MISSING) == wanted
    if isinstance(node, Unary):
        of = _value(node.of, escape)
        return (lambda env: not of(env)) if node.op == "not" else (lambda env: -_whole(of(env)))
    if isinstance(node, Choice):
        test, yes, no = (_value(n, escape) for n in (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(node, Filter):
        args = [_value(a, escape) for a in node.args]
        run = escape if node.name == "escape" else FILTERS[node.name]
        if node.name == "default":
            raw = _lookup(node.of, escape)
            of = lambda env: None if (v := raw(env)) is _MISSING else v
        else:
            of = _value(node.of, escape)
        return lambda env: run(of(env), *[a(env) for a in args])
    if isinstance(node, Binary):
        left, right = _value(node.left, escape), _value(node.right, escape)
        if node.op == "and":
            return lambda env: left(env) and right(env)
        if node.op == "or":
            return lambda env: left(env) or right(env)
        op = _OPS[node.op]
        return lambda env: op(left(env), right(env))
    raise TemplateError(f"no expression: {node!r}")


def _writer(nodes: tuple, escape: Callable) -> Callable[[dict, Output], None]:
    steps = [_step(n, escape) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _step(node: object, escape: Callable) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        return lambda env, out, t=node.text: out.add(t)
    if isinstance(node, Print):
        value = _value(node.value, escape)
        return lambda env, out: out.add(_text(value(env)))
    if isinstance(node, Set):
        name, given = node.name, _value(node.value, escape)

        def put(env: dict, out: Output) -> None:
            env[name] = given(env)

        return put
    if isinstance(node, If):
        arms = [(_value(t, escape), _writer(b, escape)) for t, b in node.arms]
        other = _writer(node.other, escape)

        def branch(env: dict, out: Output) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)
            other(env, out)

        return branch
    if isinstance(node, Generation):
        inner = _writer(node.body, escape)

        def generated(env: dict, out: Output) -> None:
            begin = out.size
            inner(env, out)
            out.spans.append((begin, out.size))

        return generated
    if isinstance(node, For):
        over, var, body = _value(node.over, escape), node.var, _writer(node.body, escape)

        def loop(env: dict, out: Output) -> None:
            items = over(env)
            if not isinstance(items, list):
                raise TemplateError("a loop runs over a list")
            for i, item in enumerate(items):
                body({**env, var: item, "loop": loop_state(i, len(items))}, out)

        return loop
    raise TemplateError(f"no node: {node!r}")


def loop_state(index: int, length: int) -> dict:
    return {"index0": index, "index": index + 1, "first": index == 0, "last": index == length - 1, "length": length}


def _names(node: object) -> set[str]:
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, tuple):
        return set().union(*[_names(n) for n in node]) if node else set()
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*[_names(getattr(node, f)) for f in node.__dataclass_fields__])
    return set()


class Template:
    """A compiled template: text before the loop over ``messages``, the loop's
    body for one message, text after it.

    The body sees one message, its place (``loop``) and the names set before the
    loop, nothing of other messages, so turns of one conversation can be rendered
    in different tasks.
    """

    def __init__(self, source: str, controls: tuple[str, ...] = ()) -> None:
        escape = escaper(tuple(controls))
        self.tree = fold(parse(source), escape)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For) and n.over == Name("messages")]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages, outside other blocks")
        at = loops[0]
        head, loop, tail = self.tree[:at], self.tree[at], self.tree[at + 1 :]
        if "messages" in _names(head) | _names(loop.body) | _names(tail):
            raise TemplateError("messages are read by the loop over them only")
        self._head, self._body, self._tail, self._var = _writer(head, escape), _writer(loop.body, escape), _writer(tail, escape), loop.var

    def head(self, out: Output, context: dict) -> dict:
        """Write the text before the loop; returns the variables of the loop."""
        env = dict(context)
        self._head(env, out)
        return env

    def turn(self, out: Output, env: dict, message: dict, index: int, length: int) -> None:
        self._body({**env, self._var: message, "loop": loop_state(index, length)}, out)

    def tail(self, out: Output, env: dict) -> None:
        self._tail(dict(env), out)

    def render(self, messages: list[dict], **context: object) -> Output:
        out = Output()
        env = self.head(out, context)
        for i, message in enumerate(messages):
            self.turn(out, env, message, i, len(messages))
        self.tail(out, env)
        return out
