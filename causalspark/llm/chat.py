"""Chat formatting by a compiled template.

A template is parsed to a small syntax tree (text, expressions, ``for``, ``if``, ``generation`` blocks), constants are
folded, and the tree becomes Python closures that yield pieces of output and mark what lies in a generation block. The
language is closed: names of the context, fields, literals, comparisons, ``and or not + ~``, ``in``, and the filters listed
in ``FILTERS``; there are no calls, no attributes of Python objects and no unbounded loops.

Texts and roles are escaped before they enter a template, so that no control string can be read inside them: a backslash
is doubled, and one is put behind the first character of each control string. The escape is undone on reading back.

Turns of a conversation are rendered and read back as a stream in turn order, with a state of one turn, so a
conversation of any length takes bounded memory. Rows are brought together by conversation with one shuffle.

Defined cases: null texts and roles are empty; turns that are null or equal go in the order null first, then role, then
text; conversations with a null id form one conversation with a null id; repeated rows are repeated turns; an empty
table gives an empty result; other columns do not take part. In a template a missing field is empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import slices

START, END = "<|turn|>", "<|end|>"
#: Strings that a text must not hold in the open: own marks and the usual ones of other templates.
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: One turn: mark, role, line end, text (under the loss mask if an assistant says it), mark.
TEMPLATE = ("{% for m in messages %}{{ '" + START + "' ~ m.role ~ '\\n' }}"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}"
            "{{ '" + END + "' ~ '\\n' }}{% endfor %}")

FILTERS = {"trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(), "lower": lambda s: str(s).lower(), "length": len}


# ---------------------------------------------------------------- syntax tree

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """The template is outside the language."""


_PART = re.compile(r"\{\{-?(?P<out>(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>==|!=|<=|>=|[<>()\[\].|+~%-]))""")
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def accept(self, *words: str) -> str | None:
        if (found := self.peek()) in words and found is not None:
            self.at += 1
            return found
        return None

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.accept("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negation()
        while self.accept("and"):
            node = Op("and", (node, self.negation()))
        return node

    def negation(self):
        return Op("not", (self.negation(),)) if self.accept("not") else self.comparison()

    def comparison(self):
        node = self.sum()
        while word := self.accept("==", "!=", "<", ">", "<=", ">=", "in"):
            node = Op(word, (node, self.sum()))
        return node

    def sum(self):
        node = self.filtered()
        while word := self.accept("+", "-", "~", "%"):
            node = Op(word, (node, self.filtered()))
        return node

    def filtered(self):
        node = self.atom()
        while self.accept("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = Op(f"|{name}", (node,))
        return node

    def atom(self):
        if self.accept("("):
            node = self.either()
            if not self.accept(")"):
                raise TemplateError("a bracket is open")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(text))
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        if text in _WORDS:
            return Const(_WORDS[text])
        path = [text]
        while True:
            if self.accept("."):
                path.append(self._field("name"))
            elif self.accept("["):
                path.append(self._field("str")[1:-1])
                if not self.accept("]"):
                    raise TemplateError("a bracket is open")
            else:
                break
        if any(p.startswith("_") for p in path):
            raise TemplateError(f"no name {'.'.join(path)!r}")
        return Name(tuple(path))

    def _field(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError("a field is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _PART.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at:m.start()]))
        if m["out"] is not None:
            parts.append(("out", m["out"]))
        elif m["tag"] is not None:
            parts.append(("tag", m["tag"].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    place = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        body = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                body.append(Output(Const(text)))
            elif kind == "out":
                body.append(Output(_Expression(text).whole()))
            else:
                word = text.split(None, 1)[0] if text else ""
                if word in ends:
                    return tuple(body), text
                if word == "if":
                    body.append(branch(text[2:]))
                elif word == "for":
                    m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", text, re.S)
                    if not m:
                        raise TemplateError(f"cannot read {text!r}")
                    inner, _ = block("endfor")
                    body.append(For(m[1], _Expression(m[2]).whole(), inner))
                elif word == "generation":
                    inner, _ = block("endgeneration")
                    body.append(Generation(inner))
                else:
                    raise TemplateError(f"no tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    def branch(test: str) -> If:
        then, end = block("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif"):
            other = (branch(end[4:]),)
        elif end == "else":
            other, _ = block("endif")
        return If(_Expression(test).whole(), then, other)

    return block()[0]


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a,
    **{f"|{k}": f for k, f in FILTERS.items()}}


def _text(value) -> str:
    return "" if value is None else str(value)


def fold(node):
    """The same tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for item in map(fold, node):
            for x in item if isinstance(item, tuple) else (item,):
                if isinstance(x, Output) and isinstance(x.value, Const):
                    if not (text := _text(x.value.value)):
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + text))
                        continue
                    x = Output(Const(text))
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name == "~" and isinstance(args[1], Const) and isinstance(args[0], Op) and args[0].name == "~" and isinstance(args[0].args[1], Const):
            return Op("~", (args[0].args[0], Const(_text(args[0].args[1].value) + _text(args[1].value))))
        if node.name in _OPS and all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.name](*(a.value for a in args)))
        return Op(node.name, args)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# ---------------------------------------------------------------- closures

def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        first, rest = node.path[0], node.path[1:]

        def get(scope):
            value = scope.get(first)
            for field in rest:
                value = value.get(field) if isinstance(value, dict) else None
            return value
        return get
    args = [_value(a) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    op = _OPS[node.name]
    if len(args) == 1:
        return lambda scope: op(args[0](scope))
    return lambda scope: op(args[0](scope), args[1](scope))


Piece = tuple[str, bool]


def _emit(body: tuple, marked: bool = False) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(node, marked) for node in body]

    def run(scope):
        for step in steps:
            yield from step(scope)
    return run


def _step(node, marked: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Output):
        value = _value(node.value)

        def out(scope):
            if text := _text(value(scope)):
                yield text, marked
        return out
    if isinstance(node, Generation):
        return _emit(node.body, True)
    if isinstance(node, If):
        test, then, other = _value(node.test), _emit(node.then, marked), _emit(node.other, marked)
        return lambda scope: then(scope) if test(scope) else other(scope)
    over, body, name = _value(node.over), _emit(node.body, marked), node.name

    def loop(scope):
        items, number = iter(over(scope) or ()), 0
        item = next(items, None)
        while item is not None:  # one item is read ahead, for loop.last
            after = next(items, None)
            inner = scope | {name: item, "loop": {"index0": number, "index": number + 1, "first": number == 0, "last": after is None}}
            yield from body(inner)
            item, number = after, number + 1
    return loop


def compile_template(template: str = TEMPLATE) -> Callable[[dict], Iterator[Piece]]:
    """A function from a context (``messages``: any iterable of dicts) to pieces (text, under the loss mask)."""
    return _emit(fold(parse(template)))


# ---------------------------------------------------------------- escape and reading back

_OPEN = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text) if "\\" in text or "<" in text or "[" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in output of TEMPLATE."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        end = formatted.index(END, m.end())
        yield unescape(m[1]), unescape(formatted[m.end():end])
        at = end + len(END) + 1


class Digest:
    """What is read back of a conversation's output, turn by turn, and of its loss mask."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.rest = ""

    def add(self, text: str, marked: bool) -> None:
        self.formatted_chars += len(text)
        if marked:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest += text
        while (end := self.rest.find(END + "\n")) >= 0:
            end += len(END) + 1
            for role, said in read_back(self.rest[:end]):
                self.turns.update(f"{role}\n{said}\n".encode())
                self.n_turns += 1
            self.rest = self.rest[end:]

    def row(self, conv_id: int | None) -> tuple:
        if self.rest:
            raise ValueError("output ends inside a turn")
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, messages) of rows in order; the messages of one must be used up before the next."""
    from itertools import groupby
    rows = (r for batch in slices(batches) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv_id, group in groupby(rows, key=lambda r: r[0]):
        yield conv_id, ({"turn": turn, "role": escape_role(role), "text": escape(text)} for _, turn, role, text in group)


def formatted_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part, formatted, marked: the output in pieces, in the order of ``part`` (their texts joined are the output)."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("marked", pa.bool_())])

    def run(batches):
        render, out, size = compile_template(template), [], 0
        for conv_id, messages in _conversations(batches):
            for part, (text, marked) in enumerate(render({"messages": messages})):
                out.append((conv_id, part, text, marked))
                size += len(text)
                if size > 1 << 22 or len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return _sorted_turns(conversations).mapInArrow(run, "conv_id bigint, part bigint, formatted string, marked boolean")


def format_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        render, out = compile_template(template), []
        for conv_id, messages in _conversations(batches):
            digest = Digest()
            for text, marked in render({"messages": messages}):
                digest.add(text, marked)
            out.append(digest.row(conv_id))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return _sorted_turns(conversations).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose two turns hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(probe)
