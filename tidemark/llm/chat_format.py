"""Chat formatting by compiled templates.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and each node becomes a Python
closure that yields pieces of output. The language has ``{{ expression }}``, ``{% for x in expression %}``, ``{% if %}``
with ``elif`` and ``else``, ``{% set x = expression %}`` and ``{% generation %} ... {% endgeneration %}``, whose output
is under the loss mask. Expressions have strings, numbers, names, fields of mappings (``x.f``, ``x['f']``), ``+``, comparisons,
``and``, ``or``, ``not``, ``in`` and the filters given to the compiler. There are no calls, no attributes of objects and
no imports, so a template reaches nothing but its data.

Rendering is a stream: the messages of a conversation pass one at a time, so a very long conversation needs no more memory
than its longest message.

Defined results: null roles and texts are empty. Turns are ordered by turn (nulls first), role and text, so that ties have
one order. Rows without conv_id are one conversation of their own. Repeated rows are repeated turns. An empty table has no
conversations but those the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import batch_of
from .store import text_map

# ---- syntax tree


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple


class TemplateError(ValueError):
    pass


TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
LEXEME = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+|.()\[\]<>,=]))")
WORDS = {"and", "or", "not", "in", "true", "false", "none"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected {source[at:]!r}")
        at = m.end()
        number, string, name, mark = m.groups()
        if number:
            out.append(("const", float(number) if "." in number else int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        elif name:
            out.append(("word" if name.lower() in WORDS else "name", name.lower() if name.lower() in WORDS else name))
        else:
            out.append(("mark", mark))
    return out


class Parser:
    """Recursive descent over the template's tags; expression() over a tag's lexemes."""

    def __init__(self, template: str):
        self.parts = []
        trim = False
        pieces = TAG.split(template)
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                if trim:
                    piece = piece.lstrip()
                if i + 1 < len(pieces) and pieces[i + 1][2:3] == "-":
                    piece = piece.rstrip()
                if piece:
                    self.parts.append(("text", piece))
                trim = False
            else:
                trim = piece[-3:-2] == "-"
                if not piece.startswith("{#"):
                    self.parts.append(("print" if piece.startswith("{{") else "tag", piece[2:-2].strip().strip("-")))
        self.at = 0

    def body(self, *ends: str) -> tuple[Node, str]:
        nodes = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Node("text", (text,)))
            elif kind == "print":
                nodes.append(Node("print", (self.whole(text),)))
            else:
                word, _, rest = text.strip().partition(" ")
                if word in ends:
                    return Node("body", tuple(nodes)), text.strip()
                nodes.append(self.tag(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return Node("body", tuple(nodes)), ""

    def tag(self, word: str, rest: str) -> Node:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            return Node("for", (m[1], self.whole(m[2]), self.body("endfor")[0]))
        if word == "if":
            cases, test = [], self.whole(rest)
            while True:
                inner, end = self.body("elif", "else", "endif")
                cases.append((test, inner))
                if end == "endif":
                    return Node("if", tuple(cases))
                if end == "else":
                    cases.append((Node("const", (True,)), self.body("endif")[0]))
                    return Node("if", tuple(cases))
                test = self.whole(end[4:])
        if word == "set":
            name, _, value = rest.partition("=")
            return Node("set", (name.strip(), self.whole(value)))
        if word == "generation":
            return Node("generation", (self.body("endgeneration")[0],))
        raise TemplateError(f"unknown tag {word!r}")

    def whole(self, source: str) -> Node:
        self.tokens, self.pos = _lex(source), 0
        node = self.expression()
        if self.pos < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.pos][1]!r} in {source!r}")
        return node

    def peek(self, *values) -> bool:
        return self.pos < len(self.tokens) and self.tokens[self.pos][0] in ("mark", "word") and self.tokens[self.pos][1] in values

    def next(self):
        if self.pos >= len(self.tokens):
            raise TemplateError("expression ends too soon")
        self.pos += 1
        return self.tokens[self.pos - 1]

    def binary(self, below: Callable[[], Node], *operators: str) -> Node:
        node = below()
        while self.peek(*operators):
            op = self.next()[1]
            node = Node("binary", (op, node, below()))
        return node

    def expression(self) -> Node:
        return self.binary(lambda: self.binary(self.negation, "and"), "or")

    def negation(self) -> Node:
        if self.peek("not"):
            self.next()
            return Node("not", (self.negation(),))
        return self.binary(lambda: self.binary(self.postfix, "+"), "==", "!=", "<", ">", "<=", ">=", "in")

    def postfix(self) -> Node:
        node = self.atom()
        while self.peek(".", "[", "|"):
            mark = self.next()[1]
            if mark == "[":
                node = Node("field", (node, self.expression()))
                if self.next()[1] != "]":
                    raise TemplateError("missing ]")
            else:
                kind, name = self.next()
                if kind != "name":
                    raise TemplateError(f"name expected, not {name!r}")
                node = Node("field", (node, Node("const", (name,)))) if mark == "." else Node("filter", (name, node))
        return node

    def atom(self) -> Node:
        kind, value = self.next()
        if kind == "const":
            return Node("const", (value,))
        if kind == "word" and value in ("true", "false", "none"):
            return Node("const", ({"true": True, "false": False, "none": None}[value],))
        if kind == "name":
            return Node("name", (value,))
        if value == "(":
            node = self.expression()
            if self.next()[1] != ")":
                raise TemplateError("missing )")
            return node
        raise TemplateError(f"unexpected {value!r}")


OPERATORS = {
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The same tree with constant expressions worked out, decided branches taken and neighbouring texts joined."""
    const = lambda n: n.kind == "const"
    if node.kind == "binary":
        op, a, b = node.args[0], fold(node.args[1], filters), fold(node.args[2], filters)
        if op in ("and", "or"):
            if const(a):
                return b if bool(a.args[0]) == (op == "and") else a
        elif const(a) and const(b):
            return Node("const", (OPERATORS[op](a.args[0], b.args[0]),))
        return Node("binary", (op, a, b))
    if node.kind == "not":
        a = fold(node.args[0], filters)
        return Node("const", (not a.args[0],)) if const(a) else Node("not", (a,))
    if node.kind == "field":
        return Node("field", tuple(fold(x, filters) for x in node.args))
    if node.kind == "filter":
        name, a = node.args[0], fold(node.args[1], filters)
        if name not in filters:
            raise TemplateError(f"unknown filter {name!r}")
        return Node("const", (_filtered(filters[name], a.args[0]),)) if const(a) else Node("filter", (name, a))
    if node.kind == "print":
        a = fold(node.args[0], filters)
        return Node("text", (_text(a.args[0]),)) if const(a) else Node("print", (a,))
    if node.kind == "set":
        return Node("set", (node.args[0], fold(node.args[1], filters)))
    if node.kind == "for":
        return Node("for", (node.args[0], fold(node.args[1], filters), fold(node.args[2], filters)))
    if node.kind == "generation":
        return Node("generation", (fold(node.args[0], filters),))
    if node.kind == "if":
        cases = []
        for test, inner in node.args:
            test, inner = fold(test, filters), fold(inner, filters)
            if const(test) and not test.args[0]:
                continue
            if const(test) and not cases:
                return inner
            cases.append((test, inner))
            if const(test):
                break
        return Node("if", tuple(cases)) if cases else Node("body", ())
    if node.kind == "body":
        out: list[Node] = []
        for n in node.args:
            n = fold(n, filters)
            for x in n.args if n.kind == "body" else (n,):
                if x.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].args[0] + x.args[0],))
                elif x != Node("text", ("",)):
                    out.append(x)
        return Node("body", tuple(out))
    return node


def _filtered(f: Callable, value: object) -> object:
    """A filter's result; of nothing, nothing."""
    return None if value is None else f(value)


def _text(value: object) -> str:
    return "" if value is None else str(value)


# ---- closures

Piece = tuple[str, bool]  # output, under the loss mask
Render = Callable[[dict, bool], Iterator[Piece]]
Value = Callable[[dict], object]


def _value(node: Node, filters: dict[str, Callable]) -> Value:
    if node.kind == "const":
        constant = node.args[0]
        return lambda scope: constant
    if node.kind == "name":
        name = node.args[0]
        return lambda scope: scope.get(name)
    if node.kind == "field":
        of, field = (_value(n, filters) for n in node.args)

        def get(scope: dict) -> object:
            container = of(scope)
            return container.get(field(scope)) if isinstance(container, dict) else None

        return get
    if node.kind == "filter":
        f, a = filters[node.args[0]], _value(node.args[1], filters)
        return lambda scope: _filtered(f, a(scope))
    if node.kind == "not":
        a = _value(node.args[0], filters)
        return lambda scope: not a(scope)
    op, a, b = node.args[0], _value(node.args[1], filters), _value(node.args[2], filters)
    if op == "and":
        return lambda scope: a(scope) and b(scope)
    if op == "or":
        return lambda scope: a(scope) or b(scope)
    f = OPERATORS[op]
    return lambda scope: f(a(scope), b(scope))


def _render(node: Node, filters: dict[str, Callable]) -> Render:
    if node.kind == "text":
        text = node.args[0]

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            yield text, masked

    elif node.kind == "print":
        value = _value(node.args[0], filters)

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            yield _text(value(scope)), masked

    elif node.kind == "set":
        name, value = node.args[0], _value(node.args[1], filters)

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

    elif node.kind == "for":
        name, items, inner = node.args[0], _value(node.args[1], filters), _render(node.args[2], filters)

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            for i, item in enumerate(items(scope) or ()):
                yield from inner({**scope, name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, masked)

    elif node.kind == "if":
        cases = [(_value(test, filters), _render(inner, filters)) for test, inner in node.args]

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            for test, inner in cases:
                if test(scope):
                    yield from inner(scope, masked)
                    return

    elif node.kind == "generation":
        inner = _render(node.args[0], filters)

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            yield from inner(scope, True)

    else:
        inners = [_render(n, filters) for n in node.args]

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            for inner in inners:
                yield from inner(scope, masked)

    return out


def compile_template(template: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields pieces of output, each with its loss mask."""
    filters = filters or {}
    tree, _ = Parser(template).body()
    run = _render(fold(tree, filters), filters)
    return lambda **names: run(names, False)


# ---- the format

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}{{ '" + START + "' }}{{ message.role | escape_role }}{{ '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '" + END + "' + '\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    """No control string is left: ``<|`` becomes ``<\\|``, and a backslash two, so that unescape() gives back the text."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS = {"escape": escape, "escape_role": escape_role}


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str, int]]:
    """The turns in formatted output: role, text, the text under the loss mask (all unescaped), and the turn's formatted length.

    Only control strings delimit turns. A turn's last piece ends with its closing marker.
    """
    text, mask = [], []
    buffer = ""
    for piece, masked in pieces:
        buffer += piece
        text.append(piece)
        if masked:
            mask.append(piece)
        if buffer.endswith(END + "\n"):
            whole = "".join(text)
            if not whole.startswith(START):
                raise ValueError("a turn does not begin with its marker")
            role, _, body = whole[len(START) : -len(END) - 1].partition("\n")
            yield unescape(role), unescape(body), unescape("".join(mask)), len(whole)
            text, mask, buffer = [], [], ""
        else:
            buffer = buffer[-len(END) - 1 :]
    if text and any(text):
        raise ValueError("the last turn is not closed")


def _messages(rows: Iterator[dict]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of sorted rows, each a stream of messages that must be read before the next."""
    row = next(rows, None)
    while row is not None:
        conv = row["conv_id"]

        def own() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv_id"] == conv:  # noqa: B023
                yield {"role": row["role"] or "", "text": row["text"] or ""}
                row = next(rows, None)

        yield conv, own()


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            yield from batch.slice(lo, 256).to_pylist()


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, formatted, spans: [start, end) of what is under the loss mask, in code points."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        for conv, messages in _messages(_rows(batches)):
            out, spans, at = [], [], 0
            for piece, masked in render(messages=messages):
                out.append(piece)
                if masked and piece:
                    spans.append([at, at + len(piece)])
                at += len(piece)
            yield batch_of(schema, [conv], ["".join(out)], [spans])

    return text_map(_sorted(conversations), run, "conv_id bigint, formatted string, spans array<array<bigint>>")


def format_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The same output, read back as it is rendered -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        rows = []
        for conv, messages in _messages(_rows(batches)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for role, text, masked, length in read_back(render(messages=messages)):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + length
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(rows) >= 1000:
                yield batch_of(schema, *zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch_of(schema, *zip(*rows, strict=True))

    return text_map(_sorted(conversations), run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
