"""Chat formatting by a template compiler.

A small sandboxed language: text, ``{{ expression }}``, ``{% for x in messages %}``, ``{% if %}``, ``{% else %}``,
``{% generation %}`` (what a model is to learn) and ``{% end... %}``. Expressions are string literals, fields of the message of a
loop around them (only role and text), ``==``, ``!=``, ``+`` and the filters ``escape``, ``escape_line``, ``upper``,
``lower`` and ``trim``; nothing else can be reached. Templates are parsed to a tree, constants are folded, and each node
becomes a Python closure that appends to the output; generation blocks note the span they fill.

Control strings start with ``<|``. ``escape`` puts a backslash into ``<``, backslashes, ``|`` so that no text can hold one;
``escape_line`` also takes line ends out of a field that ends with one. Both can be undone exactly.

Turns are rendered in order of turn, then role, then text; nulls count as empty; a null conv_id is a conversation of its
own; repeated rows are rendered as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAT_TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role|escape_line + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)
FIELDS = ("role", "text")


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", s)


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", s)


def escape_line(s: str) -> str:
    return escape(s.replace("%", "%25").replace("\n", "%0A"))


def unescape_line(s: str) -> str:
    return unescape(s).replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """kind: text, name, field, filter, add, equal, differ, if, for, generation, block."""

    kind: str
    value: object = None
    parts: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+()]))""")


class ExpressionParser:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, value: str | None = None) -> tuple[str, str]:
        if not self.tokens or (value and self.tokens[0][1] != value):
            raise TemplateError(f"expected {value or 'more'}")
        return self.tokens.pop(0)

    def next_is(self, *values: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] == "op" and self.tokens[0][1] in values

    def whole(self) -> Node:
        node = self.sum()
        if self.next_is("==", "!="):
            kind = "equal" if self.take()[1] == "==" else "differ"
            node = Node(kind, parts=[node, self.sum()])
        if self.tokens:
            raise TemplateError(f"left over: {self.tokens}")
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.next_is("+"):
            self.take()
            node = Node("add", parts=[node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.next_is("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = Node("filter", name, [node])
        return node

    def atom(self) -> Node:
        kind, value = self.take()
        if value == "(":
            node = self.sum()
            self.take(")")
            return node
        if kind == "text":
            return Node("text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind != "name":
            raise TemplateError(f"unexpected {value}")
        if self.next_is("."):
            self.take()
            name = self.take()[1]
            if name not in FIELDS:
                raise TemplateError(f"no field {name}")
            return Node("field", (value, name))
        return Node("name", value)


def in_scope(node: Node, scope: list[str]) -> Node:
    """The expression, if it only names messages of loops around it, and those by field."""
    if node.kind == "name" or (node.kind == "field" and node.value[0] not in scope):
        raise TemplateError(f"no value is named {node.value if node.kind == 'name' else node.value[0]}")
    for p in node.parts:
        in_scope(p, scope)
    return node


def parse(source: str) -> Node:
    root = Node("block")
    stack: list[tuple[Node, list[Node]]] = [(root, root.parts)]
    scope: list[str] = []
    for piece in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S):
        if piece.startswith("{{"):
            stack[-1][1].append(in_scope(ExpressionParser(piece[2:-2]).whole(), scope))
        elif piece.startswith("{%"):
            verb, _, rest = piece[2:-2].strip().partition(" ")
            if verb == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
                if not m:
                    raise TemplateError(f"cannot read for {rest!r}")
                node = Node("for", m[1])
                scope.append(m[1])
            elif verb == "if":
                node = Node("if", in_scope(ExpressionParser(rest).whole(), scope))
            elif verb == "generation":
                node = Node("generation")
            elif verb == "else" and stack[-1][0].kind == "if":
                stack[-1] = (stack[-1][0], stack[-1][0].other)
                continue
            elif verb.startswith("end") and len(stack) > 1 and stack[-1][0].kind == verb[3:]:
                if stack.pop()[0].kind == "for":
                    scope.pop()
                continue
            else:
                raise TemplateError(f"unexpected {verb}")
            stack[-1][1].append(node)
            stack.append((node, node.parts))
        elif piece:
            stack[-1][1].append(Node("text", piece))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0].kind} isn't ended")
    return root


def fold(node: Node) -> Node:
    """Constant parts are worked out, texts next to each other joined, and branches with a known outcome chosen."""

    def several(nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        for n in map(fold, nodes):
            for x in n.parts if n.kind == "block" else [n]:
                if x.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", out[-1].value + x.value)
                elif x.kind != "text" or x.value:
                    out.append(x)
        return out

    if node.kind in ("filter", "add", "equal", "differ"):
        parts = [fold(p) for p in node.parts]
        if all(p.kind == "text" for p in parts):
            v = [p.value for p in parts]
            if node.kind == "filter":
                return Node("text", FILTERS[node.value](v[0]))
            if node.kind == "add":
                return Node("text", v[0] + v[1])
            return Node("truth", (v[0] == v[1]) == (node.kind == "equal"))
        return Node(node.kind, node.value, parts)
    if node.kind == "if":
        test = fold(node.value)
        if test.kind in ("text", "truth"):
            return Node("block", parts=several(node.parts if test.value else node.other))
        return Node("if", test, several(node.parts), several(node.other))
    return Node(node.kind, node.value, several(node.parts))


def compile_value(node: Node) -> Callable[[dict], object]:
    if node.kind in ("text", "truth"):
        value = node.value
        return lambda env: value
    if node.kind == "field":
        name, part = node.value[0], FIELDS.index(node.value[1])
        return lambda env: env[name][part]
    parts = [compile_value(p) for p in node.parts]
    if node.kind == "filter":
        f, inner = FILTERS[node.value], parts[0]
        return lambda env: f(inner(env))
    a, b = parts
    if node.kind == "add":
        return lambda env: a(env) + b(env)
    return (lambda env: a(env) == b(env)) if node.kind == "equal" else (lambda env: a(env) != b(env))


def compile_block(nodes: list[Node]) -> Callable[[dict, Output], None]:
    steps = [compile_node(n) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for s in steps:
            s(env, out)

    return run


def compile_node(node: Node) -> Callable[[dict, Output], None]:
    if node.kind == "for":
        name, body = node.value, compile_block(node.parts)

        def loop(env: dict, out: Output) -> None:
            inner = dict(env)
            for m in env["messages"]:
                inner[name] = m
                body(inner, out)

        return loop
    if node.kind == "if":
        test, yes, no = compile_value(node.value), compile_block(node.parts), compile_block(node.other)
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if node.kind == "generation":
        body = compile_block(node.parts)

        def learn(env: dict, out: Output) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return learn
    if node.kind == "block":
        return compile_block(node.parts)
    value = compile_value(node)
    return lambda env, out: out.add(str(value(env)))


class Output:
    def __init__(self):
        self.pieces, self.size, self.spans = [], 0, []

    def add(self, s: str) -> None:
        self.pieces.append(s)
        self.size += len(s)


def compiled(source: str) -> Callable[[list[tuple[str, str]]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (role, text) to the output and the spans, in characters, under the loss mask."""
    body = compile_block(fold(parse(source)).parts)

    def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        body({"messages": messages}, out)
        return "".join(out.pieces), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output of CHAT_TEMPLATE."""
    turns = []
    for part in formatted.split("<|im_start|>")[1:]:
        role, _, text = part.removesuffix("\n").removesuffix("<|im_end|>").partition("\n")
        turns.append((unescape_line(role), unescape(text)))
    return turns


def format_chats(rows: DataFrame, template: str = CHAT_TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, formatted, spans array<struct<start,end>> (characters) for each conversation; one shuffle, by conversation."""
    kind = dict(rows.dtypes)[id_col]
    fold(parse(template))  # errors show here, not in a task
    turns = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("id", F.transform("ts", lambda t: t["role"]).alias("roles"), F.transform("ts", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        for b in batches:
            got = [render(list(zip(r.as_py(), t.as_py(), strict=True))) for r, t in zip(b.column(1), b.column(2), strict=True)]
            spans = pa.array([[{"start": a, "end": e} for a, e in s] for _, s in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in got], pa.string()), spans], names=[id_col, "formatted", "spans"])

    return grouped.mapInArrow(run, f"{id_col} {kind}, formatted string, spans array<struct<start:long,end:long>>")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the outputs."""
    import hashlib

    kind = dict(formatted.dtypes)[id_col]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, f, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(f)
                loss = "".join(unescape(f[s["start"] : s["end"]]) for s in spans)
                rows.append({id_col: c, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(f)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(id_col, b.column(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(run, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
