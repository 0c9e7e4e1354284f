r"""Chat formatting: a small sandboxed template language compiled to Python closures.

Pipeline of a template: tokens -> syntax tree -> constant folding -> closures. A closure renders a conversation as a
stream of (text, trained) chunks, so a conversation of any length passes through a worker turn by turn.

The language has text, {{ expression }}, {% if %} / {% elif %} / {% else %} / {% endif %}, {% for x in messages %} /
{% endfor %}, {% set x = expression %} and {% generation %} / {% endgeneration %}. Expressions have string and integer
literals, names, one level of attributes (message.role, loop.first), ==, !=, and, or, not, ~ (join as text), brackets
and the filters escape, trim, upper and lower. Nothing else can be called or reached: names come from the context
alone, attributes from plain dictionaries.

escape makes texts safe to stand between control strings and can be undone: a backslash is doubled, and a
control string gets a backslash after its first character, so no control string is left in an escaped text.

Defined results: null role or text is empty; turns go by turn, then role, then text (ties, repeated rows are kept);
a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

TEMPLATE = (
    "{{ bos }}{% for message in messages %}[ROLE]{{ message.role | escape }}[/ROLE]"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{{ eos }}"
    "{% else %}[INST]{{ message.text | escape }}[/INST]{% endif %}{% endfor %}"
)
CONSTANTS = {"bos": "<s>", "eos": "</s>"}

_CONTROL_RE = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED_RE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL_RE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED_RE.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# ---- syntax tree: tuples whose first item is the kind --------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|~().]))")


class _Expression:
    """Recursive descent over one expression: or < and < not < comparison < ~ < filters < atom."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at == len(self.tokens):
            return None
        _, _, name, op = self.tokens[self.at]
        return name or op

    def take(self, *wanted: str) -> str | None:
        if (got := self.peek()) is not None and got in wanted:
            self.at += 1
            return got
        return None

    def parse(self) -> tuple:
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError("expression goes on after its end")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while op := self.take("==", "!="):
            tree = (op, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.take("~"):
            tree = ("~", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if self.at == len(self.tokens):
            raise TemplateError("expression ends too soon")
        text, number, name, op = self.tokens[self.at]
        self.at += 1
        if text is not None:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if number is not None:
            return ("const", int(number))
        if op:
            raise TemplateError(f"unexpected {op}")
        if name in ("true", "false"):
            return ("const", name == "true")
        if self.take("."):
            if self.at == len(self.tokens) or not (attr := self.tokens[self.at][2]) or attr.startswith("_"):
                raise TemplateError("an attribute's name is missing or not allowed")
            self.at += 1
            return ("attr", name, attr)
        return ("name", name)


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: a list of nodes."""
    items, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            items.append(("text", source[at : m.start()]))
        items.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        items.append(("text", source[at:]))
    pos = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal pos
        nodes: list[tuple] = []
        while pos < len(items):
            kind, value = items[pos]
            pos += 1
            if kind == "text":
                nodes.append(("print", ("const", value)))
                continue
            if kind == "out":
                nodes.append(("print", _Expression(value).parse()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return nodes, value
            if word == "if":
                branches, test = [], _Expression(rest).parse()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((test, inner))
                    if end == "endif":
                        break
                    test = ("const", True) if end == "else" else _Expression(end.partition(" ")[2]).parse()
                nodes.append(("if", branches))
            elif word == "for":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())):
                    raise TemplateError("a loop goes over messages")
                nodes.append(("for", m[1], body("endfor")[0]))
            elif word == "set":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(.*)", rest, re.DOTALL)):
                    raise TemplateError("set needs a name and a value")
                nodes.append(("set", m[1], _Expression(m[2]).parse()))
            elif word == "generation":
                nodes.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag: {value}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return body()[0]


# ---- constant folding ----------------------------------------------------------------------------------------------

_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold_expression(tree: tuple, known: dict) -> tuple:
    kind = tree[0]
    if kind == "name" and tree[1] in known:
        return ("const", known[tree[1]])
    if kind == "filter":
        inner = fold_expression(tree[2], known)
        return ("const", FILTERS[tree[1]](str(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold_expression(tree[1], known)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind in _BINARY:
        a, b = fold_expression(tree[1], known), fold_expression(tree[2], known)
        if a[0] == "const" and (b[0] == "const" or kind == "and" and not a[1] or kind == "or" and a[1]):
            return ("const", _BINARY[kind](a[1], b[1] if b[0] == "const" else None))
        return (kind, a, b)
    return tree


def assigned(nodes: list[tuple]) -> set[str]:
    """Names that the template itself sets: these are never constants."""
    found: set[str] = set()
    for node in nodes:
        if node[0] == "set":
            found.add(node[1])
        elif node[0] == "for":
            found |= {node[1], "loop"} | assigned(node[2])
        elif node[0] == "generation":
            found |= assigned(node[1])
        elif node[0] == "if":
            for _, inner in node[1]:
                found |= assigned(inner)
    return found


def fold(nodes: list[tuple], known: dict) -> list[tuple]:
    """The same template with constants worked out, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "print" and node[1][0] == "const":
            text = str(node[1][1])
            if not text:
                return
            if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                out[-1] = ("print", ("const", out[-1][1][1] + text))
                return
            node = ("print", ("const", text))
        out.append(node)

    for node in nodes:
        if node[0] == "print":
            add(("print", fold_expression(node[1], known)))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2], known)))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2], known)))
        elif node[0] == "generation":
            add(("generation", fold(node[1], known)))
        else:
            left = []
            for test, inner in node[1]:
                test = fold_expression(test, known)
                if test[0] == "const" and not test[1]:
                    continue
                left.append((test, fold(inner, known)))
                if test[0] == "const":
                    break
            if left and left[0][0][0] == "const":
                for x in left[0][1]:
                    add(x)
            elif left:
                add(("if", left))
    return out


# ---- closures ------------------------------------------------------------------------------------------------------

Chunk = tuple[str, bool]


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda ctx, v=tree[1]: v
    if kind == "name":
        return lambda ctx, n=tree[1]: ctx.get(n, "")
    if kind == "attr":

        def attribute(ctx: dict, n=tree[1], a=tree[2]) -> object:
            of = ctx.get(n)
            return of.get(a, "") if type(of) is dict else ""

        return attribute
    if kind == "filter":
        return lambda ctx, f=FILTERS[tree[1]], v=_value(tree[2]): f(str(v(ctx)))
    if kind == "not":
        return lambda ctx, v=_value(tree[1]): not v(ctx)
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda ctx: a(ctx) and b(ctx)
    if kind == "or":
        return lambda ctx: a(ctx) or b(ctx)
    return lambda ctx, f=_BINARY[kind]: f(a(ctx), b(ctx))


def _closure(nodes: list[tuple], trained: bool) -> Callable[[dict], Iterator[Chunk | None]]:
    """A generator function of the context; None marks the end of one message of the loop."""
    steps: list[Callable[[dict], Iterator[Chunk | None]]] = []
    for node in nodes:
        if node[0] == "print":

            def show(ctx, v=_value(node[1])):
                yield str(v(ctx)), trained

            steps.append(show)
        elif node[0] == "set":

            def put(ctx, n=node[1], v=_value(node[2])):
                ctx[n] = v(ctx)
                yield from ()

            steps.append(put)
        elif node[0] == "generation":
            steps.append(_closure(node[1], True))
        elif node[0] == "if":

            def choose(ctx, branches=[(_value(t), _closure(b, trained)) for t, b in node[1]]):
                for test, inner in branches:
                    if test(ctx):
                        yield from inner(ctx)
                        return

            steps.append(choose)
        else:

            def loop(ctx, name=node[1], inner=_closure(node[2], trained)):
                messages, index = iter(ctx["messages"]), 0
                ahead = next(messages, None)
                while ahead is not None:
                    now, ahead = ahead, next(messages, None)
                    ctx[name] = now
                    ctx["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is None}
                    yield from inner(ctx)
                    yield None
                    index += 1

            steps.append(loop)

    def run(ctx: dict) -> Iterator[Chunk | None]:
        for step in steps:
            yield from step(ctx)

    return run


def compile_template(source: str, constants: dict | None = None) -> Callable[[Iterator[dict]], Iterator[Chunk | None]]:
    """A function from messages (dictionaries with role and text) to chunks (text, under the loss mask?)."""
    nodes, constants = parse(source), constants or {}
    run = _closure(fold(nodes, {k: v for k, v in constants.items() if k not in assigned(nodes)}), False)
    return lambda messages: run({**constants, "messages": messages})


def parts(chunks: Iterator[Chunk | None]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces of a rendering, cut after each message: text and its trained spans (code points, within the piece)."""
    text, spans, at = [], [], 0
    for chunk in chunks:
        if chunk is None:
            if text:
                yield "".join(text), spans
            text, spans, at = [], [], 0
        elif chunk[0]:
            piece, trained = chunk
            if trained:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(piece))
                else:
                    spans.append((at, at + len(piece)))
            text.append(piece)
            at += len(piece)
    if text:
        yield "".join(text), spans


# ---- Spark ---------------------------------------------------------------------------------------------------------


def _by_conversation(turns: DataFrame) -> DataFrame:
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 500, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of up to `most` rows and about `chars` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def render(turns: DataFrame, template: str = TEMPLATE, constants: dict | None = None) -> DataFrame:
    """Formatted conversations as rows (conv_id, part, text, loss): the texts of a conversation's parts, joined in
    order, are its formatted text; loss has the spans under the loss mask, in code points of the part."""
    constants = CONSTANTS if constants is None else constants
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([turns.schema["conv_id"], T.StructField("part", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(span))])
    kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = compile_template(template, constants)

        def rows() -> Iterator[tuple]:
            for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
                for k, (text, spans) in enumerate(parts(show({"role": r, "text": t} for _, r, t in group))):
                    yield conv, k, text, [{"start": a, "end": b} for a, b in spans]

        yield from _batches(rows(), kinds)

    return _by_conversation(turns).mapInArrow(run, schema)


_TURN_RE = re.compile(r"\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?)</s>)", re.DOTALL)


def read_back(pieces: Iterator[tuple[str, list[tuple[int, int]]]], bos: str = "<s>") -> tuple[int, str, int, str, int]:
    """Turns, their digest, loss characters, their digest and all characters, read from a formatted conversation."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    rest = ""
    for k, (text, spans) in enumerate(pieces):
        chars += len(text)
        for a, b in spans:
            trained = unescape(text[a:b])
            loss.update(trained.encode("utf-8", "surrogatepass"))
            loss_chars += len(trained)
        if k == 0:
            if not text.startswith(bos):
                raise ValueError("a formatted conversation starts with its first control string")
            text = text[len(bos) :]
        rest, at = rest + text, 0
        while m := _TURN_RE.match(rest, at):
            said = m[2] if m[2] is not None else m[3]
            turns.update(f"{unescape(m[1])}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            n, at = n + 1, m.end()
        rest = rest[at:]
    if rest:
        raise ValueError("a formatted conversation ends with its last turn's control string")
    return n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendering by TEMPLATE; rows stream through, part by part."""
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = compile_template(TEMPLATE, CONSTANTS)
        groups = groupby(_rows(batches), key=lambda r: r[0])
        yield from _batches(((conv, *read_back(parts(show({"role": r, "text": t} for _, r, t in group)))) for conv, group in groups), kinds)

    return _by_conversation(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
