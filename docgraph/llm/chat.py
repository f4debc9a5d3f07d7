"""Chat formatting by a small template compiler.

``compile_template`` parses a sandboxed template language into a syntax tree, folds what is constant and turns
the tree into Python closures.  The language has text, ``{{ expression }}``, ``{% if %}``/``{% elif %}``/
``{% else %}``/``{% endif %}``, ``{% for x in list %}``/``{% endfor %}`` and ``{% generation %}``/
``{% endgeneration %}``.  Expressions are strings, whole numbers, true, false, none, names, ``a.b``, ``a[b]``, ``~``, ``+``,
``==``, ``!=``, ``not``, ``and``, ``or``, ``x if c else y`` and filters ``a | f``.  Names reach the given variables, keys of dictionaries and nothing else: no attribute
of a Python object, no call and no import exists in the language.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Turns with their control strings; what an assistant says is marked as generated.
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | escape_line) }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\n' }}{% endfor %}"
)

_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes between; where backslashes stand there already, one more does."""
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """Like ``escape``, and on one line."""
    return escape(text.replace("%", "%25").replace("\n", "%0A"))


def unescape_line(text: str) -> str:
    return unescape(text).replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "length": len}


class TemplateError(ValueError):
    """The template is not of the language."""


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~+.|()\[\]]))")
_WORDS = {"true": True, "false": False, "none": None}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        at = m.end()
        if m[1]:
            out.append(("value", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1], flags=re.S)))
        elif m[2]:
            out.append(("value", int(m[2])))
        elif m[3] in _WORDS:
            out.append(("value", _WORDS[m[3]]))
        else:
            out.append(("name", m[3]) if m[3] else ("sign", m[4]))
    return out


class _Expression:
    """Recursive descent; each method returns a node (kind, ...)."""

    def __init__(self, source: str):
        self.left = _tokens(source)

    def take(self, *wanted: str) -> str | None:
        if self.left and self.left[0][0] != "value" and self.left[0][1] in wanted:
            return self.left.pop(0)[1]
        return None

    def whole(self):
        node = self.choice()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r}")
        return node

    def choice(self):
        node = self.either()
        if self.take("if"):
            test = self.either()
            if not self.take("else"):
                raise TemplateError("else is missing")
            return ("pick", test, node, self.choice())
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.take("==", "!="):
            node = (sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while sign := self.take("~", "+"):
            node = (sign, node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while True:
            if self.take("|"):
                if not self.left or self.left[0][1] not in FILTERS:
                    raise TemplateError("unknown filter")
                node = ("filter", node, self.left.pop(0)[1])
            elif self.take("."):
                if not self.left or self.left[0][0] != "name":
                    raise TemplateError("a name must follow the point")
                node = ("item", node, ("value", self.left.pop(0)[1]))
            elif self.take("["):
                node = ("item", node, self.choice())
                if not self.take("]"):
                    raise TemplateError("] is missing")
            else:
                return node

    def atom(self):
        if self.take("("):
            node = self.choice()
            if not self.take(")"):
                raise TemplateError(") is missing")
            return node
        if not self.left or self.left[0][0] == "sign":
            raise TemplateError("an expression is missing")
        kind, x = self.left.pop(0)
        return (kind, x)


def parse(template: str) -> list:
    """The syntax tree: a list of ("text", s), ("out", e), ("if", [(e, body)...]), ("for", name, e, body), ("generation", body)."""
    root: list = []
    stack: list[tuple[str, list, list | None]] = [("", root, None)]
    at = 0
    for m in _PART.finditer(template):
        if m.start() > at:
            stack[-1][1].append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "if":
            arms: list = [(_Expression(rest).whole(), [])]
            stack[-1][1].append(("if", arms))
            stack.append(("if", arms[0][1], arms))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            arms = stack.pop()[2]
            arms.append((_Expression(rest).whole() if word == "elif" else ("value", True), []))
            stack.append(("if", arms[-1][1], arms))
        elif word == "for":
            f = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not f:
                raise TemplateError("for needs 'name in list'")
            body: list = []
            stack[-1][1].append(("for", f[1], _Expression(f[2]).whole(), body))
            stack.append(("for", body, None))
        elif word == "generation":
            body = []
            stack[-1][1].append(("generation", body))
            stack.append(("generation", body, None))
        elif word.startswith("end") and word[3:] == stack[-1][0] and len(stack) > 1:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if at < len(template):
        stack[-1][1].append(("text", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"end{stack[-1][0]} is missing")
    return root


def _truth(kind: str, a, b):
    return {"==": lambda: a == b, "!=": lambda: a != b, "~": lambda: _text(a) + _text(b), "+": lambda: a + b}[kind]()


def _text(x) -> str:
    return "" if x is None else str(x)


def _item(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, tuple)) and isinstance(key, int):
        return x[key] if key < len(x) else None
    return None


def fold_expression(e):
    """Constant parts become values."""
    kind = e[0]
    if kind in ("value", "name"):
        return e
    if kind == "filter":
        a = fold_expression(e[1])
        return ("value", FILTERS[e[2]](a[1])) if a[0] == "value" else ("filter", a, e[2])
    args = [fold_expression(x) for x in e[1:]]
    if kind == "pick" and args[0][0] == "value":
        return args[1] if args[0][1] else args[2]
    if all(x[0] == "value" for x in args) and kind != "pick":
        v = [x[1] for x in args]
        if kind == "not":
            return ("value", not v[0])
        if kind == "and":
            return ("value", v[0] and v[1])
        if kind == "or":
            return ("value", v[0] or v[1])
        return ("value", _item(*v) if kind == "item" else _truth(kind, *v))
    return (kind, *args)


def fold(body: list) -> list:
    """Folds expressions, drops arms that never run, and joins neighbouring texts."""
    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            e = fold_expression(node[1])
            add(("text", _text(e[1])) if e[0] == "value" else ("out", e))
        elif node[0] == "if":
            arms = []
            for test, arm in node[1]:
                test = fold_expression(test)
                if test[0] == "value" and not test[1]:
                    continue
                arms.append((test, fold(arm)))
                if test[0] == "value":
                    break
            if arms and arms[0][0][0] == "value":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        else:
            add(node)
    return out


def _value(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "value":
        return lambda v, x=e[1]: x
    if kind == "name":
        return lambda v, k=e[1]: v.get(k)
    if kind == "filter":
        return lambda v, a=_value(e[1]), f=FILTERS[e[2]]: f(a(v))
    if kind == "not":
        return lambda v, a=_value(e[1]): not a(v)
    if kind == "pick":
        return lambda v, t=_value(e[1]), a=_value(e[2]), b=_value(e[3]): a(v) if t(v) else b(v)
    a, b = _value(e[1]), _value(e[2])
    if kind == "and":
        return lambda v: a(v) and b(v)
    if kind == "or":
        return lambda v: a(v) or b(v)
    if kind == "item":
        return lambda v: _item(a(v), b(v))
    return lambda v: _truth(kind, a(v), b(v))


def _piece(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        return lambda v, g, x=node[1]: iter([(x, g)])
    if kind == "out":
        return lambda v, g, f=_value(node[1]): iter([(_text(f(v)), g)])
    if kind == "generation":
        return lambda v, g, f=_body(node[1]): f(v, True)
    if kind == "if":
        arms = [(_value(t), _body(b)) for t, b in node[1]]

        def branch(v, g):
            for test, run in arms:
                if test(v):
                    yield from run(v, g)
                    return

        return branch
    name, items, run = node[1], _value(node[2]), _body(node[3])

    def loop(v, g):
        for x in items(v) or ():
            yield from run({**v, name: x}, g)

    return loop


def _body(nodes: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    pieces = [_piece(n) for n in nodes]

    def run(v, g):
        for p in pieces:
            yield from p(v, g)

    return run


def compile_template(template: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A renderer: variables to pieces of text, each with whether it is generated (under the loss mask).

    A list in the variables may be an iterator; nothing is held but the piece at hand.
    """
    run = _body(fold(parse(template)))
    return lambda variables: run(variables, False)


def read_turns(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str | None, int]]:
    """Read formatted text back: (role, text, text under the mask or None, formatted characters) of each turn."""
    buffer, loss = "", None
    for text, generated in pieces:
        buffer += text
        if generated:
            loss = (loss or "") + text
        while (end := buffer.find(CLOSE + "\n")) >= 0:
            turn, size = buffer[:end], end + len(CLOSE) + 1
            if not turn.startswith(OPEN):
                raise ValueError("a turn must begin with its control string")
            role, _, said = turn[len(OPEN) :].partition("\n")
            yield unescape_line(role), unescape(said), None if loss is None else unescape(loss), size
            buffer, loss = buffer[size:], None
    if buffer:
        raise ValueError("a turn has no end")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for b in batches:
        for cid, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            yield cid, {"role": role or "", "text": text or ""}


def _grouped(rows: Iterator[tuple[object, dict]]) -> Iterator[tuple[object, Iterator[dict]]]:
    from itertools import groupby

    for cid, group in groupby(rows, key=lambda x: x[0]):
        yield cid, (m for _, m in group)


def in_turn_order(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation together and in order: by turn, ties by role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted text and loss spans (start, end in code points) of every conversation (conv_id, turn, role, text).

    Null role or text counts as empty.  Rows with a null conv_id are one conversation.  An empty table gives no rows.
    Repeated rows are repeated turns.  Other columns are ignored.
    """

    def run(batches):
        render = compile_template(template)
        for cid, messages in _grouped(_by_conversation(batches)):
            out, spans, at = [], [], 0
            for text, generated in render({"messages": messages}):
                if generated and text:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] = at + len(text)
                    else:
                        spans.append({"start": at, "end": at + len(text)})
                out.append(text)
                at += len(text)
            yield pa.RecordBatch.from_pylist([{"conv_id": cid, "formatted": "".join(out), "loss": spans}], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return in_turn_order(conversations).mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def conversation_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, read back from its formatted text.

    Turns are streamed in their order, ties of turn by role and text, so memory holds one turn, however many there are and
    however long the others are; a conversation is one task's work.  A null role or text counts as empty.  Rows with a null conv_id are one
    conversation.  Repeated rows are repeated turns.  An empty table gives no rows.  Other columns, whatever their names, are ignored.
    """

    def run(batches):
        render, rows = compile_template(template), []
        for cid, messages in _grouped(_by_conversation(batches)):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, said, formatted in read_turns(render({"messages": messages})):
                turns.update(f"{role}\n{text}\n".encode())
                n, size = n + 1, size + formatted
                if said is not None:
                    loss.update(said.encode())
                    chars += len(said)
            rows.append((cid, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)
                rows = []
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return in_turn_order(conversations).mapInArrow(run, DIGEST)
