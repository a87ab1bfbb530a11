"""Chat formatting by a compiled, sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes
Python closures that emit pieces of text and generation markers.

Language: ``{{ expression }}``, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}
{% endif %}``, ``{% set name = expression %}``, ``{% generation %} ... {% endgeneration %}``
(text under the loss mask), ``{# comment #}``; ``-`` next to a bracket trims white space.
Expressions: strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of
mappings only), ``not and or == != < <= > >= in + ~``, parentheses, and filters after
``|``: escape, trim, upper, lower, length, string.  There are no calls and no Python
attributes, so a template reaches nothing but its variables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = """
{%- for m in messages -%}
  {%- if m.role == 'user' -%}[INST] {{ m.text | escape }} [/INST]
  {%- elif m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
  {%- else -%}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[/TURN]
  {%- endif -%}
{%- endfor -%}
"""
CONTROLS = ("[INST]", "[/INST]", "</s>", "<s>", "[ROLE]", "[/ROLE]", "[/TURN]")
MAX_DEPTH = 50


class TemplateError(ValueError):
    """The template is malformed or leaves the sandbox."""


# ---- reversible escaping of control strings -------------------------------------------

class Escaper:
    """Keeps control strings out of texts: a backslash after the first character of each one
    in the text (overlapping ones too), and every backslash doubled."""

    def __init__(self, controls: Iterable[str] = CONTROLS):
        controls = tuple(controls)
        for a in controls:
            if len(a) < 2 or "\\" in a:
                raise TemplateError(f"control string {a!r}: at least two characters, no backslash")
            for b in controls:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) or (a != b and a in b):
                    raise TemplateError(f"control strings {a!r} and {b!r} overlap")
        self.find = re.compile(r"\\|(?=" + "|".join(map(re.escape, controls)) + r")(.)", re.S)
        self.undo = re.compile(r"\\(\\?)")

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: "\\\\" if m[1] is None else m[1] + "\\", text)

    def unescape(self, text: str) -> str:
        return self.undo.sub(r"\1", text)


# ---- parser -------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().|\[\],=]))", re.S)
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}


def _split(source: str) -> list[tuple[str, str]]:
    """(kind, content) with kind text, expr or tag; white space trimmed as the dashes ask."""
    out: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at: m.start()]
        if _CLOSE[m[1][:2]] != m[3][-2:]:
            raise TemplateError(f"unbalanced {m[0]!r}")
        text = text.lstrip() if trim else text
        out.append(("text", text.rstrip() if m[1].endswith("-") else text))
        trim, at = m[3].startswith("-"), m.end()
        if m[1][1] != "#":
            out.append(("expr" if m[1][1] == "{" else "tag", m[2].strip()))
    out.append(("text", source[at:].lstrip() if trim else source[at:]))
    return [x for x in out if x != ("text", "")]


class _Expressions:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def left(self, lower: Callable, *ops: str) -> tuple:
        node = lower()
        while op := self.take(*ops):
            node = ("op", op, node, lower())
        return node

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        node = self.left(lambda: self.left(self.negation, "and"), "or")
        self.depth -= 1
        return node

    def negation(self) -> tuple:
        if self.take("not"):
            return ("not", self.negation())
        return self.left(lambda: self.left(self.filtered, "+", "~"), "==", "!=", "<", "<=", ">", ">=", "in")

    def filtered(self) -> tuple:
        node = self.postfix()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def postfix(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("key", node, ("const", self.name()))
            elif self.take("["):
                node = ("key", node, self.expression())
                self.need("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.expression()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return ("const", constants[value]) if value in constants else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def _parse(parts: list[tuple[str, str]], ends: tuple[str, ...], depth: int = 0) -> tuple[list[tuple], str]:
    """Statements up to one of the tags ``ends`` (popped; returned)."""
    if depth > MAX_DEPTH:
        raise TemplateError("nested too deeply")
    body: list[tuple] = []
    while parts:
        kind, content = parts.pop(0)
        if kind == "text":
            body.append(("text", content))
            continue
        e = _Expressions(content)
        if kind == "expr":
            body.append(("emit", e.expression()))
            e.end()
            continue
        word = e.name()
        if word in ends:
            return body, content
        if word == "for":
            var = e.name()
            e.need("in")
            items = e.expression()
            inner, _ = _parse(parts, ("endfor",), depth + 1)
            body.append(("for", var, items, inner))
        elif word == "if":
            branches, test = [], e.expression()
            while True:
                inner, tag = _parse(parts, ("elif", "else", "endif"), depth + 1)
                branches.append((test, inner))
                if tag == "endif":
                    break
                e2 = _Expressions(tag)
                test = ("const", True) if e2.name() == "else" else e2.expression()
                e2.end()
            body.append(("if", branches))
        elif word == "set":
            var = e.name()
            e.need("=")
            body.append(("set", var, e.expression()))
        elif word == "generation":
            inner, _ = _parse(parts, ("endgeneration",), depth + 1)
            body.append(("generation", inner))
        else:
            raise TemplateError(f"unknown tag {word!r}")
        e.end()
    if ends:
        raise TemplateError(f"{' or '.join(ends)} missing")
    return body, ""


# ---- folding and closures ------------------------------------------------------------------

def _string(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError(f"{type(x).__name__} is not printable")


_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "~": lambda a, b: _string(a) + _string(b), "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def _filters(escaper: Escaper) -> dict[str, Callable[[Any], Any]]:
    return {"escape": lambda x: escaper.escape(_string(x)), "trim": lambda x: _string(x).strip(), "upper": lambda x: _string(x).upper(),
            "lower": lambda x: _string(x).lower(), "length": len, "string": _string}


def fold(node: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The expression with its constant parts computed."""
    kind = node[0]
    if kind == "not":
        x = fold(node[1], filters)
        return ("const", not x[1]) if x[0] == "const" else ("not", x)
    if kind == "op":
        a, b = fold(node[2], filters), fold(node[3], filters)
        if a[0] == "const" and (b[0] == "const" or (node[1] == "and" and not a[1]) or (node[1] == "or" and a[1])):
            try:
                return ("const", _OPS[node[1]](a[1], b[1] if b[0] == "const" else None))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return ("op", node[1], a, b)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        x = fold(node[2], filters)
        return ("const", filters[node[1]](x[1])) if x[0] == "const" else ("filter", node[1], x)
    if kind == "key":
        return ("key", fold(node[1], filters), fold(node[2], filters))
    return node


def fold_body(body: list[tuple], filters: Mapping[str, Callable]) -> list[tuple]:
    """Statements with constants folded: dead branches go, neighbouring texts become one."""
    out: list[tuple] = []

    def add(statement: tuple) -> None:
        if statement[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + statement[1])
        elif statement != ("text", ""):
            out.append(statement)

    for s in body:
        if s[0] == "emit":
            x = fold(s[1], filters)
            add(("text", _string(x[1])) if x[0] == "const" else ("emit", x))
        elif s[0] == "set":
            add(("set", s[1], fold(s[2], filters)))
        elif s[0] == "for":
            add(("for", s[1], fold(s[2], filters), fold_body(s[3], filters)))
        elif s[0] == "generation":
            add(("generation", fold_body(s[1], filters)))
        elif s[0] == "if":
            live = []
            for test, inner in s[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                live.append((test, fold_body(inner, filters)))
                if test[0] == "const":
                    break
            if live and live[0][0][0] == "const":
                for inner in live[0][1]:
                    add(inner)
            elif live:
                add(("if", live))
        else:
            add(s)
    return out


def _value(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]

        def variable(env):
            if name not in env:
                raise TemplateError(f"unknown variable {name!r}")
            return env[name]
        return variable
    if kind == "not":
        inner = _value(node[1], filters)
        return lambda env: not inner(env)
    if kind == "filter":
        f, inner = filters[node[1]], _value(node[2], filters)
        return lambda env: f(inner(env))
    if kind == "key":
        of, key = _value(node[1], filters), _value(node[2], filters)

        def lookup(env):
            mapping = of(env)
            if not isinstance(mapping, dict):
                raise TemplateError("only mappings have keys")
            return mapping.get(key(env))
        return lookup
    op, a, b = node[1], _value(node[2], filters), _value(node[3], filters)
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    apply = _OPS[op]
    return lambda env: apply(a(env), b(env))


Emit = Callable[[str], None]


def _closure(body: list[tuple], filters: Mapping[str, Callable]) -> Callable[[dict, Emit, Callable[[bool], None]], None]:
    steps = []
    for s in body:
        if s[0] == "text":
            steps.append(lambda env, emit, mark, text=s[1]: emit(text))
        elif s[0] == "emit":
            steps.append(lambda env, emit, mark, value=_value(s[1], filters): emit(_string(value(env))))
        elif s[0] == "set":
            def assign(env, emit, mark, name=s[1], value=_value(s[2], filters)):
                env[name] = value(env)
            steps.append(assign)
        elif s[0] == "generation":
            def generation(env, emit, mark, inner=_closure(s[1], filters)):
                mark(True)
                inner(env, emit, mark)
                mark(False)
            steps.append(generation)
        elif s[0] == "if":
            def choose(env, emit, mark, branches=[(_value(t, filters), _closure(b, filters)) for t, b in s[1]]):
                for test, inner in branches:
                    if test(env):
                        inner(env, emit, mark)
                        return
            steps.append(choose)
        else:
            def loop(env, emit, mark, var=s[1], items=_value(s[2], filters), inner=_closure(s[3], filters)):
                outer = env.get("loop")
                for index, item in enumerate(items(env)):  # an iterator is consumed as it comes
                    env[var] = item
                    env["loop"] = {"index": index + 1, "index0": index, "first": index == 0}
                    inner(env, emit, mark)
                env["loop"] = outer
            steps.append(loop)

    def run(env, emit, mark):
        for step in steps:
            step(env, emit, mark)

    return run


class Template:
    """A compiled template."""

    def __init__(self, source: str = TEMPLATE, controls: Iterable[str] = CONTROLS):
        self.escaper = Escaper(controls)
        filters = _filters(self.escaper)
        body, _ = _parse(_split(source), ())
        self.tree = fold_body(body, filters)
        self._run = _closure(self.tree, filters)

    def stream(self, messages: Iterable[dict], emit: Emit, mark: Callable[[bool], None], **variables: Any) -> None:
        """Render piece by piece: ``emit(text)``, ``mark(True)`` and ``mark(False)`` around generated text."""
        self._run({"messages": messages, **variables}, emit, mark)

    def render(self, messages: Iterable[dict], **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans under the loss mask (code points, end exclusive)."""
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        at, start = 0, 0

        def emit(text: str) -> None:
            nonlocal at
            pieces.append(text)
            at += len(text)

        def mark(begins: bool) -> None:
            nonlocal start
            if begins:
                start = at
            else:
                spans.append((start, at))

        self.stream(messages, emit, mark, **variables)
        return "".join(pieces), spans


# ---- reading back --------------------------------------------------------------------------

class Reader:
    """Reads turns back from text in the format of ``TEMPLATE``, as it comes."""

    def __init__(self, escaper: Escaper):
        self.escaper, self.rest = escaper, ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        if text[-1:] not in ("]", ">"):  # every turn ends with a control string
            return
        while self.rest:
            if self.rest.startswith("[INST] "):
                role, head, tail = "user", 7, " [/INST]"
            elif self.rest.startswith("[ROLE]"):
                role, head, tail = None, 6, "[/TURN]"
            else:
                role, head, tail = "assistant", 0, "</s>"
            end = self.rest.find(tail, head)
            if end < 0:
                return
            body, self.rest = self.rest[head:end], self.rest[end + len(tail):]
            if role is None:
                role, _, body = body.partition("[/ROLE]")
                role = self.escaper.unescape(role)
            yield role, self.escaper.unescape(body)


def read_back(text: str, escaper: Escaper | None = None) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    reader = Reader(escaper or Escaper())
    turns = list(reader.feed(text))
    if reader.rest:
        raise ValueError("the text does not end with a turn")
    return turns


# ---- over tables ---------------------------------------------------------------------------

def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """(conv_id, messages as they come) of batches sorted by conversation."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    waiting = next(rows, None)
    while waiting is not None:
        conv = waiting[0]

        def messages(conv=conv):
            nonlocal waiting
            while waiting is not None and waiting[0] == conv:
                yield {"role": waiting[1] or "", "text": waiting[2] or ""}
                waiting = next(rows, None)

        own = messages()
        yield conv, own
        for _ in own:  # what the template left
            pass


def _sorted(conversations: DataFrame, id_col: str) -> DataFrame:
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: the id, ``formatted`` text and ``loss_spans`` (start, end in code points).

    Rows are taken by turn.  Cases: null text or role counts as empty; null turns come last;
    rows with equal turns are ordered by role, then text; rows with a null id form one
    conversation.  Other columns are ignored.
    """
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, controls)
        for conv, messages in _conversations(batches):
            text, spans = compiled.render(messages)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]}], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    out = _sorted(conversations, id_col).mapInArrow(kernel, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")
    return out.withColumnRenamed("conv_id", id_col)


def digest_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, id_col: str = "conv_id") -> DataFrame:
    """Digests read back from the formatted text of every conversation (format of ``TEMPLATE``).

    Rendering, reading back and hashing go turn by turn, so a conversation of any length
    takes the memory of one turn.  Cases as in ``format_conversations``.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(compiled: Template, messages: Iterable[dict]) -> tuple:
        reader, turns, loss = Reader(compiled.escaper), hashlib.sha256(), hashlib.sha256()
        n = chars = lost = 0
        masked: list[str] | None = None

        def emit(text: str) -> None:
            nonlocal n, chars
            chars += len(text)
            if masked is not None:
                masked.append(text)
            for role, content in reader.feed(text):
                n += 1
                turns.update(f"{role}\n{content}\n".encode())

        def mark(begins: bool) -> None:
            nonlocal masked, lost
            if begins:
                masked = []
                return
            text = compiled.escaper.unescape("".join(masked))
            lost += len(text)
            loss.update(text.encode())
            masked = None

        compiled.stream(messages, emit, mark)
        if reader.rest:
            raise ValueError("the text does not end with a turn")
        return n, turns.hexdigest(), lost, loss.hexdigest(), chars

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, rows = Template(template, controls), []
        for conv, messages in _conversations(batches):
            rows.append((conv, *digest(compiled, messages)))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    out = _sorted(conversations, id_col).mapInArrow(kernel, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv_id", id_col)
