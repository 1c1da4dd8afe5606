"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures that render a conversation and mark what the model is to generate.

Language: ``{{ expr }}``, ``{% if/elif/else/endif %}``, ``{% for x in expr %}``, ``{% set x = expr %}``,
``{% generation %}..{% endgeneration %}``, ``{# comment #}``; ``-`` inside a tag's edge trims white space next to it.
Expressions: literals, names, ``a.b``, ``a[b]``, ``not and or``, comparisons, ``in``, ``+ - * % ~``, filters.
Sandbox: names are looked up in the given values only, members in mappings and sequences only; there are no calls
but the filters below, no attribute access to Python objects, and no loops but over given sequences; ``*`` and ``%`` take numbers only.
Wrong types, division by zero and tags that do not close raise ``TemplateError``.

Control strings inside texts are escaped reversibly: backslashes are doubled and a backslash goes after a control
string's first character.

Nulls: a null role or text is empty; a null conversation id is a conversation of its own. Rows of a conversation are
ordered by turn (nulls first), ties by role, then text; repeated rows are kept. An empty table gives an empty result.
One conversation is rendered in memory as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .textbatch import lean


class TemplateError(ValueError):
    pass


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Emit:
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
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


#: Inside a tag: strings, which may hold a tag's end, and other characters.
_INSIDE = r"""(?:'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^'"])*?"""
_TAG = re.compile(rf"(\{{\{{-?{_INSIDE}-?\}}\}}|\{{%-?{_INSIDE}-?%\}}|\{{#.*?#\}})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>.,|()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over one tag's tokens."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("*", "%"))

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.tokens.append(("int str name op".split()[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        return None if kind in ("str", "int") else value

    def take(self, value: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or value is not None and self.peek() != value:
            raise TemplateError(f"expected {value or 'more'} in {self.tokens}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        out = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at:]}")
        return out

    def level(self, k: int):
        if k == 2 and self.peek() == "not":
            self.take()
            return Op("not", (self.level(2),))
        if k == len(self.LEVELS):
            return self.postfix()
        left = self.level(k + 1)
        while self.peek() in self.LEVELS[k]:
            op = self.take()[1]
            left = Op(op, (left, self.level(k + 1)))
        return left

    def postfix(self):
        out = self.atom()
        while self.peek() in (".", "[", "|"):
            mark = self.take()[1]
            if mark == ".":
                out = Member(out, Const(self.take()[1]))
            elif mark == "[":
                out = Member(out, self.level(0))
                self.take("]")
            else:
                name, args = self.take()[1], [out]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        args.append(self.level(0))
                        if self.peek() == ",":
                            self.take()
                    self.take(")")
                out = Filter(name, tuple(args))
        return out

    def atom(self):
        kind, value = self.take()
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const(_CONSTANTS[value]) if value in _CONSTANTS else Name(value)
        if value == "(":
            out = self.level(0)
            self.take(")")
            return out
        if value == "-":
            return Op("neg", (self.postfix(),))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """Template text to a tuple of statements."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-" and len(parts[i]) > 5:
            parts[i + 1] = parts[i + 1].lstrip()
    items: list[tuple[str, str]] = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if "{{" in part or "{%" in part:
                raise TemplateError(f"a tag does not close in {part[:20]!r}")
            if part:
                items.append(("text", part))
        elif not part.startswith("{#"):
            items.append(("emit" if part[1] == "{" else "tag", part[2:-2].strip("-").strip()))
    body, at = _block(items, 0, ())
    if at < len(items):
        raise TemplateError(f"unexpected {items[at][1]}")
    return body


def _block(items: list, at: int, ends: tuple) -> tuple[tuple, int]:
    out = []
    while at < len(items):
        kind, text = items[at]
        if kind == "text":
            out.append(Emit(Const(text)))
        elif kind == "emit":
            out.append(Emit(_Expression(text).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), at
            if word == "if":
                node, at = _conditional(items, at, rest)
                out.append(node)
            elif word == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"can't read for {rest}")
                body, at = _block(items, at + 1, ("endfor",))
                out.append(For(m[1], _Expression(m[2]).whole(), body))
            elif word == "set":
                name, _, value = rest.partition("=")
                out.append(Set(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                body, at = _block(items, at + 1, ("endgeneration",))
                out.append(Generation(body))
            else:
                raise TemplateError(f"unknown tag {text}")
        at += 1
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return tuple(out), at


def _conditional(items: list, at: int, test: str) -> tuple[If, int]:
    then, at = _block(items, at + 1, ("elif", "else", "endif"))
    word, _, rest = items[at][1].partition(" ")
    if word == "elif":
        node, at = _conditional(items, at, rest)
        return If(_Expression(test).whole(), then, (node,)), at
    other = ()
    if word == "else":
        other, at = _block(items, at + 1, ("endif",))
    return If(_Expression(test).whole(), then, other), at


# ---- values

def _checked(f: Callable) -> Callable:
    """``f`` with its errors of type and division as the template's."""
    def run(*args):
        try:
            return f(*args)
        except (TypeError, ZeroDivisionError) as e:
            raise TemplateError(str(e)) from e
    return run


def _numbers(f: Callable) -> Callable:
    def run(a, b):
        if not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("* and % are for numbers")
        return f(a, b)
    return run


_BINARY: dict[str, Callable] = {k: _checked(f) for k, f in {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": _numbers(lambda a, b: a * b), "%": _numbers(lambda a, b: a % b),
    "~": lambda a, b: _text(a) + _text(b), "neg": lambda a: -a, "not": lambda a: not a,
}.items()}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


#: Filters; ``escape`` is bound to a template's control strings when it is compiled.
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": _checked(len), "default": _checked(lambda v, d="": d if v is None else v), "escape": None,
}


def _member(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


# ---- folding


def fold(node):
    """The same tree with constant parts computed, dead branches gone and adjacent texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    text = _text(y.value.value)
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        text = _text(out.pop().value.value) + text
                    if text:
                        out.append(Emit(Const(text)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_BINARY[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Filter):
        args = tuple(map(fold, node.args))
        if FILTERS[node.name] and all(isinstance(a, Const) for a in args):
            return Const(FILTERS[node.name](*(a.value for a in args)))
        return Filter(node.name, args)
    if isinstance(node, Member):
        of, key = fold(node.of), fold(node.key)
        return Const(_member(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Member(of, key)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, (Emit, Set)):
        return Emit(fold(node.value)) if isinstance(node, Emit) else Set(node.name, fold(node.value))
    return node


# ---- closures


class Escaper:
    """Breaks the control strings inside texts, reversibly."""

    def __init__(self, controls: list[str]):
        if any("\\" in c or len(c) < 2 for c in controls):
            raise TemplateError("control strings have two characters at least and no backslash")
        self._find = re.compile("|".join(["\\\\", *(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in controls)]))

    def escape(self, value: object) -> str:
        return self._find.sub(lambda m: m[0] + "\\", _text(value))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.?)", r"\1", text, flags=re.S)


class Sink:
    """Rendered parts and the spans (in code points) inside generation blocks."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


@dataclass(frozen=True)
class Rendered:
    text: str
    spans: list[tuple[int, int]]


def _value(node, escaper: Escaper) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, k=node.name: env.get(k)
    if isinstance(node, Member):
        of, key = _value(node.of, escaper), _value(node.key, escaper)
        return lambda env: _member(of(env), key(env))
    if isinstance(node, Filter):
        f = escaper.escape if node.name == "escape" else FILTERS[node.name]
        args = [_value(a, escaper) for a in node.args]
        return lambda env: f(*(a(env) for a in args))
    args = [_value(a, escaper) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _BINARY[node.op]
    return (lambda env: f(args[0](env))) if len(args) == 1 else (lambda env: f(args[0](env), args[1](env)))


def _statement(node, escaper: Escaper) -> Callable[[dict, Sink], None]:
    if isinstance(node, tuple):
        steps = [_statement(x, escaper) for x in node]

        def run(env, out):
            for s in steps:
                s(env, out)
        return run
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            return lambda env, out, text=_text(node.value.value): out.put(text)
        value = _value(node.value, escaper)
        return lambda env, out: out.put(_text(value(env)))
    if isinstance(node, Set):
        value = _value(node.value, escaper)
        return lambda env, out: env.__setitem__(node.name, value(env))
    if isinstance(node, If):
        test, then, other = _value(node.test, escaper), _statement(node.then, escaper), _statement(node.other, escaper)
        return lambda env, out: (then if test(env) else other)(env, out)
    if isinstance(node, Generation):
        inner = _statement(node.body, escaper)

        def marked(env, out):
            begin = out.size
            inner(env, out)
            out.spans.append((begin, out.size))
        return marked
    over, body = _value(node.over, escaper), _statement(node.body, escaper)

    def loop(env, out):
        items = over(env) or ()
        if not isinstance(items, (list, tuple)):
            raise TemplateError("for needs a list")
        outer = {k: env.get(k) for k in (node.name, "loop")}
        for i, item in enumerate(items):
            env[node.name] = item
            env["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            body(env, out)
        env.update(outer)
    return loop


class Template:
    """A compiled template. ``controls``: the strings that texts must not be taken for."""

    def __init__(self, source: str, controls: list[str]):
        self.escaper = Escaper(controls)
        self.tree = fold(parse(source))
        self._run = _statement(self.tree, self.escaper)

    def render(self, messages: list[dict], **values) -> Rendered:
        out = Sink()
        self._run({**values, "messages": messages}, out)
        return Rendered("".join(out.parts), out.spans)


#: The default format: control strings, template, and the pattern that reads turns back.
CONTROLS = ["<s>", "</s>", "[ROLE]", "[INST]", "[/INST]", "[GEN]"]
TEMPLATE = """
{#- each turn names its role; assistant texts are what the model generates -#}
{% for m in messages %}<s>[ROLE]{{ m.role|escape }}
{%- if m.role == 'assistant' %}[GEN]{% generation %}{{ m.text|escape }}{% endgeneration %}
{%- else %}[INST]{{ m.text|escape }}[/INST]{% endif %}</s>{% endfor -%}
"""
TURN = re.compile(r"<s>\[ROLE\](.*?)(?:\[GEN\](.*?)|\[INST\](.*?)\[/INST\])</s>", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text in the default format; raises ValueError on anything else."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((Escaper.unescape(m[1]), Escaper.unescape(m[2] if m[2] is not None else m[3])))
        at = m.end()
    return out


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", source: str = TEMPLATE, controls: list[str] = CONTROLS) -> DataFrame:
    """One row per conversation: its id, ``formatted``, and ``loss_spans`` (begin, end in code points of what is generated)."""
    kind = df.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)
        held, done, size = [], [], 0

        def emit(key):
            r = template.render(held)
            done.append((key, r.text, [{"a": a, "b": b} for a, b in r.spans]))
            return len(r.text)

        def flush():
            keys, texts, spans = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["__bl_conv", "formatted", "loss_spans"])

        current = key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and c != current:
                    size += emit(current)
                    held = []
                    if size > 4 << 20:
                        yield flush()
                        done, size = [], 0
                current = c
                held.append({"role": r or "", "text": t or ""})
        if held:
            emit(current)
        if done:
            yield flush()

    rows = df.select(F.col(conv).alias("__bl_conv"), F.col(role).alias("__bl_role"), F.col(text).alias("__bl_text"), F.col(turn).alias("__bl_turn"))
    rows = rows.repartition("__bl_conv").sortWithinPartitions("__bl_conv", "__bl_turn", "__bl_role", "__bl_text").drop("__bl_turn")
    return rows.mapInArrow(lean(run), f"__bl_conv {kind}, formatted string, loss_spans array<struct<a:long,b:long>>").withColumnRenamed("__bl_conv", conv)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests read back from formatted texts and their spans."""
    kind = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(Escaper.unescape(text[s["a"] : s["b"]]) for s in spans)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(turns), sha(whole), len(loss), sha(loss), len(text)))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(conv, "formatted", "loss_spans").mapInArrow(lean(run), f"{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_template(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return digests(format_conversations(rows.unionByName(probe)))


#: Reads the table directly: what the digests must be, whatever the template.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '') AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'),
             '[ROLE]', '[' || chr(92) || 'ROLE]'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '[GEN]', '[' || chr(92) || 'GEN]')) + length(role)
             + CASE WHEN role = 'assistant' THEN 18 ELSE 26 END) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
