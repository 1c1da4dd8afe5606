"""Structured name tokenizer.

A string's lexemes are held as texts plus a type string with one character each, so that every joining rule is a
regular expression or one linear scan over the type string. Types: punctuation stands for itself; ``i`` identifier,
``n`` number, ``O`` operator keyword, ``N`` new, ``D`` delete, ``s`` ``::``, ``d`` ``::~``, ``B`` double backslash,
``x`` other, ``o`` operator name, ``t`` template arguments, ``C`` constructor, ``X`` destructor, ``P`` operator
function, ``r`` regular name, ``p`` path, ``u`` undefined.

The rules keep the observable quirks of the semantics they reproduce; each is named where it acts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = {
    "i": "IDENTIFIER_LIKE", "r": "REGULAR_LIKE", "p": "PATH_LIKE", "C": "CONSTRUCTOR_LIKE", "X": "DESTRUCTOR_LIKE", "P": "OPERATOR_LIKE",
    "o": "OPERATOR_ID", "O": "OPERATOR", "t": "TEMPLATE_LIKE", "n": "NUMBER_LIKE", "N": "NEW", "D": "DELETE",
}

#: Digits that are no decimal digits (superscripts, circled digits) begin and continue words too.
_ODD_DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal())
_LEX = re.compile(rf"[A-Za-z_\d{_ODD_DIGITS}]+|::~|::|\\\\|.", re.S)
_FIRST_ODD = re.compile(rf"[^\x20-\x7e\d{_ODD_DIGITS}]")
_KNOWN = {"operator": "O", "new": "N", "delete": "D", "::": "s", "::~": "d", "\\\\": "B"} | {c: c for c in "<> ~.(),=+-*/\\:;!?[]&|%^'\"`@#${}"}

# Operator symbols behind the keyword. Those that may end the string differ from those with more behind them:
# ``>>`` at the end is no operator while ``><`` is one.
_OPERATOR = re.compile(
    r"<<=|>>=|->\*|(?:<<|<=|>>|>=|--|-=|->)(?= )|==|\+\+|\+=|\*=|/=|!=|&&|&=|\|\||\|=|%=|\^=|\(\)|\[\]"
    r"|(?:<<|<=|><|>=|--|-=|->)\Z|[ND]\[\]|[<>\-=+*/!&|%^~,ND](?= |\Z)"
)
_NO_TEMPLATE = frozenset("!.~Oo=+-/\\:;?|%^`ND@#$}{'\"dx")
# Shapes by precedence: (types left to right, result, whether the repeated names must be equal).
_SHAPES = (("isi", "C"), ("itsit", "C"), ("idi", "X"), ("itdit", "X"), ("o", "P"), ("it", "r"), ("i", "r"))
_PATH = re.compile(r"(?:r(?=[\\B/])|[\\B/](?=r))[/\\Birn.p]*")
_PATH_JOIN = re.compile(r"(?:r )?p(?: [pr]|p)*")
_PATH_EDGE = re.compile(r"r:p|[/\\B]p|p[/\\B]")
_FIXED = frozenset("CXP")  # names that undefined neighbours don't absorb


class _Types(dict):
    """Types of lexemes, kept for the most part as long as there is room."""

    def __missing__(self, t: str) -> str:
        found = "n" if t[0].isdigit() else "i" if t[0] == "_" or t[0].isascii() and t[0].isalpha() else "x"
        if len(self) < 100_000 and len(t) < 40:
            self[t] = found
        return found


_TYPES = _Types(_KNOWN)


def lex(text: str) -> tuple[list[str], str]:
    texts = _LEX.findall(text)
    return texts, "".join(map(_TYPES.__getitem__, texts))


def _replace(texts: list[str], types: str, spans: Iterator[tuple[int, int, str]]) -> tuple[list[str], str]:
    """Each ascending span (begin, end, type) becomes one token; type "" drops it."""
    out, kinds, at = [], [], 0
    for a, b, kind in spans:
        out += texts[at:a]
        kinds.append(types[at:a])
        if kind:
            out.append("".join(texts[a:b]))
            kinds.append(kind)
        at = b
    return out + texts[at:], "".join(kinds) + types[at:]


def join_operators(texts: list[str], types: str) -> tuple[list[str], str]:
    spans, at = [], 0
    while (k := types.find("O", at)) >= 0:
        after = k + 1 + (types[k + 1 : k + 2] == " ")
        m = _OPERATOR.match(types, after)
        if m:
            spans.append((k, m.end(), "o"))
            at = m.end()
            continue
        if types[after : after + 1] in ("n", "B"):  # quirk: before a number or double backslash the keyword is lost
            spans.append((k, after, ""))
        else:
            spans.append((k, k + 1, "i"))
        at = after
    return _replace(texts, types, iter(spans))


def join_templates(texts: list[str], types: str) -> tuple[list[str], str]:
    opens: list[int] = []
    partner: dict[int, int] = {}
    bad = [0]
    for k, c in enumerate(types):
        bad.append(bad[-1] + (c in _NO_TEMPLATE))
        if c == "<":
            opens.append(k)
        elif c == ">" and opens:
            partner[k] = opens.pop()
    spans, right = [], types.rfind(">")
    while right > 1:  # quirk: a bracket among the first two tokens ends the search
        left = partner.get(right)
        if left is None:  # nothing closes it; quirk: a string that begins with "<" counts as closed there
            if types[0] != "<":
                right = types.rfind(">", 0, right)
                continue
            left = 0
        if bad[right + 1] == bad[left]:
            spans.append((left, right + 1, "t"))
        right = types.rfind(">", 0, left)
    return _replace(texts, types, reversed(spans))


def _qualified(types: str, begin: int) -> int:
    """Start of the qualification ``(i [t] s)*`` that ends before ``begin``."""
    while True:
        if begin >= 2 and types[begin - 2 : begin] == "is":
            begin -= 2
        elif begin >= 3 and types[begin - 3 : begin] == "its":
            begin -= 3
        else:
            return begin


def match_names(texts: list[str], types: str) -> tuple[list[str], str]:
    for shape, kind in _SHAPES:
        n, spans, right = len(shape), [], len(types)
        half = (n - 1) // 2
        lost: list[int] = []
        while right >= n:
            at = types.rfind(shape, 0, right)
            if at < 0:
                break
            if kind in "CX" and texts[at : at + half] != texts[at + half + 1 : at + n]:
                right = at + n - 1
                continue
            begin = _qualified(types, at)
            if shape == "it" and types[at + n : at + n + 1] == "t":
                # quirk: the second template is copied into the name and stays, and one token more goes on the left
                spans.append((begin, at + n, kind, texts[at + n]))
                lost.append(begin - 1)
                right = max(begin - 1, 0)
            else:
                spans.append((begin, at + n, kind, ""))
                right = begin
        if not spans:
            continue
        extra = {a: more for a, _, _, more in spans if more}
        joined, kinds = [], []
        at = 0
        for a, b, k, more in reversed(spans):
            joined += texts[at:a]
            kinds.append(types[at:a])
            if more and joined and a > 0:
                joined.pop()
                kinds[-1] = kinds[-1][:-1] if kinds[-1] else kinds[-1]
                if not types[at:a]:
                    kinds = ["".join(kinds)[:-1]]
            joined.append("".join(texts[a:b]) + more)
            kinds.append(k)
            at = b
        texts, types = joined + texts[at:], "".join(kinds) + types[at:]
        if -1 in lost and 0 in extra:  # the token on the left of the first is the last one
            texts, types = texts[:-1], types[:-1]
    spans, at = [], 0
    while (at := types.find("rsr", at)) >= 0:  # quirk: a chain of three joins in pairs only
        spans.append((at, at + 3, "r"))
        at += 3
    return _replace(texts, types, iter(spans))


def join_paths(texts: list[str], types: str) -> tuple[list[str], str]:
    for pattern in (_PATH, _PATH_JOIN, _PATH_EDGE):
        found = [(m.start(), m.end(), "p") for m in pattern.finditer(types)]
        texts, types = _replace(texts, types, iter(found))
    return texts, types


def _strip_eols(text: str) -> str:
    while len(text) > 1:
        if text[0] == "\\" and text[1] in "rnt":
            text = text[2:]
        elif text[-2] == "\\" and text[-1] in "rnt":
            text = text[:-2]
        else:
            break
    return text


def _absorb_other(texts: list[str], types: str) -> list[tuple[str, str]]:
    """Odd characters join a neighbour, which becomes undefined and then spreads; nothing changes further before the first one."""
    first = types.find("x")
    if first < 0 and "u" not in types:
        return list(zip(texts, types))
    if first > 3 and "u" not in types:
        begin = first - 3
        return list(zip(texts[:begin], types)) + _absorb_other(texts[begin:], types[begin:])
    out: list[list] = []  # [parts, type]
    k, n = 0, len(texts)
    while k < n:
        if types[k] != "x":
            out.append([[texts[k]], types[k]])
        elif out and out[-1][1] not in _FIXED and out[-1][0][-1][-1] != ">":
            out[-1][0].append(texts[k])
            out[-1][1] = "u"
        elif k + 1 < n and types[k + 1] not in _FIXED and texts[k + 1][-1] != ">":
            out.append([[texts[k], texts[k + 1]], "u"])
            k += 1
        else:
            out.append([[texts[k]], "u"])
        k += 1
    done: list[list] = []
    for parts, kind in out:
        last = done[-1] if done else None
        if last and kind == "u" and last[1] not in _FIXED and last[0][-1][-1] != ">" or last and last[1] == "u" and kind not in _FIXED:
            last[0] += parts
            last[1] = "u"
        else:
            done.append([parts, kind])
    return [("".join(parts), kind) for parts, kind in done]


def split_tokens(texts: list[str], types: str) -> list[tuple[str, str]]:
    found = _absorb_other(texts, types)
    if "p" not in types:
        return [(t, NAMES[k]) for t, k in found if k in NAMES]
    out, skip = [], False
    for text, kind in found:
        if kind == "p" and not skip:
            words = [w for w in _strip_eols(text).split(" ") if w]
            out += [(w, "i") for w in words]
            skip = not words  # quirk: the token behind an emptied path is not looked at
            continue
        skip = False
        out.append((text, kind))
    return [(t, NAMES[k]) for t, k in out if k in NAMES]


def tokenize(text: str | None) -> list[tuple[str, str]]:
    """(token, type) pairs of a string."""
    if not text:
        return []
    if ">" in text or "::" in text or "operator" in text:
        state = lex(text)
        for step in (join_operators, join_templates, match_names, join_paths):
            state = step(*state)
        return split_tokens(*state)
    # without templates, scopes and operators every identifier is a name, and an odd character takes all that follows it
    if odd := _FIRST_ODD.search(text):
        text = text[: odd.end()]
    texts, types = lex(text)
    return split_tokens(*join_paths(texts, types.replace("i", "r")))


TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("type", T.StringType())]))


@F.arrow_udf(TOKENS)
def tokenize_udf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        found = [tokenize(s) for s in batch.to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        token, kind = (pa.array([t[i] for f in found for t in f], pa.string()) for i in (0, 1))
        yield pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([token, kind], ["token", "type"]))
