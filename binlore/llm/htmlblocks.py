"""Leaf text blocks of an HTML page: their normalised text and the path of open elements, with the vectors a labeller reads."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTE_OR_END = re.compile(r"[\"'>]")
#: Elements that hold no text of the page, if they end: scripts, styles, form fields and the window's title.
_SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "select", "title")}
#: Without an end these run to the end of the page; of the others only the tag goes.
_TO_THE_END = {"script", "style"}
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these open elements up to the nearest boundary.
_P_ENDS = BLOCK - {"button", "label", "option"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

PATH_DIM, TAG_DIM, WORD_DIM, NUMBERS = 768, 64, 128, 7
DIM = PATH_DIM + TAG_DIM + WORD_DIM + NUMBERS


class Element:
    """An open element: its tag, the class, id and role words, and sums over the path from the root.

    ``bits``: buckets of all tags and words; ``block``: the innermost block-level tag; ``group``: number of the path of block-level elements.
    """

    __slots__ = ("tag", "words", "parent", "bits", "block", "group")

    def __init__(self, tag: str, words: tuple[str, ...], parent: "Element | None", groups: dict):
        self.tag, self.words, self.parent = tag, words, parent
        self.bits, self.block, self.group = (parent.bits, parent.block, parent.group) if parent else (0, "", 0)
        self.bits |= 1 << _bucket(tag, PATH_DIM, 1)
        for w in words:
            self.bits |= 1 << _bucket(w, PATH_DIM, 2)
        if tag in BLOCK:
            self.block = tag
            self.group = groups.setdefault((self.group, tag, words), len(groups) + 1)


@dataclass
class Block:
    text: str
    element: Element | None  # the innermost open element
    linked: int  # characters inside links

    @property
    def group(self) -> int:
        return self.element.group if self.element else 0


def _words_of(attrs: str) -> tuple[str, ...]:
    out = []
    for m in _ATTR.finditer(attrs):
        for w in _SPLIT.findall(m[2] or m[3] or m[4] or ""):
            w = w.lower()
            out.append(w[:-1] if len(w) > 3 and w.endswith("s") else w)
    return tuple(out)


class _Tags:
    """The tag that follows a place, for a page's places in order, in time linear in its length: (start, end, name, closing, attributes); comments have no name."""

    def __init__(self, page: str):
        self.page = page
        self.lost: set[int] = set()  # quotes from which no tag's end is found outside of quotes

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag: outside of quotes, or the next one where quotes do not close; -1: none."""
        page = self.page
        first = page.find(">", at)
        if first < 0:
            return -1
        seen = []
        while (m := _QUOTE_OR_END.search(page, at)) and m[0] != ">":
            seen.append(m.start())
            close = -1 if m.start() in self.lost else page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        else:
            if m:
                return m.start()
        self.lost.update(seen)
        return first

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            closing = page.startswith("/", start + 1)
            if name := _NAME.match(page, start + 1 + closing):
                end = self._end(name.end())
                return (start, end + 1, name[0].lower(), closing, page[name.end() : end]) if end >= 0 else None
            if page.startswith(("!", "?", "/"), start + 1):
                end = page.find(">", start)
                return (start, end + 1, "", False, "") if end >= 0 else None
            at = start + 1
        return None


def blocks(page: str) -> list[Block]:
    """All leaf blocks in page order. Scripts, styles, form fields, the window's title and comments hold no text."""
    out: list[Block] = []
    stack: list[Element] = []
    groups: dict = {}
    open_at: dict[str, list[int]] = {}  # places of a tag's open elements
    block_at: list[int] = []  # places of block-level elements
    parts: list[str] = []
    linked, at = 0, 0
    endless: set[str] = set()  # skipped elements that have no end tag from here on

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def last(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def close(k: int):
        for e in stack[k:]:
            open_at[e.tag].pop()
            if e.tag in BLOCK:
                block_at.pop()
        del stack[k:]

    tags = _Tags(page)
    while tag := tags.after(at):
        start, end, name, closing, attrs = tag
        if start > at:
            parts.append(page[at:start])
            if open_at.get("a"):
                linked += start - at
        at = end
        if closing:
            k = last((name,))
            if name == "br":
                parts.append(" ")
            elif name in BLOCK:
                flush()
                if k >= 0:
                    close(k)
            elif k >= 0 and k > (block_at[-1] if block_at else -1):
                close(k)
        elif name in _SKIPPED:
            if name in ("select", "textarea"):
                parts.append(" ")
            if name not in endless:
                if m := _SKIPPED[name].search(page, at):
                    at = m.end()
                elif name in _TO_THE_END:
                    at = len(page)
                    break
                else:
                    endless.add(name)
        elif name == "br":
            parts.append(" ")
        elif name:
            if name in BLOCK:
                flush()
                if name in _P_ENDS and block_at and stack[block_at[-1]].tag == "p":
                    close(block_at[-1])
                if name in _CLOSES:
                    own, bounds = _CLOSES[name]
                    if (k := last(own)) > last(bounds):
                        close(k)
            if name not in VOID and not attrs.endswith("/"):
                open_at.setdefault(name, []).append(len(stack))
                if name in BLOCK:
                    block_at.append(len(stack))
                stack.append(Element(name, _words_of(attrs), stack[-1] if stack else None, groups))
            if name in ("img", "iframe"):
                parts.append(" ")
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _bucket(word: str, size: int, salt: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), salt) * 2654435761 % (1 << 32) * size >> 32


class Vectors:
    """Hashed tag-path and word vectors; remembers paths and words in bounded caches."""

    def __init__(self):
        self.paths: dict[tuple[int, str], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, element: Element | None) -> np.ndarray:
        bits, block = (element.bits, element.block) if element else (0, "")
        found = self.paths.get((bits, block))
        if found is None:
            found = np.zeros(PATH_DIM + TAG_DIM, np.float32)
            found[:PATH_DIM] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little")
            if block:
                found[PATH_DIM + _bucket(block, TAG_DIM, 3)] = 1
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[bits, block] = found
        return found

    def page(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), DIM), np.float32)
        get, words = self.words.get, self.words
        if len(words) > 300_000:
            words.clear()
        base = PATH_DIM + TAG_DIM
        for i, b in enumerate(found):
            out[i, :base] = self._path(b.element)
            own = b.text.lower().split(" ")
            index = [get(w, -1) for w in own]
            if -1 in index:
                for k, x in enumerate(index):
                    if x < 0:
                        w = own[k]
                        index[k] = words[w] = _bucket(w.strip(".,;:!?()[]\"'|»«·-*#$%&") or w, WORD_DIM, 4)
            counts = np.bincount(index, minlength=WORD_DIM)
            out[i, base : base + WORD_DIM] = np.sqrt(counts / len(own))
            n, text = len(b.text), b.text
            out[i, base + WORD_DIM :] = (
                np.log1p(n) / 8, np.log1p(len(own)) / 6, b.linked / n, (text.count(".") + text.count(",")) / len(own), text[-1] in ".!?",
                "©" in text, text[0].isupper(),
            )
        return out
