"""Fast exact tokenization: texts are cut before spaces between words and each distinct piece is encoded once.

A cut stands only before a space between two characters that are certainly neither white space nor combining
marks, where neither vocabulary's pre-tokenizer lets a match run across; so the ids equal those of the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from .textbatch import raw, table_of

LETTERS = table_of((0x41, 0x5A), (0x61, 0x7A))
PUNCTUATION = table_of((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Lead bytes of combining marks; ASCII letters before them are not lower-cased ahead of the tokenizer's normalizer.
COMBINING = table_of((0xCC, 0xCD), (0xE1, 0xE3), (0xEF, 0xFF))

#: Distinct pieces an encoder remembers; bounds a worker's memory (a dict of 699,051 doubles its table). When it is full, only the
#: pieces of the chunk at hand stay.
CACHE_PIECES = 690_000
#: Text bytes encoded at once: longer chunks repeat fewer pieces.
ENCODE_BYTES = 4 << 20
#: Pieces joined to one text for the tokenizer; longer texts take more time a piece.
JOINED = 50


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_points(data: np.ndarray, off: np.ndarray, fine: bool = True) -> np.ndarray:
    """Ascending byte positions of cuts: the texts' bounds, safe spaces, and (fine) ends of ASCII letter runs before punctuation."""
    spaces = np.flatnonzero(data == 0x20)
    spaces = spaces[(spaces > 1) & (spaces + 1 < len(data))]
    before, lead, after = data[spaces - 1], data[spaces - 2], data[spaces + 1]
    graphic = lambda b: (b > 0x20) & (b < 0x7F)
    safe = (graphic(before) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xCB))) & (graphic(after) | ((after >= 0xC3) & (after <= 0xCB)))
    marks = np.zeros(len(data) + 1, bool)
    marks[spaces[safe]] = True
    if fine:
        marks[1:-1] |= LETTERS[data[:-1]] & PUNCTUATION[data[1:]]
    marks[off] = True
    return np.flatnonzero(marks)


#: The encoder that a worker's tasks of one job share: (job, path, encoder).
_shared: list[tuple[str, str, PieceEncoder]] = []


def shared_encoder(job: str, path: str) -> PieceEncoder:
    """The job's encoder in this worker, with the pieces that its tasks before this one met; another job's is dropped."""
    if not _shared or _shared[0][:2] != (job, path):
        drop_shared()
        _shared.append((job, path, PieceEncoder(path)))
    return _shared[0][2]


def drop_shared() -> None:
    """Give the shared encoder's memory back."""
    _shared.clear()


def _gathered(ids: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the pieces ``which``, in their order."""
    begin = bounds[which]
    size = bounds[which + 1] - begin
    after = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat((begin - after[:-1]).astype(np.int32), size)  # fewer than 2**31 ids are held
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], after


class PieceEncoder:
    """Encodes batches of texts with a tokenizers file; remembers pieces between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark = self._separator()
        self.sign = self.separator.strip() or self.separator
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(b" " in x for x in self.special):
            raise ValueError("a special token with a space would be cut")
        special = "".join(f"(?!{re.escape(x.decode())})" for x in self.special)
        # one space at most, then visible ASCII and Latin characters without a special token
        self.plain = re.compile(f" ?(?:{special}[\\x21-\\x7e\\u00c0-\\u02ff])+").fullmatch if self.mark is not None else lambda t: None
        self.caseless = self.tokenizer.encode("Ab Ñ", add_special_tokens=False).ids == self.tokenizer.encode("ab Ñ", add_special_tokens=False).ids
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def _separator(self) -> tuple[str, int | None]:
        """A text between pieces that gives one id of its own there, and that id."""
        for text in ("\n", " 9 "):
            ids = self.tokenizer.encode(f"a{text} b", add_special_tokens=False).ids
            alone = self.tokenizer.encode(text, add_special_tokens=False).ids
            around = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", " b")]
            if len(alone) == 1 and ids == around[0] + alone + around[1]:
                return text, alone[0]
        return "", None

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of each piece alone. Plain pieces go through the tokenizer joined, parted by the separator."""
        n = len(pieces)
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = [self.plain(t) is not None and self.sign not in t for t in texts]
        joined = [t for t, ok in zip(texts, plain) if ok]
        alone = [t for t, ok in zip(texts, plain) if not ok]
        sizes = np.zeros(n, np.int64)
        ok = np.array(plain, bool)
        flat = np.zeros(0, np.uint32)
        if joined:
            texts = [self.separator.join(joined[i : i + JOINED] + [""]) for i in range(0, len(joined), JOINED)]
            got = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            marks = np.flatnonzero(got == self.mark)
            if len(marks) != len(joined):
                raise ValueError("the tokenizer doesn't keep the separator apart")
            sizes[ok] = np.diff(np.concatenate(([-1], marks))) - 1
            flat = got[got != self.mark]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)] if alone else []
        sizes[~ok] = [len(x) for x in rest]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.zeros(bounds[-1], np.uint32)
        ids[np.repeat(ok, sizes)] = flat
        ids[np.repeat(~ok, sizes)] = [i for x in rest for i in x]
        return ids, bounds

    def encode(self, texts: pa.LargeBinaryArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` appended; bounds of the texts)."""
        data, off = raw(texts)
        seen = data.tobytes().lower()  # ASCII letters only
        lowered = np.frombuffer(seen, np.uint8)
        ordinary = not any(x.lower() in seen for x in self.special)  # else special tokens stay whole and as they are
        cuts = cut_points(data, off, ordinary)
        if ordinary and self.caseless and not COMBINING[data].any():
            data = lowered
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)]).dictionary_encode()
        vocab = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.known.get, vocab, repeat(-1)), np.int64, len(vocab))
        new = np.flatnonzero(known < 0)
        ids, bounds = self.ids, self.bounds
        if len(new):
            fresh = [vocab[i] for i in new]
            more, ends = self._encode_pieces(fresh)
            known[new] = np.arange(len(bounds) - 1, len(bounds) - 1 + len(new))
            ids, bounds = np.concatenate((ids, more)), np.concatenate((bounds, bounds[-1] + ends[1:]))
            if len(self.known) + len(new) <= CACHE_PIECES:
                self.known.update(zip(fresh, known[new].tolist()))
                self.ids, self.bounds = ids, bounds
            elif len(vocab) <= CACHE_PIECES:
                ids, bounds = _gathered(ids, bounds, known)
                known = np.arange(len(vocab))
                self.known, self.ids, self.bounds = dict(zip(vocab, known.tolist())), ids, bounds
        which = known[pieces.indices.to_numpy(zero_copy_only=False)] if len(vocab) else np.zeros(0, np.int64)
        flat, after = _gathered(ids, bounds, which)
        ends = after[np.searchsorted(cuts, off)]  # ids before each text's bound
        rows = len(texts)
        bounds = ends + np.arange(rows + 1)  # an end id after each text
        out = np.full(bounds[-1], end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[body] = flat
        return out, bounds
