"""Tokenizers library over whole texts, each distinct pre-token encoded once per worker.

Within a set of characters whose classes are the same in every Unicode
version (ASCII, Latin-1, Latin Extended A and B, a few punctuation marks) the
pre-tokens of the two patterns below are found with array operations; the
library's model turns each distinct pre-token into ids and the ids are
gathered back. Texts with any other character, or with one of the
tokenizer's added tokens, are given to the library whole. Both ways give the
library's ids; tests compare them on random texts.
"""

from __future__ import annotations

import os

import numpy as np

from loomgraph.llm.blocks import span_hashes

_LETTER, _DIGIT, _SPACE, _OTHER, _UNSAFE = 1, 2, 3, 4, 5
_TOP = 0x2100


def _classes() -> np.ndarray:
    out = np.full(_TOP, _UNSAFE, dtype=np.uint8)
    for c in [*range(0x20, 0x7F), *range(0xA1, 0x250)]:
        x = chr(c)
        out[c] = _LETTER if x.isalpha() else _DIGIT if x.isnumeric() else _OTHER
    for x in "\t\n\r ":
        out[ord(x)] = _SPACE
    for x in "‘’“”–—…•":
        out[ord(x)] = _OTHER
    for c in (0xAD, 0x130):  # a format character, and a letter whose lower case is two characters
        out[c] = _UNSAFE
    return out


_CLASS = _classes()
_LOWER = np.array([ord(chr(c).lower()) if _CLASS[c] == _LETTER and len(chr(c).lower()) == 1 else c for c in range(_TOP)], dtype=np.uint32)
for _c in range(_TOP):  # a lower case outside the safe set
    if _LOWER[_c] >= _TOP or _CLASS[_LOWER[_c]] == _UNSAFE:
        _CLASS[_c] = _UNSAFE


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if visible, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class PretokenEncoder:
    """ids of texts; style "byte" is the byte-level pattern with blanks kept, "word" lower-cases and drops white space."""

    def __init__(self, path: str, style: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if style not in ("byte", "word"):
            raise ValueError(f"unknown style {style!r}")
        self.tokenizer, self.style, self.limit = Tokenizer.from_file(path), style, cache
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _piece(self, token: str) -> bytes:
        shown = token.encode().decode("latin-1").translate(_LETTERS)
        return np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()

    def _starts(self, cp: np.ndarray, cls: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Flags of the characters at which a pre-token begins."""
        n = len(cp)
        edge = np.zeros(n + 1, dtype=bool)
        edge[edges] = True
        run = np.ones(n, dtype=bool)
        run[1:] = (cls[1:] != cls[:-1]) | edge[1:-1]
        flag = run.copy()
        quote = (cp == 0x27) & run
        quote[:-1] &= run[1:]  # a run of one character
        if n:
            quote[-1] = False
        if self.style == "byte":
            # the last white space before a visible character of the same text
            last = np.flatnonzero((cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
            blank = last[cp[last] == 0x20]
            flag[last] = True
            flag[blank + 1] = False
            after = np.zeros(n, dtype=bool)
            after[blank + 1] = True
            quote &= ~after
        else:
            flag[cls == _DIGIT] = True
        at = np.flatnonzero(quote)
        if len(at):
            ends = edges[np.searchsorted(edges, at, side="right")]
            one = np.where(at + 1 < ends, cp[np.minimum(at + 1, n - 1)], 0)
            two = np.where(at + 2 < ends, cp[np.minimum(at + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(at), dtype=bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for hit, size in ((short, 2), (long, 3)):
                flag[at[hit] + 1] = False
                ahead = (at[hit] + size)[at[hit] + size < ends[hit]]
                flag[ahead] = True
        return flag

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """ids of each text of a slice of UTF-8 bytes."""
        text = data.tobytes().decode("utf-8")
        head = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        edges = head[offsets]
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        cls = _CLASS[np.minimum(cp, _TOP - 1)]
        bad = np.zeros(len(cp) + 1, dtype=np.int64)
        np.cumsum(cls == _UNSAFE, out=bad[1:])
        whole = bad[edges[1:]] > bad[edges[:-1]]
        if any(x in text for x in self.added):
            whole |= np.array([any(x in text[a:b] for x in self.added) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        small = np.minimum(cp, _TOP - 1)
        if self.style == "word":
            small = _LOWER[small]
        starts = np.flatnonzero(self._starts(small, cls, edges)) if len(cp) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(cp))
        keep = ~np.repeat(whole, np.diff(np.searchsorted(starts, edges)))
        if self.style == "word":
            # white space inside a text belongs to no pre-token; a run of it begins a span of its own
            keep &= cls[starts] != _SPACE
        first = np.concatenate(([0], np.cumsum(keep)))[np.searchsorted(starts, edges)]
        starts, ends = starts[keep], ends[keep]
        keys, where, inverse = np.unique(span_hashes(small.astype("<u2").view(np.uint8), 2 * starts, 2 * ends), return_index=True, return_inverse=True)
        got = self._lookup(keys.tolist(), starts[where], ends[where], text)
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
        flat = np.frombuffer(b"".join(got), dtype="<u4")
        begin = np.cumsum(size) - size
        n = size[inverse]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(begin[inverse] - upto[:-1], n) + np.arange(upto[-1])]
        out = [ids[a:b] for a, b in zip(upto[first[:-1]], upto[first[1:]], strict=True)]
        for i in np.flatnonzero(whole):
            out[i] = self.whole(text[edges[i] : edges[i + 1]])
        return out

    def _lookup(self, keys: list[int], starts: np.ndarray, ends: np.ndarray, text: str) -> list[bytes]:
        young, old, out = self.young, self.old, []
        for key, a, b in zip(keys, starts.tolist(), ends.tolist(), strict=True):
            x = young.get(key)
            if x is None:
                x = old.get(key)
                if x is None:
                    token = text[a:b]
                    x = self._piece(token.lower() if self.style == "word" else token)
                young[key] = x
            out.append(x)
        if len(young) > self.limit // 2:
            self.young, self.old = {}, young
        return out


_encoders: dict[tuple, PretokenEncoder] = {}


def encoder(path: str, style: str) -> PretokenEncoder:
    """One encoder for a worker; its table of pre-tokens is bounded and serves later tasks too."""
    key = (path, style)
    if key not in _encoders:
        _encoders[key] = PretokenEncoder(path, style)
    return _encoders[key]
