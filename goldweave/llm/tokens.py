"""Exact, memoised batch encoding with the public `tokenizers` library.

A byte-pair encoder never merges across its pre-token boundaries, so a text can be cut at
places that are boundaries in every context, each distinct piece encoded once by the
library, and the ids joined.  Cuts are found with numpy on the bytes, only where neighbours
prove a boundary: between runs of letters, digits and punctuation, before a blank that
follows one of these, and around a line feed between two of these.  Everything else stays
within a piece.  Pieces are looked up by a 64-bit hash; the tests compare all forms of
text with the library's own encoding.  Texts that hold the string of an added token (as
`<|endoftext|>`), which the library makes one id, are encoded by it as they are.

The caches belong to one Python worker, have a fixed size and are emptied when full.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from goldweave.llm import textvec as V

_LETTER, _DIGIT, _PUNCT, _QUOTE, _BLANK, _FEED, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _PUNCT
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39], _CLASS[32], _CLASS[10] = _QUOTE, _BLANK, _FEED
#: _CUT[x, y]: a boundary between classes x and y in every context (line feeds: see cuts()).
_CUT = np.zeros((7, 7), bool)
_CUT[:3, :3] = ~np.eye(3, dtype=bool)
_CUT[:4, _BLANK] = True
_CUT = _CUT.ravel()
#: The letters that byte-level models write for bytes which aren't printable, in the order of the bytes.
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256))}
#: A piece that is one pre-token: letters, maybe after a blank.
_LETTERS = re.compile("( ?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)").fullmatch
_MOST, _RECENT = 2_000_000, 100_000


def load(path: str):
    """The tokenizer in one file, with the library's own settings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the joined texts."""
    c = _CLASS[buf]
    # two-byte Latin-1 letters but for the signs of multiplication and division
    two = np.flatnonzero(buf[:-1] == 0xC3)
    two = two[(buf[two + 1] != 0x97) & (buf[two + 1] != 0xB7)]
    c[two] = c[two + 1] = _LETTER
    cut = np.zeros(len(buf), bool)
    cut[1:] = _CUT[c[:-1] * np.uint8(7) + c[1:]]
    plain = c < _BLANK
    feed = np.flatnonzero((c[1:-1] == _FEED) & plain[:-2] & plain[2:]) + 1
    cut[feed] = cut[feed + 1] = True
    cut[starts[:-1]] = cut[starts[1:] - 1] = True
    return np.flatnonzero(cut)


class _Known:
    """64-bit keys to numbers 0.. in the order they came; a small table of recent keys beside a large one."""

    def __init__(self):
        self.old, self.new, self.n_old = pd.Index(np.empty(0, np.uint64)), np.empty(0, np.uint64), 0
        self.recent = pd.Index(self.new)

    def __len__(self) -> int:
        return self.n_old + len(self.new)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = self.old.get_indexer(keys) if self.n_old else np.full(len(keys), -1)
        if len(self.new) and len(miss := np.flatnonzero(out < 0)):
            k = self.recent.get_indexer(keys[miss])
            out[miss] = np.where(k < 0, -1, k + self.n_old)
        return out

    def add(self, keys: np.ndarray) -> None:
        self.new = np.concatenate([self.new, keys])
        if len(self.new) > max(_RECENT, self.n_old // 4):
            self.old, self.new = pd.Index(np.concatenate([self.old.to_numpy(), self.new])), self.new[:0]
            self.n_old = len(self.old)
        self.recent = pd.Index(self.new)


class Encoder:
    """`encode(texts)` -> (ids uint32 of all texts joined, lengths int64), as encode_batch gives them."""

    def __init__(self, path: str, kind: str):
        """kind: "byte" (byte-level BPE with the GPT-2 split), "word" (lower-cased BPE with word ends) or "plain" (no cuts)."""
        self.tok, self.kind = load(path), kind
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self):
        self.known = _Known()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.len = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a)), a.dtype)])

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, lengths = self._pieces(pieces)
        k = len(self.known)
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.at, self.len = self._grown(self.at, k + len(keys)), self._grown(self.len, k + len(keys))
        self.flat[self.used : self.used + len(ids)] = ids
        self.len[k : k + len(keys)] = lengths
        self.at[k : k + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.known.add(keys)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _plain; single pre-tokens of letters go straight to the library's model."""
        model, byte = self.tok.model.tokenize, self.kind == "byte"
        got: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if m := _LETTERS(p):
                word = p if byte else m[2].lower()
                if not word.isascii():  # byte-level models spell each byte as a letter
                    word = word.encode().decode("latin-1").translate(_SPELLED)
                got[i] = [t.id for t in model("\u0120" + word[1:] if byte and m[1] else word)]
            else:
                rest.append(i)
        ids, lengths = self._plain([pieces[i] for i in rest])
        ends = np.cumsum(lengths)
        for i, n, e in zip(rest, lengths.tolist(), ends.tolist(), strict=True):
            got[i] = ids[e - n : e].tolist()
        return np.array([x for g in got for x in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        out: list[int] = []
        lengths = np.zeros(len(texts), np.int64)
        for a in range(0, len(texts), 1000):
            for i, e in enumerate(fast(texts[a : a + 1000], add_special_tokens=False), a):
                ids = e.ids
                lengths[i] = len(ids)
                out += ids
        return np.array(out, np.uint32), lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "plain":
            return self._plain([t or "" for t in texts])
        odd = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if odd:
            apart = set(odd)
            ids, n = self.encode([None if i in apart else t for i, t in enumerate(texts)])
            own, sizes = self._plain([texts[i] for i in odd])
            ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[odd], sizes), own)
            n[odd] = sizes
            return ids, n
        got = [self._some(texts[a:b]) for a, b in V.chunks(texts)]
        return (np.concatenate([g[0] for g in got]) if got else np.empty(0, np.uint32)), (np.concatenate([g[1] for g in got]) if got else np.empty(0, np.int64))

    def _some(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts = V.pack(texts)
        s = cuts(buf, starts)
        e = np.append(s[1:], len(buf))
        apart = np.zeros(len(buf), bool)
        apart[starts[1:] - 1] = True  # the line feeds between texts
        real = ~apart[s]
        s, e = s[real], e[real]
        keys = V.span_hash(V.LOWER[buf] if self.kind == "word" else buf, s, e)
        k = self.known.find(keys)
        if len(miss := np.flatnonzero(k < 0)):
            new, first = np.unique(keys[miss], return_index=True)
            if len(self.known) and len(self.known) + len(new) > _MOST:
                self._empty()
                new, first = np.unique(keys, return_index=True)
                miss = np.arange(len(keys))
            raw = buf.tobytes()
            self._learn(new, [raw[s[i] : e[i]].decode("utf-8", "replace") for i in miss[first]])
            k[miss] = self.known.find(keys[miss])
        n = self.len[k]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[k] - ends + n, n) + np.arange(total)]
        per = np.append(0, ends)[np.searchsorted(s, starts)]
        return ids, np.diff(per)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a file; made once per Python worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
