"""Byte-level BPE of whole texts, by distinct pre-token.

The tokenizers library encodes each distinct pre-token once and a worker keeps
the ids; texts are cut into pre-tokens with numpy.  A pre-token's ids do not
depend on its surroundings, so the result equals the library's own.  Texts with
an added token's string, or with characters that this Python's Unicode tables do
not know, are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np

from . import textkernels as K

# Unicode White_Space, and the contractions of the pre-token pattern.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
CHUNK = 2 << 20
_cache: dict = {}


def class_table() -> np.ndarray:
    if "classes" not in _cache:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            name = unicodedata.category(chr(c))
            t[c] = UNKNOWN if name == "Cn" else kinds.get(name[0], OTHER)
        t[WHITE_SPACE] = SPACE
        _cache["classes"] = t
    return _cache["classes"]


def pre_token_starts(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Indices at which a pre-token starts, for texts laid end to end at ``offs``."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    cls = class_table()[codes]
    space = cls == SPACE
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    # The last white space before other characters is on its own; a blank joins what follows.
    after = np.flatnonzero(~first[1:] & space[:-1] & ~space[1:]) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        stop = np.concatenate([first, np.ones(3, dtype=bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in ONE_LETTER]) & ~stop[quote + 1]
        two = np.zeros(len(quote), dtype=bool)
        for x, y in TWO_LETTERS:
            two |= (a == ord(x)) & (b == ord(y))
        two &= ~stop[quote + 1] & ~stop[quote + 2]
        start[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            start[at[at < n]] = True
    return np.flatnonzero(start)


class SpanCache:
    """Ids of distinct spans of text by sorted hash, grown as they are met; emptied when full.

    A subclass gives ``encode(words)``: the ids of all words end to end, and their numbers.
    """

    def __init__(self, limit: int = 2_000_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.uint32)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        ids, sizes = self.encode(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes.astype(np.uint32))
        self.used += len(ids)

    def slots(self, keys: np.ndarray, word) -> np.ndarray:
        """Slots of distinct sorted ``keys``; ``word(i)`` gives the text of the i-th."""
        if len(self.keys) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(missing):
            self._add(keys[missing], [word(i) for i in missing.tolist()])
            at = np.searchsorted(self.keys, keys)
        return at

    def lookup(self, text: str, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans from each start to the next, and where each span's ids begin."""
        ends = np.append(starts[1:], len(codes))
        keys, pick, back = np.unique(K.SpanHash(codes)(starts, ends), return_index=True, return_inverse=True)
        slot = self.slots(keys, lambda i: text[starts[pick[i]] : ends[pick[i]]])[back]
        sizes = self.size[slot].astype(np.int64)
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return self.flat[np.repeat(self.first[slot] - total[:-1], sizes) + np.arange(total[-1])], total


class PieceCache(SpanCache):
    """Ids of distinct pre-tokens by the tokenizers library."""

    def __init__(self, path: str, limit: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        super().__init__(limit)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words as lines of one text, which is much faster than single words.

        A newline is a pre-token of its own between two words that hold no white space.
        """
        found: list[list[int]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if w.strip(" ") and not any(c.isspace() for c in w[w[0] == " " :])]
        for lo in range(0, len(plain), 2000):
            group = plain[lo : lo + 2000]
            ids = self.tokenizer.encode_batch_fast(["\n".join(words[i] for i in group)], add_special_tokens=False)[0].ids
            line: list[int] = []
            lines = [line]
            for x in ids:
                if x == self.newline:
                    lines.append(line := [])
                else:
                    line.append(x)
            for i, one in zip(group, lines, strict=True):
                found[i] = one
        for i in set(range(len(words))).difference(plain):
            found[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes


def piece_cache(path: str) -> PieceCache:
    if _cache.get("path") != path:
        _cache["path"], _cache["pieces"] = path, PieceCache(path)
    return _cache["pieces"]


def encode_column(column, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text of an Arrow string column, in order; null counts as empty."""
    cache = piece_cache(path)
    buf, byte_offs = K.utf8_column(column)
    for lo, hi in K.chunks(byte_offs, CHUNK):
        part = buf[byte_offs[lo] : byte_offs[hi]]
        at = byte_offs[lo : hi + 1] - byte_offs[lo]
        text = part.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
        offs = lead[at]
        starts = pre_token_starts(codes, offs)
        ids, total = cache.lookup(text, codes, starts)
        bounds = total[np.searchsorted(starts, offs)]
        odd = K.per_document(class_table()[codes] == UNKNOWN, offs) > 0
        whole = any(a in text for a in cache.added)
        for i in range(hi - lo):
            own = text[offs[i] : offs[i + 1]] if whole or odd[i] else ""
            if odd[i] or (whole and any(a in own for a in cache.added)):
                yield lo + i, np.array(cache.tokenizer.encode(own, add_special_tokens=False).ids, np.uint32)
            else:
                yield lo + i, ids[bounds[i] : bounds[i + 1]]
