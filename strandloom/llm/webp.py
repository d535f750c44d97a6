"""Lossless WebP (VP8L) images: a full decoder, a batch decoder and a batch encoder.

``decode_image`` reads any lossless stream: prefix codes with or without an entropy
image, back-references, colour cache, and the predictor, cross-colour,
subtract-green and palette transforms.  ``decode_images`` decodes many images at
once: those of one prefix group and one alpha advance together, one pixel a step,
with their prefix codes as lookup tables and a colour cache each; predictors are
inverted along slanted lines of pixels, of all images together.  Images with an
entropy image or several alphas go to ``decode_image``.
``encode_images`` writes back-references, colour caches, palettes and transforms,
chosen for each image from its own samples, with prefix codes fitted to it.

Pixels are rows of (alpha, red, green, blue) bytes in numpy arrays.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the format: order of the code-length code's lengths, and alphabet sizes.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
ALPHABETS = [280, 256, 256, 256, 40]
_RUNS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}  # of code lengths: least run, extra bits
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD

#: Distances 1..120 stand for near pixels: by distance, then by column, right before left.
NEAR = sorted(
    [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0],
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]),
)


class DamagedImage(ValueError):
    """The stream breaks the format's rules."""


# ---------------------------------------------------------------- one image


class _Bits:
    """Least-significant-bit-first reader."""

    def __init__(self, data: bytes):
        self.data, self.at, self.window, self.base = data, 0, 0, 0
        self._load(0)

    def _load(self, at: int) -> None:
        self.base = at >> 3
        self.window = int.from_bytes(self.data[self.base : self.base + 64], "little")

    def peek(self, n: int) -> int:
        off = self.at - 8 * self.base
        if off < 0 or off + n > 512:
            self._load(self.at)
            off = self.at - 8 * self.base
        return (self.window >> off) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise DamagedImage("stream ends early")

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v


class _Code:
    """A prefix code: table from the next bits to (symbol, length)."""

    def __init__(self, lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if not used:
            used = [(0, 0)]
        if len(used) == 1:
            self.bits, self.table, self.spelled = 0, [(used[0][1], 0)], {}
            return
        self.bits, self.spelled = used[-1][0], {}
        if sum(1 << (self.bits - n) for n, _ in used) != 1 << self.bits:
            raise DamagedImage("prefix code is not complete")
        self.table = [(0, 0)] * (1 << self.bits)
        code, last = 0, used[0][0]
        for n, s in used:
            code <<= n - last
            last = n
            low = int(format(code, f"0{n}b")[::-1], 2)
            for k in range(low, 1 << self.bits, 1 << n):
                self.table[k] = (s, n)
            code += 1

    def read(self, bits: _Bits) -> int:
        symbol, n = self.table[bits.peek(self.bits)] if self.bits else self.table[0]
        bits.read(n)
        return symbol


def _spelled_lengths(code: _Code, v: int) -> tuple[list[int], int, int, int]:
    """(lengths, symbols, bits, last length above 0) that 16 bits spell whole, up to a repetition of the last length."""
    lengths, symbols, used, before = [], 0, 0, 0
    while True:
        k, n = code.table[v >> used & ((1 << code.bits) - 1)]
        least, more = _RUNS.get(k, (1, 0))
        if k == 16 or not n or used + n + more > 16:
            return lengths, symbols, used, before
        if k < 16:
            lengths.append(k)
            before = k or before
        else:
            lengths += [0] * (least + (v >> used + n & ((1 << more) - 1)))
        symbols += 1
        used += n + more


def _read_lengths(bits: _Bits, size: int) -> list[int]:
    lengths = [0] * size
    v = bits.peek(62)
    if v & 1:  # simple code: one or two symbols
        n = 11 if v & 4 else 4
        symbols = [v >> 3 & ((1 << n - 3) - 1)]
        if v & 2:
            symbols.append(v >> n & 255)
            n += 8
        bits.skip(n)
        for s in symbols:
            if s >= size:
                raise DamagedImage("symbol outside its alphabet")
            lengths[s] = 1
        return lengths
    inner, n = [0] * 19, 4 + (v >> 1 & 15)
    for i, k in enumerate(CODE_LENGTH_ORDER[:n]):
        inner[k] = v >> 5 + 3 * i & 7
    bits.skip(5 + 3 * n)
    code = _shared_code(tuple(inner))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise DamagedImage("too many code lengths")
    table, mask = code.table, (1 << code.bits) - 1
    byte, used = bits.at >> 3, bits.at & 7
    window = int.from_bytes(bits.data[byte : byte + 2 * size + 8], "little") >> used  # no length takes more than 14 bits
    at, before = 0, 8
    known = code.spelled
    while at < size and left:
        found = known.get(window & 0xFFFF)
        if found is None:
            found = known[window & 0xFFFF] = _spelled_lengths(code, window & 0xFFFF)
        many, symbols, n, last = found
        if symbols and symbols <= left and at + len(many) <= size:
            lengths[at : at + len(many)] = many
            at += len(many)
            left -= symbols
            window >>= n
            used += n
            before = last or before
            continue
        left -= 1
        k, n = table[window & mask]
        window >>= n
        used += n
        if k < 16:
            lengths[at] = k
            before = k or before
            at += 1
            continue
        least, more = _RUNS[k]
        run = least + (window & ((1 << more) - 1))
        window >>= more
        used += more
        if at + run > size:
            raise DamagedImage("code lengths run over")
        if k == 16:
            lengths[at : at + run] = [before] * run
        at += run
    bits.at = 8 * byte
    bits.skip(used)
    return lengths


def _read_group(bits: _Bits, cache_size: int) -> list[_Code]:
    return [_shared_code(tuple(_read_lengths(bits, n + (cache_size if i == GREEN else 0)))) for i, n in enumerate(ALPHABETS)]


@lru_cache(64)
def _shared_code(lengths: tuple[int, ...]) -> _Code:
    return _Code(lengths)


def _prefixed(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _ceil_shift(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_pixels(bits: _Bits, width: int, height: int, main: bool) -> list[int]:
    """Entropy-coded pixels as packed ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise DamagedImage("colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_of, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = _ceil_shift(width, group_bits)
        group_of = [(p >> 8) & 0xFFFF for p in _read_pixels(bits, across, _ceil_shift(height, group_bits), False)]
        n_groups = max(group_of) + 1
    groups = [_read_group(bits, len(cache)) for _ in range(n_groups)]
    out: list[int] = []
    total, group, cached = width * height, groups[0], 0
    while len(out) < total:
        at = len(out)
        if group_of is not None:
            y, x = divmod(at, width)
            group = groups[group_of[(y >> group_bits) * across + (x >> group_bits)]]
        s = group[GREEN].read(bits)
        if s < 256:
            red, blue, alpha = (group[k].read(bits) for k in (RED, BLUE, ALPHA))
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _prefixed(bits, s - 256)
            back = _distance(_prefixed(bits, group[DISTANCE].read(bits)), width)
            if back > at or at + length > total:
                raise DamagedImage("back-reference outside the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            for p in out[cached:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = len(out)
            out.append(cache[s - 280])
    return out


def _unpack(pixels, width: int) -> np.ndarray:
    return np.array(pixels, ">u4").view(np.uint8).reshape(-1, width, 4)


def _summed(channels: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is short."""
    return sum(channels[..., k] for k in range(1, channels.shape[-1])) + channels[..., 0]


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left, top, top_right, top_left):
    """Predictions of pixels (int arrays, channels last) by one mode."""
    if 1 <= mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if 6 <= mode <= 9:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        nearer = _summed(np.abs(top - top_left)) < _summed(np.abs(left - top_left))
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        over = mean - top_left
        return np.clip(mean + ((over + (over < 0)) >> 1), 0, 255)
    black = np.zeros_like(left)
    black[..., 0] = 255
    return black


def invert_predictors(residuals: list[np.ndarray], modes: list[np.ndarray], bits: list[int]) -> list[np.ndarray]:
    """Many images at once.  Pixels of equal column + 2 * row need none of each other."""
    sizes = [r.shape[:2] for r in residuals]
    ends = np.cumsum([h * w for h, w in sizes])
    line, mode, width = [], [], []
    for (h, w), of, b in zip(sizes, modes, bits):
        m = of[np.arange(h)[:, None] >> b, np.arange(w) >> b, 2] & 15
        m[0], m[:, 0] = 1, 2
        m[0, 0] = 0
        line.append((np.arange(w) + 2 * np.arange(h)[:, None]).ravel())
        mode.append(m.ravel())
        width.append(np.full(h * w, w))
    flat = np.concatenate([r.reshape(-1, 4) for r in residuals]).astype(np.int16)
    mode, width = np.concatenate(mode), np.concatenate(width)
    key = np.concatenate(line) * 16 + mode
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at = order[lo:hi]
        above = at - width[at]
        near = (flat[np.maximum(i, 0)] for i in (at - 1, above, above + 1, above - 1))
        flat[at] = (flat[at] + _predict(int(mode[at[0]]), *near)) & 255
    flat = flat.astype(np.uint8)
    return [flat[e - h * w : e].reshape(h, w, 4) for (h, w), e in zip(sizes, ends.tolist())]


def invert_predictor(residual: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    return invert_predictors([residual], [modes], [bits])[0]


def invert_cross_color(image: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    height, width, _ = image.shape
    per_pixel = factors[np.arange(height)[:, None] >> bits, np.arange(width) >> bits].astype(np.int8).astype(int)
    red_to_blue, green_to_blue, green_to_red = per_pixel[..., 1], per_pixel[..., 2], per_pixel[..., 3]
    out = image.astype(int)
    green = image[..., 2].astype(np.int8).astype(int)
    out[..., 1] = (out[..., 1] + (green_to_red * green >> 5)) & 255
    red = out[..., 1].astype(np.uint8).astype(np.int8).astype(int)
    out[..., 3] = (out[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * red >> 5)) & 255
    return out.astype(np.uint8)


def invert_subtract_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1] += image[..., 2]
    out[..., 3] += image[..., 2]
    return out


def invert_palette(image: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    per_byte = 1 << pack
    size = 8 >> pack
    index = (image[..., 2][..., None] >> (np.arange(per_byte) * size)) & ((1 << size) - 1)
    index = index.reshape(image.shape[0], -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)
    table[: len(palette)] = palette
    return table[index]


def image_chunk(data: bytes) -> bytes:
    """The lossless stream inside a WebP file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise DamagedImage("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        name, size = struct.unpack("<4sI", data[at : at + 8])
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise DamagedImage("no lossless chunk")


def _read_start(bits: _Bits) -> tuple[int, int, int, list[tuple]]:
    """(width, height, coded width, transforms with their data, in the order of the stream)."""
    if bits.read(8) != 0x2F:
        raise DamagedImage("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise DamagedImage("unknown version")
    todo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in todo]:
            raise DamagedImage("transform used twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            across = _ceil_shift(coded, block)
            todo.append((kind, _unpack(_read_pixels(bits, across, _ceil_shift(height, block), False), across), block))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind,))
        else:
            size = bits.read(8) + 1
            palette = np.cumsum(_unpack(_read_pixels(bits, size, 1, False), size)[0].astype(int), axis=0).astype(np.uint8)
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, palette, coded, pack))
            coded = _ceil_shift(coded, pack)
    return width, height, coded, todo


_INVERT = {PREDICTOR: invert_predictor, CROSS_COLOR: invert_cross_color, SUBTRACT_GREEN: invert_subtract_green, PALETTE: invert_palette}


def decode_image(stream: bytes) -> np.ndarray:
    """(height, width, 4) pixels of any lossless stream."""
    bits = _Bits(stream)
    _, height, coded, todo = _read_start(bits)
    image = _unpack(_read_pixels(bits, coded, height, True), coded)
    for kind, *more in reversed(todo):
        image = _INVERT[kind](image, *more)
    return image


# ---------------------------------------------------------------- many images


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Lookup tables (images, 2**bits) of symbol * 16 + length for rows of code lengths."""
    n, size = lengths.shape
    bits = max(1, int(lengths.max()))
    single = (lengths > 0).sum(axis=1) <= 1
    order = np.argsort(np.where(lengths == 0, 99, lengths) * size + np.arange(size), axis=1)
    sorted_lengths = np.take_along_axis(lengths, order, axis=1)
    reach = np.where(sorted_lengths > 0, 1 << (bits - sorted_lengths), 0)
    reach[single, 0], reach[single, 1:] = 1 << bits, 0
    if (reach.sum(axis=1) != 1 << bits).any():
        raise DamagedImage("prefix code is not complete")
    entry = (order << 4 | np.where(single[:, None], 0, sorted_lengths)).astype(np.uint16)
    table = np.repeat(entry.ravel(), reach.ravel()).reshape(n, 1 << bits)
    return table[:, _turned(np.arange(1 << bits), bits)], bits


@dataclass
class Head:
    """What stands before the pixels of a stream that the batch decoder takes."""

    height: int
    coded: int
    todo: list[tuple]
    cache_bits: int
    lengths: list[list[int]]
    at: int

    @property
    def size(self) -> int:
        return self.coded * self.height


def read_head(stream: bytes) -> Head | None:
    """The head of a stream, None if it has an entropy image, several alphas or very long codes."""
    bits = _Bits(stream)
    _, height, coded, todo = _read_start(bits)
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1) or cache_bits > 11:
        return None
    lengths = [_read_lengths(bits, n + (1 << cache_bits if cache_bits and k == GREEN else 0)) for k, n in enumerate(ALPHABETS)]
    if max(map(max, lengths)) > 12 or sum(map(bool, lengths[ALPHA])) > 1:
        return None
    return Head(height, coded, todo, cache_bits, lengths, bits.at)


#: Pixels that the batch decoder works on at a time, at least one image's.
PIXELS = 1 << 23


def decode_images(streams: list[bytes], lanes: int = 4096) -> list[np.ndarray]:
    """Pixels (height, width, 4) of many streams."""
    out: list[np.ndarray | None] = [None] * len(streams)
    heads = [read_head(s) for s in streams]
    plain = sorted((i for i, head in enumerate(heads) if head), key=lambda i: (-heads[i].size, i))
    lo = 0
    while lo < len(plain):
        group = plain[lo : lo + min(lanes, max(1, PIXELS // heads[plain[lo]].size))]
        for i, pixels in zip(group, _lockstep([streams[i] for i in group], [heads[i] for i in group])):
            if pixels is None:
                heads[i] = None
            else:
                out[i] = _unpack(pixels, heads[i].coded)
        lo += len(group)
    for i, head in enumerate(heads):
        if head is None:
            out[i] = decode_image(streams[i])
    left = {i: list(heads[i].todo) for i in plain if heads[i] and heads[i].todo}
    while left:
        predicted = []
        for i in list(left):
            while left[i] and left[i][-1][0] != PREDICTOR:
                kind, *more = left[i].pop()
                out[i] = _INVERT[kind](out[i], *more)
            if left[i]:
                predicted.append((i, *left[i].pop()[1:]))
            else:
                del left[i]
        if predicted:
            at, modes, bits = zip(*predicted)
            for i, image in zip(at, invert_predictors([out[i] for i in at], list(modes), list(bits))):
                out[i] = image
    return out


_NEAR_X, _NEAR_Y = (np.array([p[k] for p in NEAR]) for k in (0, 1))
#: Entries of the lookup tables: low bits are lengths, so that three of them add up to a pixel and its bits.
_SIZE_BITS, _SHIFT = 6, {GREEN: 14, RED: 22, BLUE: 6, DISTANCE: 6}
_STEPS = 32  # between two looks at which streams have ended


#: Of length and distance symbols: extra bits, and least value; of cached colours, which are one pixel: none.
_EXTRA = np.array([max(k - 2, 0) >> 1 if k >= 4 else 0 for k in range(40)], np.uint64)
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << (k - 2 >> 1)) + 1 for k in range(40)])
_GREEN_EXTRA, _GREEN_LEAST = np.zeros(280 + 2048, np.uint64), np.ones(280 + 2048, np.int64)
_GREEN_EXTRA[256:280], _GREEN_LEAST[256:280] = _EXTRA[:24], _LEAST[:24]
_GREEN_MASK, _MASK = ((np.uint64(1) << x) - np.uint64(1) for x in (_GREEN_EXTRA, _EXTRA))


def _lockstep(streams: list[bytes], heads: list[Head]) -> list[np.ndarray | None]:
    """Packed coded pixels of streams: one symbol of all a step, then copies and cached colours of all together.

    None stands for a stream that asks its cache for a colour that it never held.
    """
    n = len(streams)
    total = np.array([h.size for h in heads])
    pad = 8 * _STEPS + 8  # a damaged stream may read on for so many bytes
    padded = [s + bytes(len(s) & 1) for s in streams]
    byte_of = np.cumsum([0] + [len(p) for p in padded])
    halves = np.frombuffer(b"".join(padded) + bytes(pad), "<u2").astype(np.uint64)
    words = halves[:-3] | halves[1:-2] << np.uint64(16) | halves[2:-1] << np.uint64(32) | halves[3:] << np.uint64(48)
    at = byte_of[:-1] * 8 + np.array([h.at for h in heads])
    end = byte_of[:-1] * 8 + np.array([8 * len(s) for s in streams])
    tables, masks, rows = {}, {}, {}
    for k in (GREEN, RED, BLUE, DISTANCE):
        size = max(len(h.lengths[k]) for h in heads)
        table, bits = _tables(np.array([h.lengths[k] + [0] * (size - len(h.lengths[k])) for h in heads]))
        table = table.ravel().astype(np.int32)
        tables[k], masks[k], rows[k] = (table >> 4 << _SHIFT[k]) | (table & 15), np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) << bits
    width = np.array([h.coded for h in heads])
    base = np.cumsum(total + 1) - (total + 1)  # of each stream's pixels; one more place takes what comes after its end
    stop, to = base + total, base.copy()
    whole = np.zeros(int((total + 1).sum()) + int(_LEAST[23]) + 1024, np.uint32)  # a damaged stream may copy on for so many pixels
    out = whole[: int((total + 1).sum())]
    met = []  # (place, symbol, length, distance symbol, its extra bits and what follows, stream) of all that is no plain pixel
    odd_from, low = np.int32(256 << _SHIFT[GREEN]), np.int32((1 << _SIZE_BITS) - 1)
    live, step = np.arange(n), 0
    green_rows, red_rows, blue_rows, distance_rows = (rows[k] for k in (GREEN, RED, BLUE, DISTANCE))

    def window(pos):
        """49 bits or more from each place on."""
        return words[pos >> 4] >> (pos & 15).view(np.uint64)

    def look(k, lanes, v):
        return tables[k].take(lanes + (v & masks[k]).view(np.int64))

    while len(live):
        for _ in range(_STEPS):
            alive = to < stop
            v = window(at)
            green = look(GREEN, green_rows, v)
            v >>= (green & low).astype(np.uint64)
            red = look(RED, red_rows, v)
            v >>= (red & low).astype(np.uint64)
            row = green + red
            row += look(BLUE, blue_rows, v)
            used = row & low
            whole[to] = row >> _SIZE_BITS
            odd = np.flatnonzero(green >= odd_from)
            if len(odd):
                first, who = green[odd], live[odd]
                symbol, size = first >> _SHIFT[GREEN], first & low
                v = window(at[odd] + size)
                length = _GREEN_LEAST[symbol] + (v & _GREEN_MASK[symbol]).view(np.int64)
                more = _GREEN_EXTRA[symbol]
                v >>= more
                far = look(DISTANCE, distance_rows[who], v)
                more += (far & low).astype(np.uint64)
                v >>= (far & low).astype(np.uint64)
                far >>= _SHIFT[DISTANCE]
                more += _EXTRA[far]
                used[odd] = np.where(symbol < 280, size + more.view(np.int64), size)
                met.append((np.where(alive[odd], to[odd], -1), symbol, length, far, v, who))
                to[odd] += (length - 1) * alive[odd]
            used *= alive
            at += used
            to += alive
        if (at > end).any():
            raise DamagedImage("stream ends early")
        if (to > stop).any():
            raise DamagedImage("back-reference outside the image")
        on = np.flatnonzero(to < stop)
        if len(on) < len(live):
            live, at, to, end, stop, green_rows, red_rows, blue_rows = (x[on] for x in (live, at, to, end, stop, green_rows, red_rows, blue_rows))
    alpha = np.array([next((s for s, x in enumerate(h.lengths[ALPHA]) if x), 0) << 24 for h in heads], np.uint32)
    out |= np.repeat(alpha, total + 1)
    cache_bits = np.array([h.cache_bits for h in heads])
    place, symbol, length, far, v, who = (np.concatenate(x) for x in zip(*met)) if met else np.zeros((6, 0), np.int64)
    order = np.argsort(place)
    order = order[int((place < 0).sum()) :]
    odd = symbol[order] >= 280
    held, order = order[odd], order[~odd]
    held = [place[held], symbol[held] - 280]
    code = _LEAST[far[order]] + (v[order].astype(np.uint64) & _MASK[far[order]]).astype(np.int64)
    near = np.minimum(code, len(NEAR)) - 1
    reach = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[who[order]]))
    copied = [place[order], length[order], reach]
    if (copied[0] - reach < base[who[order]]).any():
        raise DamagedImage("back-reference outside the image")
    lost = np.zeros(n, dtype=bool)
    lo = 0
    while lo < n:  # a part of the images at a time, which bounds memory
        hi = max(lo + 1, int(np.searchsorted(base, base[lo] + PIXELS // 8)))
        a, z = int(base[lo]), int(base[hi - 1] + total[hi - 1]) + 1
        mine = [[x[0][i:j] - a, *(y[i:j] for y in x[1:])] for x in (held, copied) for i, j in [np.searchsorted(x[0], (a, z))]]
        lost[lo:hi] = _filled(out[a:z], base[lo:hi] - a, total[lo:hi], cache_bits[lo:hi], *mine)
        lo = hi
    return [None if lost[i] else out[b : b + t] for i, (b, t) in enumerate(zip(base.tolist(), total.tolist()))]


def _followed(source: np.ndarray, places: np.ndarray) -> None:
    """Lead ``places`` to what their sources, which lie before them, have from elsewhere in turn; by doubling."""
    while len(places):
        now = source[places]
        further = source[now]
        going = further != now
        places = places[going]
        source[places] = further[going]


def _filled(out: np.ndarray, base: np.ndarray, total: np.ndarray, cache_bits: np.ndarray, held: list, copied: list) -> np.ndarray:
    """Fill in copies (place, length, distance) and cached colours (place, slot); which images asked an empty cache."""
    lost = np.zeros(len(base), dtype=bool)
    source = np.arange(len(out))
    place, length, reach = copied
    copies = np.repeat(place - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    source[copies] = copies - np.repeat(reach, length)
    _followed(source, copies)
    place, slot = held
    if len(place):
        image = np.repeat(np.arange(len(base)), total + 1)
        among = np.flatnonzero(cache_bits[image] > 0)
        slots = np.zeros(len(out), np.uint16)
        slots[among] = out[among] * np.uint32(CACHE_MULTIPLIER) >> (32 - cache_bits[image[among]]).astype(np.uint32)
        slots[place] = slot
        order = among[np.argsort(slots[source[among]], kind="stable")]  # a slot's places, in order of images and pixels
        before = np.full(len(out), -1)
        before[order[1:]] = order[:-1]
        last, image = before[place], image[place]
        none = (last < base[image]) | (slots[source[np.maximum(last, 0)]] != slot)
        lost[image[none]] = True
        source[place] = np.where(none, place, last)
        _followed(source, place)
        out[place] = out[source[place]]
    out[copies] = out[source[copies]]
    return lost


# ---------------------------------------------------------------- encoder

_LIMIT = 10
#: Lengths of the encoder's own code-length code: every length up to 10, and the two runs of zeros.
_INNER = {0: 3, 6: 3, 7: 3, 1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 8: 4, 9: 4, 10: 4, 17: 4, 18: 4}


def _turned(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(values)
    for k in range(bits):
        out |= ((values >> k) & 1) << (bits - 1 - k)
    return out


_TURN = _turned(np.arange(1 << _LIMIT), _LIMIT)


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of rows of code lengths, bits turned for writing."""
    n, size = lengths.shape
    order = np.argsort(np.where(lengths == 0, 99, lengths) * size + np.arange(size), axis=1)
    sorted_lengths = np.take_along_axis(lengths, order, axis=1)
    step = np.where(sorted_lengths > 0, 1 << (_LIMIT - sorted_lengths), 0)
    start = (np.cumsum(step, axis=1) - step) >> (_LIMIT - sorted_lengths)
    code = np.zeros((n, size), np.int64)
    np.put_along_axis(code, order, start, axis=1)
    return _TURN[code] >> (_LIMIT - lengths)


def fitted_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete code lengths up to the limit for rows of symbol counts."""
    n, size = counts.shape
    used = counts > 0
    total = counts.sum(axis=1, keepdims=True)
    ideal = np.ceil(np.log2(np.maximum(total, 1) / np.maximum(counts, 1)))
    lengths = np.where(used, np.clip(ideal, 1, _LIMIT), 0).astype(np.int64)
    several = used.sum(axis=1) > 1
    space = np.where(used, 1 << (_LIMIT - lengths), 0).sum(axis=1)
    full = 1 << _LIMIT
    order = np.argsort(-counts, axis=1, kind="stable")
    depth = int(used.sum(axis=1).max(initial=0))
    row = np.arange(n)
    while (space > full).any():  # rare symbols were cut at the limit: lengthen from the rarest on
        for k in range(depth - 1, -1, -1):
            s = order[:, k]
            now = lengths[row, s]
            go = (space > full) & (now > 0) & (now < _LIMIT)
            lengths[row[go], s[go]] += 1
            space[go] -= 1 << (_LIMIT - 1 - now[go])
    while ((space < full) & several).any():  # room is left: shorten from the most frequent on
        for k in range(depth):
            s = order[:, k]
            now = lengths[row, s]
            gain = np.where(now > 1, 1 << (_LIMIT - np.maximum(now, 1)), full)
            go = several & (now > 1) & (space + gain <= full)
            if go.any():
                lengths[row[go], s[go]] -= 1
                space[go] += gain[go]
    return lengths


def _length_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bits, number of bits) that spell rows of code lengths, in order."""
    inner = np.zeros((1, 19), np.int64)
    inner[0, list(_INNER)] = list(_INNER.values())
    code, size = _canonical(inner)[0], inner[0]
    n, width = lengths.shape
    flat = lengths.ravel()
    at = np.arange(n * width)
    first = np.ones(n * width, dtype=bool)
    first[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    first[::width] = True
    starts = np.flatnonzero(first)
    run = np.diff(np.append(starts, n * width))
    zero = flat[starts] == 0
    rows, order, value, count = [], [], [], []

    def put(where, symbol, extra, extra_bits, rank):
        rows.append(at[where] // width)
        order.append(where * 4 + rank)
        value.append(code[symbol] | extra << size[symbol])
        count.append(size[symbol] + extra_bits)

    put(starts[~zero], flat[starts[~zero]], 0, 0, 0)
    where, left = starts[zero], run[zero]
    rank = 0
    while len(where):
        long, middle = left >= 11, (left >= 3) & (left < 11)
        taken = np.where(long, np.minimum(left, 138), np.where(middle, left, 1))
        symbol = np.where(long, 18, np.where(middle, 17, 0))
        extra = np.where(long, taken - 11, np.where(middle, taken - 3, 0))
        put(where, symbol, extra, np.where(long, 7, np.where(middle, 3, 0)), rank)
        left = left - taken
        where, left = where[left > 0], left[left > 0]
        rank += 1
    rows, order, value, count = (np.concatenate([np.broadcast_to(x, np.shape(o)) for x, o in zip(part, order)]) for part in (rows, order, value, count))
    by = np.argsort(order, kind="stable")
    return rows[by], value[by], count[by]


CACHE_BITS = 6
PREDICTOR_BLOCK = 5
_FIRST_MODES = np.arange(1, 14)
_FACTORS = (-32, -8, 8, 16, 32)


def _flat_code(bits: int) -> tuple[int, int]:
    """(value, number of bits) that spell a code in which each of the first 2**bits symbols has that many bits."""
    place, more = CODE_LENGTH_ORDER.index(bits), (bits - 1) // 2
    parts = [(0, 1), (place - 3, 4), (1 << 3 * place, 3 * place + 3), (1, 1), (more, 3), ((1 << bits) - 2, 2 + 2 * more)]
    value = size = 0
    for v, n in parts:
        value |= v << size
        size += n
    return value, size


def _prefix_parts(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, number of extra bits) of lengths or distances."""
    u = value - 1
    top = np.frexp(np.maximum(u, 1))[1].astype(np.int64) - 1
    n = np.where(u < 4, 0, top - 1)
    return np.where(u < 4, u, 2 * top + (u >> np.maximum(n, 0) & 1)), np.where(u < 4, 0, u & ((1 << n) - 1)), n


def _signed(x: np.ndarray) -> np.ndarray:
    """Bytes 0..255 as -128..127."""
    return (x & 255 ^ 128) - 128


def _least(costs: list[np.ndarray]) -> np.ndarray:
    return np.stack(costs).argmin(axis=0)


class _Bitstream:
    """Bits of many images, put in the order in which each image has them."""

    def __init__(self, n: int):
        self.n, self.parts = n, []

    def put(self, value, count, where=None) -> None:
        where = np.arange(self.n) if where is None else where
        self.parts.append((where, np.broadcast_to(np.asarray(value).astype(np.uint64), where.shape), np.broadcast_to(np.asarray(count, np.int64), where.shape)))

    def files(self) -> list[bytes]:
        where, value, count = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(where.astype(np.uint16) if self.n <= 1 << 16 else where, kind="stable")
        where, value, count = where[order], value[order], count[order]
        per_image = np.bincount(where, count, self.n).astype(np.int64)
        words = (per_image + 63) // 64
        base = np.cumsum(words) - words
        at = np.cumsum(count) - count - (np.cumsum(per_image) - per_image)[where] + base[where] * 64
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[new]] = np.bitwise_or.reduceat(value << shift, new)
        over = np.flatnonzero((at & 63) + count > 64)  # one a word at most
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        raw = out.astype("<u8").tobytes()
        files = []
        for b, size in zip((base * 8).tolist(), ((per_image + 7) // 8).tolist()):
            pad = size & 1
            files.append(struct.pack("<4sI4s4sI", b"RIFF", 12 + size + pad, b"WEBP", b"VP8L", size) + raw[b : b + size] + bytes(pad))
        return files


def _predicted(rgb: np.ndarray, image: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of whole images, and each block's mode (image, down, across): the one with the least residuals."""
    near = [np.roll(rgb, k, axis=0) for k in (1, width, width - 1, width + 1)]
    block = (image << 2) | (y >> PREDICTOR_BLOCK << 1) | (x >> PREDICTOR_BLOCK)
    rest = [(rgb - _predict(int(m), *near)) & 255 for m in _FIRST_MODES]
    inner = (x > 0) & (y > 0)  # the others have fixed predictions
    cost = [np.bincount(block, _summed(np.abs(_signed(r))) * inner, minlength=4 * (int(image.max()) + 1)) for r in rest]
    modes = _least(cost)
    out = np.choose(modes[block][:, None], rest)
    out = np.where((y == 0)[:, None], (rgb - near[0]) & 255, np.where((x == 0)[:, None], (rgb - near[1]) & 255, out))
    start = (x == 0) & (y == 0)
    out[start] = rgb[start]
    return out, _FIRST_MODES[modes].reshape(-1, 2, 2)


def _matches(argb: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pixel, length, distance) of back-references: the last earlier place of the same four pixels, carried on while it fits."""
    n = len(argb)
    if n < 5:
        return (np.zeros(0, np.int64),) * 3
    wide = argb.astype(np.uint64)
    key = image[: n - 3].astype(np.uint64)
    for k in range(4):
        key = (key ^ wide[k : n - 3 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    tie = key[order[1:]] == key[order[:-1]]
    equal = np.flatnonzero(np.append(tie, False) | np.append(False, tie))  # places of equal keys are put in order
    ranked = np.cumsum(np.append(True, ~tie))[equal] << 32 | order[equal]
    ranked.sort()
    order[equal] = ranked & ((1 << 32) - 1)
    before, after = order[:-1], order[1:]
    same = image[before] == image[np.minimum(after + 3, n - 1)]
    for k in range(4):
        same &= argb[before + k] == argb[after + k]
    far = np.zeros(n, np.int64)
    far[after[same]] = (after - before)[same]
    found = np.flatnonzero(far)
    if not len(found):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.diff(far, prepend=-1))
    stop = np.append(new, n)[np.searchsorted(new, found, side="right")]
    at, ends, taken, reach = found.tolist(), (stop + 3).tolist(), [], -1
    for i, (p, e) in enumerate(zip(at, ends)):
        if p >= reach:
            taken.append(i)
            reach = e
    pick = found[taken]
    return pick, stop[taken] + 3 - pick, far[pick]


def encode_images(samples: np.ndarray, sizes: np.ndarray, width: int) -> list[bytes]:
    """WebP files of images of ``width`` pixels, at most 64, whose rows of (red, green, blue) bytes lie end to end.

    ``sizes`` are the images' numbers of bytes, multiples of ``3 * width``, for at most 64 rows.
    What an image uses depends on its own bytes alone: a palette, if it has few colours;
    else, by its checksum, one of eight ways: predictor, cross-colour, subtract-green, all
    three, or none in four of them; a colour cache, if it would serve an eighth of the pixels; and
    back-references wherever four pixels or more stand earlier in the image.
    """
    n = len(sizes)
    bits = _Bitstream(n)
    put = bits.put
    rgb = samples.reshape(-1, 3).astype(np.int16)
    n_pixels = sizes // 3
    first = np.cumsum(n_pixels) - n_pixels
    image = np.repeat(np.arange(n), n_pixels)
    y, x = np.divmod(np.arange(len(rgb)) - first[image], width)
    colour = rgb[:, 0].astype(np.int64) << 16 | rgb[:, 1].astype(np.int64) << 8 | rgb[:, 2]
    colours = np.unique(image << 24 | colour)
    n_colours = np.bincount(colours >> 24, minlength=n)
    first_colour = np.cumsum(n_colours) - n_colours
    with_palette = (n_colours <= 16) | ((n_colours <= 256) & (4 * n_colours <= n_pixels))
    way = np.array([zlib.crc32(samples[a : a + s]) % 8 for a, s in zip((3 * first).tolist(), sizes.tolist())], np.int64)
    way[with_palette] = -1
    subtracted, predicted, crossed = (np.isin(way, w) for w in ((2, 3), (0, 3), (1, 3)))

    put(0x2F | (width - 1) << 8 | (n_pixels // width - 1).astype(np.uint64) << np.uint64(22), 40)
    # Subtract-green.
    put(1 | SUBTRACT_GREEN << 1, 3, np.flatnonzero(subtracted))
    at = np.flatnonzero(subtracted[image])
    rgb[at, 0] = (rgb[at, 0] - rgb[at, 1]) & 255
    rgb[at, 2] = (rgb[at, 2] - rgb[at, 1]) & 255
    # Predictor: a mode for each block.
    who = np.flatnonzero(predicted)
    if len(who):
        at = np.flatnonzero(predicted[image])
        rgb[at], modes = _predicted(rgb[at], np.searchsorted(who, image[at]), x[at], y[at], width)
        put(1 | PREDICTOR << 1 | (PREDICTOR_BLOCK - 2) << 3, 6, who)
        put(0, 1, who)
        put(*_flat_code(4), who)
        for symbol in (0, 0, 255, 0):
            put(0b101 | symbol << 3, 11, who)
        down, across = ((k + (1 << PREDICTOR_BLOCK) - 1) >> PREDICTOR_BLOCK for k in (n_pixels[who] // width, width))
        for i in range(2):
            for j in range(across):
                here = down > i
                put(_turned(modes[here, i, j], 4), 4, who[here])
    # Cross-colour: one set of factors for each image.
    who = np.flatnonzero(crossed)
    if len(who):
        at = np.flatnonzero(crossed[image])
        of = np.searchsorted(who, image[at])
        red, green, blue = (rgb[at, k].astype(np.int64) for k in range(3))

        def best(channel, by, factors):
            rest = [(channel - (f * _signed(by) >> 5)) & 255 for f in factors]
            pick = _least([np.bincount(of, np.abs(_signed(r)), minlength=len(who)) for r in rest])
            return np.choose(pick[of], rest), np.array(factors)[pick] & 255

        new_red, green_to_red = best(red, green, _FACTORS)
        new_blue, green_to_blue = best(blue, green, _FACTORS)
        new_blue, red_to_blue = best(new_blue, red, (0, *_FACTORS))
        rgb[at, 0], rgb[at, 2] = new_red, new_blue
        put(1 | CROSS_COLOR << 1 | 7 << 3, 6, who)
        put(0, 1, who)
        for symbol in (green_to_blue, red_to_blue, green_to_red, np.full(len(who), 255), np.zeros(len(who), np.int64)):
            put(0b101 | symbol << 3, 11, who)
    # Palette: colours as steps, and several pixels in one where they are few.
    pack = np.where(with_palette, np.select([n_colours <= 2, n_colours <= 4, n_colours <= 16], [3, 2, 1], 0), 0)
    who = np.flatnonzero(with_palette)
    if len(who):
        put(1 | PALETTE << 1 | (n_colours[who] - 1) << 3, 11, who)
        put(0, 1, who)
        for _ in range(3):
            put(*_flat_code(8), who)
        put(0b11 | 1 << 2 | 0 << 3 | 255 << 11, 19, who)
        put(0b101, 11, who)
        of = colours >> 24
        mine = with_palette[of]
        value = colours & 0xFFFFFF
        parts = []
        for shift in (8, 16, 0):  # green, red, blue
            c = value >> shift & 255
            step = np.diff(c, prepend=0)
            step[first_colour] = c[first_colour]
            parts.append(_turned(step & 255, 8))
        opaque = np.zeros(len(value), np.int64)
        opaque[first_colour] = 1
        put((parts[0] | parts[1] << 8 | parts[2] << 16 | opaque << 24)[mine], 25, of[mine])
    put(0, 1)  # no more transforms

    coded_width = -(-width // (1 << pack))
    coded = coded_width * (n_pixels // width)
    start = np.cumsum(coded) - coded
    total = int(coded.sum())
    alpha = np.where(predicted, 0, 255)
    to = start[image] + y * coded_width[image] + (x >> pack[image])
    mine = with_palette[image]
    of = image[mine]
    local = np.searchsorted(colours, of << 24 | colour[mine]) - first_colour[of] << (x[mine] & (1 << pack[of]) - 1) * (8 >> pack[of])
    argb = np.bincount(to[mine], local, minlength=total).astype(np.int64) << 8
    argb[to[~mine]] = rgb[~mine, 0].astype(np.int64) << 16 | rgb[~mine, 1].astype(np.int64) << 8 | rgb[~mine, 2]
    image = np.repeat(np.arange(n), coded)
    argb |= alpha[image] << 24

    # Back-references, then the cache for what they leave.
    head, length, far = _matches(argb, image)
    inside = np.zeros(total + 1, np.int64)
    np.add.at(inside, head, 1)
    np.add.at(inside, head + length, -1)
    free = np.cumsum(inside[:total]) == 0
    slot = (CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    key = image << CACHE_BITS | slot
    order = np.argsort(slot.astype(np.uint8), kind="stable")  # equal slots of an image lie together, as images do
    hit = np.zeros(total, dtype=bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    hit &= free
    cached = (8 * np.bincount(image, hit, minlength=n) >= coded) & ~with_palette
    hit &= cached[image]
    literal = free & ~hit

    n_green = ALPHABETS[GREEN] + (1 << CACHE_BITS)
    symbols = {GREEN: argb >> 8 & 255, RED: argb >> 16 & 255, BLUE: argb & 255}
    symbols[GREEN][hit] = ALPHABETS[GREEN] + slot[hit]
    length_symbol, length_extra, length_bits = _prefix_parts(length)
    symbols[GREEN][head] = 256 + length_symbol
    reach = np.zeros(8 * 64 + 8, np.int64)
    distance = far + len(NEAR)
    for w in np.unique(coded_width).tolist():
        reach[:] = 0
        for k in range(len(NEAR), 0, -1):
            reach[_distance(k, w)] = k
        here = (coded_width[image[head]] == w) & (far < len(reach))
        short = reach[far[here]]
        distance[np.flatnonzero(here)[short > 0]] = short[short > 0]
    distance_symbol, distance_extra, distance_bits = _prefix_parts(distance)

    put(np.where(cached, 1 | CACHE_BITS << 1, 0), np.where(cached, 5, 1))
    put(0, 1)  # one group of codes
    inner = [_INNER.get(k, 0) for k in CODE_LENGTH_ORDER[:14]]
    spelled = 10 << 1 | sum(v << (5 + 3 * i) for i, v in enumerate(inner))
    token = free.copy()
    token[head] = True
    counted = {GREEN: (image[token], symbols[GREEN][token], n_green), RED: (image[literal], symbols[RED][literal], 256), BLUE: (image[literal], symbols[BLUE][literal], 256), DISTANCE: (image[head], distance_symbol, 40)}
    codes = {}
    for k in (GREEN, RED, BLUE, ALPHA, DISTANCE):
        if k == ALPHA:
            put(0b101 | alpha << 3, 11)
            continue
        of, symbol, size = counted[k]
        counts = np.bincount(of * size + symbol, minlength=size * n).reshape(n, size)
        lengths = fitted_lengths(counts)
        one = (counts > 0).sum(axis=1) <= 1
        put(0b101 | counts.argmax(axis=1)[one] << 3, 11, np.flatnonzero(one))
        for some, alphabet in ((~one & cached, size), (~one & ~cached, min(size, ALPHABETS[k]))):
            other = np.flatnonzero(some)
            put(spelled, 5 + 3 * 14 + 1, other)
            if len(other):
                row, value, count = _length_tokens(lengths[other, :alphabet])
                put(value, count, other[row])
        lengths[one] = 0
        codes[k] = _canonical(lengths), lengths

    def spelled_by(k, at, symbol):
        index = image[at] * codes[k][0].shape[1] + symbol
        return codes[k][0].ravel()[index], codes[k][1].ravel()[index]

    tokens = np.flatnonzero(token)
    value, count = spelled_by(GREEN, tokens, symbols[GREEN][tokens])
    plain = np.flatnonzero(literal[tokens])
    at, before = tokens[plain], count[plain]
    (red, red_bits), (blue, blue_bits) = (spelled_by(k, at, symbols[k][at]) for k in (RED, BLUE))
    value[plain] |= (red | blue << red_bits) << before
    count[plain] = before + red_bits + blue_bits
    copied = np.searchsorted(tokens, head)
    before = count[copied]
    far_code, far_bits = spelled_by(DISTANCE, head, distance_symbol)
    value[copied] |= (length_extra | (far_code | distance_extra << far_bits) << length_bits) << before
    count[copied] = before + length_bits + far_bits + distance_bits
    put(value, count, image[tokens])
    return bits.files()
