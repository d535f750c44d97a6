import hashlib
import zlib

import numpy as np
import pytest

from strandloom.llm import mediatext, webp
from tests.llm.fixtures import awkward, table


class Writer:
    """Test-side bit writer for streams with features that the encoder does not use."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def code(self, lengths):
        """Write code lengths with a flat code-length code; returns symbol -> (code, length)."""
        self.put(0, 1)
        self.put(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(format(n, "04b")[::-1], 2), 4)
        out, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            last = n
            out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
            code += 1
        return out

    def one(self, symbol):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.put(v, n)
        return {symbol: (0, 0)}

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(b, np.uint8), bitorder="little").tobytes()


def flat(n, size):
    return [n] * (1 << n) + [0] * (size - (1 << n))


def put_image(w, pixels, main, cache_bits=0, moves=()):
    """Write (alpha, red, green, blue) pixels as literals, but for ``moves``: at -> (length, distance symbol)."""
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    lengths = [9] * size + []
    spare = 512 - size
    lengths = [8] * spare + [9] * (size - spare)  # a complete code over all symbols
    green = w.code(lengths)
    red, blue, alpha = (w.code(flat(8, 256)) for _ in range(3))
    dist = w.code(flat(5, 40))
    cache, at = {}, 0
    moves = dict(moves)
    while at < len(pixels):
        a, r, g, b = (int(x) for x in pixels[at])
        packed = a << 24 | r << 16 | g << 8 | b
        slot = (webp.CACHE_MULTIPLIER * packed & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if at in moves:
            length, symbol = moves[at]
            assert length <= 4
            w.put(*green[256 + length - 1])
            w.put(*dist[symbol])
            n = length
        elif cache_bits and cache.get(slot) == packed:
            w.put(*green[280 + slot])
            n = 1
        else:
            for table_, v in ((green, g), (red, r), (blue, b), (alpha, a)):
                w.put(*table_[v])
            n = 1
        for p in pixels[at : at + n]:
            q = int(p[0]) << 24 | int(p[1]) << 16 | int(p[2]) << 8 | int(p[3])
            if cache_bits:
                cache[(webp.CACHE_MULTIPLIER * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
        at += n


def start(width, height):
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def picture(height, width, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    base[:, width // 2 :] = base[:, :1]
    return base


def both(stream):
    one, many = webp.decode_image(stream), webp.decode_images([stream])[0]
    assert (one == many).all()
    return one


def test_literals_and_cache():
    p = picture(6, 9)
    for bits in (0, 3):
        w = start(9, 6)
        w.put(0, 1)
        put_image(w, p.reshape(-1, 4), True, bits)
        assert (both(w.bytes()) == p).all()


def test_back_references_in_both_decoders():
    p = np.zeros((4, 8, 4), np.uint8)
    p[..., 0] = 255
    p[:, :, 2] = np.arange(8) % 4
    flat_p = p.reshape(-1, 4)
    w = Writer()
    w.put(0x2F, 8)
    w.put(7, 14)
    w.put(3, 14)
    w.put(0, 4)
    w.put(0, 3)  # no transform, cache or groups
    green = w.code([8] * (512 - 280) + [9] * (560 - 512))
    red, blue, alpha = w.code(flat(8, 256)), w.code(flat(8, 256)), w.one(255)
    dist = w.code(flat(5, 40))
    for at in range(8):
        for t, v in ((green, int(flat_p[at, 2])), (red, 0), (blue, 0), (alpha, 255)):
            w.put(*t[v])
    for _ in range(6):  # symbol 0 is distance 1 in codes: the pixel above
        w.put(*green[259])
        w.put(*dist[0])
    assert (both(w.bytes()) == p).all()


def test_subtract_green_cross_colour_and_predictor():
    want = picture(8, 12, 4)
    for mode in range(14):
        modes = np.zeros((2, 3, 4), np.uint8)
        modes[..., 0], modes[..., 2] = 255, mode
        flat_want = want.reshape(-1, 4).astype(int)
        residual = np.zeros_like(flat_want)
        for i in range(96):
            y, x = divmod(i, 12)
            if i == 0:
                guess = np.array([255, 0, 0, 0])
            elif y == 0:
                guess = flat_want[i - 1]
            elif x == 0:
                guess = flat_want[i - 12]
            else:
                guess = webp._predict(mode, flat_want[i - 1], flat_want[i - 12], flat_want[i - 11], flat_want[i - 13])
            residual[i] = (flat_want[i] - guess) & 255
        w = start(12, 8)
        w.put(1, 1)
        w.put(webp.PREDICTOR, 2)
        w.put(0, 3)
        put_image(w, modes.reshape(-1, 4), False)
        w.put(0, 1)
        put_image(w, residual, True)
        assert (both(w.bytes()) == want).all(), mode

    factors = np.full((2, 3, 4), 255, np.uint8)
    factors[..., 1:] = [[[200, 17, 33], [1, 2, 3], [90, 250, 128]]] * 2
    sent = want.astype(int)
    per = factors[np.arange(8)[:, None] >> 2, np.arange(12) >> 2].astype(np.int8).astype(int)
    signed = lambda x: x.astype(np.uint8).astype(np.int8).astype(int)
    sent[..., 3] = (sent[..., 3] - (per[..., 2] * signed(want[..., 2]) >> 5) - (per[..., 1] * signed(want[..., 1]) >> 5)) & 255
    sent[..., 1] = (sent[..., 1] - (per[..., 3] * signed(want[..., 2]) >> 5)) & 255
    w = start(12, 8)
    w.put(1, 1)
    w.put(webp.CROSS_COLOR, 2)
    w.put(0, 3)
    put_image(w, factors.reshape(-1, 4), False)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    sent[..., 1] = (sent[..., 1] - sent[..., 2]) & 255
    sent[..., 3] = (sent[..., 3] - sent[..., 2]) & 255
    put_image(w, sent.reshape(-1, 4), True)
    assert (both(w.bytes()) == want).all()


@pytest.mark.parametrize("colours", [2, 3, 9, 40])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    index = rng.integers(0, colours, (5, 11))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    size, per = 8 >> pack, 1 << pack
    across = -(-11 // per)
    packed = np.zeros((5, across, 4), np.uint8)
    packed[..., 0] = 255
    for x in range(11):
        packed[:, x // per, 2] |= (index[:, x] << (size * (x % per))).astype(np.uint8)
    w = start(11, 5)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(colours - 1, 8)
    put_image(w, np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8)), False)
    w.put(0, 1)
    put_image(w, packed.reshape(-1, 4), True)
    assert (both(w.bytes()) == palette[index]).all()


def test_damage_is_reported():
    stream = webp.image_chunk(webp.encode_images(np.arange(192, dtype=np.uint8), np.array([192]), 64)[0])
    for bad in (b"", b"\x00" + stream[1:], stream[:30]):
        with pytest.raises(webp.DamagedImage):
            webp.decode_images([bad])


def test_encoder_round_trip():
    rng = np.random.default_rng(1)
    pay = [bytes([7]) * 192, bytes(rng.integers(0, 256, 192 * 64, dtype=np.uint8)), bytes(rng.integers(0, 2, 384, dtype=np.uint8)), bytes(range(192))]
    skew = np.concatenate([np.zeros(192 * 60, np.uint8), np.arange(768, dtype=np.int64).astype(np.uint8)])
    pay.append(skew.tobytes())
    files = webp.encode_images(np.frombuffer(b"".join(pay), np.uint8), np.array([len(p) for p in pay]), 64)
    for f, p in zip(files, pay):
        assert both(webp.image_chunk(f))[..., 1:].tobytes() == p


def test_operator_on_awkward_rows(spark):
    rows = awkward()
    media = mediatext.with_media(table(spark, rows))
    got = mediatext.media_features(media).collect()
    assert len(got) == len(rows)
    by_text = {}
    want = sorted((str(i), len((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == want
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        raw += b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
        assert by_text.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    pixels = {r.doc_id: bytes(r.pixels) for r in mediatext.pixel_arrays(media).collect()}
    assert pixels[9][:7] == b"one two" and len(pixels[9]) == 192
    assert mediatext.media_features(mediatext.with_media(table(spark, []))).count() == 0


def test_the_query_uses_every_part_of_the_format(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mediatext.with_media(docs).collect()
    streams = [webp.image_chunk(f) for r in rows for f in mediatext.media_files(bytes(r.media))]
    heads = [webp.read_head(s) for s in streams]
    assert all(heads)  # all of them are decoded by the batch decoder
    for kind in (webp.PREDICTOR, webp.CROSS_COLOR, webp.SUBTRACT_GREEN, webp.PALETTE):
        assert sum(kind in [k for k, *_ in h.todo] for h in heads) >= 3, kind
    assert sum(h.cache_bits > 0 for h in heads) >= 20
    assert sum(any(h.lengths[webp.GREEN][256:280]) for h in heads) >= 20
    for k in range(0, len(streams), 9):  # the decoder of single images agrees
        assert (webp.decode_image(streams[k]) == webp.decode_images([streams[k]])[0]).all()


def test_an_image_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(5)
    pay = [rng.integers(60, 60 + k, 192 * (1 + k % 7), dtype=np.uint8) for k in range(1, 60)]
    sizes = np.array([len(p) for p in pay])
    together = webp.encode_images(np.concatenate(pay), sizes, 64)
    assert together == [webp.encode_images(p, sizes[i : i + 1], 64)[0] for i, p in enumerate(pay)]
    for f, p in zip(together, pay):
        assert both(webp.image_chunk(f))[..., 1:].tobytes() == p.tobytes()


def test_a_step_decodes_a_symbol_of_every_image(monkeypatch):
    """op1: copied pixels take no steps of their own, and parts of a batch give what single images give."""
    lines = [bytes([65 + i % 26, 97 + i % 7, 32]) * 64 for i in range(64)]
    blank = np.full(64 * 64 * 3, 32, np.uint8)
    samples = [blank, np.frombuffer(b"".join(lines), np.uint8), *(np.frombuffer(np.random.default_rng(i).bytes(192 * rows), np.uint8) for i, rows in enumerate((1, 2, 9)))]
    streams = [webp.image_chunk(f) for f in webp.encode_images(np.concatenate(samples), np.array([len(s) for s in samples]), 64)]
    alone = [webp.decode_image(s) for s in streams]
    assert all((a[..., 1:].ravel() == s).all() for a, s in zip(alone, samples))
    for pixels in (1, 5000, webp.PIXELS):
        monkeypatch.setattr(webp, "PIXELS", pixels)
        assert all((a == b).all() for a, b in zip(alone, webp.decode_images(streams)))
    asked = []
    followed = webp._followed
    monkeypatch.setattr(webp, "_followed", lambda source, places: (asked.append(len(places)), followed(source, places)))
    webp.decode_images(streams[:2])
    assert sum(asked) > 4000


def test_values_of_prefix_symbols():
    """op1: the tables of lengths and distances give what the bit reader gives."""
    for symbol in range(40):
        extra = int(webp._EXTRA[symbol])
        for more in {0, (1 << extra) - 1, (1 << extra) // 3}:
            assert int(webp._LEAST[symbol]) + more == webp._prefixed(webp._Bits(more.to_bytes(8, "little")), symbol)
