import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import webp
from tidewater.llm.media import media_round_trip, padded, payloads
from tidewater.llm.webp import Writer, decode, decode_many, encode_texts, near_pixels, write_lengths


# Fixed values of the format: the pixels (to the left, up) that the distance codes 1 to 120 stand for.
DISTANCE_MAP = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


def test_near_pixels_are_those_of_the_format():
    assert list(near_pixels()) == DISTANCE_MAP


def body(out: Writer) -> bytes:
    data = b"\x2f" + out.value.to_bytes(-(-out.n // 8), "little")
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def turned(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2)


class Stream(Writer):
    """An encoder of literals, back-references and cache hits with codes of equal lengths."""

    def image(self, steps, cache: int = 0):
        self.put(bool(cache), 1)
        if cache:
            self.put(cache, 4)

    def codes(self, cache: int = 0):
        """Green has 512 codes of 9 bits where they are needed; the rest 8 bits; distances 5 bits and 6."""
        n = 280 + (1 << cache if cache else 0)
        lengths = [9] * n
        short = 512 - n  # so many symbols have a bit less
        assert 0 <= short <= n
        self.green = dict.fromkeys(range(n))
        for i in range(short):
            lengths[i] = 8
        write_lengths(self, tuple(lengths))
        self.green = {s: c for s, c in webp.PrefixCode(lengths).codes.items()}
        for _ in range(3):
            write_lengths(self, (8,) * 256)
        d = [5] * 24 + [6] * 16
        write_lengths(self, tuple(d))
        self.far = webp.PrefixCode(d).codes

    def literal(self, p: int):
        self.put(*self.green[p >> 8 & 255])
        for shift in (16, 0, 24):
            self.put(turned(p >> shift & 255, 8), 8)

    def number(self, v: int, table, first: int):
        if v <= 4:
            return self.put(*table[first + v - 1])
        v -= 1
        extra = v.bit_length() - 2
        self.put(*table[first + 2 * (extra + 1) + (v >> extra & 1)])
        self.put(v & ((1 << extra) - 1), extra)

    def copy(self, n: int, d: int):
        self.number(n, self.green, 256)
        self.number(d, self.far, 0)

    def cached(self, k: int):
        self.put(*self.green[280 + k])

    def pixels(self, values):
        self.image(None)
        self.codes()
        for p in values:
            self.literal(p)


def head(width, height, *transforms):
    out = Stream()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *rest in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            out.put(rest[0] - 2, 3)
            out.pixels(rest[1])
        elif kind == webp.PALETTE:
            out.put(len(rest[0]) - 1, 8)
            last = [0] * 4
            store = []
            for p in rest[0]:
                now = [p >> s & 255 for s in (0, 8, 16, 24)]
                store.append(sum((a - b & 255) << s for a, b, s in zip(now, last, (0, 8, 16, 24))))
                last = now
            out.pixels(store)
    out.put(0, 1)
    return out


def argb(image):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in image.reshape(-1, 4)]


def test_literals_copies_and_cache():
    rng = random.Random(3)
    out = head(20, 15)
    out.image(None, 6)
    out.put(0, 1)  # one group
    out.codes(6)
    pixels = []
    cache = [0] * 64

    def add(p):
        pixels.append(p)
        cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> 26] = p

    palette = [rng.getrandbits(32) for _ in range(9)]
    used = set()
    while len(pixels) < 300:
        kind = rng.random()
        if kind < 0.4 or not pixels:
            p = rng.choice(palette)
            out.literal(p)
            add(p)
        elif kind < 0.7:
            code = rng.randrange(1, 300)
            dx, dy = near_pixels()[code - 1] if code <= 120 else (code - 120, 0)
            d = max(1, dx + dy * 20)
            n = rng.choice([1, 2, 5, 17, 40])
            if d > len(pixels) or len(pixels) + n > 300:
                continue
            used.add(code > 120)
            out.copy(n, code)
            for _ in range(n):
                add(pixels[-d])
        else:
            k = rng.randrange(64)
            out.cached(k)
            add(cache[k])
    assert used == {True, False}
    assert argb(decode(body(out))) == pixels


def test_groups_by_block():
    rng = random.Random(4)
    out = head(10, 9)
    out.image(None)
    out.put(1, 1)
    out.put(0, 3)  # blocks of 4 x 4
    out.pixels([g << 8 for g in [0, 1, 2, 1, 1, 0, 2, 2, 0]])
    codes = []
    for _ in range(3):
        out.codes()
        codes.append(out.green)
    pixels = [rng.getrandbits(32) for _ in range(90)]
    which = [0, 1, 2, 1, 1, 0, 2, 2, 0]
    for i, p in enumerate(pixels):
        out.green = codes[which[(i // 10 // 4) * 3 + i % 10 // 4]]
        out.literal(p)
    assert argb(decode(body(out))) == pixels


def predicted(mode, l, t, tl, tr):
    """One channel-wise prediction; select looks at whole pixels."""
    avg = lambda *x: sum(x) // 2
    clamp = lambda x: min(255, max(0, x))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(l, t, tl)]
        return l if sum(abs(g - a) for g, a in zip(guess, l)) < sum(abs(g - b) for g, b in zip(guess, t)) else t
    one = {
        0: lambda a, b, c, d, k: 255 if k == 3 else 0, 1: lambda a, b, c, d, k: a, 2: lambda a, b, c, d, k: b, 3: lambda a, b, c, d, k: d, 4: lambda a, b, c, d, k: c,
        5: lambda a, b, c, d, k: avg(avg(a, d), b), 6: lambda a, b, c, d, k: avg(a, c), 7: lambda a, b, c, d, k: avg(a, b), 8: lambda a, b, c, d, k: avg(c, b), 9: lambda a, b, c, d, k: avg(b, d),
        10: lambda a, b, c, d, k: avg(avg(a, c), avg(b, d)), 12: lambda a, b, c, d, k: clamp(a + b - c),
        13: lambda a, b, c, d, k: clamp(avg(a, b) + int((avg(a, b) - c) / 2)),
    }[mode]
    return [one(a, b, c, d, k) for k, (a, b, c, d) in enumerate(zip(l, t, tl, tr))]


def test_predictors_of_every_mode():
    rng = random.Random(5)
    w, h = 22, 9
    modes = [m % 14 for m in range(6 * 3)]
    image = [[[rng.randrange(256) for _ in range(4)] for _ in range(w)] for _ in range(h)]
    rest = []
    for y in range(h):
        for x in range(w):
            if not y:
                guess = image[y][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = image[y - 1][0]
            else:
                right = image[y - 1][x + 1] if x + 1 < w else image[y][0]
                guess = predicted(modes[(y // 4) * 6 + x // 4], image[y][x - 1], image[y - 1][x], image[y - 1][x - 1], right)
            rest.append(sum((a - b & 255) << s for a, b, s in zip(image[y][x], guess, (0, 8, 16, 24))))
    out = head(w, h, (webp.PREDICTOR, 2, [m << 8 for m in modes]))
    out.image(None)
    out.put(0, 1)
    out.codes()
    for p in rest:
        out.literal(p)
    assert argb(decode(body(out))) == [sum(c << s for c, s in zip(p, (0, 8, 16, 24))) for row in image for p in row]


def test_colour_transforms_together():
    rng = random.Random(6)
    w, h = 9, 6
    image = [[rng.randrange(256) for _ in range(4)] for _ in range(w * h)]  # b, g, r, a
    multipliers = [[rng.randrange(256) for _ in range(3)] for _ in range(3 * 2)]
    s8 = lambda v: v - 256 if v > 127 else v
    rest = []
    for i, (b, g, r, a) in enumerate(image):
        r, b = r - g & 255, b - g & 255  # subtract-green was first
        gr, gb, rb = multipliers[(i // w // 4) * 3 + i % w // 4]
        r2 = r - (s8(gr) * s8(g) >> 5) & 255
        b2 = b - (s8(gb) * s8(g) >> 5) - (s8(rb) * s8(r) >> 5) & 255
        rest.append(a << 24 | r2 << 16 | g << 8 | b2)
    out = head(w, h, (webp.SUBTRACT_GREEN,), (webp.CROSS_COLOUR, 2, [255 << 24 | rb << 16 | gb << 8 | gr for gr, gb, rb in multipliers]))
    out.image(None)
    out.put(0, 1)
    out.codes()
    for p in rest:
        out.literal(p)
    assert argb(decode(body(out))) == [a << 24 | r << 16 | g << 8 | b for b, g, r, a in image]


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palettes_of_every_packing(colours):
    rng = random.Random(colours)
    w, h = 11, 4
    palette = [rng.getrandbits(32) for _ in range(colours)]
    index = [[rng.randrange(colours) for _ in range(w)] for _ in range(h)]
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    out = head(w, h, (webp.PALETTE, palette))
    out.image(None)
    out.put(0, 1)
    out.codes()
    for row in index:
        for x in range(0, w, 1 << pack):
            out.literal(sum(v << k * (8 >> pack) for k, v in enumerate(row[x : x + (1 << pack)])) << 8)
    assert argb(decode(body(out))) == [palette[i] for row in index for i in row]


def test_texts_come_back_by_both_decoders(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [b"", b"a", b"x" * 192, bytes(range(256)) * 3, "Größe, naïve: plain text. ".encode() * 40, *(rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (5, 1000, 7000))]
    monkeypatch.setattr(webp, "SIDE", 100)  # so that some images are wider
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    samples, at, sizes = payloads(raw, offsets)
    files = encode_texts(samples, at)
    for t, n, f, a, b in zip(texts, sizes, files, map(decode, files), decode_many(files), strict=True):
        assert np.array_equal(a, b) and (a[..., 3] == 255).all()
        assert a[..., :3].tobytes()[:n] == t + b" " * (padded(len(t)) - len(t))
        assert int.from_bytes(f[4:8], "little") == len(f) - 8
    assert files[0] == files[0] and decode_many([]) == []


def forms(files):
    """How many files have a palette, literals alone, a cache; and the back-references and cache entries read."""
    found = {"palette": 0, "literals": 0, "cache": 0}
    for f in files:
        plan = webp.plan_of(0, f)
        found["palette" if plan is None else "cache" if plan.cache else "literals"] += 1
    return found


def test_every_form_is_used_over_the_documents(monkeypatch):
    """Over a whole table each form is the shortest for some texts, files are smaller than literals alone, and
    both decoders read them, with back-references and the cache."""
    import pyarrow.parquet as pq

    from tidewater.llm.common import utf8

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() + ["", "x" * 5000, "ab" * 700]
    raw, offsets = utf8(pa.array(texts))
    samples, at, sizes = payloads(raw, offsets)
    files = encode_texts(samples, at)
    found = forms(files)
    assert found["palette"] >= 1 and found["literals"] > 50 and found["cache"] > 500, found
    read = {"copies": 0, "cached": 0}
    numbers, symbols = webp._Lanes.numbers, webp._Lanes.symbols
    monkeypatch.setattr(webp._Lanes, "numbers", lambda self, lanes, s: (read.__setitem__("copies", read["copies"] + len(s)), numbers(self, lanes, s))[1])

    def counted(self, lanes, code):
        out = symbols(self, lanes, code)
        read["cached"] += int((out >= 280).sum())
        return out

    monkeypatch.setattr(webp._Lanes, "symbols", counted)
    for image, n, a in zip(decode_many(files), sizes, at, strict=False):
        assert image[..., :3].tobytes()[:n] == samples[a : a + n].tobytes()
    assert read["copies"] > 1000 and read["cached"] > 1000, read
    for i in range(0, len(files), 50):
        assert np.array_equal(decode(files[i]), decode_many([files[i]])[0])
    monkeypatch.setattr(webp, "text_head", lambda rich, f=webp.text_head: f(False) if not rich else (f(True)[0], 1 << 40))
    assert sum(map(len, files)) < 0.92 * sum(map(len, encode_texts(samples, at)))


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        decode(b"RIFF0000WEBPVP8 0000/")


def test_rows_keep_their_bytes(spark, odd_docs):
    got = media_round_trip(odd_docs).collect()
    want = []
    for r in odd_docs.collect():
        b = (r.text or "").encode()
        p = b + b" " * (padded(len(b)) - len(b))
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    same = {(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in got}
    assert len(same) == len({r.payload_sha256 for r in got})
    assert media_round_trip(odd_docs.limit(0)).collect() == []
