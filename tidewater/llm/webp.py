"""Lossless WebP: a decoder of the whole format, and an encoder for sample columns.

The decoder reads prefix codes, back-references and the colour cache, and undoes the predictor,
cross-colour, subtract-green and palette transforms. Images of one batch whose prefix codes are the same
are decoded side by side, one array lane each. The encoder writes each image as literals, with colour cache
and back-references, or as a palette, whichever is shortest.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
NEAR = 120  #: distance codes that stand for a near pixel
FEW = 80  #: files from which decoding them at once is faster than one by one
SIDE = 16383  #: most columns that the encoder uses; the format's most is 16384


@functools.cache
def near_pixels() -> tuple[tuple[int, int], ...]:
    """(columns to the left, rows up) of the pixel that each short distance code stands for: all pixels
    within 7 rows up and 8 columns, nearest first; of equally near ones those with fewer columns, then
    the one to the left, first. Along the own row only pixels to the left come before."""
    found = []
    for dy in range(8):
        for dx in range(-7, 9):
            if dy or dx > 0:
                found.append((dx, dy))
    found.sort(key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
    return tuple(found[:NEAR])


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.value, self.held, self.next = 0, 0, at >> 3
        if at & 7:
            self.read(at & 7)

    def _need(self, n: int) -> None:
        while self.held < n:
            chunk = self.data[self.next : self.next + 8]
            self.value |= int.from_bytes(chunk, "little") << self.held
            self.held += 64
            self.next += 8

    def peek(self, n: int) -> int:
        if self.held < n:
            self._need(n)
        return self.value & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if self.held < n:
            self._need(n)
        self.value >>= n
        self.held -= n

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.skip(n)
        return out

    def position(self) -> int:
        return self.next * 8 - self.held


class PrefixCode:
    """A canonical prefix code: `table` has symbol and length for the next `most` bits of the stream."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("an empty prefix code")
        self.single = used[0][1] if len(used) == 1 else None
        self.most = 0 if self.single is not None else max(n for n, _ in used)
        self.symbols = np.full(1 << self.most, used[0][1], np.int32)
        self.sizes = np.zeros(1 << self.most, np.int32)
        self.codes = {}
        if self.single is not None:
            self.codes[self.single] = (0, 0)
            self.table = [(self.single, 0)]
            return
        if sum(1 << (self.most - n) for n, _ in used) != 1 << self.most:
            raise ValueError("a prefix code that is not complete")
        code = last = 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            turned = int(format(code, f"0{n}b")[::-1], 2)
            self.codes[s] = (turned, n)
            self.symbols[turned :: 1 << n] = s
            self.sizes[turned :: 1 << n] = n
            code += 1
        self.table = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        s, n = self.table[bits.peek(self.most)]
        bits.skip(n)
        return s


def read_lengths(bits: Bits, symbols: int) -> list[int]:
    """The code lengths of one prefix code."""
    out = [0] * symbols
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        out[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(first)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    at, last = 0, 8
    while at < symbols and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            out[at] = s
            last = s or last
            at += 1
            continue
        n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        out[at : at + n] = [value] * n
        at += n
    if len(out) != symbols:
        raise ValueError("too many code lengths")
    return out


@dataclass
class Group:
    """The five codes of one group: green with lengths and cache, red, blue, alpha, distance."""

    codes: list[PrefixCode]


@dataclass
class Image:
    width: int
    height: int
    transforms: list = field(default_factory=list)
    coded_width: int = 0  #: of the pixels as they are stored


def _groups(bits: Bits, count: int, cache: int) -> list[Group]:
    return [Group([PrefixCode(read_lengths(bits, n)) for n in (256 + 24 + (1 << cache if cache else 0), 256, 256, 256, 40)]) for _ in range(count)]


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels (0xAARRGGBB) of an image or of a transform's data."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    which, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        which = (read_pixels(bits, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).tolist()
    groups = _groups(bits, max(which) + 1 if which else 1, cache_bits)
    total = width * height
    if not which:
        return np.array(_rest(bits, groups[0].codes, [], total, cache_bits, width), np.uint32)
    out: list[int] = []
    while len(out) < total:  # up to where the block changes
        y, x = divmod(len(out), width)
        end = min(total, y * width + min(width, ((x >> block) + 1) << block))
        _rest(bits, groups[which[(y >> block) * across + (x >> block)]].codes, out, end, cache_bits, width, total)
    return np.array(out, np.uint32)


def _rest(bits: Bits, codes: list[PrefixCode], out: list[int], end: int, cache_bits: int, width: int, total: int | None = None) -> list[int]:
    """out, the pixels so far, and those that follow up to `end`; a back-reference may go beyond it, but
    not beyond `total`."""
    total = end if total is None else total
    shift, cached = 32 - cache_bits, 0  # pixels that the cache has seen
    cache = [0] * (1 << cache_bits) if cache_bits else []
    (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (far, far_mask) = ((c.table, (1 << c.most) - 1) for c in codes)
    data, value, held, at = bits.data, bits.value, bits.held, bits.next
    near = near_pixels()
    while len(out) < end:
        if held < 64:  # no pixel or back-reference takes more
            value |= int.from_bytes(data[at : at + 8], "little") << held
            held += 64
            at += 8
        s, n = green[value & green_mask]
        value >>= n
        held -= n
        if s < 256:
            r, n = red[value & red_mask]
            value >>= n
            held -= n
            b, n = blue[value & blue_mask]
            value >>= n
            held -= n
            a, n = alpha[value & alpha_mask]
            value >>= n
            held -= n
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            found = []
            for symbol in (s - 256, None):
                if symbol is None:
                    symbol, n = far[value & far_mask]
                    value >>= n
                    held -= n
                extra = max(0, symbol - 2 >> 1)
                found.append(symbol + 1 if symbol < 4 else ((2 + (symbol & 1)) << extra) + (value & ((1 << extra) - 1)) + 1)
                value >>= extra
                held -= extra
            n, d = found
            if d > NEAR:
                d -= NEAR
            else:
                dx, dy = near[d - 1]
                d = max(1, dx + dy * width)
            if d > len(out) or len(out) + n > total:
                raise ValueError("a back-reference outside the image")
            if d >= n:
                out += out[-d : len(out) - d + n]
            else:
                for _ in range(n):
                    out.append(out[-d])
        else:
            for p in out[cached:]:
                cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
            cached = len(out)
            out.append(cache[s - 280])
    bits.value, bits.held, bits.next = value, held, at
    return out


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Add to each pixel what its block's mode predicts from pixels decoded before it."""
    height, width = pixels.shape
    rest = pixels.view(np.uint8).reshape(height, width, 4).astype(np.int32).tolist()
    modes = (modes >> 8 & 15).tolist()
    rows: list[list[list[int]]] = []
    for y in range(height):
        row: list[list[int]] = []
        up = rows[-1] if rows else None
        for x in range(width):
            if not y:
                guess = [0, 0, 0, 255] if not x else row[x - 1]
            elif not x:
                guess = up[0]
            else:
                l, t, tl = row[x - 1], up[x], up[x - 1]
                tr = up[x + 1] if x + 1 < width else row[0]
                m = modes[y >> block][x >> block]
                if m == 1:
                    guess = l
                elif m == 2:
                    guess = t
                elif m == 3:
                    guess = tr
                elif m == 4:
                    guess = tl
                elif m == 5:
                    guess = [((a + c >> 1) + b) >> 1 for a, b, c in zip(l, t, tr)]
                elif m == 6:
                    guess = [(a + b) >> 1 for a, b in zip(l, tl)]
                elif m == 7:
                    guess = [(a + b) >> 1 for a, b in zip(l, t)]
                elif m == 8:
                    guess = [(a + b) >> 1 for a, b in zip(tl, t)]
                elif m == 9:
                    guess = [(a + b) >> 1 for a, b in zip(t, tr)]
                elif m == 10:
                    guess = [((a + b >> 1) + (c + d >> 1)) >> 1 for a, b, c, d in zip(l, tl, t, tr)]
                elif m == 11:
                    left = sum(abs(b - c) for b, c in zip(t, tl))
                    top = sum(abs(a - c) for a, c in zip(l, tl))
                    guess = l if left < top else t
                elif m == 12:
                    guess = [min(255, max(0, a + b - c)) for a, b, c in zip(l, t, tl)]
                elif m == 13:
                    guess = []
                    for a, b, c in zip(l, t, tl):
                        mean = (a + b) >> 1
                        half = int((mean - c) / 2)
                        guess.append(min(255, max(0, mean + half)))
                else:
                    guess = [0, 0, 0, 255]
            row.append([(a + b) & 255 for a, b in zip(rest[y][x], guess)])
        rows.append(row)
    return np.ascontiguousarray(np.array(rows, np.uint8)).view(np.uint32).reshape(height, width)


def undo_cross_colour(pixels: np.ndarray, multipliers: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    m = multipliers[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]

    def times(multiplier: np.ndarray, colour: np.ndarray) -> np.ndarray:
        return (multiplier.astype(np.uint8).view(np.int8).astype(np.int32) * colour.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5

    green, red, blue = pixels >> 8 & 255, (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    red = (red + times(m & 255, green)) & 255
    blue = (blue + times(m >> 8 & 255, green) + times(m >> 16 & 255, red)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return (pixels & np.uint32(0xFF00FF00)) | ((pixels >> 16 & 255) + green & 255) << np.uint32(16) | ((pixels & 255) + green & 255)


def undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    """Palette entries for the indices in green, 2 ** pack of them in each pixel."""
    index = pixels >> 8 & 255
    if pack:
        each = 8 >> pack
        x = np.arange(width)
        index = index[:, x >> pack] >> ((x & ((1 << pack) - 1)) * each).astype(np.uint32) & np.uint32((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def added(palette: np.ndarray) -> np.ndarray:
    """A palette from the differences that it is stored as, byte by byte."""
    return np.ascontiguousarray(np.cumsum(palette.view(np.uint8).reshape(-1, 4), axis=0).astype(np.uint8)).view(np.uint32).ravel()


def start_of(data: bytes) -> Bits:
    """The stream of a file's lossless chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP")
    return Bits(data, 21 * 8)


def read_head(bits: Bits) -> Image:
    """Size and transforms."""
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    image = Image(width, height)
    seen = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            w, h = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            image.transforms.append((kind, read_pixels(bits, w, h, False).reshape(h, w), block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            image.transforms.append((kind, added(read_pixels(bits, n, 1, False)), width, pack))
            width = (width + (1 << pack) - 1) >> pack
        else:
            image.transforms.append((kind,))
    image.coded_width = width
    return image


def undo(image: Image, pixels: np.ndarray) -> np.ndarray:
    for kind, *rest in reversed(image.transforms):
        pixels = {PREDICTOR: undo_predictor, CROSS_COLOUR: undo_cross_colour, SUBTRACT_GREEN: undo_subtract_green, PALETTE: undo_palette}[kind](pixels, *rest)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """The pixels of one file: height, width, and red, green, blue, alpha."""
    bits = start_of(data)
    image = read_head(bits)
    pixels = undo(image, read_pixels(bits, image.coded_width, image.height, True).reshape(image.height, image.coded_width))
    return rgba(pixels)


def rgba(pixels: np.ndarray) -> np.ndarray:
    out = np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)
    return out[..., [2, 1, 0, 3]]


# ---- encoding of sample columns

CACHE = 8  #: bits of the colour cache's index
LEAST_COPY, MOST_COPY = 3, 4096  #: pixels of a back-reference
REACH = 1 << 20  #: pixels that a back-reference goes back at most
HASH = 0x1E35A7BD  # Fixed value of the format: the factor of the colour cache's index.


def _completed(lengths: list[int], most: int = 15) -> tuple[int, ...]:
    """The same lengths made shorter, commonest first, until the code is complete."""
    lengths = list(lengths)
    room = (1 << most) - sum(1 << (most - n) for n in lengths)
    if room < 0:
        raise ValueError("lengths that no prefix code has")
    while room:
        for b in sorted(range(len(lengths)), key=lambda b: (lengths[b], b)):
            gain = 1 << (most - lengths[b])  # one bit less doubles what the value takes
            if lengths[b] > 1 and gain <= room:
                lengths[b] -= 1
                room -= gain
                break
        else:
            raise ValueError("a code that can't be completed")
    return tuple(lengths)


@functools.cache
def text_lengths() -> tuple[int, ...]:
    """Code lengths of the 256 sample values for texts, by rule: 3 bits for a blank, 5 for the commonest
    half of the lower-case letters, then letters, the rest of ASCII and other bytes in growing lengths."""
    out = [13] * 256
    for b in range(32, 127):
        out[b] = 11
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,.\n":
        out[b] = 9
    for b in range(128, 256):
        out[b] = 10 if b < 0xC0 else 12
    out[0xC3] = 8
    for b in b"bfgkmpvwyzjqx":
        out[b] = 7
    for b in b"etaoinshrdlcu":
        out[b] = 5
    out[32] = 3
    return _completed(out, 14)


@functools.cache
def green_lengths() -> tuple[int, ...]:
    """Code lengths of the green alphabet: half of it are the sample values as text_lengths() has them, the
    other half the entries of the colour cache and, by rule, the lengths of back-references."""
    copies = [6] * 8 + [7] * 16  # a quarter of the code
    return (*[n + 1 for n in text_lengths()], *copies, *[2 + CACHE] * (1 << CACHE))


@functools.cache
def distance_lengths() -> tuple[int, ...]:
    """Code lengths of the 40 distance symbols: each takes the same part of the code, or half of it."""
    return (5,) * 24 + (6,) * 16


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits


def _turned(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def write_lengths(out: Writer, lengths: tuple[int, ...]) -> None:
    """One prefix code. One or two symbols below 256 are told by themselves; other lengths one by one, runs
    of zeros and of the same length at once, under a code of 3 to 5 bits for the lengths."""
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256 and all(lengths[i] == 1 for i in used):
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for i in used:
            out.put(i, 8)
        return
    steps: list[tuple[int, int, int]] = []  # symbol, extra value, its bits
    at, last = 0, 8
    while at < len(lengths):
        n, run = lengths[at], 1
        while at + run < len(lengths) and lengths[at + run] == n:
            run += 1
        if not n and run >= 3:
            run = min(run, 138)
            steps.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif n and n == last and run >= 3:
            run = min(run, 6)
            steps.append((16, run - 3, 2))
        else:
            run = 1
            steps.append((n, 0, 0))
            last = n or last
        at += run
    kinds = sorted({s for s, _, _ in steps}, key=lambda s: (-sum(x == s for x, _, _ in steps), s))
    if len(kinds) == 1:
        kinds.append(next(k for k in range(19) if k != kinds[0]))
    width = (len(kinds) - 1).bit_length()
    short = (1 << width) - len(kinds)  # the commonest ones have a bit less
    sizes = [0] * 19
    for k, s in enumerate(kinds):
        sizes[s] = width - (k < short)
    codes = PrefixCode(sizes).codes
    out.put(0, 1)
    count = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if sizes[s]))
    out.put(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        out.put(sizes[s], 3)
    out.put(0, 1)  # as many lengths as there are symbols
    for s, extra, bits in steps:
        out.put(*codes[s])
        out.put(extra, bits)


@functools.cache
def text_head(rich: bool) -> tuple[int, int]:
    """The stream between the image's size and its pixels, and its bits: opaque, no transform, one group of
    codes; if rich a colour cache and back-references."""
    out = Writer()
    out.put(0, 1)  # alpha is not used
    out.put(0, 3)
    out.put(0, 1)  # no transform
    out.put(rich, 1)
    if rich:
        out.put(CACHE, 4)
    out.put(0, 1)  # one group
    lengths = text_lengths()
    write_lengths(out, green_lengths() if rich else (*lengths, *[0] * 24))
    write_lengths(out, lengths)
    write_lengths(out, lengths)
    write_lengths(out, (*[0] * 255, 1))
    write_lengths(out, distance_lengths() if rich else (1, *[0] * 39))
    return out.value, out.n


@functools.cache
def _codes(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    codes = PrefixCode(list(lengths)).codes
    return np.array([codes.get(s, (0, 0))[0] for s in range(len(lengths))], np.uint64), np.array(lengths, np.int64)


def _number(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and extra bits of lengths or distances from 1 on."""
    v = v - 1
    top = np.maximum(np.frexp(v.astype(np.float64))[1] - 1, 0)  # place of the highest bit
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(extra, 0) & 1))
    return symbol, v & ((1 << extra) - 1), extra


@functools.cache
def near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one in rows of `width` pixels."""
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(near_pixels(), 1):
        out.setdefault(max(1, dx + dy * width), k)
    return out


def cache_index(pixels: np.ndarray) -> np.ndarray:
    return (pixels * np.uint32(HASH)) >> np.uint32(32 - CACHE)


def _previous(keys: np.ndarray) -> np.ndarray:
    """The place of the last equal key before each one, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order][1:] == keys[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def copies(pixels: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and distance of the back-references of images end to end: from left to right, wherever
    LEAST_COPY pixels stood before in the image, all that follows alike."""
    n = len(pixels)
    if n < LEAST_COPY:
        return (np.zeros(0, np.int64),) * 3
    file = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = pixels.astype(np.uint64)
    mixed = file.astype(np.uint64)
    for k in range(LEAST_COPY):
        mixed = (mixed[: n - k] ^ keys[k:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    before = _previous(mixed)
    end = offsets[1:][file[: len(before)]]
    at = np.arange(len(before))
    first = np.maximum(before, 0)
    ok = (before >= 0) & (at + LEAST_COPY <= end) & (at - before <= REACH)
    for k in range(LEAST_COPY):
        ok &= pixels[first + k] == pixels[at + k]
    found = np.flatnonzero(ok)
    places, lengths, distances = [], [], []
    done = 0
    for i, b, e in zip(found.tolist(), before[found].tolist(), end[found].tolist(), strict=True):
        if i < done:
            continue
        size, most, step = LEAST_COPY, min(MOST_COPY, e - i), 16
        while size < most:
            step = min(step, most - size)
            differ = pixels[i + size : i + size + step] != pixels[b + size : b + size + step]
            k = int(differ.argmax())
            if differ[k]:
                size += k
                break
            size += step
            step *= 4
        places.append(i)
        lengths.append(size)
        distances.append(i - b)
        done = i + size
    return np.array(places, np.int64), np.array(lengths, np.int64), np.array(distances, np.int64)


def shape_of(samples: int, row: int = 64) -> tuple[int, int]:
    """Width and height of an image with room for so many samples, three a pixel: rows of `row` pixels,
    of a multiple of it where the image would be too high."""
    pixels = -(-samples // 3)
    width = row * -(-pixels // (row * SIDE))
    if width > SIDE:
        raise ValueError("too many samples for one image")
    return width, -(-pixels // width)


def _fields(rgb: np.ndarray, pixels: np.ndarray, offsets: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values and bits of three fields for each pixel: green, red and blue; an entry of the cache; length and
    distance of a back-reference; nothing where one has copied the pixel."""
    lits, bits = _codes(text_lengths())
    green, green_bits = _codes(green_lengths())
    far, far_bits = _codes(distance_lengths())
    order = rgb[:, [1, 0, 2]]
    values, sizes = lits[order], bits[order]
    values[:, 0], sizes[:, 0] = green[order[:, 0]], green_bits[order[:, 0]]
    index = cache_index(pixels)
    file = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = _previous(file << CACHE | index.astype(np.int64))
    hit = np.flatnonzero((before >= 0) & (pixels[np.maximum(before, 0)] == pixels) & (sizes.sum(1) > 2 + CACHE))
    values[hit, 0], sizes[hit, 0] = green[280 + index[hit]], 2 + CACHE
    values[hit, 1:] = sizes[hit, 1:] = 0
    at, length, distance = copies(pixels, offsets)
    if len(at):
        inside = np.zeros(len(pixels) + 1, np.int64)
        inside[at] += 1
        np.add.at(inside, at + length, -1)
        gone = np.cumsum(inside[:-1]) > 0
        values[gone] = sizes[gone] = 0
        code = distance + NEAR
        # a few distances have short codes: within the rows of one image's width
        for width in set(widths):
            near = near_codes(width)
            short = np.flatnonzero((distance <= 7 * width + 8) & (np.array(widths)[file[at]] == width))
            code[short] = [near.get(d, d + NEAR) for d in distance[short].tolist()]
        for column, (number, alphabet, alphabet_bits, first) in enumerate(((length, green, green_bits, 256), (code, far, far_bits, 0))):
            symbol, extra, extra_bits = _number(number)
            values[at, column] = alphabet[first + symbol] | extra.astype(np.uint64) << alphabet_bits[first + symbol].astype(np.uint64)
            sizes[at, column] = alphabet_bits[first + symbol] + extra_bits
    return values.ravel(), sizes.ravel()


def _file(body: bytes, width: int, height: int, head: int, start: int, size: int) -> bytes:
    """The file whose stream is `body` from the bit `start` on: what stands before it is put in."""
    out = bytearray(body[: size + (size & 1)])
    if size & 1:
        out[size] = 0
    top = int.from_bytes(b"RIFF" + (len(out) - 8).to_bytes(4, "little") + b"WEBPVP8L" + (size - 20).to_bytes(4, "little") + b"\x2f", "little")
    top |= (width - 1 | height - 1 << 14 | head << 28) << 168
    k = -(-start // 8)
    out[:k] = (int.from_bytes(out[:k], "little") | top).to_bytes(k, "little")
    return bytes(out)


def plain_palette(pixel: int, width: int, height: int) -> bytes:
    """The file of an image of one colour: a palette of it, and an index that takes no bits."""
    out = Writer()
    out.put(0, 4)
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(0, 8)  # one entry
    out.put(0, 1)
    for codes in ((pixel >> 8 & 255, pixel >> 16 & 255, pixel & 255, pixel >> 24), (0, 0, 0, 0)):
        if codes == (0, 0, 0, 0):
            out.put(0, 3)  # no other transform, no cache, one group
        for symbol in (*codes, 0):
            write_lengths(out, (*[0] * symbol, 1))
    start = 21 * 8 + 28 + out.n
    size = -(-start // 8)
    return _file(bytes(size + 1), width, height, out.value, start, size)


def encode_texts(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A file for each run of samples: red, green, blue of each pixel of an image as shape_of() gives. Of its
    forms (literals; cache and back-references; a palette for one colour) the shortest."""
    rgb = raw.reshape(-1, 3)
    wide = rgb.astype(np.uint32)
    pixels = wide[:, 0] << np.uint32(16) | wide[:, 1] << np.uint32(8) | wide[:, 2] | np.uint32(0xFF000000)
    shapes = [shape_of(n) for n in np.diff(offsets).tolist()]
    places = offsets // 3
    lits, bits = _codes(text_lengths())
    order = rgb[:, [1, 0, 2]].ravel()
    forms = [(lits[order], bits[order]), _fields(rgb, pixels, places, [w for w, _ in shapes])]
    heads = [text_head(False), text_head(True)]
    totals = []
    for (_, sizes), (_, head_bits) in zip(forms, heads, strict=True):
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        totals.append(np.diff(ends) + 21 * 8 + 28 + head_bits)
    rich = totals[1] < totals[0]
    owner = np.repeat(rich, np.diff(offsets))
    values, n = np.where(owner, forms[1][0], forms[0][0]), np.where(owner, forms[1][1], forms[0][1])
    total, start = np.where(rich, totals[1], totals[0]), np.where(rich, heads[1][1], heads[0][1]) + 21 * 8 + 28
    ends = np.cumsum(n)
    before = np.concatenate([[0], ends])[offsets]
    words = (total + 63) // 32 + 1
    base = np.concatenate([[0], np.cumsum(words)])
    # where each field starts, in bits from the first word of all files
    at = ends - n + np.repeat(base[:-1] * 32 + start - before[:-1], np.diff(offsets))
    some = np.flatnonzero(n)
    at, values = at[some], values[some]
    word = at >> 5
    shift = (at & 31).astype(np.uint64)
    # a field is below 2 ** 31, so that it ends within the word after its own
    value = values << shift
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(base[-1]) + 1, np.uint64)
    if len(firsts):
        out[word[firsts]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), firsts)
        out[word[firsts] + 1] += np.add.reduceat(value >> np.uint64(32), firsts)
    data = out.astype("<u4").tobytes()
    step = np.append(pixels[1:] != pixels[:-1], True)
    step[places[1:] - 1] = False
    plain = np.add.reduceat(step, places[:-1]) == 0 if len(shapes) else np.zeros(0, bool)
    files = []
    for i, (b, bits, first, own, one) in enumerate(zip(base.tolist(), total.tolist(), start.tolist(), rich.tolist(), plain.tolist(), strict=False)):
        width, height = shapes[i]
        size = -(-bits // 8)
        if one:
            files.append(plain_palette(int(pixels[places[i]]), width, height))
        else:
            files.append(_file(data[b * 4 : b * 4 + size + 1], width, height, heads[own][0], first, size))
    return files


# ---- decoding of many files side by side


_HEADS: dict[int, tuple] = {}


@dataclass
class Plan:
    """An image without transforms and groups: its size, the first bit of its pixels, its codes and the
    bits of its cache's index."""

    file: int
    width: int
    height: int
    at: int
    codes: list[PrefixCode]
    cache: int


def plan_of(file: int, data: bytes) -> Plan | None:
    """How to decode a file side by side with others; None for images with transforms or groups. What
    follows the size is parsed once for each distinct run of bits."""
    bits = start_of(data)
    size = bits.read(28)
    at = 21 * 8 + 28
    width, height = (size & 16383) + 1, (size >> 14) + 1
    for head, (n, codes, cache) in _HEADS.items():
        own = int.from_bytes(data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)
        if own == head:
            return Plan(file, width, height, at + n, codes, cache)
    if bits.read(4) or bits.read(1):
        return None
    cache = bits.read(4) if bits.read(1) else 0
    if bits.read(1) or cache > 11:
        return None
    codes = _groups(bits, 1, cache)[0].codes
    n = bits.position() - at
    head = int.from_bytes(data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)
    if len(_HEADS) < 16:
        _HEADS[head] = (n, codes, cache)
    return Plan(file, width, height, at + n, codes, cache)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file (height, width, RGBA)."""
    out: list[np.ndarray | None] = [None] * len(files)
    alike: dict[int, list[Plan]] = {}
    for i, data in enumerate(files):
        plan = plan_of(i, data)
        if plan is None:
            out[i] = decode(data)
        else:
            alike.setdefault(id(plan.codes), []).append(plan)
    for plans in alike.values():
        for i, pixels in _side_by_side(files, plans):
            out[i] = rgba(pixels)
    return out


class _Lanes:
    """The streams of many files, of which some are read at once."""

    def __init__(self, files: list[bytes], plans: list[Plan]):
        self.starts = np.concatenate([[0], np.cumsum([len(files[p.file]) + 8 for p in plans])])
        raw = np.frombuffer(b"".join(files[p.file] + bytes(8) for p in plans), np.uint8)
        # 32 bits from every byte on
        padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
        self.words = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
        self.at = self.starts[:-1] * 8 + np.array([p.at for p in plans])

    def symbols(self, lanes, code: PrefixCode) -> np.ndarray:
        a = self.at[lanes]
        key = self.words[a >> 3] >> (a & 7).astype(np.uint32) & np.uint32((1 << code.most) - 1)
        self.at[lanes] = a + code.sizes[key]
        return code.symbols[key]

    def numbers(self, lanes, symbol: np.ndarray) -> np.ndarray:
        """Lengths or distances from their prefix symbols."""
        extra = np.maximum(symbol - 2, 0) >> 1
        a = self.at[lanes]
        value = self.words[a >> 3] >> (a & 7).astype(np.uint32)
        value = value.astype(np.int64) & ((1 << extra.astype(np.int64)) - 1)
        self.at[lanes] = a + extra
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)).astype(np.int64) << extra) + value + 1)


def _side_by_side(files: list[bytes], plans: list[Plan]) -> list[tuple[int, np.ndarray]]:
    """All files take a step at once, a pixel each: a lane reads a literal or an entry of its cache, or goes
    on with the back-reference that it is in. Where few lanes are left, these are read one by one."""
    plans = sorted(plans, key=lambda p: (-p.width * p.height, p.width))
    codes, cache_bits = plans[0].codes, plans[0].cache
    sizes = np.array([p.width * p.height for p in plans])
    widths = np.array([p.width for p in plans])
    lanes = _Lanes(files, plans)
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")  # files that have a pixel of that number
    places = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(sizes.sum()), np.uint32)
    rich = any(codes[0].lengths[256:])
    green, channels, fixed = codes[0], [], np.uint32(0)
    for code, shift in zip(codes[1:4], (16, 0, 24), strict=True):
        if code.single is None:
            channels.append((code, np.uint32(shift)))
        else:
            fixed |= np.uint32(code.single << shift)
    cache = np.zeros(len(plans) << cache_bits, np.uint32)
    rows = np.arange(len(plans)) << cache_bits
    shift = np.uint32(32 - cache_bits)
    left, back = np.zeros(len(plans), np.int64), np.zeros(len(plans), np.int64)  # of the lanes' back-references
    near = np.array(near_pixels())
    wide = int(np.searchsorted(-alive, -FEW, "right"))  # pixels up to which many files are decoded at once

    for pixel, n in enumerate(alive[:wide].tolist()):
        to = places[:n] + pixel
        own = np.flatnonzero(left[:n] == 0) if rich else slice(0, n)
        first = lanes.symbols(own, green) if green.single is None else np.full(n, green.single, np.int32)[own]
        if rich:
            copy = first >= 256
            k = np.flatnonzero(copy)
            if len(k):
                cached, refs = own[k[first[k] >= 280]], own[k[first[k] < 280]]
                if len(cached):
                    out[to[cached]] = cache[rows[cached] + first[k[first[k] >= 280]] - 280]
                if len(refs):
                    left[refs] = lanes.numbers(refs, first[k[first[k] < 280]] - 256)
                    d = lanes.numbers(refs, lanes.symbols(refs, codes[4]) if codes[4].single is None else np.full(len(refs), codes[4].single))
                    short = d <= NEAR
                    pairs = near[np.minimum(d, NEAR) - 1]
                    back[refs] = np.where(short, np.maximum(1, pairs[:, 0] + pairs[:, 1] * widths[refs]), d - NEAR)
                    if (back[refs] > pixel).any() or (pixel + left[refs] > sizes[refs]).any():
                        raise ValueError("a back-reference outside the image")
                literal = np.flatnonzero(~copy)
                own, first = own[literal], first[literal]
        value = first.astype(np.uint32) << np.uint32(8) | fixed
        for code, by in channels:
            value |= lanes.symbols(own, code).astype(np.uint32) << by
        if not rich:
            out[to] = value
            continue
        out[to[own]] = value
        going = np.flatnonzero(left[:n])
        if len(going):
            out[to[going]] = out[to[going] - back[going]]
            left[going] -= 1
        if cache_bits:
            now = out[to]
            cache[rows[:n] + ((now * np.uint32(HASH)) >> shift)] = now
    for k in range(int(alive[wide]) if wide < len(alive) else 0):
        bits = Bits(files[plans[k].file], int(lanes.at[k] - lanes.starts[k] * 8))
        a, b = int(places[k]), int(places[k + 1])
        known, d = out[a : a + wide].tolist(), int(back[k])
        for _ in range(int(left[k])):
            known.append(known[-d])
        out[a:b] = _rest(bits, codes, known, b - a, cache_bits, plans[k].width)
    return [(p.file, out[places[k] : places[k + 1]].reshape(p.height, p.width)) for k, p in enumerate(plans)]
