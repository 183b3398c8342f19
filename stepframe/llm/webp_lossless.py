"""Lossless WebP (VP8L) in Python: a decoder for whole streams, a lockstep decoder for many, and an encoder that does as told.

The media operator's own codec is java/WebpLossless.java; this one reads media without Spark and is what tests hold
that one against.

Decoding: prefix codes (simple and normal, with meta prefix groups), back-references with the two-dimensional short
distances, the colour cache, and the four transforms (predictor, cross-colour, subtract-green, palette), written to
arrays of ARGB pixels. `decode_many` decodes the pixels of all images of one prefix group side by side in numpy, one
symbol of each image at a time; images that need a colour cache, meta prefix groups or codes over LANE_BITS bits go
through the plain decoder. Both give the same pixels.
"""

from __future__ import annotations

import heapq

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LANE_BITS = 12
LONGEST_CODE = 11  # of the encoder
# fixed values of the format
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
BLACK = 0xFF000000


def short_distances() -> list[tuple[int, int]]:
    """(dx, dy) of the distance codes 1 to 120: nearest first; at equal distance falling |dy|... right before left."""
    # fixed values of the format, in its order
    flat = """0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4
    -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5
    -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5
    -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2
    6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"""
    return [tuple(map(int, p.split(","))) for p in flat.split()]


SHORT = short_distances()


class Broken(ValueError):
    """The bytes are not a lossless WebP image."""


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise Broken("the stream ends too early")
        return v


class Code:
    """A canonical prefix code as one lookup table: (symbol << 4 | length) by the next `bits` bits."""

    def __init__(self, lengths: list[int] | None = None, single: int | None = None):
        if single is not None:
            self.bits, self.table = 0, [single << 4]
            return
        self.bits = bits = max(lengths)
        if not bits:
            raise Broken("a prefix code without symbols")
        if sum(1 for n in lengths if n) == 1:
            self.bits, self.table = 0, [next(s for s, n in enumerate(lengths) if n) << 4]
            return
        if sum(1 << (bits - n) for n in lengths if n) != 1 << bits:
            raise Broken("a prefix code that is not complete")
        table = [0] * (1 << bits)
        for s, n, word in code_words(lengths):
            table[word :: 1 << n] = [s << 4 | n] * (1 << (bits - n))
        self.table = table

    def read(self, b: Bits) -> int:
        if not self.bits:
            return self.table[0] >> 4
        e = self.table[b.peek(self.bits)]
        b.at += e & 15
        if b.at > b.end:
            raise Broken("the stream ends too early")
        return e >> 4


def code_words(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code word as it lies in the stream) of a canonical code."""
    word, last, out = 0, 0, []
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        word <<= n - last
        last = n
        out.append((s, n, int(f"{word:0{n}b}"[::-1], 2)))
        word += 1
    return out


def read_code(b: Bits, alphabet: int) -> Code:
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        first = b.read(8 if wide else 1)
        if not two:
            return Code(single=first)
        lengths = [0] * max(alphabet, 256)
        second = b.read(8)
        if first == second:
            return Code(single=first)
        lengths[first] = lengths[second] = 1
        return Code(lengths)
    sizes = [0] * 19
    for k in range(4 + b.read(4)):
        sizes[CODE_ORDER[k]] = b.read(3)
    code = Code(sizes)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and left:
        left -= 1
        s = code.read(b)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + b.read(2))
        else:
            lengths += [0] * (3 + b.read(3) if s == 17 else 11 + b.read(7))
    if len(lengths) > alphabet:
        raise Broken("too many code lengths")
    return Code(lengths + [0] * (alphabet - len(lengths)))


def read_codes(b: Bits, cache: int) -> list[Code]:
    return [read_code(b, n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]


def long_value(prefix: int, b: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = SHORT[code - 1]
    return max(1, dx + dy * width)


def _above(n: int, bits: int) -> int:
    return -(-n // (1 << bits))


def read_pixels(b: Bits, width: int, height: int, main: bool = False) -> list[int]:
    """One entropy-coded image: the plain decoder."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise Broken("colour cache too large")
    groups, grid, grid_bits, grid_width = None, None, 0, 0
    if main and b.read(1):
        grid_bits = b.read(3) + 2
        grid_width = _above(width, grid_bits)
        grid = [(p >> 8) & 0xFFFF for p in read_pixels(b, grid_width, _above(height, grid_bits))]
    groups = [read_codes(b, cache_bits) for _ in range(max(grid) + 1 if grid else 1)]
    cache = [0] * (1 << cache_bits) if cache_bits else None
    total, out = width * height, []
    green, red, blue, alpha, dist = groups[0]
    while len(out) < total:
        if grid:
            at = len(out)
            green, red, blue, alpha, dist = groups[grid[(at // width >> grid_bits) * grid_width + (at % width >> grid_bits)]]
        s = green.read(b)
        if s < 256:
            r, bl, a = red.read(b), blue.read(b), alpha.read(b)
            new = [a << 24 | r << 16 | s << 8 | bl]
        elif s < 280:
            n = long_value(s - 256, b)
            d = distance(long_value(dist.read(b), b), width)
            if d > len(out) or len(out) + n > total:
                raise Broken("a back-reference leaves the image")
            new = [out[k - d] for k in range(len(out), len(out) + min(n, d))]
            new = (new * (n // len(new) + 1))[:n]
        elif cache:
            new = [cache[s - 280]]
        else:
            raise Broken("a symbol that no code has")
        out += new
        if cache:
            for p in new:
                cache[(HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


# --- transforms, on lists of ARGB pixels


def _each(f, *pixels: int) -> int:
    return sum(f(*((p >> k) & 255 for p in pixels)) << k for k in (0, 8, 16, 24))


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs(((top >> k) & 255) - ((corner >> k) & 255)) for k in (0, 8, 16, 24))
    to_top = sum(abs(((left >> k) & 255) - ((corner >> k) & 255)) for k in (0, 8, 16, 24))
    return left if to_left < to_top else top


def _half_step(a: int, c: int) -> int:
    d = a - c
    return _clamp(a + (d // 2 if d >= 0 else -(-d // 2)))


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """What a pixel is expected to be; right: the one above to the right, corner: above to the left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _half(_half(left, right), top)
        case 6:
            return _half(left, corner)
        case 7:
            return _half(left, top)
        case 8:
            return _half(corner, top)
        case 9:
            return _half(top, right)
        case 10:
            return _half(_half(left, corner), _half(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _each(lambda a, b, c: _clamp(a + b - c), left, top, corner)
        case 13:
            return _each(_half_step, _half(left, top), corner)
        case _:
            return BLACK


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _sub(a: int, b: int) -> int:
    return _each(lambda x, y: (x - y) & 255, a, b)


def _expected(px: list[int], at: int, width: int, modes: list[int], bits: int, across: int) -> int:
    y, x = divmod(at, width)
    if y == 0:
        return px[at - 1] if x else BLACK
    if x == 0:
        return px[at - width]
    mode = (modes[(y >> bits) * across + (x >> bits)] >> 8) & 15
    return predict(mode, px[at - 1], px[at - width], px[at - width + 1], px[at - width - 1])


def undo_predictor(px: list[int], width: int, bits: int, modes: list[int]) -> list[int]:
    out, across = list(px), _above(width, bits)
    for at in range(len(out)):
        out[at] = _add(out[at], _expected(out, at, width, modes, bits, across))
    return out


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _delta(t: int, c: int) -> int:
    return (_signed(t) * _signed(c)) >> 5


def cross_colour(px: list[int], width: int, bits: int, factors: list[int], back: bool) -> list[int]:
    """Inverts (back) or applies the cross-colour transform."""
    out, across = [], _above(width, bits)
    for at, p in enumerate(px):
        y, x = divmod(at, width)
        f = factors[(y >> bits) * across + (x >> bits)]
        red_to_blue, green_to_blue, green_to_red = (f >> 16) & 255, (f >> 8) & 255, f & 255
        green, red, blue = (p >> 8) & 255, (p >> 16) & 255, p & 255
        if back:
            new = (red + _delta(green_to_red, green)) & 255
            blue = (blue + _delta(green_to_blue, green) + _delta(red_to_blue, new)) & 255
        else:
            new = (red - _delta(green_to_red, green)) & 255
            blue = (blue - _delta(green_to_blue, green) - _delta(red_to_blue, red)) & 255
        out.append(p & 0xFF00FF00 | new << 16 | blue)
    return out


def palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo(px: np.ndarray, width: int, height: int, transforms: list[tuple]) -> np.ndarray:
    """Inverts the transforms, last read first. px: uint32 pixels of the coded (maybe narrower) image."""
    for kind, *info in reversed(transforms):
        if kind == SUBTRACT_GREEN:
            green = (px >> 8) & 255
            px = px & 0xFF00FF00 | ((px & 0x00FF00FF) + green * 0x00010001) & 0x00FF00FF
        elif kind == PALETTE:
            (colours,) = info
            bits = palette_bits(len(colours))
            index = (px >> 8) & 255
            if bits:
                each = 8 >> bits
                packed = index.reshape(height, -1)
                parts = [(packed >> (each * k)) & ((1 << each) - 1) for k in range(1 << bits)]
                index = np.stack(parts, axis=-1).reshape(height, -1)[:, :width].ravel()
            px = np.append(colours, np.zeros(256 - len(colours), np.uint32))[index].astype(np.uint32)
        elif kind == PREDICTOR:
            bits, modes = info
            px = np.array(undo_predictor(px.tolist(), width, bits, modes), np.uint32)
        else:
            bits, factors = info
            px = np.array(cross_colour(px.tolist(), width, bits, factors, True), np.uint32)
    return px


def read_head(data: bytes) -> tuple[Bits, int, int, int, list[tuple]]:
    """(bits at the main image, width, height, coded width, transforms) of a RIFF file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise Broken("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size:
        raise Broken("the file ends too early")
    b = Bits(data[20 : 20 + size])
    if b.read(8) != 0x2F:
        raise Broken("no lossless signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise Broken("unknown version")
    coded, transforms = width, []
    while b.read(1):
        kind = b.read(2)
        if any(t[0] == kind for t in transforms):
            raise Broken("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            transforms.append((kind, bits, read_pixels(b, _above(coded, bits), _above(height, bits))))
        elif kind == PALETTE:
            n = b.read(8) + 1
            colours = np.array(read_pixels(b, n, 1), np.uint32).view(np.uint8).reshape(-1, 4)
            colours = np.cumsum(colours, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            transforms.append((kind, colours))
            coded = _above(coded, palette_bits(n))
        else:
            transforms.append((kind,))
    return b, width, height, coded, transforms


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a file: the plain decoder."""
    b, width, height, coded, transforms = read_head(data)
    px = np.array(read_pixels(b, coded, height, main=True), np.uint32)
    return undo(px, width, height, transforms).reshape(height, width)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of many files, their main images side by side."""
    out: list = [None] * len(files)
    lanes = []
    for k, data in enumerate(files):
        b, width, height, coded, transforms = read_head(data)
        start = b.at
        cached, grouped = b.read(1), 0
        if not cached:
            grouped = b.read(1)
        codes = None if cached or grouped else read_codes(b, 0)
        if codes is None or max(c.bits for c in codes) > LANE_BITS:
            b.at = start
            px = np.array(read_pixels(b, coded, height, main=True), np.uint32)
            out[k] = undo(px, width, height, transforms).reshape(height, width)
        else:
            lanes.append((k, b, width, height, coded, transforms, codes))
    if lanes:
        pixels = _decode_lanes([(x[1], x[4], x[4] * x[3], x[6]) for x in lanes])
        for (k, _, width, height, _, transforms, _), px in zip(lanes, pixels, strict=True):
            out[k] = undo(px, width, height, transforms).reshape(height, width)
    return out


def _decode_lanes(images: list[tuple[Bits, int, int, list[Code]]]) -> list[np.ndarray]:
    """images: (bits at the first symbol, width, number of pixels, codes)."""
    n = len(images)
    raw = b"".join(b.data + b"\0" * 8 for b, *_ in images)
    data = np.frombuffer(raw, np.uint8)
    window = data[:-3].astype(np.int64)
    for k in (1, 2, 3):
        window |= data[k : len(data) - 3 + k].astype(np.int64) << (8 * k)
    first_byte = np.cumsum([0] + [len(b.data) + 8 for b, *_ in images])
    at = np.array([8 * f + b.at for f, (b, *_) in zip(first_byte, images)], np.int64)
    stop_bit = np.array([8 * (f + len(b.data)) for f, (b, *_) in zip(first_byte, images)], np.int64)
    ends = np.cumsum([m for _, _, m, _ in images])
    put = ends - np.array([m for _, _, m, _ in images])
    starts = put.copy()
    out = np.zeros(int(ends[-1]), np.uint32)
    depth = max(codes[0].bits for *_, codes in images)
    tables = np.zeros((n, 1 << depth), np.int32)
    for k, (*_, codes) in enumerate(images):
        tables[k] = np.resize(np.array(codes[0].table, np.int32), 1 << depth)
    tables = tables.ravel()
    plain = all(not c.bits for *_, codes in images for c in codes[1:4])
    others = []
    if not plain:
        for c in (1, 2, 3):
            d = max(codes[c].bits for *_, codes in images)
            t = np.stack([np.resize(np.array(codes[c].table, np.int32), 1 << d) for *_, codes in images])
            others.append((t.ravel(), d))
    base = np.array([codes[3].table[0] >> 4 << 24 | codes[1].table[0] >> 4 << 16 | codes[2].table[0] >> 4 for *_, codes in images], np.int64) if plain else None
    live = np.flatnonzero(put < ends)
    at, put, end, row = at[live], put[live], ends[live], live << depth
    mask = (1 << depth) - 1
    rest = base[live] if plain else None
    while len(live):
        e = np.take(tables, row + ((np.take(window, at >> 3) >> (at & 7)) & mask))
        at += e & 15
        s = e >> 4
        literal = s < 256
        if literal.all():
            own = slice(None)
        else:
            own = np.flatnonzero(literal)
            for k in np.flatnonzero(~literal).tolist():
                b, width, _, codes = images[live[k]]
                b.at = int(at[k]) - 8 * int(first_byte[live[k]])
                if s[k] >= 280:
                    raise Broken("a symbol that no code has")
                m = long_value(int(s[k]) - 256, b)
                d = distance(long_value(codes[4].read(b), b), width)
                p = int(put[k])
                if d > p - starts[live[k]] or p + m > end[k]:
                    raise Broken("a back-reference leaves the image")
                out[p : p + m] = np.resize(out[p - d : p - d + min(d, m)], m)
                at[k] = b.at + 8 * int(first_byte[live[k]])
                put[k] += m
        if plain:
            out[put[own]] = rest[own] | s[own] << 8
        else:
            px = s[own].astype(np.int64) << 8
            for (table, d), shift in zip(others, (16, 0, 24), strict=True):
                here = at[own]
                e = np.take(table, (live[own] << d) + ((np.take(window, here >> 3) >> (here & 7)) & ((1 << d) - 1)))
                at[own] = here + (e & 15)
                px |= (e >> 4).astype(np.int64) << shift
            out[put[own]] = px
        put[own] += 1
        done = put >= end
        if done.any():
            if (at[done] > stop_bit[live[done]]).any():
                raise Broken("the stream ends too early")
            keep = ~done
            live, at, put, end, row = live[keep], at[keep], put[keep], end[keep], row[keep]
            if plain:
                rest = rest[keep]
        if len(live) and (at >> 3).max() >= len(window):
            raise Broken("the stream ends too early")
    return [out[e - m : e] for e, (_, _, m, _) in zip(ends.tolist(), images, strict=True)]


# --- encoder


class Writer:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, []

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n
        if self.n >= 64:
            self._flush()

    def _flush(self) -> None:
        k = self.n >> 3
        self.done.append((self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little"))
        self.value >>= 8 * k
        self.n &= 7

    def put_many(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Values of at most 31 bits each, one after the other."""
        if not len(values):
            return
        self._flush()
        ends = np.cumsum(lengths) + self.n
        starts = ends - lengths
        total = int(ends[-1])
        shifted = values.astype(np.uint64) << (starts & 31).astype(np.uint64)
        word = starts >> 5
        n_words = (total >> 5) + 2
        # codes of one word do not overlap, so adding is or-ing
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.zeros(n_words, np.uint64)
        sums[word[first]] = np.add.reduceat(shifted, first)
        low = sums & np.uint64(0xFFFFFFFF)
        low[1:] += sums[:-1] >> np.uint64(32)
        low[0] |= np.uint64(self.value)
        # a word may now carry what the one before spilled over; the bits are disjoint, so it stays below 2^32
        raw = low.astype("<u4").tobytes()
        k = total >> 3
        self.done.append(raw[:k])
        self.n = total & 7
        self.value = raw[k] & ((1 << self.n) - 1) if self.n else 0

    def bytes(self) -> bytes:
        return b"".join([*self.done, self.value.to_bytes(-(-self.n // 8), "little")])


def code_lengths(counts: dict[int, int], longest: int = LONGEST_CODE) -> dict[int, int]:
    """Huffman code lengths of at most `longest` bits for symbols by their counts."""
    floor = 1
    while True:
        heap = [(max(c, floor), s, (s,)) for s, c in sorted(counts.items())]
        heapq.heapify(heap)
        lengths = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths.values()) <= longest:
            return lengths
        floor = max(2 * floor, sum(counts.values()) >> longest)


def write_code(w: Writer, counts: dict[int, int], alphabet: int) -> tuple[list[int], list[int]]:
    """Writes the code for symbols with these counts; (code words, lengths) by symbol."""
    words, lengths = [0] * alphabet, [0] * alphabet
    used = sorted(counts)
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        w.put(0b001 if s < 2 else 0b101, 3)
        w.put(s, 1 if s < 2 else 8)
        return words, lengths
    if len(used) == 1:
        counts = {0: 1, **counts}
        used = sorted(counts)
    for s, n in code_lengths(counts).items():
        lengths[s] = n
    for s, _, word in code_words(lengths):
        words[s] = word
    w.put(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at, last = 0, used[-1] + 1
    while at < last:
        n = lengths[at]
        run = 1
        while at + run < last and lengths[at + run] == n:
            run += 1
        at += run
        if n == 0:
            while run >= 3:
                k = min(run, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                run -= k
            tokens += [(0, 0, 0)] * run
        else:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
                run -= k
            tokens += [(n, 0, 0)] * run
    of: dict[int, int] = {}
    for t, _, _ in tokens:
        of[t] = of.get(t, 0) + 1
    if len(of) == 1:
        of[0 if 0 not in of else 1] = 0
    sizes = [0] * 19
    for s, n in code_lengths({s: max(c, 1) for s, c in of.items()}, 7).items():
        sizes[s] = n
    count = max(k for k, s in enumerate(CODE_ORDER) if sizes[s]) + 1
    count = max(count, 4)
    w.put(count - 4, 4)
    for s in CODE_ORDER[:count]:
        w.put(sizes[s], 3)
    word = {s: (v, n) for s, n, v in code_words(sizes)}
    w.put(1, 1)
    # how many code lengths follow: at least 2
    left = max(len(tokens), 2) - 2
    width = max(1, (left.bit_length() + 1) // 2)
    w.put(width - 1, 3)
    w.put(left, 2 * width)
    for t, extra, bits in tokens + [(0, 0, 0)] * (2 - len(tokens)):
        w.put(*word[t])
        if bits:
            w.put(extra, bits)
    return words, lengths


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra value, extra bits) of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _short_code(d: int, width: int) -> int:
    for k, (dx, dy) in enumerate(SHORT):
        if dx + dy * width == d:
            return k + 1
    return d + 120


def write_pixels(w: Writer, px: list[int], width: int, main: bool = False, cache_bits: int = 0, matches: bool = False, grid: tuple[int, list[int]] | None = None) -> None:
    """One entropy-coded image of ARGB pixels. grid: (bits, group of each block) for the main image."""
    w.put(1, 1) if cache_bits else w.put(0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(1 if grid else 0, 1)
        if grid:
            w.put(grid[0] - 2, 3)
            write_pixels(w, [g << 8 for g in grid[1]], _above(width, grid[0]))
    cache = [None] * (1 << cache_bits) if cache_bits else None
    seen: dict = {}
    tokens: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # group, [(code number, symbol, extra, bits)]
    at = 0

    def remember(k: int) -> None:
        if cache is not None:
            cache[(HASH * px[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        if matches and k >= 2:
            seen[(px[k - 2], px[k - 1], px[k])] = k - 2

    while at < len(px):
        y, x = divmod(at, width)
        group = grid[1][(y >> grid[0]) * _above(width, grid[0]) + (x >> grid[0])] if grid else 0
        start = seen.get(tuple(px[at : at + 3])) if matches else None
        n = 0
        if start is not None:
            while n < 4096 and at + n < len(px) and px[start + n] == px[at + n]:
                n += 1
        if n >= 3:
            s, extra, bits = prefix_of(n)
            ds, dextra, dbits = prefix_of(_short_code(at - start, width))
            tokens.append((group, [(0, 256 + s, extra, bits), (4, ds, dextra, dbits)]))
        else:
            n, p = 1, px[at]
            slot = (HASH * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache else 0
            if cache and cache[slot] == p:
                tokens.append((group, [(0, 280 + slot, 0, 0)]))
            else:
                tokens.append((group, [(0, (p >> 8) & 255, 0, 0), (1, (p >> 16) & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]))
        for k in range(at, at + n):
            remember(k)
        at += n
    groups = max((g for g in grid[1]), default=0) + 1 if grid else 1
    counts = [[{} for _ in range(5)] for _ in range(groups)]
    for g, parts in tokens:
        for c, s, _, _ in parts:
            counts[g][c][s] = counts[g][c].get(s, 0) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[write_code(w, counts[g][c], sizes[c]) for c in range(5)] for g in range(groups)]
    for g, parts in tokens:
        for c, s, extra, bits in parts:
            words, lengths = codes[g][c]
            w.put(words[s], lengths[s])
            if bits:
                w.put(extra, bits)


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _start(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 1)
    w.put(0, 3)
    return w


def encode(image: np.ndarray, predictor: tuple[int, list[int]] | None = None, cross: tuple[int, list[int]] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, matches: bool = True, grid: tuple[int, list[int]] | None = None) -> bytes:
    """A file of an ARGB image (height, width). predictor: (block bits, mode of each block); cross: (block bits, factors)."""
    height, width = image.shape
    px, coded = image.astype(np.uint32).ravel(), width
    w = _start(width, height)
    if palette:
        colours, index = np.unique(px, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has at most 256 colours")
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        write_pixels(w, np.ascontiguousarray(steps).view(np.uint32).ravel().tolist(), len(colours))
        bits = palette_bits(len(colours))
        coded = _above(width, bits)
        rows = np.zeros((height, coded << bits), np.uint32)
        rows[:, :width] = index.reshape(height, width)
        rows = rows.reshape(height, coded, 1 << bits)
        px = (sum(rows[:, :, k] << ((8 >> bits) * k) for k in range(1 << bits)) << 8).ravel()
    px = px.tolist()
    if predictor:
        bits, modes = predictor
        w.put(1 | PREDICTOR << 1, 3)
        w.put(bits - 2, 3)
        modes = [m << 8 for m in modes]
        write_pixels(w, modes, _above(coded, bits))
        px = [_sub(p, _expected(px, at, coded, modes, bits, _above(coded, bits))) for at, p in enumerate(px)]
    if cross:
        bits, factors = cross
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(bits - 2, 3)
        write_pixels(w, factors, _above(coded, bits))
        px = cross_colour(px, coded, bits, factors, False)
    if subtract_green:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        px = [p & 0xFF00FF00 | ((p >> 16) - (p >> 8) & 255) << 16 | (p - (p >> 8)) & 255 for p in px]
    w.put(0, 1)
    write_pixels(w, px, coded, main=True, cache_bits=cache_bits, matches=matches, grid=grid)
    return riff(w.bytes())
