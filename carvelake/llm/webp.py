"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder.

Pixels are uint32 ARGB in row order. `decode` reads prefix codes (simple, normal, meta), back-references, the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Where an image has one prefix code
group whose red, blue and alpha codes are constant and uses no cache, its literals are read several at a time
through a table of bit windows (`_one_channel`); everything else goes through the symbol-by-symbol reader.

`encode_grey` writes samples as grey pixels: with a palette where there are at most 16 values, so that a pixel holds up to eight
samples, else less green; equal strings of 8 samples or more as back-references. `encode` writes any tool that it is asked for.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

SIDE = 16384
#: Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
ALPHABETS = [280, 256, 256, 256, 40]
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Short distances: offsets (x, y) from near to far.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class WebPError(ValueError):
    pass


class Bits:
    """Reads bits from the lowest up."""

    def __init__(self, data: bytes):
        self.value, self.size, self.pos, self.data = 0, 0, 0, data

    def fill(self) -> None:
        if self.pos > len(self.data) + 64:
            raise WebPError("the data ends early")
        self.value |= int.from_bytes(self.data[self.pos : self.pos + 8], "little") << self.size
        self.size += 64
        self.pos += 8

    def read(self, n: int) -> int:
        if self.size < n:
            self.fill()
        v = self.value & ((1 << n) - 1)
        self.value >>= n
        self.size -= n
        return v

    @property
    def at(self) -> int:
        return self.pos * 8 - self.size

    def seek(self, at: int) -> None:
        self.pos, self.value, self.size = at >> 3, 0, 0
        self.read(at & 7)


def canonical(lengths: tuple[int, ...]) -> list[int]:
    """Code of each symbol, first bit highest."""
    codes, code = [0] * len(lengths), 0
    for n in range(1, max(lengths, default=0) + 1):
        for s, own in enumerate(lengths):
            if own == n:
                codes[s] = code
                code += 1
        code <<= 1
    return codes


def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


class Prefix:
    """One prefix code; symbols are looked up by the next ``width`` bits."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [s for s, n in enumerate(lengths) if n]
        self.lengths = lengths
        self.only = used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        if self.only is None:
            if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
                raise WebPError("a prefix code is not complete")
            codes = canonical(lengths)
            self.width = max(lengths)
            self.mask = (1 << self.width) - 1
            self.symbol = [0] * (1 << self.width)
            for s in used:
                step = 1 << lengths[s]
                self.symbol[_reversed(codes[s], lengths[s]) :: step] = [s] * (len(self.symbol) // step)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if bits.size < self.width:
            bits.fill()
        s = self.symbol[bits.value & self.mask]
        n = self.lengths[s]
        bits.value >>= n
        bits.size -= n
        return s


def _read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        for s in symbols:
            if s >= alphabet:
                raise WebPError("a symbol is out of range")
            lengths[s] = 1
        return _prefix(tuple(lengths))
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = Prefix(tuple(own))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    k, last = 0, 8
    while k < alphabet and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
        else:
            value, extra, least = (last, 2, 3) if s == 16 else (0, 3, 3) if s == 17 else (0, 7, 11)
            n = least + bits.read(extra)
            if k + n > alphabet:
                raise WebPError("too many code lengths")
            lengths[k : k + n] = [value] * n
            k += n
    return _prefix(tuple(lengths))


@lru_cache(maxsize=64)
def _prefix(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(lengths)


@lru_cache(maxsize=8)
def _windows(lengths: tuple[int, ...], width: int) -> tuple[list[bytes], list[int], list[int]]:
    """For each window of ``width`` bits, the literals that it holds whole, the bits they take, and the first symbol."""
    codes = canonical(lengths)
    size = 1 << width
    symbol, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for s, n in enumerate(lengths):
        if n:
            symbol[_reversed(codes[s], n) :: 1 << n] = s
            length[_reversed(codes[s], n) :: 1 << n] = n
    every = np.arange(size)
    taken, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
    out = np.zeros((size, 16), np.uint8)
    going = np.ones(size, bool)
    for k in range(16):
        rest = every >> taken
        going &= (taken + length[rest] <= width) & (symbol[rest] < 256)
        if not going.any():
            break
        out[going, k] = symbol[rest[going]]
        count[going] += 1
        taken[going] += length[rest[going]]
    flat = out.tobytes()
    return [flat[16 * k : 16 * k + c] for k, c in enumerate(count.tolist())], taken.tolist(), symbol.tolist()


def _one_channel(bits: Bits, literal: Prefix, distance: Prefix, width: int, total: int) -> np.ndarray:
    """The next ``total`` green samples where all other channels are constant: literals and back-references."""
    lengths = literal.lengths
    window = 16 if total >= 4096 or literal.width > 12 else 12
    parts, steps, firsts = _windows(lengths, window)
    spare = total // 8 + 16  # a corrupt stream is read past its end by no more than this, then refused
    data = np.frombuffer(bits.data + bytes(spare), np.uint8).astype(np.uint32)
    words = (data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24).tolist()
    mask, pos, most = (1 << window) - 1, bits.at, 8 * len(bits.data)
    out = bytearray()
    while len(out) < total:
        if pos > most:
            raise WebPError("the data ends early")
        for _ in range((total - len(out) + 15) // 16):  # a window holds 16 literals at most
            e = words[pos >> 3] >> (pos & 7) & mask
            part = parts[e]
            if not part:
                break
            out += part
            pos += steps[e]
        else:
            continue
        k, s = len(out), firsts[e]
        if k >= total:
            break
        pos += lengths[s]
        s -= 256
        n = s + 1
        if s > 3:
            extra = (s - 2) >> 1
            n = ((2 + (s & 1)) << extra) + (words[pos >> 3] >> (pos & 7) & ((1 << extra) - 1)) + 1
            pos += extra
        if distance.only is None:
            s = distance.symbol[words[pos >> 3] >> (pos & 7) & distance.mask]
            pos += distance.lengths[s]
        else:
            s = distance.only
        back = s + 1
        if s > 3:
            extra = (s - 2) >> 1
            back = ((2 + (s & 1)) << extra) + (words[pos >> 3] >> (pos & 7) & ((1 << extra) - 1)) + 1
            pos += extra
        back = back - 120 if back > 120 else _back(back, width)
        if back > k or k + n > total:
            raise WebPError("a back-reference is out of range")
        if back >= n:
            out += out[k - back : k - back + n]
        else:
            out += (out[k - back :] * (n // back + 1))[:n]
    pos -= sum(lengths[s] for s in out[total:])  # the last windows went on behind the image
    if pos > most:
        raise WebPError("the data ends early")
    bits.seek(pos)
    return np.frombuffer(bytes(out[:total]), np.uint8)


def _back(code: int, width: int) -> int:
    """How many pixels a distance code goes back."""
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


#: Groups of prefix codes read before, by number, alphabets and length in bits, then by their bits.
_GROUPS: dict[tuple, dict[int, list[list[Prefix]]]] = {}


def _read_groups(bits: Bits, sizes: list[int], n: int) -> list[list[Prefix]]:
    """The prefix codes of an image. Many images have the same ones, so some are remembered."""
    at = bits.at
    for (number, *alphabets, length), known in _GROUPS.items():
        if number == n and alphabets == sizes:
            groups = known.get(int.from_bytes(bits.data[at >> 3 : (at + length + 7) >> 3], "little") >> (at & 7) & ((1 << length) - 1))
            if groups:
                bits.seek(at + length)
                return groups
    groups = [[_read_prefix(bits, size) for size in sizes] for _ in range(n)]
    length = bits.at - at
    if length < 4096 and len(_GROUPS) < 8:
        own = int.from_bytes(bits.data[at >> 3 : (at + length + 7) >> 3], "little") >> (at & 7) & ((1 << length) - 1)
        _GROUPS[n, *sizes, length] = {own: groups}
    return groups


def _value(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    tile, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        down = (height + (1 << tile) - 1) >> tile
        groups_of = (_read_image(bits, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        n_groups = max(groups_of) + 1
    sizes = [ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:]]
    groups = _read_groups(bits, sizes, n_groups)
    total = width * height
    if n_groups == 1 and not cache_bits and groups_of is None:
        g, r, b, a, distance = groups[0]
        if None not in (r.only, b.only, a.only) and g.only is None:
            green = _one_channel(bits, g, distance, width, total).astype(np.uint32)
            return green << np.uint32(8) | np.uint32(a.only << 24 | r.only << 16 | b.only)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    k, stored = 0, 0
    while k < total:
        if groups_of is not None:
            own = groups[groups_of[(k // width >> tile) * across + (k % width >> tile)]]
        else:
            own = groups[0]
        s = own[0].read(bits)
        if s < 256:
            r, b, a = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out[k] = a << 24 | r << 16 | s << 8 | b
            k += 1
        elif s < 280:
            length = _value(bits, s - 256)
            back = _back(_value(bits, own[4].read(bits)), width)
            if back > k or k + length > total:
                raise WebPError("a back-reference is out of range")
            for k in range(k, k + length):
                out[k] = out[k - back]
            k += 1
        else:
            if cache_bits:
                while stored < k:
                    cache[(HASH * out[stored] & 0xFFFFFFFF) >> shift] = out[stored]
                    stored += 1
            out[k] = cache[s - 280]
            k += 1
    return np.array(out, np.uint32)


def _planes(pixels: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue along the last axis."""
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(planes: np.ndarray) -> np.ndarray:
    p = (planes & 255).astype(np.uint32)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def _half(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return _half(_half(left, top_right), top)
        case 6:
            return _half(left, top_left)
        case 7:
            return _half(left, top)
        case 8:
            return _half(top_left, top)
        case 9:
            return _half(top, top_right)
        case 10:
            return _half(_half(left, top_left), _half(top, top_right))
        case 11:
            from_left = sum(abs(t - c) for t, c in zip(top, top_left))
            from_top = sum(abs(a - c) for a, c in zip(left, top_left))
            return left if from_left < from_top else top
        case 12:
            return [_clamp(a + t - c) for a, t, c in zip(left, top, top_left)]
        case 13:
            mean = _half(left, top)
            return [_clamp(m + int((m - c) / 2)) for m, c in zip(mean, top_left)]
    return [255, 0, 0, 0]


def _predict(image: np.ndarray, modes: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    """Removes (forward) or adds the predictions. image: rows of ARGB."""
    height, width = image.shape
    source = _planes(image).tolist()
    known = source if forward else [[[0] * 4 for _ in range(width)] for _ in range(height)]
    out = [[[0] * 4 for _ in range(width)] for _ in range(height)] if forward else known
    for y in range(height):
        row, above = known[y], known[y - 1] if y else None
        for x in range(width):
            if y == 0:
                guess = [255, 0, 0, 0] if x == 0 else row[x - 1]
            elif x == 0:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < width else row[0]
                guess = predicted(int(modes[y >> tile, x >> tile]), row[x - 1], above[x], right, above[x - 1])
            sign = -1 if forward else 1
            out[y][x] = [(v + sign * p) & 255 for v, p in zip(source[y][x], guess)]
    return _joined(np.array(out, np.int64).reshape(height, width, 4))


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 255 ^ 128) - 128


def _cross(image: np.ndarray, elements: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    height, width = image.shape
    p = _planes(image)
    e = _planes(elements[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile])
    delta = lambda t, c: _signed(t) * _signed(c) >> 5
    red_in = p[..., 1]
    sign = -1 if forward else 1
    red = red_in + sign * delta(e[..., 3], p[..., 2])
    used = red_in if forward else red & 255
    blue = p[..., 3] + sign * (delta(e[..., 2], p[..., 2]) + delta(e[..., 1], used))
    return _joined(np.stack([p[..., 0], red, p[..., 2], blue], axis=-1))


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    """Adds (or takes) green to red and blue."""
    g = image >> np.uint32(8) & np.uint32(255)
    if sign > 0 and not (image & np.uint32(0x00FF00FF)).any():
        return image & np.uint32(0xFF00FF00) | g << np.uint32(16) | g
    p = _planes(image)
    return _joined(np.stack([p[..., 0], p[..., 1] + sign * p[..., 2], p[..., 2], p[..., 3] + sign * p[..., 2]], axis=-1))


def decode(data: bytes) -> np.ndarray:
    """Rows of ARGB pixels of one lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise WebPError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if 20 + size > len(data):
        raise WebPError("the data ends early")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [u[0] for u in undo]:
            raise WebPError("a transform is given twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across, down = ((n + (1 << tile) - 1) >> tile for n in (coded, height))
            undo.append((kind, tile, _read_image(bits, across, down, False).reshape(down, across), coded))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            colours = _joined(np.cumsum(_planes(_read_image(bits, size, 1, False)), axis=0))
            packing = _bundle(size)
            undo.append((kind, packing, colours, coded))
            coded = (coded + (1 << packing) - 1) >> packing
        else:
            undo.append((kind, 0, None, coded))
    image = _read_image(bits, coded, height, True).reshape(height, coded)
    for kind, number, table, before in reversed(undo):
        if kind == PREDICTOR:
            image = _predict(image, (table >> np.uint32(8) & np.uint32(15)), number, False)
        elif kind == CROSS_COLOUR:
            image = _cross(image, table, number, False)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, 1)
        else:
            index = image >> np.uint32(8) & np.uint32(255)
            if number:
                each = 8 >> number
                shifts = np.arange(1 << number, dtype=np.uint32) * np.uint32(each)
                index = (index[:, :, None] >> shifts & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :before]
            full = np.zeros(256, np.uint32)
            full[: len(table)] = table
            image = full[index]
    return image


# --- encoder ---


class Writer:
    """Bits from the lowest up, as an array of zeros and ones."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> k & 1 for k in range(n)], np.uint8))

    def all(self, values: np.ndarray, n: np.ndarray) -> None:
        """Each value in its own number of bits."""
        place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
        self.parts.append((np.repeat(values, n) >> place & 1).astype(np.uint8))

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def code_lengths(weights: list[float], longest: int = 15) -> tuple[int, ...]:
    """Huffman code lengths; light symbols are made heavier until no code is too long."""
    floor = 0.0
    while True:
        heap = [(max(w, floor), k, (k,)) for k, w in enumerate(weights) if w > 0]
        lengths = [0] * len(weights)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return tuple(lengths)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths, default=0) <= longest:
            return tuple(lengths)
        floor = max(2 * floor, sum(weights) / (1 << (longest + 3)))


def _write_prefix(w: Writer, lengths: tuple[int, ...]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(used[0] if used else 0, 8)
        return
    w.put(0, 1)
    items: list[tuple[int, int, int]] = []  # symbol, extra bits and their number
    k = 0
    while k < len(lengths):
        run = 1
        while k + run < len(lengths) and lengths[k + run] == lengths[k]:
            run += 1
        if lengths[k] == 0 and run >= 3:
            run = min(run, 138)
            items.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        else:
            run = 1
            items.append((lengths[k], 0, 0))
        k += run
    own = code_lengths([sum(1 for i in items if i[0] == s) for s in range(19)], 7)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    w.put(max(last, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(last, 4)]:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = canonical(own)
    single = sum(1 for n in own if n) == 1
    for s, extra, n in items:
        if not single:
            w.put(_reversed(codes[s], own[s]), own[s])
        w.put(extra, n)


def _container(w: Writer) -> bytes:
    body = b"\x2f" + w.bytes()
    pad = len(body) & 1
    return b"RIFF" + (len(body) + pad + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * pad


#: Usual frequencies of bytes in prose, in parts of a thousand: the space, letters from frequent to rare, and the rest.
LETTERS = "etaoinhsrdlucmfwgypbvkxjqz"


@lru_cache(maxsize=1)
def prose_code() -> tuple[int, ...]:
    """Code lengths of literals and match lengths that suit prose."""
    weights = [0.02] * 256 + [2.0] * 14 + [0.05] * 10
    for k, c in enumerate(LETTERS):
        weights[ord(c)] = 110 * 0.88**k
        weights[ord(c.upper())] = 2.2 * 0.93**k
    for c, v in ((" ", 160), ("\n", 4), (".", 12), (",", 12), ("!", 2)):
        weights[ord(c)] = v
    for c in "0123456789#$%&*|-'\"":
        weights[ord(c)] = 1
    for b in range(0x80, 0xC0):
        weights[b] = 0.4
    weights[0xC3] = 12
    return code_lengths(weights)


@lru_cache(maxsize=1)
def distance_code() -> tuple[int, ...]:
    """Code lengths of distances: most lie some hundreds to thousands back."""
    return code_lengths([0.5 if k < 12 else 4.0 if k < 28 else 1.0 for k in range(40)])


#: Samples that a back-reference replaces at least, and the farthest distance and longest copy of the format.
MATCH, FARTHEST, LONGEST = 8, (1 << 20) - 120, 4096


def _matches(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of copies from left to right: where strings of MATCH samples were last seen at one distance in a row."""
    n = len(flat) - MATCH + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    wide = flat.astype(np.uint64)
    key = wide[:n].copy()
    for k in range(1, MATCH):
        key |= wide[k : k + n] << np.uint64(8 * k)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    distance = np.zeros(n, np.int64)
    distance[order[1:][same]] = order[1:][same] - order[:-1][same]
    distance[distance > FARTHEST] = 0
    edge = np.flatnonzero(np.diff(distance, prepend=0)).tolist()
    found, end = [], 0
    for a, b in zip(edge, [*edge[1:], n]):
        d = int(distance[a])
        stop, start = b + MATCH - 1, max(a, end)
        if d and stop - start >= MATCH:
            for k in range(start, stop, LONGEST):
                found.append((k, min(LONGEST, stop - k), d))
            end = stop
    return tuple(np.array(found, np.int64).reshape(-1, 3).T) if found else (none, none, none)


def _all_prefix_parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_prefix_parts` of many values."""
    v = np.maximum(values - 1, 1)
    top = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    small = values <= 4
    return (
        np.where(small, values - 1, 2 * top + (v >> np.maximum(top - 1, 0) & 1)),
        np.where(small, 0, v & ((1 << np.maximum(top - 1, 0)) - 1)),
        np.where(small, 0, top - 1),
    )


@lru_cache(maxsize=64)
def _reversed_codes(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes of all symbols; the only symbol of a code takes no bits."""
    one = sum(1 for n in lengths if n) == 1
    return np.array(lengths) * (not one), np.array([_reversed(c, n) for c, n in zip(canonical(lengths), lengths)])


@lru_cache(maxsize=64)
def _code_bits(*codes: tuple[int, ...]) -> np.ndarray:
    """Bits of no colour cache, one group, and its prefix codes; a single number is the only symbol of a code."""
    w = Writer()
    w.put(0, 1), w.put(0, 1)
    for lengths in codes:
        _write_prefix(w, lengths)
    return np.concatenate(w.parts)


RED_OR_BLUE = (1,) + (0,) * 255
ALPHA = {0: RED_OR_BLUE, 255: RED_OR_BLUE[::-1]}


@lru_cache(maxsize=1)
def _prose_bits() -> np.ndarray:
    return _code_bits(prose_code(), RED_OR_BLUE, RED_OR_BLUE, ALPHA[255], distance_code())


def _write_channel(w: Writer, flat: np.ndarray, own: bool, alpha: int) -> None:
    """Green samples, all other channels constant. own: prefix codes of the image's own, else those of prose."""
    start, length, distance = _matches(flat)
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + length, -1)
    literal = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    lcode, lextra, lbits = _all_prefix_parts(length)
    dcode, dextra, dbits = _all_prefix_parts(distance + 120)
    if own:
        green = np.bincount(np.concatenate([flat[literal], lcode + 256]), minlength=280)
        if (green > 0).sum() == 1:  # a code of one symbol above 255 can't be written
            green[0 if green[0] == 0 else 1] += 1
        codes = code_lengths(green.tolist()), code_lengths(np.bincount(dcode, minlength=40).tolist()) if len(start) else (0,) * 40
    else:
        codes = prose_code(), distance_code()
    w.parts.append(_code_bits(codes[0], RED_OR_BLUE, RED_OR_BLUE, ALPHA[alpha], codes[1]) if own else _prose_bits())
    (n, code), (dn, dsymbol) = map(_reversed_codes, codes)
    # items in order of their places: a literal is one, a back-reference four
    order = np.argsort(np.concatenate([literal, start]), kind="stable")
    size = np.where(order < len(literal), 1, 4)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(size) - size
    values, bits = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
    values[at[: len(literal)]], bits[at[: len(literal)]] = code[flat[literal]], n[flat[literal]]
    for k, (v, b) in enumerate(((code[lcode + 256], n[lcode + 256]), (lextra, lbits), (dsymbol[dcode], dn[dcode]), (dextra, dbits))):
        values[at[len(literal) :] + k], bits[at[len(literal) :] + k] = v, b
    w.all(values, bits)


def encode_grey(samples: np.ndarray) -> bytes:
    """A grey image (rows of uint8) as red = green = blue, of which green alone takes bits."""
    height, width = samples.shape
    w = Writer()
    w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 1), w.put(0, 3), w.put(1, 1)
    colours = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(colours) <= 16:
        w.put(PALETTE, 2), w.put(len(colours) - 1, 8)
        grey = colours.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
        _write_image(w, _joined(np.diff(_planes(grey), axis=0, prepend=0)), len(colours), False, 0, False, 0)
        place = np.zeros(256, np.uint8)
        place[colours] = np.arange(len(colours))
        packing = _bundle(len(colours))
        per, each = 1 << packing, 8 >> packing
        index = np.pad(place[samples], ((0, 0), (0, -width % per))).reshape(height, -1, per)
        w.put(0, 1)
        _write_channel(w, (index << (np.arange(per, dtype=np.uint8) * np.uint8(each))).sum(axis=2).astype(np.uint8).ravel(), True, 0)
    else:
        w.put(SUBTRACT_GREEN, 2), w.put(0, 1)
        _write_channel(w, samples.ravel(), False, 255)
    return _container(w)


def _bundle(colours: int) -> int:
    """How often the width halves where a pixel holds the indices of several."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _prefix_parts(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _write_image(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int, back: bool, tile: int) -> None:
    """Literals, cache hits and back-references to the pixel before or above, with a code group for every other tile."""
    p = pixels.ravel().tolist()
    height = len(p) // width
    events: list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]] = []
    cache: dict[int, int] = {}
    k = 0
    while k < len(p):
        group = (((k // width) >> tile) + ((k % width) >> tile)) & 1 if tile else 0
        n, d = 0, 1
        if back and k:
            for far in {1, width}:
                if far <= k:
                    m = 0
                    while k + m < len(p) and p[k + m] == p[k + m - far] and m < 4096:
                        m += 1
                    if m > n:
                        n, d = m, far
        if n >= 3:
            code = next((i + 1 for i, (x, y) in enumerate(NEAR) if max(x + y * width, 1) == d), d + 120)
            a, b = _prefix_parts(n), _prefix_parts(code)
            events.append((group, [(0, 256 + a[0]), (-1, a[1] | a[2] << 32), (4, b[0]), (-1, b[1] | b[2] << 32)], []))
        else:
            n = 1
            slot = (HASH * p[k] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache.get(slot) == p[k]:
                events.append((group, [(0, 280 + slot)], []))
            else:
                events.append((group, [(0, p[k] >> 8 & 255), (1, p[k] >> 16 & 255), (2, p[k] & 255), (3, p[k] >> 24)], []))
        if cache_bits:
            for v in p[k : k + n]:
                cache[(HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        k += n
    w.put(1, 1), w.put(cache_bits, 4) if cache_bits else None
    if not cache_bits:
        w.parts[-1][:] = 0
    if main:
        w.put(1 if tile else 0, 1)
        if tile:
            w.put(tile - 2, 3)
            across, down = ((n + (1 << tile) - 1) >> tile for n in (width, height))
            kinds = np.add.outer(np.arange(down), np.arange(across)).astype(np.uint32) & np.uint32(1)
            _write_image(w, kinds << np.uint32(8), across, False, 0, False, 0)
    sizes = [ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:]]
    lengths = []
    for group in range(2 if tile and max(e[0] for e in events) else 1):
        for which, size in enumerate(sizes):
            counts = [0] * size
            for e in events:
                for c, s in e[1]:
                    if c == which and e[0] == group:
                        counts[s] += 1
            if sum(1 for c in counts if c) == 1 and counts.index(max(counts)) >= 256:
                counts[0] += 1
            lengths.append(code_lengths(counts) if any(counts) else tuple(counts))
            _write_prefix(w, lengths[-1])
    codes = [[_reversed(c, n) for c, n in zip(canonical(x), x)] for x in lengths]
    for group, parts, _ in events:
        for which, s in parts:
            if which < 0:
                w.put(s & 0xFFFFFFFF, s >> 32)
            elif sum(1 for n in lengths[group * 5 + which] if n) > 1:
                w.put(codes[group * 5 + which][s], lengths[group * 5 + which][s])


def encode(image: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, back: bool = True, tile: int = 0, seed: int = 0) -> bytes:
    """Rows of ARGB pixels with any of the format's tools; modes and factors of the transforms are drawn from ``seed``."""
    rng = np.random.default_rng(seed)
    height, width = image.shape
    w = Writer()
    w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    for kind in transforms:
        w.put(1, 1), w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(0, 3)
            down, across = ((n + 3) >> 2 for n in image.shape)
            table = rng.integers(0, 14, (down, across)).astype(np.uint32) << np.uint32(8) if kind == PREDICTOR else rng.integers(0, 1 << 24, (down, across)).astype(np.uint32)
            _write_image(w, table, across, False, 0, False, 0)
            image = _predict(image, table >> np.uint32(8), 2, True) if kind == PREDICTOR else _cross(image, table, 2, True)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, -1)
        else:
            colours, index = np.unique(image, return_inverse=True)
            index = index.reshape(image.shape)
            if len(colours) > 256:
                raise WebPError("too many colours for a palette")
            w.put(len(colours) - 1, 8)
            planes = _planes(colours)
            _write_image(w, _joined(np.diff(planes, axis=0, prepend=0)), len(colours), False, 0, False, 0)
            packing = _bundle(len(colours))
            per, each = 1 << packing, 8 >> packing
            index = np.pad(index, ((0, 0), (0, -image.shape[1] % per))).reshape(height, -1, per)
            image = (index << (np.arange(per) * each)).sum(axis=2).astype(np.uint32) << np.uint32(8)
    w.put(0, 1)
    _write_image(w, image, image.shape[1], True, cache_bits, back, tile)
    return _container(w)
