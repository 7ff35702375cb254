"""A second decoder of lossless WebP for the tests, bit by bit and without anything of the package's own: prefix codes, back-references,
subtract-green and palettes, which are what grey images are written with."""

ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


def decode(data: bytes) -> list[list[int]]:
    """Rows of ARGB numbers."""
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and int.from_bytes(data[4:8], "little") + 8 == len(data)
    stream = data[20:]
    place = 0

    def bits(n):
        nonlocal place
        v = 0
        for k in range(n):
            v |= (stream[place >> 3] >> (place & 7) & 1) << k
            place += 1
        return v

    def tree(lengths):
        """Symbols by their code as a string of bits."""
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) == 1:
            return {"": used[0][1]}
        code, last, out = 0, used[0][0], {}
        for n, s in used:
            code <<= n - last
            out[f"{code:0{n}b}"] = s
            code, last = code + 1, n
        return out

    def symbol(codes):
        seen = ""
        while seen not in codes:
            seen += str(bits(1))
        return codes[seen]

    def code(alphabet):
        if bits(1):
            two = bits(1)
            symbols = [bits(8 if bits(1) else 1)] + ([bits(8)] if two else [])
            return tree([int(s in symbols) for s in range(alphabet)])
        own = [0] * 19
        for k in range(4 + bits(4)):
            own[ORDER[k]] = bits(3)
        lengths_tree, lengths, last = tree(own), [], 8
        assert not bits(1)
        while len(lengths) < alphabet:
            s = symbol(lengths_tree)
            if s < 16:
                lengths.append(s)
                last = s or last
            else:
                lengths += [last if s == 16 else 0] * {16: lambda: 3 + bits(2), 17: lambda: 3 + bits(3), 18: lambda: 11 + bits(7)}[s]()
        return tree(lengths)

    def number(s):
        if s < 4:
            return s + 1
        extra = (s - 2) >> 1
        return ((2 + (s & 1)) << extra) + bits(extra) + 1

    def pixels(width, height, main):
        assert not bits(1)  # no colour cache
        if main:
            assert not bits(1)  # one group of codes
        green, red, blue, alpha, distance = [code(n) for n in (280, 256, 256, 256, 40)]
        out = []
        while len(out) < width * height:
            s = symbol(green)
            if s < 256:
                r, b, a = symbol(red), symbol(blue), symbol(alpha)
                out.append(a << 24 | r << 16 | s << 8 | b)
            else:
                n, far = number(s - 256), number(symbol(distance))
                assert far > 120
                for _ in range(n):
                    out.append(out[120 - far])
        return out

    def added(p, q):
        return sum(((p >> s & 255) + (q >> s & 255) & 255) << s for s in (0, 8, 16, 24))

    assert bits(8) == 0x2F
    width, height = bits(14) + 1, bits(14) + 1
    assert bits(4) == 0
    coded, palette, green = width, None, False
    while bits(1):
        kind = bits(2)
        if kind == 2:
            green = True
        else:
            assert kind == 3
            size = bits(8) + 1
            palette = pixels(size, 1, False)
            for k in range(1, size):
                palette[k] = added(palette[k], palette[k - 1])
            each = 1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8
            coded = -(-width * each // 8)
    flat = pixels(coded, height, True)
    rows = [flat[k * coded : (k + 1) * coded] for k in range(height)]
    if palette:
        rows = [[palette[r[x * each // 8] >> 8 >> (x * each % 8) & ((1 << each) - 1)] for x in range(width)] for r in rows]
    if green:
        rows = [[added(p, (p >> 8 & 255) * 0x010001) for p in r] for r in rows]
    return rows
