"""Progressive JPEG in numpy: scans of coefficients in and out, inverse transform, chroma upsampling."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

#: Fixed order in which a block's 64 coefficients are stored: row by row places of the zigzag walk.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Scale of the integer basis of the inverse transform; sums stay exact in floating point.
_SCALE = 1 << 12


def _basis() -> np.ndarray:
    """Row k: what coefficient k (in zigzag order) adds to the 64 samples, in whole steps of 1 / _SCALE."""
    u, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * _SCALE)


_BASIS = _basis()


@dataclass
class Component:
    """A colour plane: sampling factors, blocks across and down, and coefficients in zigzag order."""

    h: int
    v: int
    quant: int
    across: int = 0
    down: int = 0
    whole_across: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    height: int
    width: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


# ---- bits


def bits_to_bytes(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: filled up with ones, and a zero byte after each 0xFF."""
    full = np.ones(-(-len(bits) // 8) * 8, np.uint8)
    full[: len(bits)] = bits
    return np.packbits(full).tobytes().replace(b"\xff", b"\xff\x00")


def number_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The numbers' bits one after the other, each in its own width."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(values)), widths)
    shift = ends[owner] - 1 - np.arange(total)
    return ((values[owner] >> shift) & 1).astype(np.uint8)


def magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category of each value and its extra bits."""
    size = np.zeros(len(values), np.int64)
    some = values != 0
    size[some] = np.floor(np.log2(abs(values[some]))).astype(np.int64) + 1
    return size, np.where(values < 0, values + (1 << size) - 1, values)


class Reader:
    """Bits of one scan, read from the front."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff", np.uint8)
        self.bits = np.unpackbits(raw)
        self.raw = raw
        self.at = 0

    def peek16(self) -> int:
        i, s = self.at >> 3, self.at & 7
        raw = self.raw
        return ((int(raw[i]) << 16 | int(raw[i + 1]) << 8 | int(raw[i + 2])) >> (8 - s)) & 0xFFFF

    def number(self, n: int) -> int:
        x = self.peek16() >> (16 - n) if n else 0
        self.at += n
        return x

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Huffman:
    """A table of codes: symbol and length for every 16 bits that may come."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.counts, self.symbols = counts, symbols
        self.codes: dict[int, tuple[int, int]] = {}
        code = k = 0
        table = np.zeros(1 << 16, np.int32)
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[symbols[k]] = (code, length)
                low = code << (16 - length)
                table[low : low + (1 << (16 - length))] = symbols[k] << 8 | length
                code, k = code + 1, k + 1
            code <<= 1
        self.table = table
        #: 16 bits to the difference that starts there and its length, as far as met.
        self.differences: dict[int, tuple[int, int]] = {}

    def read(self, r: Reader) -> int:
        x = int(self.table[r.peek16()])
        if not x & 255:
            raise ValueError("no such code")
        r.at += x & 255
        return x >> 8


@functools.lru_cache(64)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    """Tables are the same from file to file, mostly."""
    return Huffman(counts, symbols)


# ---- decoding


def _planes(image: Image) -> None:
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    units = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    for c in image.components:
        c.across, c.down = -(-image.width * c.h // (8 * most_h)), -(-image.height * c.v // (8 * most_v))
        c.whole_across = units[0] * c.h
        c.coefficients = np.zeros((units[0] * c.h * units[1] * c.v, 64), np.int32)


def _order(image: Image, parts: list[Component]) -> list[tuple[Component, np.ndarray]]:
    """Blocks of each component of a scan in the order of the scan: by itself row by row, else unit by unit."""
    if len(parts) == 1:
        c = parts[0]
        if c.across == c.whole_across:
            return [(c, np.arange(c.down * c.across))]
        return [(c, (np.arange(c.down)[:, None] * c.whole_across + np.arange(c.across)).ravel())]
    out = []
    for c in parts:
        units = c.whole_across // c.h
        rows = len(c.coefficients) // c.whole_across // c.v
        grid = np.arange(len(c.coefficients)).reshape(rows, c.v, units, c.h).transpose(0, 2, 1, 3)
        out.append((c, grid.reshape(rows * units, c.v * c.h)))
    return out


def _dc(image: Image, parts: list[Component], tables: list[Huffman], data: bytes, high: int, low: int) -> None:
    order = _order(image, parts)
    counts = [b.shape[1] if b.ndim == 2 else 1 for _, b in order]
    blocks = [b if b.ndim == 2 else b[:, None] for _, b in order]
    units = len(blocks[0])
    r = Reader(data)
    if high:
        bit = r.bits[: units * sum(counts)].reshape(units, -1).astype(np.int32)
        at = 0
        for (c, _), b in zip(order, blocks, strict=True):
            c.coefficients[b, 0] |= bit[:, at : at + b.shape[1]] << low
            at += b.shape[1]
        return
    raw = r.raw.astype(np.int64)
    words = ((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]).tolist()  # 24 bits from each byte on
    lookup = [t.differences for t in tables]
    at, slots = 0, [k for k, n in enumerate(counts) for _ in range(n)]
    differences = []
    for _ in range(units):
        for k in slots:
            x = (words[at >> 3] >> (8 - (at & 7))) & 0xFFFF
            known = lookup[k].get(x)
            if known is None:
                entry = int(tables[k].table[x])
                size, length = entry >> 8, entry & 255
                if not length:
                    raise ValueError("no such code")
                value = 0
                if size + length <= 16:
                    value = (x >> (16 - length - size)) & ((1 << size) - 1)
                else:
                    y = (words[(at + length) >> 3] >> (8 - ((at + length) & 7))) & 0xFFFF
                    value = y >> (16 - size)
                value = value if not size or value >> (size - 1) else value - (1 << size) + 1
                known = (value, length + size)
                if size + length <= 16:
                    lookup[k][x] = known
            differences.append(known[0])
            at += known[1]
    table = np.array(differences, np.int32).reshape(units, -1)
    at = 0
    for (c, _), b in zip(order, blocks, strict=True):
        mine = table[:, at : at + b.shape[1]]
        c.coefficients[b.ravel(), 0] = np.cumsum(mine.ravel()).astype(np.int32) << low
        at += b.shape[1]


@functools.lru_cache(16)
def _signed(size: int) -> np.ndarray:
    """What the extra bits of a size category stand for."""
    x = np.arange(1 << size, dtype=np.int32)
    return np.where(x >> (size - 1), x, x - (1 << size) + 1).astype(np.int32)


def _ac_first(c: Component, blocks: np.ndarray, table: Huffman, data: bytes, first: int, last: int, low: int) -> None:
    n = last - first + 1
    if len(table.codes) == 1 and (s := next(iter(table.codes))) >> 4 == 0 and s & 15:
        # the one code is for a coefficient of one size that follows at once, so all of them are equally long
        length, size = table.codes[s][1], s & 15
        each = length + size
        if each == 8:
            found = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)[: len(blocks) * n].astype(np.int32) & ((1 << size) - 1)
        else:
            r = Reader(data)
            bits = r.bits[: len(blocks) * n * each].reshape(-1, each)[:, length:].astype(np.int32)
            found = bits @ (1 << np.arange(size - 1, -1, -1)).astype(np.int32)
        value = _signed(size)[found] << low
        c.coefficients[blocks, first : last + 1] = value.reshape(-1, n)
        return
    r, run = Reader(data), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = table.read(r)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                c.coefficients[b, k] = r.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + r.number(zeros) - 1
                break


def _ac_refine(c: Component, blocks: np.ndarray, table: Huffman, data: bytes, first: int, last: int, low: int) -> None:
    r, bit = Reader(data), 1 << low
    if all(s & 15 == 0 and s >> 4 < 15 for s in table.codes):
        # no new coefficients: after each run's length come correction bits of what is not zero already
        at = 0
        while at < len(blocks):
            s = table.read(r) >> 4
            run = (1 << s) + r.number(s)
            mine = blocks[at : at + run]
            band = c.coefficients[mine, first : last + 1]
            if band.all():
                step = r.bits[r.at : r.at + band.size].reshape(band.shape).astype(np.int32) << low
                c.coefficients[mine, first : last + 1] = band + np.where(band > 0, step, -step)
                r.at += band.size
                at += run
                continue
            rows, columns = np.nonzero(band)
            step = r.bits[r.at : r.at + len(rows)].astype(np.int32) * bit
            band[rows, columns] += np.where(band[rows, columns] > 0, step, -step)
            c.coefficients[mine, first : last + 1] = band
            r.at += len(rows)
            at += run
        return

    def correct(row: np.ndarray, k: int) -> None:
        if r.number(1):
            row[k] += bit if row[k] > 0 else -bit

    run = 0
    for b in blocks.tolist():
        row, k = c.coefficients[b], first
        if not run:
            while k <= last:
                s = table.read(r)
                zeros, size = s >> 4, s & 15
                new = 0
                if size:
                    new = bit if r.number(1) else -bit
                elif zeros < 15:
                    run = (1 << zeros) + r.number(zeros)
                    break
                while k <= last:
                    if row[k]:
                        correct(row, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    row[k] = new
                k += 1
        if run:
            for j in range(k, last + 1):
                if row[j]:
                    correct(row, j)
            run -= 1


def decode(data: bytes) -> Image:
    """Coefficients of a progressive JPEG, gathered from its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, ids, at, comment = None, {}, {}, 2, b""
    quants: dict[int, np.ndarray] = {}
    while data[at] == 0xFF and data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    quants[body[0] & 15], body = np.frombuffer(body[1:129], ">u2").astype(np.int32), body[129:]
                else:
                    quants[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int32), body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xC2:
            parts = [Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            image = Image(int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), parts, quants)
            ids = {body[6 + 3 * k]: parts[k] for k in range(body[5])}
            _planes(image)
        elif marker == 0xDA:
            n = body[0]
            parts = [ids[body[1 + 2 * k]] for k in range(n)]
            names = [body[2 + 2 * k] for k in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = data.find(b"\xff", at)
            while data[end + 1] == 0:
                end = data.find(b"\xff", end + 2)
            scan, at = data[at:end], end
            if first == 0:
                _dc(image, parts, [tables.get(x >> 4) for x in names], scan, high, low)
            else:
                c, blocks = _order(image, parts)[0]
                step = _ac_refine if high else _ac_first
                step(c, blocks, tables[16 | names[0] & 15], scan, first, last, low)
        elif marker in (0xC0, 0xC1, 0xC3, 0xDD) or 0xC5 <= marker <= 0xCF:
            raise ValueError("only progressive JPEG without restarts is read")
    image.comment = comment
    return image


def samples(image: Image, c: Component) -> np.ndarray:
    """A plane of 8-bit samples: coefficients times steps, inverse transform, level shift."""
    values = (c.coefficients * image.quants[c.quant][None]).astype(np.float64) @ _BASIS
    level = ((values.astype(np.int64) + _SCALE // 2) >> 12) + 128
    rows = len(c.coefficients) // c.whole_across
    plane = np.clip(level, 0, 255).reshape(rows, c.whole_across, 8, 8).transpose(0, 2, 1, 3)
    return plane.reshape(rows * 8, c.whole_across * 8).astype(np.uint8)


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3 tensor of full resolution: chroma repeated, then turned into red, green and blue."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        plane = samples(image, c).astype(np.int32)
        plane = plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1) if (c.h, c.v) != (most_h, most_v) else plane
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, plane in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, k] = np.clip((plane + half) >> 16, 0, 255)
    return out


# ---- storing bytes


#: Codes of four bits each for the sizes of differences, and for the lengths of runs.
_DC_TABLE = Huffman(bytes([0, 0, 0, 12, *[0] * 12]), bytes(range(12)))
_RUN_TABLE = Huffman(bytes([0, 0, 0, 15, *[0] * 12]), bytes(n << 4 for n in range(15)))
#: The one code of a first AC scan: a value of size 7 that follows at once.
_AC_TABLE = Huffman(bytes([1, *[0] * 15]), bytes([7]))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, t: Huffman) -> bytes:
    return bytes([kind]) + t.counts + t.symbols


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    names = b"".join(bytes([i, t]) for i, t in parts)
    return _segment(0xDA, bytes([len(parts)]) + names + bytes([first, last, high << 4 | low])) + data


def store(payload: bytes) -> bytes:
    """One payload as store_all() does it."""
    return store_all([payload])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """4:2:0 progressive JPEGs whose quantised coefficients are the bytes, 64 to a block, in zigzag order.

    Byte b is kept as b - 255 below 128 and as b from 128 on: all 256 values of size 8, none of them zero. DC
    and AC come without their last bit first, and with it in refinement scans; each plane's AC comes in
    two bands. A comment has the payload's length, as the last unit of six blocks may not be full. What is
    the same for all payloads is computed for all at once.
    """
    if any(len(p) % 64 for p in payloads):
        raise ValueError("a payload is not a multiple of 64 bytes")
    units = [max(1, -(-len(p) // 384)) for p in payloads]
    across = [-(-n // 4095) for n in units]
    down = [-(-n // a) for n, a in zip(units, across, strict=True)]
    cuts = np.r_[0, np.cumsum([a * d for a, d in zip(across, down, strict=True)])]
    flat = np.zeros((int(cuts[-1]), 384), np.uint8)
    for p, at in zip(payloads, cuts.tolist(), strict=False):
        flat[at:].reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8)
    b = flat.reshape(-1, 6, 64)
    coded, low = _COARSE[b], _LOW[b]
    coarse = _VALUES[b[:, :, 0]] >> 1
    previous = np.zeros_like(coarse)
    previous[:, 1:4], previous[1:, 0], previous[1:, 4:] = coarse[:, 0:3], coarse[:-1, 3], coarse[:-1, 4:]
    previous[cuts[:-1], 0] = 0
    previous[cuts[:-1], 4:] = 0
    size, extra = magnitude((coarse - previous).ravel())
    widths = 4 + size
    bits = number_bits((size << size) | extra, widths)  # codes of the sizes are the sizes, in four bits
    ends = np.r_[0, np.cumsum(widths)][cuts * 6]
    dc_low = _LOW_DC[b[:, :, 0]]
    out = []
    for i, p in enumerate(payloads):
        x, y, a, d = int(cuts[i]), int(cuts[i + 1]), across[i], down[i]
        frame = bytes([8]) + (16 * d).to_bytes(2, "big") + (16 * a).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(p)), _QUANTS, _segment(0xC2, frame), _TABLES]
        parts.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, bits_to_bytes(bits[ends[i] : ends[i + 1]])))
        planes = [_planes_of(v[x:y], a, d) for v in (coded, low)]
        for k, plane in enumerate(planes[0], 1):
            for first, last in ((1, 5), (6, 63)):
                parts.append(_scan([(k, 0)], first, last, 0, 1, plane[:, first : last + 1].tobytes()))
        parts.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, bits_to_bytes(dc_low[x:y].ravel())))
        for k, plane in enumerate(planes[1], 1):
            pieces, at = [], 0
            while at < len(plane):
                r = min((len(plane) - at).bit_length() - 1, 14)
                run = min(len(plane) - at, (2 << r) - 1)
                pieces += [_run_bits(r, run), plane[at : at + run, 1:].ravel()]
                at += run
            parts.append(_scan([(k, 1)], 1, 63, 1, 0, bits_to_bytes(np.concatenate(pieces))))
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _planes_of(blocks: np.ndarray, across: int, down: int) -> list[np.ndarray]:
    """Luma, blue and red blocks of the units, each row by row."""
    grid = blocks.reshape(down, across, 6, 64)
    luma = grid[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [luma, grid[:, :, 4].reshape(-1, 64), grid[:, :, 5].reshape(-1, 64)]


@functools.lru_cache(4096)
def _run_bits(r: int, run: int) -> np.ndarray:
    return number_bits(np.array([r, run - (1 << r)]), np.array([4, r]))


_BYTES = np.arange(256, dtype=np.int32)
#: The coefficient of each byte, its half as a first AC scan codes it, and its last bit in AC and DC.
_VALUES = np.where(_BYTES < 128, _BYTES - 255, _BYTES).astype(np.int32)
_COARSE = np.where(_BYTES < 128, (abs(_VALUES) >> 1) ^ 0x7F, _VALUES >> 1).astype(np.uint8)
_LOW, _LOW_DC = (abs(_VALUES) & 1).astype(np.uint8), (_VALUES & 1).astype(np.uint8)
_QUANTS = _segment(0xDB, bytes([0]) + bytes([1] * 64))
_TABLES = _segment(0xC4, _table(0x00, _DC_TABLE) + _table(0x10, _AC_TABLE) + _table(0x11, _RUN_TABLE))


def payload(image: Image) -> bytes:
    """The bytes that store() put in the coefficients."""
    luma, cb, cr = (c.coefficients for c in image.components)
    across = image.components[0].whole_across // 2
    down = len(cb) // across
    grid = np.empty((down, across, 6, 64), np.int32)
    grid[:, :, :4] = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    grid[:, :, 4], grid[:, :, 5] = cb.reshape(down, across, 64), cr.reshape(down, across, 64)
    n = int(image.comment.removeprefix(b"payload="))
    values = grid.reshape(-1)[:n]
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()
