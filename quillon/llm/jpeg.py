"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, which give RGB tensors.

The decoder reads any Huffman-coded progressive frame of 8-bit samples: spectral selection, successive
approximation, interleaved DC scans, restart intervals, any sampling factors. Scans whose tables
have a single code of one bit have symbols at fixed places when every coefficient has the same
size; those are read as whole arrays, others bit by bit. The encoder writes frames of that kind
only: it stores bytes, losslessly, as quantised coefficients.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of ITU-T T.81: natural position of each zigzag index.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _cosines() -> np.ndarray:
    """64 x 64: natural-order coefficients of a block to its samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) / 2 * np.where(k == 0, np.sqrt(0.5), 1)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64).astype(np.float32)


COSINES = _cosines()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  #: blocks that hold samples
    high: int = 0
    full_wide: int = 0  #: blocks with padding to whole MCUs
    full_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.empty((0, 64), np.int32))  #: zigzag order


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def get(self, n: int) -> int:
        while self.left < n:
            self.value = (self.value << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.left += 8
        self.left -= n
        out = (self.value >> self.left) & ((1 << n) - 1)
        self.value &= (1 << self.left) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = (code << 1) | self.get(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("bad Huffman code")


def _signed(v: int, n: int) -> int:
    return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _intervals(data: bytes, restart: int, units: int) -> list[bytes]:
    """Entropy-coded bytes of each restart interval, unstuffed."""
    if not restart:
        return [data.replace(b"\xff\x00", b"\xff")]
    raw = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) else []
    edges = [0, *(c for i in cuts for c in (i, i + 2)), len(data)]
    return [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges[::2], edges[1::2])]


def _blocks_of(c: Component) -> np.ndarray:
    """Indices of the blocks of a scan with one component."""
    return (np.arange(c.high)[:, None] * c.full_wide + np.arange(c.wide)).ravel()


def _fast(kind: str, scan: list[Component], codes: dict, size: int, data: bytes, restart: int, ss: int, se: int, al: int) -> bool:
    """Reads a scan with fixed places into the coefficients, if it is one."""
    if len(scan) > 1:
        return False
    c, n = scan[0], se - ss + 1
    at = slice(None) if c.wide == c.full_wide else _blocks_of(c)
    blocks = c.wide * c.high
    if kind == "dc" and restart == 1 and list(codes) == [(1, 0)]:  # a code bit, size bits, filler, marker
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff\xd0", np.uint8)
        stride = (1 + size + 7) // 8 + 2
        if len(raw) != blocks * stride or size > 15 or stride != 4:
            return False
        raw = raw.reshape(blocks, 4)
        if (raw[:, 2] != 0xFF).any():
            return False
        word = (raw[:, 0].astype(np.int32) << 8 | raw[:, 1]) >> (15 - size)
        value = word & ((1 << size) - 1)
        c.coefficients[at, 0] = np.where(value >> (size - 1), value, value - (1 << size) + 1) << al
        return True
    if kind == "ac" and not restart and list(codes) == [(1, 0)] and codes[1, 0] >> 4 == 0 and size == 7:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)  # a code bit and seven of value
        if len(raw) != blocks * n:
            return False
        value = raw.reshape(blocks, n).astype(np.int32) & 127
        c.coefficients[at, ss : se + 1] = np.where(value >> 6, value, value - 127) << al
        return True
    if kind == "ac+" and not restart and list(codes) == [(1, 0)] and codes[1, 0] == 0 and n == 63:
        own = c.coefficients[at, 1:]
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)  # end of block, then a bit for each of 63
        if len(raw) != blocks * 8 or not own.all():
            return False
        bits = np.unpackbits(raw).reshape(blocks, 64)[:, 1:].astype(np.int32)
        c.coefficients[at, 1:] = own + np.sign(own) * (bits << al)
        return True
    if kind == "dc+" and not restart:
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8), count=blocks).astype(np.int32)
        c.coefficients[at, 0] |= bits << al
        return True
    return False


def _slow(kind: str, frame: Frame, scan: list[Component], dc: list[dict], ac: dict, data: bytes, restart: int, ss: int, se: int, al: int) -> None:
    """Reads any progressive scan, bit by bit."""
    if len(scan) == 1:
        units = [[(scan[0], int(i), 0)] for i in _blocks_of(scan[0])]
    else:
        wide = scan[0].full_wide // scan[0].h
        high = scan[0].full_high // scan[0].v
        units = [
            [(c, (r * c.v + y) * c.full_wide + q * c.h + x, k) for k, c in enumerate(scan) for y in range(c.v) for x in range(c.h)]
            for r in range(high)
            for q in range(wide)
        ]
    parts = _intervals(data, restart, len(units))
    for part, first in zip(parts, range(0, len(units), restart or len(units))):
        bits, last, run = _Bits(part), [0] * len(scan), 0
        for unit in units[first : first + (restart or len(units))]:
            for c, i, k in unit:
                row = c.coefficients[i]
                if kind == "dc":
                    n = bits.symbol(dc[k])
                    last[k] += _signed(bits.get(n), n)
                    row[0] = last[k] << al
                elif kind == "dc+":
                    row[0] |= bits.get(1) << al
                elif kind == "ac":
                    if run:
                        run -= 1
                        continue
                    z = ss
                    while z <= se:
                        r, n = divmod(bits.symbol(ac), 16)
                        if n:
                            z += r
                            row[z] = _signed(bits.get(n), n) << al
                            z += 1
                        elif r == 15:
                            z += 16
                        else:
                            run = (1 << r) + bits.get(r) - 1
                            break
                else:
                    z = ss
                    while z <= se and not run:
                        r, n = divmod(bits.symbol(ac), 16)
                        if n == 0 and r < 15:
                            run = (1 << r) + bits.get(r)
                            break
                        new = 0 if n == 0 else (1 << al) * (1 if bits.get(1) else -1)
                        while z <= se:
                            if row[z]:
                                if bits.get(1):
                                    row[z] += (1 << al) * (1 if row[z] > 0 else -1)
                            elif r == 0:
                                row[z] = new
                                z += 1
                                break
                            else:
                                r -= 1
                            z += 1
                    if run:
                        for z in range(z, se + 1):
                            if row[z] and bits.get(1):
                                row[z] += (1 << al) * (1 if row[z] > 0 else -1)
                        run -= 1


def decode(data: bytes, max_pixels: int | None = None) -> Frame:
    """The coefficients of a progressive JPEG. Broken files raise errors of several kinds; so does a frame of more than max_pixels."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, restart, frame = 2, {}, {}, 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, ident = body[i] >> 4, body[i] & 15
                quant[ident] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int32)
                i += 65 + 64 * wide
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = _codes(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xC2:
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("8-bit samples only")
            if frame is not None or not (high and wide and n in (1, 3)) or len(body) != 6 + 3 * n:
                raise ValueError("one frame of one or three components")
            if max_pixels is not None and high * wide > max_pixels:
                raise ValueError(f"{wide} x {high} pixels are more than {max_pixels}")
            frame = Frame(wide, high, [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)], quant)
            hm, vm = max(c.h for c in frame.components), max(c.v for c in frame.components)
            if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 or hm % c.h or vm % c.v for c in frame.components):
                raise ValueError("sampling factors")
            for c in frame.components:
                c.wide, c.high = -(-(-(-wide * c.h // hm)) // 8), -(-(-(-high * c.v // vm)) // 8)
                c.full_wide, c.full_high = -(-wide // (8 * hm)) * c.h, -(-high // (8 * vm)) * c.v
                c.coefficients = np.zeros((c.full_wide * c.full_high, 64), np.int32)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE and frame is not None:
            frame.comment += body
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
            raise ValueError("progressive frames only")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            n = body[0]
            by = {c.ident: c for c in frame.components}
            scan = [by[body[1 + 2 * i]] for i in range(n)]
            ids = [body[2 + 2 * i] for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            end = at
            while True:  # to the next marker that isn't a restart or stuffing
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            coded, at = data[at:end], end
            al, refine = approx & 15, approx >> 4 > 0
            kind = ("ac" if ss else "dc") + "+" * refine
            dc = [tables.get(i >> 4, {}) for i in ids]
            ac = tables.get(16 + (ids[0] & 15), {})
            codes = ac if ss else dc[0]
            one = next(iter(codes.values()), 0)
            if not _fast(kind, scan, codes, one & 15, coded, restart, ss, se, al):
                _slow(kind, frame, scan, dc, ac, coded, restart, ss, se, al)
    if frame is None:
        raise ValueError("no frame")
    return frame


def plane(frame: Frame, c: Component) -> np.ndarray:
    """Samples of a component, level-shifted, as float32."""
    q = frame.quant[c.table][None, :]
    natural = np.empty((len(c.coefficients), 64), np.float32)
    natural[:, ZIGZAG] = c.coefficients * q
    samples = natural @ COSINES + np.float32(128)
    return samples.reshape(c.full_high, c.full_wide, 8, 8).swapaxes(1, 2).reshape(c.full_high * 8, c.full_wide * 8)


def rgb(frame: Frame) -> np.ndarray:
    """Height x width x 3, uint8, at full resolution: chroma is upsampled by repetition."""
    hm, vm = max(c.h for c in frame.components), max(c.v for c in frame.components)
    full = [plane(frame, c).repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: frame.height, : frame.width] for c in frame.components]
    if len(full) == 1:
        full *= 3
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        full = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(full, -1)), 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(table: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([table, 1, *[0] * 15, symbol]))


def _scan(ident: int, ss: int, se: int, ah: int, al: int, coded: bytes) -> bytes:
    return _segment(0xDA, bytes([1, ident, 0, ss, se, ah << 4 | al])) + coded


#: Blocks of luma, blue and red in an MCU.
SHARES = (4, 1, 1)


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are 256 + each byte of the payload, 64 bytes a block.

    Bytes fill luma blocks first, then blue and red ones; zeros fill the last MCUs; a comment holds the
    payload's size. The frame has a first scan of DC and of two AC bands, and refinements of both.
    """
    if not payload or len(payload) % 64:
        raise ValueError("the payload's size must be a positive multiple of 64")
    mcus = -(-len(payload) // 384)
    wide = min(mcus, max(64, -(-mcus // 4095)))
    high = -(-mcus // wide)
    mcus = wide * high
    padded = np.zeros(mcus * 384, np.uint8)
    padded[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = padded.reshape(-1, 64)
    out = [b"\xff\xd8", _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xFE, b"payload " + str(len(payload)).encode()))
    parts = np.split(blocks, np.cumsum([mcus * s for s in SHARES])[:-1])
    out += [_segment(0xDD, b"\x00\x01"), _one_code(0x00, 8)]
    for k, part in enumerate(parts, 1):  # DC, all but the last bit: 0, 1, seven bits, filler, restart marker
        dc = np.empty((len(part), 4), np.uint8)
        v = part[:, 0] >> 1
        dc[:, 0], dc[:, 1] = 64 | v >> 1, (v & 1) << 7 | 127
        dc[:, 2], dc[:, 3] = 0xFF, 0xD0 + np.arange(len(part)) % 8
        coded = dc.tobytes()[:-2] if not (dc[:, 1] == 0xFF).any() else _stuffed_dc(dc)
        out.append(_scan(k, 0, 0, 0, 1, coded))
    out += [_segment(0xDD, b"\x00\x00"), _one_code(0x10, 7)]
    for ss, se in ((1, 5), (6, 63)):  # AC, all but the last two bits: 0, 1, six bits
        out += [_scan(k, ss, se, 0, 2, (64 | part[:, ss : se + 1] >> 2).tobytes()) for k, part in enumerate(parts, 1)]
    out.append(_one_code(0x10, 0))
    for al in (1, 0):  # AC, one more bit each: end of block, then 63 bits
        for k, part in enumerate(parts, 1):
            bits = (part >> al) & 1
            bits[:, 0] = 0
            out.append(_scan(k, 1, 63, al + 1, al, np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")))
    for k, part in enumerate(parts, 1):
        bits = np.packbits(part[:, 0] & 1)
        if len(part) % 8:
            bits[-1] |= (1 << (8 - len(part) % 8)) - 1
        out.append(_scan(k, 0, 0, 1, 0, bits.tobytes().replace(b"\xff", b"\xff\x00")))
    return b"".join([*out, b"\xff\xd9"])


def _stuffed_dc(dc: np.ndarray) -> bytes:
    """DC blocks with a zero after each data byte of 255."""
    wide = np.empty((len(dc), 5), np.uint8)
    wide[:, :2], wide[:, 2], wide[:, 3:] = dc[:, :2], 0, dc[:, 2:]
    keep = np.ones(wide.shape, bool)
    keep[:, 2] = dc[:, 1] == 0xFF
    return wide[keep].tobytes()[:-2]


def payload_of(frame: Frame) -> bytes:
    """The bytes that store() put into a frame."""
    size = int(frame.comment.removeprefix(b"payload "))
    values = np.concatenate([c.coefficients for c in frame.components])
    return (values - 256).astype(np.uint8).tobytes()[:size]
