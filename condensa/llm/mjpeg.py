"""Baseline JPEG in numpy, many frames at once.

Entropy decoding keeps a bit position for each frame (or restart segment) and steps all of
them by one Huffman symbol at a time, so that its cost for a symbol is a few array
operations shared by thousands of frames. Grey and YCbCr with any whole sampling factors.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Blocks decoded at a time; a frame with more is decoded by itself.
MAX_BLOCKS = 60_000

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

_DC_Y = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_C = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC_Y = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
_AC_C = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")
    ),
)
#: Motion JPEG leaves its Huffman tables out; these are then meant. By (class, number).
STANDARD = {(0, 0): _DC_Y, (1, 0): _AC_Y, (0, 1): _DC_C, (1, 1): _AC_C}


def _codes(table: tuple[bytes, bytes]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length)"""
    code, at = 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            yield table[1][at], code, length
            code, at = code + 1, at + 1
        code <<= 1


@lru_cache(64)
def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """length << 8 | symbol for any next 16 bits; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in _codes(table):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


@lru_cache(64)
def _steps(table: tuple[bytes, bytes], dc: bool) -> np.ndarray:
    """value << 16 | step << 9 | zeros before it << 5 | length of code and value, for any next 16 bits; length 0 where they don't hold both."""
    bits = np.arange(1 << 16)
    code = _lookup(table).astype(np.int64)
    length, size, zeros = code >> 8, code & 15, 0 if dc else code >> 4 & 15
    step = np.where(dc, 1, np.where(size > 0, zeros + 1, np.where(zeros == 15, 16, 64)))
    fits = (code > 0) & (length + size <= 16)
    v = _signed(bits >> np.maximum(16 - length - size, 0) & (1 << size) - 1, size)
    return np.where(fits, v << 16 | length + size, 0).astype(np.int32) | (step << 9 | zeros << 5).astype(np.int32)


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values from their bits."""
    return np.where((size > 0) & (v < (1 << size) >> 1), v - (1 << size) + 1, v)


@dataclass(frozen=True)
class Header:
    """What a frame says before its scan. Frames with equal ones are decoded together."""

    width: int
    height: int
    parts: tuple[tuple[int, int, tuple[int, ...], tuple, tuple], ...]  # for each component h, v, quantisers, DC and AC table
    restart: int


@lru_cache(256)
def parse_header(head: bytes) -> Header:
    """head: a JPEG from its first byte to the end of its scan header."""
    at, quant, huff, restart, frame = 2, {}, dict(STANDARD), 0, None
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            raise ValueError("no marker")
        kind, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 64 * (1 + wide)
                quant[body[0] & 15] = tuple(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + size]))
                body = body[1 + size :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits")
            frame = (*struct.unpack(">HH", body[1:5]), [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])])
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            if frame is None or body[0] != len(frame[2]) or not frame[0] or not frame[1]:
                raise ValueError("not one scan of all components")
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            one = len(frame[2]) == 1
            parts = tuple((1 if one else h, 1 if one else v, quant[q], huff[0, tables[c] >> 4], huff[1, tables[c] & 15]) for c, h, v, q in frame[2])
            return Header(frame[1], frame[0], parts, restart)
    raise ValueError("no scan")


def split_frame(jpeg: bytes, guess: bytes = b"") -> tuple[bytes, bytes]:
    """(header, entropy-coded data). guess: another frame's header, tried first."""
    if guess and jpeg.startswith(guess):
        return guess, jpeg[len(guess) :]
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(jpeg):
        kind, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        at += 2 + n
        if kind == 0xDA:
            return jpeg[:at], jpeg[at:]
    raise ValueError("no scan")


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)], np.float32)


def _segments(data: bytes) -> list[bytes]:
    """The scan without stuffed zeros, cut at restart marks, up to whatever other mark ends it."""
    if b"\xff" not in data:
        return [data]
    if data.endswith(b"\xff\xd9") and data.count(b"\xff") == data.count(b"\xff\x00") + 1:
        return [data[:-2].replace(b"\xff\x00", b"\xff")]
    out, held, at = [], [], 0
    while (k := data.find(b"\xff", at)) >= 0 and k + 1 < len(data):
        mark = data[k + 1]
        held.append(data[at : k + 1] if mark == 0 else data[at:k])
        at = k + (1 if mark == 0xFF else 2)
        if 0xD0 <= mark <= 0xD7:
            out.append(b"".join(held))
            held = []
        elif mark not in (0, 0xFF):
            return [*out, b"".join(held)]
    return [*out, b"".join([*held, data[at:]])]


def _coefficients(head: Header, scans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (frames, units, blocks of a unit, 64) in zigzag order, DC added up; and which frames are whole."""
    kinds = [c for c, p in enumerate(head.parts) for _ in range(p[0] * p[1])]
    hm, vm = max(p[0] for p in head.parts), max(p[1] for p in head.parts)
    units = -(-head.width // (8 * hm)) * -(-head.height // (8 * vm))
    per, step = len(kinds), head.restart or units
    lookup = np.concatenate([_lookup(t) for p in head.parts for t in p[3:5]])
    steps = np.concatenate([_steps(t, i == 0) for p in head.parts for i, t in enumerate(p[3:5])])
    first, stop, start, datas, base = [], [], [], [], 0
    good = np.ones(len(scans), bool)
    for f, scan in enumerate(scans):
        own = _segments(scan)
        if len(own) < -(-units // step):
            good[f] = False
        for s, data in enumerate(own[: -(-units // step)]):
            first.append((f * units + s * step) * per)
            stop.append((f * units + min(units, (s + 1) * step)) * per)
            start.append(base * 8)
            datas.append(data + b"\xff" * 8)
            base += len(data) + 8
    raw = np.frombuffer(b"".join(datas) + b"\0" * 4, np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    limit = np.append(start[1:], base * 8).astype(np.int64) - 64 + 8
    out = np.zeros(len(scans) * units * per * 64, np.int32)
    pos, at, stop = np.array(start, np.int64), np.array(first, np.int64) * 64, np.array(stop, np.int64) * 64
    part = np.array(kinds, np.int64) << 17
    while len(pos):
        key = window[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF
        key += ((at & 63) > 0).astype(np.int64) << 16
        if per > 1:
            key += part[(at >> 6) % per]
        told = steps[key]
        length, v, put = told & 31, told >> 16, at + (told >> 5 & 15)
        then = np.minimum(at + (told >> 9 & 127), (at | 63) + 1)
        long = np.flatnonzero(length == 0)
        if len(long):
            code = lookup[key[long]].astype(np.int64)
            size, after = code & 15, pos[long] + (code >> 8)
            v[long] = _signed((window[after >> 3] >> (16 - (after & 7)) & 0xFFFF) >> (16 - size), size)
            length[long] = (code >> 8) + size
            put[long[code == 0]] += 64  # no code: beyond its block
        pos = pos + length
        broken = (pos > limit) | ((put ^ at) > 63)
        if broken.any():
            good[at[broken] // (units * per * 64)] = False
            go = ~broken
            pos, put, v, then, stop, limit = pos[go], put[go], v[go], then[go], stop[go], limit[go]
        out[put] = v  # where there is no value, 0 on what is 0
        at = then
        go = at < stop
        if not go.all():
            pos, at, stop, limit = pos[go], at[go], stop[go], limit[go]
    out = out.reshape(len(scans), units, per, 64)
    for c in range(len(head.parts)):
        own = [i for i, x in enumerate(kinds) if x == c]
        d = out[:, :, own, 0]
        for a in range(0, units, step):
            part_d = d[:, a : a + step]
            d[:, a : a + step] = np.cumsum(part_d.reshape(len(scans), -1), 1).reshape(part_d.shape)
        out[:, :, own, 0] = d
    return out, good


def _planes(head: Header, coefficients: np.ndarray, components: int) -> list[np.ndarray]:
    hm, vm = max(p[0] for p in head.parts), max(p[1] for p in head.parts)
    across, down, n = -(-head.width // (8 * hm)), -(-head.height // (8 * vm)), len(coefficients)
    out, at = [], 0
    natural = np.argsort(ZIGZAG)
    for h, v, quant, _, _ in head.parts[:components]:
        blocks = (coefficients[:, :, at : at + h * v] * np.array(quant, np.int32)).reshape(-1, 64)[:, natural].astype(np.float32)
        at += h * v
        blocks = (blocks.reshape(-1, 8) @ _COS.T).reshape(-1, 8, 8).transpose(0, 2, 1)  # rows, then columns
        blocks = (np.ascontiguousarray(blocks).reshape(-1, 8) @ _COS.T).reshape(-1, 8, 8).transpose(0, 2, 1)
        pixels = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8)
        out.append(pixels.reshape(n, down, across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, down * v * 8, across * h * 8))
    return out


def decode_planes(frames: list[bytes], *, components: int = 1) -> Iterator[tuple[list[int], list[np.ndarray], np.ndarray, Header]]:
    """(places of frames, their planes, which are whole, header), for frames of one header at a time.

    Planes are as large as whole units of the sampling. What is no baseline JPEG isn't given.
    """
    by: dict[bytes, tuple[list[int], list[bytes]]] = defaultdict(lambda: ([], []))
    guess = b""
    for i, jpeg in enumerate(frames):
        try:
            guess, scan = split_frame(jpeg, guess)
        except (ValueError, IndexError, struct.error):
            continue
        by[guess][0].append(i)
        by[guess][1].append(scan)
    for raw, (places, scans) in by.items():
        try:
            head = parse_header(raw)
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        blocks = -(-head.width // 8) * -(-head.height // 8) * 2
        size = max(1, MAX_BLOCKS // blocks)
        for a in range(0, len(scans), size):
            coefficients, good = _coefficients(head, scans[a : a + size])
            yield places[a : a + size], _planes(head, coefficients, components), good, head


def decode_jpeg(jpeg: bytes) -> np.ndarray | None:
    """(height, width) grey or (height, width, 3) RGB; None if it is no whole baseline JPEG."""
    for _, planes, good, head in decode_planes([jpeg], components=3):
        if not good[0]:
            return None
        hm, vm = max(p[0] for p in head.parts), max(p[1] for p in head.parts)
        full = [p[0].repeat(vm // v, 0).repeat(hm // h, 1)[: head.height, : head.width].astype(np.float32) for p, (h, v, *_) in zip(planes, head.parts)]
        if len(full) == 1:
            return full[0].astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255).astype(np.uint8)
    return None


#: Standard AC codes of 16 zeros, of 11 bits, and of a block's end, of 4.
_ZEROS, _END = 0x7F9, 0xA


@lru_cache(1)
def _tokens() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code and value of a difference of DC (by 2048 + v), their length, and the same for AC by zeros before it << 11 | 1024 + v."""
    out = []
    for table, runs, most in ((_DC_Y, 1, 2048), (_AC_Y, 16, 1024)):
        codes = {symbol: (code, length) for symbol, code, length in _codes(table)}
        token, bits = np.zeros((runs, 2 * most), np.uint64), np.zeros((runs, 2 * most), np.uint8)
        v = np.arange(-most, most)
        size = np.frexp(np.abs(v))[1]
        for symbol, (code, length) in codes.items():
            own, run = size == (symbol & 15), symbol >> 4
            token[run, own] = (code << size | np.where(v < 0, v + (1 << size) - 1, v))[own]
            bits[run, own] = (length + size)[own]
        out += [token.ravel(), bits.ravel()]
    return tuple(out)


def encode_grey(frames: np.ndarray, *, quantiser: int = 8, tables: bool = False) -> list[bytes]:
    """Baseline grey JPEGs of (n, height, width) pixels, both multiples of 8; without Huffman tables unless asked for."""
    n, height, width = frames.shape
    if not n:
        return []
    pixels = frames.reshape(n, height // 8, 8, width // 8, 8).transpose(0, 1, 3, 4, 2).astype(np.float32) - 128
    blocks = (pixels.reshape(-1, 8) @ _COS).reshape(-1, 8, 8).transpose(0, 2, 1)  # columns, then rows
    blocks = (np.ascontiguousarray(blocks).reshape(-1, 8) @ _COS).reshape(-1, 64)
    z = np.rint(blocks / quantiser).astype(np.int16)[:, ZIGZAG]
    per = len(z) // n
    dc = np.diff(z[:, 0].reshape(n, per), axis=1, prepend=0).ravel()
    # A token is what stands for a coefficient: runs of 16 zeros before it, its code, its value, and the end of its block.
    there = z != 0
    there[:, 0] = True
    at = np.flatnonzero(there)
    first = np.cumsum(there.sum(1))
    first = np.append(0, first)
    zeros = np.diff(at, prepend=0) - 1
    v = z.ravel()[at].astype(np.int64)
    zeros[first[:-1]] = v[first[:-1]] = 0
    dc_token, dc_bits, ac_token, ac_bits = _tokens()
    key = (zeros & 15) << 11 | v + 1024
    token, bits = ac_token[key], ac_bits[key]
    token[first[:-1]], bits[first[:-1]] = dc_token[dc + 2048], dc_bits[dc + 2048]
    long = np.flatnonzero(zeros > 15)
    if len(long):
        times = zeros[long] >> 4
        token[long] |= np.array([0, _ZEROS, _ZEROS << 11 | _ZEROS, _ZEROS << 22 | _ZEROS << 11 | _ZEROS], np.uint64)[times] << bits[long]
        bits[long] += (11 * times).astype(np.uint8)
    short = first[1:][z[:, 63] == 0] - 1
    token[short] = token[short] << np.uint64(4) | np.uint64(_END)
    bits[short] += np.uint8(4)
    # Tokens have 63 bits at most, so each lies in one or two words of 64.
    ends = np.cumsum(bits, dtype=np.int64)
    length = np.diff(ends[first[per::per] - 1], prepend=0)
    pad = -length % 8
    stops = np.cumsum(length + pad)
    begin = ends - bits + np.repeat(np.cumsum(pad) - pad, np.diff(first[::per]))
    word, shift = begin >> 6, (begin & 63).astype(np.uint8)
    token <<= 64 - bits
    packed = np.zeros(int(stops[-1]) // 64 + 2, np.uint64)
    head_of = np.flatnonzero(np.diff(word, prepend=-1))
    packed[word[head_of]] = np.bitwise_or.reduceat(token >> shift, head_of)
    over = np.flatnonzero(shift + bits > 64)
    packed[word[over] + 1] |= token[over] << (64 - shift[over])
    flat = packed.byteswap().view(np.uint8)
    stops >>= 3
    flat[stops - 1] |= ((1 << pad) - 1).astype(np.uint8)  # frames are filled up with ones
    flat = flat.tobytes()
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([quantiser]) * 64 + struct.pack(">2sHBHHB3B", b"\xff\xc0", 11, 8, height, width, 1, 1, 0x11, 0)
    if tables:
        for kind, table in ((0, _DC_Y), (0x10, _AC_Y)):
            head += b"\xff\xc4" + struct.pack(">HB", 3 + 16 + len(table[1]), kind) + table[0] + table[1]
    head += b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    return [head + flat[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip([0, *stops.tolist()], stops.tolist())]
