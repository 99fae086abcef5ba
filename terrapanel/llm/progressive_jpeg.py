"""Progressive JPEG: entropy coding, coefficient arrays, inverse transform and RGB tensors in numpy.

Many images are processed together.  Scans of a progressive file add bands of
frequencies (spectral selection) and lower bits (successive approximation) to
arrays of coefficients.  Restart intervals are independent; the decoder steps
through all intervals of all images side by side, one Huffman symbol of each at
a time.  Scans that touch different coefficients are decoded in the same steps.

Huffman-coded progressive files of one or three components with 8-bit samples,
any sampling factors and any scan script are read.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
RESTART = 8  # MCUs of a restart interval that the encoder writes
INTERLEAVED = -1

#: Scans that the encoder writes: component or INTERLEAVED, first and last frequency, high and low bit.
SCRIPT = (
    (INTERLEAVED, 0, 0, 0, 1),
    *((c, 1, 5, 0, 1) for c in range(3)),
    *((c, 6, 63, 0, 1) for c in range(3)),
    (INTERLEAVED, 0, 0, 1, 0),
    *((c, 1, 63, 1, 0) for c in range(3)),
)


@dataclass
class Frame:
    """An image as quantised coefficients: ``blocks`` are the components' block rasters, one behind the other, in zigzag order."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]  # horizontal and vertical factor of each component
    blocks: np.ndarray
    quant: tuple[np.ndarray, ...] = ()  # of each component, in zigzag order
    comment: bytes = b""
    scans: list = field(default_factory=list)


class Geometry:
    """Where the blocks of an image of some size and sampling are."""

    def __init__(self, width: int, height: int, sampling: tuple[tuple[int, int], ...]):
        self.hmax, self.vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.columns, self.rows = -(-width // (8 * self.hmax)), -(-height // (8 * self.vmax))  # of MCUs
        self.grid = [(self.rows * v, self.columns * h) for h, v in sampling]
        self.base = np.cumsum([0, *(r * c for r, c in self.grid)])
        rows, columns = np.divmod(np.arange(self.rows * self.columns), self.columns)
        parts, component = [], []
        for c, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    parts.append(self.base[c] + (rows * v + y) * self.grid[c][1] + columns * h + x)
                    component.append(c)
        self.per_mcu = len(parts)
        self.interleaved = np.stack(parts, axis=1).reshape(-1)
        self.component = np.array(component)
        self.own = []
        for c, (h, v) in enumerate(sampling):
            shown = -(-(-(-height * v // self.vmax)) // 8), -(-(-(-width * h // self.hmax)) // 8)
            y, x = np.divmod(np.arange(shown[0] * shown[1]), shown[1])
            self.own.append(self.base[c] + y * self.grid[c][1] + x)


@functools.lru_cache(4096)
def geometry(width: int, height: int, sampling: tuple[tuple[int, int], ...]) -> Geometry:
    return Geometry(width, height, sampling)


def _canonical(counts: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each of the 256 symbols."""
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code, at = 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            codes[s], lengths[s] = code, bits
            code += 1
        at += n
        code <<= 1
    return codes, lengths


def _table(lengths: dict[int, int]) -> tuple[list[int], bytes]:
    """Counts by length and symbols, as a file has them."""
    return [sum(1 for n in lengths.values() if n == bits) for bits in range(1, 17)], bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


#: The encoder's tables.  Values of a few bits without a run are short; every symbol has a code.
DC_TABLE = _table({s: 4 for s in range(12)})
AC_TABLE = _table(
    {r << 4 | s: 13 for r in range(16) for s in range(1, 11)} | {r << 4: 13 for r in range(16)} | {s: 6 for s in (1, 2, 3, 4, 8, 9)} | {0: 3, 5: 3, 7: 3, 6: 1}
)
SIZE_OF = np.array([int(n).bit_length() for n in range(1 << 12)])


def _pack(codes: np.ndarray, lengths: np.ndarray, items: np.ndarray) -> list[bytes]:
    """Bit strings of consecutive segments with so many items, filled up with ones and stuffed."""
    ends = np.cumsum(items)
    total = np.concatenate([[0], np.cumsum(lengths)])
    bits = total[ends] - total[ends - items]
    size = (bits + 7) // 8
    base = np.cumsum(size) - size
    at = total[:-1] + np.repeat(base * 8 - total[ends - items], items)
    word = at >> 5
    value = codes.astype(np.uint64) << (64 - (at & 31) - lengths).astype(np.uint64)
    n = int(size.sum()) // 4 + 3
    packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    out = packed.astype(np.uint64).astype(">u4").view(np.uint8)
    last = (base + size - 1)[size > 0]
    out[last] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)[size > 0]
    raw = out.tobytes()
    return [raw[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(base.tolist(), size.tolist(), strict=True)]


def _dc_first(blocks: np.ndarray, firsts: np.ndarray, component: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """blocks: in MCU order; firsts: which MCUs begin a segment.  Codes, lengths and items of each MCU."""
    n = len(component)
    value = (blocks[:, 0] >> low).reshape(-1, n)
    before = np.zeros_like(value)
    for c in range(component.max() + 1):
        at = np.flatnonzero(component == c)
        before[:, at[1:]] = value[:, at[:-1]]
        before[1:, at[0]] = np.where(firsts[1:], 0, value[:-1, at[-1]])
    diff = (value - before).reshape(-1)
    codes, lengths = _canonical(*DC_TABLE)
    size = SIZE_OF[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return codes[size] << size.astype(np.uint64) | extra.astype(np.uint64), lengths[size] + size, np.full(len(value), n)


def _joined(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each two columns as one item."""
    if codes.shape[1] % 2:
        codes, lengths = np.pad(codes, ((0, 0), (0, 1))), np.pad(lengths, ((0, 0), (0, 1)))
    return codes[:, ::2] << lengths[:, 1::2].astype(np.uint64) | codes[:, 1::2], lengths[:, ::2] + lengths[:, 1::2]


@functools.cache
def _without_run() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each value, from -1023 to 1023, that follows another one."""
    codes, lengths = _canonical(*AC_TABLE)
    value = np.arange(-1023, 1024)
    size = SIZE_OF[np.abs(value)]
    extra = np.where(value < 0, (1 << size) - 1 + value, value)
    return codes[size] << size.astype(np.uint64) | extra.astype(np.uint64), lengths[size] + size


def _ac_first(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, lengths = _canonical(*AC_TABLE)
    n, width = band.shape
    size_of = np.abs(band) >> low
    filled = np.count_nonzero(size_of, axis=1)
    full = filled == width
    if (full | (filled == 0)).all():
        value = np.where(band[full] < 0, -size_of[full], size_of[full]) + 1023
        code, length = _without_run()
        code, length = _joined(code[value], length[value])
        items = np.where(full, code.shape[1], 1)
        dense = np.repeat(full, items)
        out, out_length = np.full(items.sum(), codes[0]), np.full(items.sum(), lengths[0])
        out[dense], out_length[dense] = code.reshape(-1), length.reshape(-1)
        return out, out_length, items
    row, column = np.nonzero(size_of)
    value = size_of[row, column]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.where(first, -1, np.concatenate([[0], column[:-1]]) if len(column) else column)
    run = column - before - 1
    long, run = run // 16, run % 16
    count = np.bincount(row, minlength=n)
    ends = np.cumsum(count)
    end_column = np.where(count > 0, column[np.maximum(ends - 1, 0)] if len(column) else -1, -1)
    open_row = end_column < width - 1
    items = count + np.bincount(row, long, n).astype(np.int64) + open_row
    out, out_length = np.full(items.sum(), codes[0xF0]), np.full(items.sum(), lengths[0xF0])
    closed = np.cumsum(open_row) - open_row
    at = np.arange(len(row)) + np.cumsum(long) + closed[row]
    size = SIZE_OF[value]
    symbol = run << 4 | size
    extra = np.where(band[row, column] < 0, (1 << size) - 1 - value, value)
    out[at] = codes[symbol] << size.astype(np.uint64) | extra.astype(np.uint64)
    out_length[at] = lengths[symbol] + size
    at = (np.cumsum(items) - 1)[open_row]
    out[at], out_length[at] = codes[0], lengths[0]
    return out, out_length, items


def _ac_refine(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events (a newly nonzero value, 16 zeros, the end of a block), each followed by the bits of older values that it passes."""
    codes, lengths = _canonical(*AC_TABLE)
    n, width = band.shape
    value = np.abs(band) >> low
    if not (value == 1).any():
        # No value is new: each block ends at once, and the bits of its older values follow.
        old = value > 1
        count = np.count_nonzero(old, axis=1)
        groups = -(-count // 16)
        items = groups + 1
        start = np.cumsum(items) - items
        out, out_length = np.zeros(items.sum(), np.uint64), np.full(items.sum(), 16)
        out[start], out_length[start] = codes[0], lengths[0]
        bits = np.zeros((n, -(-width // 16) * 16), bool)
        bits[np.arange(bits.shape[1]) < count[:, None]] = (value & 1)[old]
        packed = np.packbits(bits, axis=1).view(">u2")
        place = np.arange(packed.shape[1]) < groups[:, None]
        rest = np.ones(len(out), bool)
        rest[start] = False
        out[rest] = packed[place]
        some = count % 16 > 0
        at = (start + groups)[some]
        out[at] >>= (16 - count[some] % 16).astype(np.uint64)
        out_length[at] = count[some] % 16
        return out, out_length, items
    value = value.reshape(-1)
    old = np.flatnonzero(value > 1)
    new = np.flatnonzero(value == 1)
    zero = np.flatnonzero(value == 0)
    zeros_before = np.searchsorted(zero, new)
    row_start = np.searchsorted(zero, new // width * width)
    same = np.zeros(len(new), bool)
    same[1:] = new[1:] // width == new[:-1] // width
    since = np.where(same, np.concatenate([[0], zeros_before[:-1]]) if len(new) else 0, row_start)
    gap = zeros_before - since
    long = gap // 16
    of = np.repeat(np.arange(len(new)), long)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long)
    zrl = zero[since[of] + 16 * nth + 15] if len(of) else np.zeros(0, np.int64)
    open_row = np.ones(n, bool)
    open_row[new[new % width == width - 1] // width] = False
    end = np.flatnonzero(open_row) * width + width - 1
    symbol = gap % 16 << 4 | 1
    positive = (band.reshape(-1)[new] > 0).astype(np.uint64)
    key = np.concatenate([zrl * 2, new * 2, end * 2 + 1])
    head = np.concatenate([np.full(len(zrl), codes[0xF0]), codes[symbol] << np.uint64(1) | positive, np.full(len(end), codes[0])])
    head_length = np.concatenate([np.full(len(zrl), lengths[0xF0]), lengths[symbol] + 1, np.full(len(end), lengths[0])])
    order = np.argsort(key, kind="stable")
    key, head, head_length = key[order], head[order], head_length[order]
    event = np.searchsorted(key, old * 2)
    out, out_length = np.empty(len(key) + len(old), np.uint64), np.ones(len(key) + len(old), np.int64)
    at = np.arange(len(key)) + np.searchsorted(event, np.arange(len(key)))
    out[at], out_length[at] = head, head_length
    out[np.arange(len(old)) + event + 1] = value[old] & 1
    items = np.bincount(key // 2 // width, minlength=n) + np.bincount(old // width, minlength=n)
    return out, out_length, items


def _segment(kind: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data


def encode(frames: list[Frame]) -> list[bytes]:
    """Progressive files with the coefficients of the frames (of three components)."""
    if not frames:
        return []
    places = [geometry(f.width, f.height, f.sampling) for f in frames]
    base = np.cumsum([0, *(len(f.blocks) for f in frames)])
    blocks = np.concatenate([f.blocks for f in frames]).astype(np.int32)
    parts: list[list[bytes]] = []
    for f in frames:
        sof = struct.pack(">BHHB", 8, f.height, f.width, len(f.sampling)) + b"".join(bytes([c + 1, h << 4 | v, c]) for c, (h, v) in enumerate(f.sampling))
        quant = f.quant or (np.ones(64, np.int64),) * len(f.sampling)
        tables = b"".join(_segment(0xDB, bytes([c]) + bytes(np.asarray(q, np.uint8))) for c, q in enumerate(quant))
        huffman = _segment(0xC4, bytes([0x00, *DC_TABLE[0]]) + DC_TABLE[1]) + _segment(0xC4, bytes([0x10, *AC_TABLE[0]]) + AC_TABLE[1])
        comment = _segment(0xFE, f.comment) if f.comment else b""
        parts.append([b"\xff\xd8", comment, tables, _segment(0xC2, sof), huffman, _segment(0xDD, struct.pack(">H", RESTART))])
    for which, first, last, high, low in SCRIPT:
        orders = [p.interleaved if which == INTERLEAVED else p.own[which] for p in places]
        units = np.array([len(o) // (p.per_mcu if which == INTERLEAVED else 1) for o, p in zip(orders, places, strict=True)])
        segments = -(-units // RESTART)
        chosen = blocks[np.concatenate([o + b for o, b in zip(orders, base[:-1], strict=True)])]
        number = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        firsts = number % RESTART == 0
        if which == INTERLEAVED and not high:
            codes, lengths, items = _dc_first(chosen, firsts, places[0].component, low)
        elif which == INTERLEAVED:
            n = places[0].per_mcu
            codes, lengths, items = (chosen[:, 0] >> low & 1).astype(np.uint64), np.ones(len(chosen), np.int64), np.full(units.sum(), n)
        else:
            codes, lengths, items = (_ac_refine if high else _ac_first)(chosen[:, first : last + 1], low)
        packed = _pack(codes, lengths, np.add.reduceat(items, np.flatnonzero(firsts)))
        components = range(len(frames[0].sampling)) if which == INTERLEAVED else [which]
        sos = _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([first, last, high << 4 | low]))
        at = 0
        for n, (own, count) in enumerate(zip(parts, segments.tolist(), strict=True)):
            own.append(sos)
            for k in range(count):
                if k:
                    own.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
                own.append(packed[at + k])
            at += count
    return [b"".join([*own, b"\xff\xd9"]) for own in parts]


@dataclass
class Scan:
    components: list[int]
    first: int
    last: int
    high: int
    low: int
    tables: list[tuple]  # of each component: counts and symbols
    restart: int
    pieces: list[bytes]


_MARK = re.compile(rb"\xff+[^\x00\xff]")
_DATA_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S)
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> Frame:
    """The frame with empty coefficients and its scans; ValueError if this is no progressive file that is read here."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, restart, frame, ids, quant_of = 2, 0, None, {}, []
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, tuple] = {}
    comment = b""
    while at < len(data):
        found = _MARK.search(data, at)
        if not found or data[found.end() - 1] == 0xD9:
            break
        kind, at = data[found.end() - 1], found.end()
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = (tuple(counts), body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("samples or components are not supported")
            entries = [body[6 + 3 * c : 9 + 3 * c] for c in range(n)]
            ids = {e[0]: c for c, e in enumerate(entries)}
            quant_of = [e[2] for e in entries]
            sampling = tuple((e[1] >> 4, e[1] & 15) for e in entries) if n > 1 else ((1, 1),)
            frame = Frame(width, height, sampling, np.zeros((0, 64), np.int16))
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF:
            raise ValueError("not progressive with Huffman codes")
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            components = [ids[body[1 + 2 * k]] for k in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            chosen = [tables.get(body[2 + 2 * k] >> 4 if not first else 0x10 | body[2 + 2 * k] & 15) for k in range(n)]
            end = _DATA_END.search(data, at)
            stop = end.start() if end else len(data)
            pieces = [x.replace(b"\xff\x00", b"\xff") for x in (_RST.split(data[at:stop]) if restart else [data[at:stop]])]
            frame.scans.append(Scan(components, first, last, bits >> 4, bits & 15, chosen, restart, pieces))
            at = stop
    if frame is None:
        raise ValueError("no frame")
    frame.comment = comment
    frame.quant = tuple(quant.get(q, np.ones(64, np.int64)) for q in quant_of)
    return frame


class _Tables:
    """Look-up of 16 bits for all Huffman tables in use: symbol and length."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []

    def of(self, table: tuple | None) -> int:
        if table not in self.number:
            look = np.zeros(1 << 16, np.int32)
            if table:
                codes, lengths = _canonical(*table)
                for s in set(table[1]):
                    a = int(codes[s]) << (16 - int(lengths[s]))
                    look[a : a + (1 << (16 - int(lengths[s])))] = s << 8 | int(lengths[s])
            self.number[table] = len(self.rows)
            self.rows.append(look)
        return self.number[table]

    def all(self) -> np.ndarray:
        return np.concatenate(self.rows) if self.rows else np.zeros(1 << 16, np.int32)


class _Work:
    """Restart intervals of one kind of scan: their blocks one behind the other, their bits in one buffer."""

    def __init__(self):
        self.blocks, self.component, self.count, self.data, self.param = [], [], [], [], []

    def add(self, blocks: np.ndarray, per_piece: int, pieces: list[bytes], param: tuple, component=None) -> None:
        for k, piece in enumerate(pieces):
            n = min(per_piece, len(blocks) - k * per_piece)
            if n <= 0:
                break
            self.count.append(n)
            self.data.append(piece)
            self.param.append(param)
        used = blocks[: len(pieces) * per_piece]
        self.blocks.append(used)
        if component is not None:
            self.component.append(component[: len(used)])

    def close(self) -> None:
        self.count = np.array(self.count)
        self.start = np.cumsum(self.count) - self.count
        self.blocks = np.concatenate(self.blocks)
        size = np.array([len(x) + 8 for x in self.data])
        self.bit = (np.cumsum(size) - size) * 8
        raw = np.frombuffer(b"".join([x + b"\xff" * 8 for x in self.data]) + b"\xff" * 16, np.uint8)
        self.end = (np.cumsum(size) - 8) * 8
        self.bytes = raw
        wide = np.zeros(len(raw) - 8, np.uint64)
        for k in range(8):
            wide = wide << np.uint64(8) | raw[k : len(raw) - 8 + k]
        self.wide = wide
        self.param = np.array(self.param)

    def peek(self, bit: np.ndarray) -> np.ndarray:
        """64 bits, of which the first 57 are valid."""
        return self.wide[bit >> 3] << (bit & 7).astype(np.uint64)


def _bits(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits behind the first ``skip`` ones."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((value << 1) < (1 << size), value - (1 << size) + 1, value)


def _decode_dc_first(work: _Work, tables: np.ndarray, store: np.ndarray) -> None:
    component = np.concatenate(work.component)
    table_of = work.param[:, 1:]  # of each component
    diff = np.zeros(len(work.blocks), np.int64)
    order = np.argsort(-work.count, kind="stable")
    count, start, bit, end, own = work.count[order], work.start[order], work.bit[order].copy(), work.end[order], table_of[order]
    for step in range(count[0]):
        m = np.searchsorted(-count, -step)
        at = start[:m] + step
        window = work.peek(bit[:m])
        found = tables[(own[np.arange(m), component[at]] << 16) + (window >> np.uint64(48)).astype(np.int64)]
        length, size = found & 255, (found >> 8).astype(np.int64)
        diff[at] = _extend(_bits(window, length, size), size)
        bit[:m] = np.minimum(bit[:m] + length + size, end[:m])
    low = np.repeat(work.param[:, 0], work.count)
    for c in range(component.max() + 1):
        own = np.flatnonzero(component == c)
        if len(own):
            total = np.cumsum(diff[own])
            piece = np.searchsorted(work.start, own, side="right") - 1
            first = np.ones(len(own), bool)
            first[1:] = piece[1:] != piece[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            store[work.blocks[own], 0] = (total - (total - diff[own])[lead]) << low[own]


def _decode_dc_refine(work: _Work, store: np.ndarray) -> None:
    at = np.repeat(work.bit - work.start, work.count) + np.arange(len(work.blocks))
    at = np.minimum(at, np.repeat(work.end, work.count))
    bit = work.bytes[at >> 3] >> (7 - (at & 7)) & 1
    store[work.blocks, 0] |= bit.astype(np.int16) << np.repeat(work.param[:, 0], work.count).astype(np.int16)


def _decode_ac_first(work: _Work, tables: np.ndarray, store: np.ndarray) -> None:
    low, table, first, last = work.param.T
    keep = np.arange(len(work.count))
    at, left, bit, k = work.start.copy(), work.count.copy(), work.bit.copy(), first.copy()
    low, table, first, last, end = low.copy(), table << 16, first.copy(), last.copy(), work.end.copy()
    nowhere = len(store) - 1
    blocks = np.append(work.blocks, nowhere)
    flat = store.reshape(-1)
    step = 0
    while len(keep):
        window = work.peek(bit)
        found = tables[table + (window >> np.uint64(48)).astype(np.int64)]
        length, symbol = (found & 255).astype(np.int64), (found >> 8).astype(np.int64)
        size, run = symbol & 15, symbol >> 4
        over = (size == 0) & (run < 15)
        n = np.where(over, run, size)
        extra = _bits(window, length, n)
        k += np.where(over, 0, run)
        put = (size > 0) & (k <= last) & (left > 0)
        where = np.where(put, blocks[np.where(left > 0, at, len(blocks) - 1)] * 64 + np.minimum(k, 63), nowhere * 64)
        flat[where] = _extend(extra, size) << low
        k += 1
        bit = np.minimum(bit + length + n, end)
        done = over | (k > last)
        skip = np.where(over, (1 << run) + extra, 1) * done
        at += skip
        left -= skip
        k = np.where(done, first, k)
        step += 1
        if step % 8 == 0 or len(keep) < 64:
            alive = left > 0
            if alive.sum() < 0.9 * len(alive) or not alive.any():
                keep, at, left, bit, k = keep[alive], at[alive], left[alive], bit[alive], k[alive]
                low, table, first, last, end = low[alive], table[alive], first[alive], last[alive], end[alive]
    store[nowhere] = 0


def _decode_ac_refine(work: _Work, tables: np.ndarray, store: np.ndarray) -> None:
    low, table, first, last = work.param.T
    of = np.repeat(np.arange(len(work.count)), work.count)
    column = np.arange(64)
    inside = (column >= first[of, None]) & (column <= last[of, None])
    value = store[work.blocks]
    known = (value != 0) & inside
    open_ = (value == 0) & inside
    known_before = np.zeros((len(of), 65), np.int64)
    np.cumsum(known, axis=1, out=known_before[:, 1:])
    open_before = np.zeros((len(of), 65), np.int64)
    np.cumsum(open_, axis=1, out=open_before[:, 1:])
    known_at, open_at = np.flatnonzero(known), np.append(np.flatnonzero(open_), 0)
    known_base = np.cumsum(known_before[:, 64]) - known_before[:, 64]
    open_base = np.cumsum(open_before[:, 64]) - open_before[:, 64]
    records: list[tuple] = []
    placed: list[tuple] = []
    at, left, bit, k = work.start.copy(), work.count.copy(), work.bit.copy(), first.copy()
    low_, table_, first_, last_, end, skip = low, table << 16, first, last, work.end, np.zeros(len(at), np.int64)
    while len(at):
        window = work.peek(bit)
        found = tables[table_ + (window >> np.uint64(48)).astype(np.int64)]
        fresh = skip == 0
        length, symbol = np.where(fresh, found & 255, 0).astype(np.int64), (found >> 8).astype(np.int64)
        size, run = symbol & 15, symbol >> 4
        over = fresh & (size == 0) & (run < 15)
        n = np.where(over, run, np.where(fresh & (size > 0), 1, 0))
        extra = _bits(window, length, n)
        skip = np.where(over, (1 << run) + extra, skip)
        whole = skip > 0
        target = open_before[at, k] + run
        exists = target < open_before[at, 64]
        stop = np.where(~whole & exists, open_at[np.minimum(open_base[at] + target, len(open_at) - 1)] - at * 64, last_ + 1)
        stop = np.clip(stop, k, last_ + 1)
        bit = bit + length + n
        count = known_before[at, stop] - known_before[at, k]
        records.append((known_base[at] + known_before[at, k], count, bit, low_))
        put = ~whole & exists & (size > 0)
        placed.append((work.blocks[at[put]] * 64 + stop[put], np.where(extra[put] > 0, 1, -1) << low_[put]))
        bit = np.minimum(bit + count, end)
        k = stop + 1
        done = whole | (k > last_)
        skip -= whole
        at = at + done
        left = left - done
        k = np.where(done, first_, k)
        alive = left > 0
        if not alive.all():
            at, left, bit, k, skip = at[alive], left[alive], bit[alive], k[alive], skip[alive]
            low_, table_, first_, last_, end = low_[alive], table_[alive], first_[alive], last_[alive], end[alive]
    flat = store.reshape(-1)
    base, count, bit, shift = (np.concatenate(x) for x in zip(*records, strict=True))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    local = known_at[np.repeat(base, count) + nth]
    where = work.blocks[local >> 6] * 64 + (local & 63)
    position = np.minimum(np.repeat(bit, count) + nth, len(work.bytes) * 8 - 1)
    one = (work.bytes[position >> 3] >> (7 - (position & 7)) & 1).astype(np.int64) << np.repeat(shift, count)
    now = flat[where].astype(np.int64)
    flat[where] = np.where((np.abs(now) & one) == 0, now + np.sign(now) * one, now)
    for where, what in placed:
        flat[where] = what


def decode(files: list[bytes | None]) -> list[Frame | None]:
    """Frames with all coefficients that the scans give; None for what can't be read."""
    frames: list[Frame | None] = []
    for data in files:
        try:
            frames.append(parse(data) if data else None)
        except (ValueError, KeyError, IndexError, struct.error):
            frames.append(None)
    good = [f for f in frames if f is not None]
    places = [geometry(f.width, f.height, f.sampling) for f in good]
    base = np.cumsum([0, *(int(p.base[-1]) for p in places)])
    store = np.zeros((int(base[-1]) + 1, 64), np.int16)
    tables = _Tables()
    levels: list[dict[tuple, _Work]] = []
    for f, p, b in zip(good, places, base[:-1], strict=True):
        level_of = [[0] * 64 for _ in f.sampling]
        for s in f.scans:
            s_last = min(63, s.last)
            level = max(max(level_of[c][s.first : s_last + 1]) for c in s.components)
            for c in s.components:
                level_of[c][s.first : s_last + 1] = [level + 1] * (s_last + 1 - s.first)
            while len(levels) <= level:
                levels.append({})
            work = levels[level].setdefault((s.first > 0, s.high > 0), _Work())
            component = None
            if s.first or len(s.components) == 1:
                order, unit = p.own[s.components[0]], 1
                component = np.zeros(len(order), np.int64) + s.components[0]
            else:
                wanted = np.isin(p.component, s.components)
                order = p.interleaved.reshape(-1, p.per_mcu)[:, wanted].reshape(-1)
                unit = int(wanted.sum())
                component = np.tile(p.component[wanted], len(order) // unit)
            per_piece = s.restart * unit if s.restart else max(1, len(order))
            if s.first:
                param = (s.low, tables.of(s.tables[0]), s.first, s_last)
            else:
                own = dict(zip(s.components, s.tables, strict=True))
                param = (s.low, *(tables.of(own.get(c)) if not s.high else 0 for c in range(3)))
            work.add(order + b, per_piece, s.pieces, param, None if s.first else component)
    look = tables.all()
    for level in levels:
        for (ac, refine), work in sorted(level.items()):
            work.close()
            if not len(work.count):
                continue
            if ac:
                (_decode_ac_refine if refine else _decode_ac_first)(work, look, store)
            elif refine:
                _decode_dc_refine(work, store)
            else:
                _decode_dc_first(work, look, store)
    for f, a, z in zip(good, base[:-1], base[1:], strict=True):
        f.blocks = store[a:z]
    return frames


_BASIS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


def inverse_transform(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples of 0-255 of each block; added up in a fixed order, so equal blocks give equal samples."""
    # Frequencies come first and blocks last, so that each step works on long rows.
    natural = np.empty((64, len(blocks)), np.float32)
    natural[ZIGZAG] = (blocks * quant).T
    by_row = natural.reshape(8, 8, -1)
    half = np.zeros((8, 8, len(blocks)), np.float32)  # vertical frequency, column
    full = np.zeros((8, 8, len(blocks)), np.float32)
    for u in range(8):
        for x in range(8):
            half[:, x] += by_row[:, u] * _BASIS[u, x]
    for v in range(8):
        for y in range(8):
            full[y] += half[v] * _BASIS[v, y]
    full += np.float32(128)
    np.rint(full, out=full)
    return np.ascontiguousarray(np.clip(full, 0, 255).astype(np.uint8).reshape(64, -1).T).reshape(-1, 8, 8)


def _plane(samples: np.ndarray, place: Geometry, c: int, sampling: tuple[int, int], height: int, width: int) -> np.ndarray:
    """Images x rows x columns of a component, at the size of the image."""
    rows, columns = place.grid[c]
    plane = samples.reshape(-1, rows, columns, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, rows * 8, columns * 8)
    for axis, (own, most) in ((2, (sampling[0], place.hmax)), (1, (sampling[1], place.vmax))):
        if most % own == 0:
            plane = np.repeat(plane, most // own, axis=axis) if most > own else plane
        else:
            plane = np.take(plane, np.arange(plane.shape[axis] * most // own) * own // most, axis=axis)
    return plane[:, :height, :width]


def stack_to_rgb(frames: list[Frame]) -> np.ndarray:
    """Tensors (image, height, width, 3) of frames of one size and sampling; chroma is repeated up to the size of luma."""
    first = frames[0]
    place = geometry(first.width, first.height, first.sampling)
    planes = []
    for c, sampling in enumerate(first.sampling):
        own = slice(place.base[c], place.base[c + 1])
        blocks = np.stack([f.blocks[own] for f in frames])
        quant = np.stack([f.quant[c] for f in frames])[:, None, :]
        planes.append(_plane(inverse_transform((blocks * quant).reshape(-1, 64), np.ones(64)), place, c, sampling, first.height, first.width))
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=3)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    out[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return out


def to_rgb(frames: list[Frame | None], most: int = 1 << 22) -> list[np.ndarray | None]:
    """The full-resolution tensor (height, width, 3) of each frame; frames of one size are transformed together, up to ``most`` pixels."""
    groups: dict[tuple, list[int]] = {}
    for n, f in enumerate(frames):
        if f is not None:
            groups.setdefault((f.width, f.height, f.sampling), []).append(n)
    out: list[np.ndarray | None] = [None] * len(frames)
    for (width, height, _), members in groups.items():
        step = max(1, most // (width * height))
        for at in range(0, len(members), step):
            own = members[at : at + step]
            for n, tensor in zip(own, stack_to_rgb([frames[n] for n in own]), strict=True):
                out[n] = tensor
    return out
