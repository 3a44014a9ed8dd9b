"""Baseline JPEG in numpy: parse markers, Huffman-decode scans, rebuild DC-only luminance thumbnails, hash them.

Many scans are decoded side by side: each restart segment of each image is a lane, and a step decodes one block of every lane.
A payload is stored losslessly as samples: each byte is one 8x8 block of even grey, so with a DC quantizer of 8 the DC-only
thumbnail is the payload. A row of `ROW` blocks is one restart segment; images end at the format's height and continue in a
further image.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: the usual DC luminance code lengths.
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
AC_BITS, AC_VALUES = [1] + [0] * 15, [0]
ROW, MOST_ROWS = 192, 8191


def canonical(bits: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table given by counts per length."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(bits: list[int], values: list[int]) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code begins so."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, length in canonical(bits, values):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def whole_blocks(dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the length and DC difference of a block that has no AC coefficient; length 0 for other blocks."""
    bits = np.arange(1 << 16, dtype=np.int32)
    size = dc & 15
    used = (dc >> 8) + size
    extra = (bits >> np.maximum(16 - used, 0)) & ((1 << size) - 1)
    end = ac[(bits << used) & 0xFFFF]
    used = used + (end >> 8)
    fits = (dc > 0) & (end > 0) & (end & 255 == 0) & (used <= 16)
    return np.where(fits, used, 0), np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    codes = {s: (c, n) for s, c, n in canonical(DC_BITS, DC_VALUES)}
    value, length = np.zeros(511, np.int32), np.zeros(511, np.int32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], length[d + 255] = (code << size | extra) << 1, n + size + 1  # the last bit ends the block
    return value, length


CODE, LENGTH = _diff_codes()


def _header(rows: int) -> bytes:
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return (b"\xff\xd8" + part(0xDB, bytes([0, 8] + [1] * 63)) + part(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
            + part(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES])) + part(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES]))
            + part(0xDD, struct.pack(">H", ROW)) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])))


def encode(data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """One media value per payload; each payload is a positive multiple of ROW bytes."""
    lines = np.diff(starts) // ROW
    frames = [min(MOST_ROWS, int(n) - k) for n in lines for k in range(0, int(n), MOST_ROWS)]
    per = [-(-int(n) // MOST_ROWS) for n in lines]
    v = data.reshape(-1, ROW).astype(np.int16) - 128
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    d += 255
    length, value = LENGTH[d], CODE[d]
    ends = np.cumsum(length, axis=1, dtype=np.int32)
    size = (ends[:, -1].astype(np.int64) + 7) // 8
    first = np.cumsum(size) - size
    bit = ends - length
    word = value << (24 - (bit & 7) - length)
    at, n = (first[:, None] + (bit >> 3)).ravel(), int(size.sum())
    packed = sum(np.bincount(at + k, ((word >> (16 - 8 * k)) & 255).ravel(), n + 3) for k in range(3))[:n].astype(np.uint8)
    packed[first + size - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = packed == 255
    stuffed = np.cumsum(full)
    out = np.zeros(n + int(stuffed[-1]) + 2 * len(size), np.uint8)
    out[np.arange(n) + stuffed - full + 2 * np.repeat(np.arange(len(size)), size)] = packed
    last = first + size
    mark = last + stuffed[last - 1] + 2 * np.arange(len(size))
    ids = np.concatenate([np.r_[0xD0 + np.arange(f - 1) % 8, 0xD9] for f in frames])
    out[mark], out[mark + 1] = 255, ids
    cuts = np.r_[0, (mark + 2)[np.cumsum(frames) - 1]]
    made = [_header(f) + out[a:b].tobytes() for f, a, b in zip(frames, cuts[:-1], cuts[1:])]
    at = np.r_[0, np.cumsum(per)]
    return [made[a] if b == a + 1 else b"".join(made[a:b]) for a, b in zip(at[:-1], at[1:])]


@dataclass
class Frame:
    """A parsed image: what its one scan needs."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantizer
    quantizers: dict[int, int] = field(default_factory=dict)  # of the DC coefficient
    tables: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int]] = field(default_factory=list)  # id, tables
    restart: int = 0
    segments: list[bytes] = field(default_factory=list)


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def parse(media: bytes) -> list[Frame]:
    """The images of a media value, one after another. Raises ValueError for anything that isn't baseline JPEG."""
    out, at, frame = [], 0, None
    while at < len(media):
        if media[at] != 0xFF or at + 1 >= len(media):
            raise ValueError("marker expected")
        mark = media[at + 1]
        at += 2
        if mark == 0xFF:
            at -= 1
        elif mark == 0xD8:
            frame = Frame()
        elif mark == 0xD9:
            if frame is None or not frame.segments:
                raise ValueError("no scan")
            out.append(frame)
            frame = None
        else:
            if frame is None or at + 2 > len(media):
                raise ValueError("cut short")
            end = at + int.from_bytes(media[at : at + 2])
            body, at = media[at + 2 : end], end
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantizers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide])
                    body = body[1 + 64 * (1 + wide) :]
            elif mark in (0xC0, 0xC1):
                _, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif mark == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    frame.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif mark in range(0xC2, 0xD0):
                raise ValueError("not baseline")
            elif mark == 0xDD:
                frame.restart = int.from_bytes(body[:2])
            elif mark == 0xDA:
                scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                stop = m.start() if (m := _END.search(media, at)) else len(media)
                if not frame.parts:
                    raise ValueError("scan before frame")
                if scan[0][0] == frame.parts[0][0]:  # luminance comes first; other scans aren't needed
                    frame.scan, frame.segments = scan, [s.replace(b"\xff\x00", b"\xff") for s in _RESTART.split(media[at:stop])]
                at = stop
    if frame is not None or not out:
        raise ValueError("no end")
    return out


def _layout(f: Frame) -> tuple[list[int], int, int, int, int]:
    """Per MCU the scan component of each block; blocks of luminance across and down an MCU; MCUs across and down."""
    by = {p[0]: p for p in f.parts}
    wide, tall = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    if len(f.scan) == 1:
        _, h, v, _ = by[f.scan[0][0]]
        return [0], 1, 1, -(-(-(-f.width * h // wide)) // 8), -(-(-(-f.height * v // tall)) // 8)
    order = [i for i, (c, _) in enumerate(f.scan) for _ in range(by[c][1] * by[c][2])]
    return order, by[f.scan[0][0]][1], by[f.scan[0][0]][2], -(-f.width // (8 * wide)), -(-f.height // (8 * tall))


def _lanes(order: list[int], dc: list[np.ndarray], ac: list[np.ndarray], data: np.ndarray, at: np.ndarray, blocks: np.ndarray, out: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Decode lanes in step; out gets the DC coefficients of scan component 0, lane after lane from `to`. Returns bad lanes."""
    words = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]
    bad = np.zeros(len(at), bool)
    live, bit, to = np.arange(len(at)), at.astype(np.int64) * 8, to.copy()
    preds = np.zeros((max(order) + 1, len(at)), np.int32)
    last = len(words) - 1

    def peek(bit: np.ndarray) -> np.ndarray:
        return (words[np.minimum(bit >> 3, last)] >> (8 - (bit & 7))) & 0xFFFF

    step, quick = 0, [whole_blocks(d, a) for d, a in zip(dc, ac)]
    fewest = int(blocks.min()) if len(blocks) else 0
    while len(live):
        part = order[step % len(order)]
        bits = peek(bit)
        used = quick[part][0][bits]
        if simple := bool(used.all()):
            bit += used
            preds[part] += quick[part][1][bits]
        else:
            hit = dc[part][bits]
            bit += hit >> 8
            size = hit & 15
            extra = peek(bit) >> (16 - size)
            bit += size
            preds[part] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            bad[live] |= hit == 0
        if part == 0:
            out[to] = preds[0]
            to += 1
        open_, k = (np.zeros(0, np.int64) if simple else None), None
        while open_ is None or len(open_):
            b = bit if open_ is None else bit[open_]
            hit = ac[part][peek(b)]
            zero, size = (hit >> 4) & 15, hit & 15
            b = b + (hit >> 8) + size
            ended = ((hit & 255) == 0) | (hit == 0)
            if open_ is None:
                bit, k = b, 1 + zero + 1
                if ended.all():
                    bad[live] |= hit == 0
                    break
                open_ = np.arange(len(bit))
                k = np.where(size == 0, 17, k)
            else:
                bit[open_] = b
                k = np.where(size == 0, k + 16, k + zero + 1)
            bad[live[open_]] |= hit == 0
            go = ~ended & (k < 64)
            open_, k = open_[go], k[go]
        step += 1
        if step >= fewest:
            go = (blocks[live] > step) & ~bad[live]
            live, bit, to, preds = live[go], bit[go], to[go], preds[:, go]
            fewest = int(blocks[live].min()) if len(live) else 0
    return bad


def thumbnails(media: list[bytes | None]) -> list[list[np.ndarray] | None]:
    """For each media value its images' DC-only luminance thumbnails, uint8 arrays with a pixel per 8x8 block; None if it is
    null, empty or not baseline JPEG."""
    frames, owner, result = [], [], [None] * len(media)
    for i, m in enumerate(media):
        try:
            own = parse(m or b"")
        except (ValueError, IndexError, struct.error):
            continue
        result[i] = [None] * len(own)
        owner += [(i, j) for j in range(len(own))]
        frames += own
    groups: dict[tuple, list[int]] = {}
    for n, f in enumerate(frames):
        order = tuple(_layout(f)[0])
        groups.setdefault((order, *((f.tables.get(t >> 4), f.tables.get(16 | t & 15)) for _, t in f.scan)), []).append(n)
    for (order, *tables), members in groups.items():
        if any(d is None or a is None for d, a in tables):
            for n in members:
                result[owner[n][0]] = None
            continue
        luts = [[lookup(list(t[:16]), list(t[16:])) for t in pair] for pair in tables]
        zeros = order.count(0)
        lane_blocks, lane_frame = [], []
        for n in members:
            f = frames[n]
            _, _, _, across, down = _layout(f)
            mcus, per = across * down, f.restart or across * down
            counts = [min(per, mcus - k) for k in range(0, mcus, per)]
            f.segments = (f.segments + [b""] * len(counts))[: len(counts)]
            lane_blocks += counts
            lane_frame += [n] * len(counts)
        segments = [s for n in members for s in frames[n].segments]
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        mcus = np.array(lane_blocks, np.int64)
        data = np.frombuffer(b"".join(segments) + b"\xff" * 8, np.uint8)
        out = np.zeros(int(mcus.sum()) * zeros, np.int32)
        bad = _lanes(list(order), [x[0] for x in luts], [x[1] for x in luts], data, np.cumsum(lens) - lens, mcus * len(order), out, (np.cumsum(mcus) - mcus) * zeros)
        wrong = {lane_frame[k] for k in np.flatnonzero(bad)}
        at = 0
        for n in members:
            f = frames[n]
            _, h, v, across, down = _layout(f)
            blocks = out[at : (at := at + across * down * zeros)].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            i, j = owner[n]
            if n in wrong or result[i] is None or f.parts[0][3] not in f.quantizers:
                result[i] = None
                continue
            wide, tall = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
            rows, cols = -(-(-(-f.height * f.parts[0][2] // tall)) // 8), -(-(-(-f.width * f.parts[0][1] // wide)) // 8)
            pixel = ((blocks[:rows, :cols] * f.quantizers[f.parts[0][3]] + 4) >> 3) + 128
            result[i][j] = np.clip(pixel, 0, 255).astype(np.uint8)
    return result


def _cells(n: int, most: int) -> np.ndarray:
    return np.arange(most) * n // most


def thumbnail_hashes(thumb: np.ndarray) -> str:
    """Average hash (8x8 cells against their mean) and difference hash (each cell against the next, 8x9), 16 hex digits each."""
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumb, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])

    def cells(down: int, across: int) -> np.ndarray:
        r, c = _cells(thumb.shape[0], down), _cells(thumb.shape[1], across)
        r2, c2 = np.maximum(np.r_[r[1:], thumb.shape[0]], r + 1), np.maximum(np.r_[c[1:], thumb.shape[1]], c + 1)
        part = total[r2][:, c2] - total[r][:, c2] - total[r2][:, c] + total[r][:, c]
        return part / ((r2 - r)[:, None] * (c2 - c))

    a, d = cells(8, 8), cells(8, 9)
    bits = np.packbits(np.r_[(a > a.mean()).ravel(), (d[:, 1:] > d[:, :-1]).ravel()])
    return bits.tobytes().hex()[:16] + ":" + bits.tobytes().hex()[16:]
