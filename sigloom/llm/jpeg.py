"""Media columns as progressive JPEG: coefficients that accumulate over scans, and full-resolution RGB tensors.

The decoder takes Huffman-coded progressive files of 8-bit samples with any sampling factors, scans and restart
intervals. Each scan adds its spectral band or its bit of precision to coefficient arrays; then blocks are
dequantised and inverse-transformed by one matrix product, chroma is upsampled, and colours are converted.

``store`` keeps bytes losslessly: a byte is one quantised coefficient, 64 of them a block, in 4:2:0 colour. Each of
the 256 values of magnitude category 8 stands for one byte, so all coefficients have one category, and every scan of
a first approximation has a table with one symbol, which is read at a fixed stride. A comment has the number of bytes and
a checksum of all that is stored. What cannot be decoded is one kind of error, ``Unreadable``; a frame that promises
more blocks than its file could hold is told before anything is allocated for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import map_slices

MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


#: Bits that a block has at least in a file of any origin (its first coefficient's code), bytes that it has in a file of
#: ``store`` (63 whole ones and more), and the scans of such a file.
LEAST_BITS, STORED_BYTES, STORED_SCANS = 1, 63, 11


class Unreadable(ValueError):
    """A file that is not what it should be."""


@contextmanager
def decoding() -> Iterator[None]:
    """Whatever fails over the bytes of a file is ``Unreadable``."""
    try:
        yield
    except Unreadable:
        raise
    except (ValueError, LookupError, ArithmeticError, TypeError, StopIteration) as e:
        raise Unreadable(f"broken file: {e}") from e


def _zigzag() -> np.ndarray:
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in order])


def _inverse() -> np.ndarray:
    """64 x 64: coefficients in zigzag order times it are the block's samples, row by row."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[_zigzag()].astype(np.float32)


INVERSE, ZIGZAG = _inverse(), _zigzag()


# ---- reading -------------------------------------------------------------------------------------------------


class Table:
    """A Huffman table as code lengths and symbols for every 16-bit window."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        code, k = 0, 0
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                lo = code << (16 - size)
                self.length[lo : lo + (1 << (16 - size))], self.symbol[lo : lo + (1 << (16 - size))] = size, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = (counts.index(1) + 1, symbols[0]) if k == 1 else None
        self._lists: tuple[list, list] | None = None

    def lists(self) -> tuple[list, list]:
        self._lists = self._lists or (self.length.tolist(), self.symbol.tolist())
        return self._lists


_tables: dict[bytes, Table] = {}


def _table(spec: bytes) -> Table:
    if spec not in _tables:
        if len(_tables) > 256:
            _tables.clear()
        _tables[spec] = Table(spec[:16], spec[16:])
    return _tables[spec]


class Bits:
    """The bits of one restart interval, its stuffing removed."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff", np.uint8)
        self.data = data
        self._three: np.ndarray | None = None
        self._windows: list | None = None
        self._bits: np.ndarray | None = None

    @property
    def three(self) -> np.ndarray:
        if self._three is None:
            d = self.data.astype(np.uint32)
            self._three = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
        return self._three

    def at(self, pos: np.ndarray) -> np.ndarray:
        return (self.three[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF

    def window(self, pos: int) -> int:
        return (int.from_bytes(self.data[pos >> 3 : (pos >> 3) + 3].tobytes(), "big") >> (8 - (pos & 7))) & 0xFFFF

    def windows(self) -> list:
        if self._windows is None:
            self._windows = ((self.three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).ravel().tolist()
        return self._windows

    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.data)
        return self._bits


def _signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    size = np.asarray(size)
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def parse(data: bytes, block_bits: int = LEAST_BITS, most_scans: int | None = None) -> dict:
    """Frame, tables at each scan, scans and comments of a progressive file. A frame of more blocks than the file has
    ``block_bits`` for, and more scans than ``most_scans``, are ``Unreadable``."""
    if data[:2] != b"\xff\xd8":
        raise Unreadable("not a JPEG file")
    out: dict = {"scans": [], "comments": [], "quant": {}, "restart": 0}
    tables: dict[tuple[int, int], bytes] = {}
    pos = 2
    while True:
        m = MARKER.search(data, pos)
        if m is None:
            raise Unreadable("no end of image")
        kind, pos = data[m.start() + 1], m.end()
        if kind == 0xD9:
            return out
        size = int.from_bytes(data[pos : pos + 2], "big")
        body, pos = data[pos + 2 : pos + size], pos + size
        if kind == 0xFE:
            out["comments"].append(body)
        elif kind == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15], body = body[1:n], body[n:]
        elif kind == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif kind == 0xC2:
            if body[0] != 8:
                raise Unreadable("8-bit samples only")
            out["height"], out["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out["parts"] = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "quant": body[8 + 3 * k]} for k in range(body[5])]
            high, wide = max(c["v"] for c in out["parts"]), max(c["h"] for c in out["parts"])
            out["mcus"] = (-(-out["height"] // (8 * high)), -(-out["width"] // (8 * wide)))
            blocks = out["mcus"][0] * out["mcus"][1] * sum(c["h"] * c["v"] for c in out["parts"])
            if not 0 < blocks * block_bits <= 8 * len(data):
                raise Unreadable(f"{blocks} blocks in {len(data)} bytes")
            for c in out["parts"]:
                c["used"] = (-(-(-(-out["height"] * c["v"] // high)) // 8), -(-(-(-out["width"] * c["h"] // wide)) // 8))
                c["coef"] = np.zeros((out["mcus"][0] * c["v"], out["mcus"][1] * c["h"], 64), np.int16)
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF:
            raise Unreadable("progressive Huffman frames only")
        elif kind == 0xDA:
            if len(out["scans"]) == most_scans:
                raise Unreadable("too many scans")
            n = body[0]
            stop = MARKER.search(data, pos)
            end = stop.start() if stop else len(data)
            ids = {c["id"]: k for k, c in enumerate(out["parts"])}
            out["scans"].append({"parts": [(ids[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)], "band": (body[1 + 2 * n], body[2 + 2 * n]), "high": body[3 + 2 * n] >> 4, "low": body[3 + 2 * n] & 15, "tables": dict(tables), "restart": out["restart"], "data": data[pos:end]})
            pos = end


@lru_cache(maxsize=512)
def _raster(rows: int, cols: int, stride: int) -> np.ndarray:
    return (np.arange(rows)[:, None] * stride + np.arange(cols)).ravel()


@lru_cache(maxsize=512)
def _interleaved(rows: int, cols: int, v: int, h: int) -> np.ndarray:
    down = (np.arange(rows)[:, None, None, None] * v + np.arange(v)[:, None]) * (cols * h)
    return (down + np.arange(cols)[:, None, None] * h + np.arange(h)).ravel()


def _order(image: dict, scan: dict) -> tuple[list[int], list[tuple[int, np.ndarray]], int]:
    """For a scan: the part of each unit of an MCU, each part's blocks in the scan's order, and how many MCUs."""
    if len(scan["parts"]) == 1:
        k = scan["parts"][0][0]
        c = image["parts"][k]
        rows, cols = c["used"]
        return [k], [(k, _raster(rows, cols, c["coef"].shape[1]))], rows * cols
    rows, cols = image["mcus"]
    parts = [(k, image["parts"][k]) for k, _, _ in scan["parts"]]
    return [k for k, c in parts for _ in range(c["h"] * c["v"])], [(k, _interleaved(rows, cols, c["v"], c["h"])) for k, c in parts], rows * cols


def _dc(image: dict, scan: dict) -> None:
    units, blocks, mcus = _order(image, scan)
    intervals = RESTART.split(scan["data"]) if scan["restart"] else [scan["data"]]
    each = scan["restart"] or mcus
    index = dict(blocks)
    per = {k: units.count(k) for k in index}
    for i, raw in enumerate(intervals):
        n = min(each, mcus - i * each)
        if n <= 0:
            break
        bits = Bits(raw)
        if scan["high"]:
            took = bits.bits()[: n * len(units)].reshape(n, len(units))
            for k in index:
                at = index[k][i * each * per[k] : (i * each + n) * per[k]]
                flat = image["parts"][k]["coef"].reshape(-1, 64)
                flat[at, 0] |= (took[:, [u == k for u in units]].ravel().astype(np.int16)) << scan["low"]
            continue
        look = {k: _table(scan["tables"][0, t]).lists() for k, t, _ in scan["parts"]}
        windows, pos, starts, sizes = bits.windows(), 0, [], []
        cycle = [look[u] for u in units]
        for _ in range(n):
            for length, symbol in cycle:
                w = windows[pos]
                pos += length[w]
                s = symbol[w]
                starts.append(pos)
                sizes.append(s)
                pos += s
        at, size = np.array(starts), np.array(sizes)
        value = _signed((bits.at(at) >> (16 - size).astype(np.uint32)).astype(np.int32), size).reshape(n, len(units))
        for k in index:
            own = value[:, [u == k for u in units]].ravel()
            rows = index[k][i * each * per[k] : (i * each + n) * per[k]]
            image["parts"][k]["coef"].reshape(-1, 64)[rows, 0] = np.cumsum(own) << scan["low"]


def _ac_first(bits: Bits, table: Table, coef: np.ndarray, rows: np.ndarray, band: tuple[int, int], low: int) -> None:
    lo, hi = band
    width = hi - lo + 1
    if table.only and table.only[1] < 16 and table.only[1] > 0:  # one symbol of run 0: a fixed stride
        size = table.only[1]
        if table.only[0] + size == 8:  # whole bytes
            value = (bits.data[: len(rows) * width] & ((1 << size) - 1)).astype(np.int16)
            value -= (value < 1 << (size - 1)) * np.int16((1 << size) - 1)
            coef[rows, lo : hi + 1] = (value << low).reshape(-1, width)
            return
        pos = np.arange(len(rows) * width) * (table.only[0] + size) + table.only[0]
        value = (bits.at(pos) >> (16 - size)).astype(np.int32)
        coef[rows, lo : hi + 1] = (_signed(value, np.int64(size)) * (1 << low)).reshape(-1, width)
        return
    windows, (length, symbol) = bits.windows(), table.lists()
    pos = run = 0
    for row in rows.tolist():
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            w = windows[pos]
            pos += length[w]
            r, s = symbol[w] >> 4, symbol[w] & 15
            if s:
                k += r
                v = windows[pos] >> (16 - s)
                pos += s
                coef[row, k] = (v if v >> (s - 1) else v - (1 << s) + 1) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + (windows[pos] >> (16 - r) if r else 0)
                pos += r
                break


def _ac_refine(bits: Bits, table: Table, coef: np.ndarray, rows: np.ndarray, band: tuple[int, int], low: int) -> None:
    lo, hi = band
    raw, length, symbol, one = bits.bits(), table.length, table.symbol, 1 << low

    def correct(some: np.ndarray, pos: int, begin: int = lo) -> int:
        """Correction bits of the non-zero coefficients of whole blocks from ``begin`` on."""
        part = coef[some, begin : hi + 1]
        there = part != 0
        n = int(np.count_nonzero(there))
        if n == part.size:
            took = raw[pos : pos + n].reshape(part.shape).astype(np.int16)
            coef[some, begin : hi + 1] = part + np.where(part > 0, took, -took) * np.int16(one)
            return pos + n
        took = raw[pos : pos + n].astype(np.int16) * one
        part[there] += np.where(part[there] > 0, took, -took)
        coef[some, begin : hi + 1] = part
        return pos + n

    pos = at = 0
    while at < len(rows):
        k, row = lo, int(rows[at])
        at += 1
        while k <= hi:
            w = bits.window(pos)
            pos += int(length[w])
            r, s = int(symbol[w]) >> 4, int(symbol[w]) & 15
            if s == 0 and r < 15:
                run = (1 << r) + (bits.window(pos) >> (16 - r) if r else 0)
                pos = correct(rows[at - 1 : at], pos + r, k)
                pos = correct(rows[at : at + run - 1], pos)
                at += run - 1
                break
            new = 0
            if s:
                new = one if raw[pos] else -one
                pos += 1
            while k <= hi:
                v = int(coef[row, k])
                if v:
                    if raw[pos]:
                        coef[row, k] = v + (one if v > 0 else -one)
                    pos += 1
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if new and k <= hi:
                coef[row, k] = new
            k += 1


def coefficients(data: bytes, block_bits: int = LEAST_BITS, most_scans: int | None = None) -> dict:
    """The parsed image with the coefficients of all its scans in each part's ``coef`` (rows, columns, 64 in zigzag order)."""
    image = parse(data, block_bits, most_scans)
    for scan in image["scans"]:
        if scan["band"][0] == 0:
            _dc(image, scan)
            continue
        (k, _, t), (_, [(_, rows)], n) = scan["parts"][0], _order(image, scan)
        coef, table = image["parts"][k]["coef"].reshape(-1, 64), _table(scan["tables"][1, t])
        each = scan["restart"] or n
        for i, raw in enumerate(RESTART.split(scan["data"]) if scan["restart"] else [scan["data"]]):
            (_ac_refine if scan["high"] else _ac_first)(Bits(raw), table, coef, rows[i * each : (i + 1) * each], scan["band"], scan["low"])
    return image


def tensor(image: dict) -> np.ndarray:
    """Full-resolution RGB, (3, height, width) bytes; one part is grey, three are Y, Cb, Cr.

    Chroma terms are computed at their own resolution and added to every sample they cover.
    """
    planes = []
    for c in image["parts"]:
        rows, cols, _ = c["coef"].shape
        flat = c["coef"].reshape(-1, 64).astype(np.float32)
        quant = image["quant"][c["quant"]]
        if (quant != 1).any():
            flat *= quant.astype(np.float32)
        planes.append((flat @ INVERSE).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
    high, wide = max(c["v"] for c in image["parts"]), max(c["h"] for c in image["parts"])
    up = [(high // c["v"], wide // c["h"]) for c in image["parts"]]

    def spread(base: np.ndarray, more: np.ndarray, by: tuple[int, int]) -> np.ndarray:
        return (base.reshape(more.shape[0], by[0], more.shape[1], by[1]) + more[:, None, :, None]).reshape(base.shape)

    y = planes[0] + np.float32(128.5)
    if up[0] != (1, 1):
        y = y.repeat(up[0][0], 0).repeat(up[0][1], 1)
    if len(planes) == 1:
        channels = [y] * 3
    else:
        # The colour conversion of the file format.
        cb, cr = planes[1], planes[2]
        channels = [spread(y, np.float32(1.402) * cr, up[2]), spread(spread(y, np.float32(-0.344136) * cb, up[1]), np.float32(-0.714136) * cr, up[2]), spread(y, np.float32(1.772) * cb, up[1])]
    out = np.empty((3, image["height"], image["width"]), np.uint8)
    for k, x in enumerate(channels):
        x = x[: image["height"], : image["width"]]
        out[k] = np.minimum(np.maximum(x, np.float32(0)), np.float32(255))
    return out


# ---- storing -------------------------------------------------------------------------------------------------

_BYTE = np.arange(256)
VALUE = np.where(_BYTE < 128, _BYTE - 255, _BYTE).astype(np.int16)
#: The byte of a first approximation: the code 0 and seven bits.
FIRST = np.where(VALUE > 0, VALUE >> 1, 127 - (-VALUE >> 1)).astype(np.uint8)
LAST = (np.abs(VALUE) & 1).astype(np.uint8)
LOW_BAND, RUN = (1, 5), 32767


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _spec(where: int, length: int, symbols: list[int]) -> bytes:
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return bytes([where, *counts, *symbols])


TABLES = _segment(0xC4, _spec(0x00, 4, list(range(12))) + _spec(0x10, 1, [0x07]) + _spec(0x11, 4, [r << 4 for r in range(15)]))
QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))


def _scan(parts: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([*band, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def _packed(*bits: np.ndarray) -> bytes:
    flat = np.concatenate(bits)
    return np.packbits(np.concatenate((flat, np.ones(-len(flat) % 8, np.uint8)))).tobytes()


def _number(value: int, width: int) -> np.ndarray:
    return np.array([(value >> k) & 1 for k in range(width - 1, -1, -1)], np.uint8)


def _refinement(band: np.ndarray) -> bytes:
    """End-of-band runs, each with the correction bits of all its blocks: every coefficient is already non-zero."""
    bits = []
    for at in range(0, len(band), RUN):
        part = band[at : at + RUN]
        size = len(part).bit_length() - 1
        bits += [_number(size, 4), _number(len(part) - (1 << size), size), LAST[part].ravel()]
    return _packed(*bits)


def _shape(n: int) -> tuple[int, int, int]:
    """(bytes of the payload, rows and columns of MCUs) for ``n`` bytes."""
    size = max(64, -(-n // 64) * 64)
    mcus = -(-size // 384)
    cols = min(4000, int(np.ceil(np.sqrt(mcus))))
    return size, -(-mcus // cols), cols


def _checksum(n: int, held: np.ndarray) -> int:
    """Of the number of bytes and of all that the blocks hold."""
    return zlib.crc32(held.tobytes(), n & 0xFFFFFFFF)


def store(data: bytes) -> bytes:
    """A progressive 4:2:0 file that holds ``data`` losslessly, its length and a checksum in a comment."""
    size, rows, cols = _shape(len(data))
    payload = data + bytes(size - len(data))
    held = np.zeros((rows * cols, 6, 64), np.uint8)
    held.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    luma = held[:, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, held[:, 4], held[:, 5]]
    dc = VALUE[held[:, :, 0]] >> 1
    diff = np.empty_like(dc)
    y = dc[:, :4].ravel()
    diff[:, :4] = np.diff(y, prepend=np.int16(0)).reshape(-1, 4)
    diff[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=np.zeros((1, 2), np.int16))
    d = diff.ravel().astype(np.int32)
    size = np.zeros(len(d), np.int32)
    for k in range(11):
        size += np.abs(d) >= 1 << k
    word = (size << size) | np.where(d > 0, d, d + (1 << size) - 1)
    width = 4 + size
    places = np.arange(16)
    grid = (word[:, None] >> np.maximum(width[:, None] - 1 - places, 0)) & 1
    first = _packed(grid[places < width[:, None]].astype(np.uint8))
    frame = bytes([8]) + (rows * 16).to_bytes(2, "big") + (cols * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"bytes=%d crc32=%08x" % (len(data), _checksum(len(data), held))), QUANT, _segment(0xC2, frame), TABLES, _scan([(1, 0), (2, 0), (3, 0)], (0, 0), 0, 1, first)]
    for lo, hi in (LOW_BAND, (LOW_BAND[1] + 1, 63)):
        out += [_scan([(k + 1, 0x00)], (lo, hi), 0, 1, FIRST[p[:, lo : hi + 1]].tobytes()) for k, p in enumerate(planes)]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], (0, 0), 1, 0, _packed((VALUE[held[:, :, 0]].ravel() & 1).astype(np.uint8))))
    out += [_scan([(k + 1, 0x01)], (1, 63), 1, 0, _refinement(p[:, 1:])) for k, p in enumerate(planes)]
    return b"".join(out) + b"\xff\xd9"


_HELD = re.compile(rb"bytes=(\d{1,18}) crc32=([0-9a-f]{8})")


def held_payload(image: dict) -> tuple[int, bytes]:
    """(bytes stored, padded payload) of an image made by ``store``; ``Unreadable`` if its frame is not that of so many bytes,
    or if a coefficient, the length or anything else that the blocks hold is not what the checksum was made of."""
    told = [m for m in map(_HELD.fullmatch, image["comments"]) if m]
    if len(told) != 1:
        raise Unreadable("not a file of stored bytes")
    n = int(told[0][1])
    size, rows, cols = _shape(n)
    if image["mcus"] != (rows, cols) or (image["height"], image["width"]) != (rows * 16, cols * 16) or [(c["id"], c["h"], c["v"]) for c in image["parts"]] != [(1, 2, 2), (2, 1, 1), (3, 1, 1)]:
        raise Unreadable("not the frame of so many bytes")
    if any((image["quant"][c["quant"]] != 1).any() for c in image["parts"]):
        raise Unreadable("quantised coefficients")
    coef = [c["coef"] for c in image["parts"]]
    found = np.empty((rows * cols, 6, 64), np.int16)
    found[:, :4] = coef[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    found[:, 4], found[:, 5] = coef[1].reshape(-1, 64), coef[2].reshape(-1, 64)
    held = np.where(found < 0, found + 255, found).astype(np.uint8)
    if _checksum(n, held) != int(told[0][2], 16) or (VALUE[held] != found).any():
        raise Unreadable("other bytes than were stored")
    return n, held.reshape(-1)[:size].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Shape, and mean, least and largest sample of each channel."""
    flat = rgb.reshape(3, -1)
    mean = flat.sum(1, dtype=np.int64) * 1000 // flat.shape[1]
    return f"3x{rgb.shape[1]}x{rgb.shape[2]}:" + ";".join(f"{m},{a},{b}" for m, a, b in zip(mean.tolist(), flat.min(1).tolist(), flat.max(1).tolist()))


# ---- columns -------------------------------------------------------------------------------------------------


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the UTF-8 of every whole text in a progressive file. Null and empty texts are 64 bytes 0; null ids
    stay null; repeated rows each return; other columns are ignored; an empty table gives no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, media binary", 64)


def _decoded(data: bytes | None, with_tensor: bool) -> list:
    """A row but for its id: of a null only that it is not intact, of a file that cannot be read its size and hash too."""
    if data is None:
        return [None] * 7 + [False] + [None] * 3 * with_tensor
    own = [len(data), sha256(data).hexdigest()]
    try:
        with decoding():
            image = coefficients(data, 8 * STORED_BYTES, STORED_SCANS)
            n, payload = held_payload(image)
            rgb = tensor(image)
            told = [n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, feature(rgb), True]
    except Unreadable:
        return [None] * 4 + own + [None, False] + [None] * 3 * with_tensor
    return told + ([*rgb.shape[1:], rgb.tobytes()] if with_tensor else [])


def decode_media(media: DataFrame, with_tensor: bool = False) -> DataFrame:
    """Rows of (doc_id, media) decoded: payload digests, the RGB tensor's feature, whether the file was intact[, the
    tensor's height, width and samples].

    ``media`` are files made by ``encode_media``. Null media, files cut short or otherwise unreadable, and files that hold
    other bytes than were stored give a row that is not intact, with nulls for what cannot be told. No file makes a task
    allocate more than a few times its own size. Null ids stay null; repeated rows each return; other columns are
    ignored; an empty table gives no rows.
    """
    kinds = {"n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()),
             "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()), "intact": ("boolean", pa.bool_())}
    kinds |= {"height": ("int", pa.int32()), "width": ("int", pa.int32()), "tensor": ("binary", pa.binary())} if with_tensor else {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*[_decoded(data, with_tensor) for data in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, kind) for x, (_, kind) in zip(rows, kinds.values())]], ["doc_id", *kinds])

    return map_slices(media.select(F.col("doc_id").cast("long"), "media"), run, "doc_id long, " + ", ".join(f"{c} {k}" for c, (k, _) in kinds.items()), 64)
