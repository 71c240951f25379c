"""Image files as bytes: TIFF in deflated tiles with a horizontal predictor and a place on the map, and PNG.

A TIFF's directory says where each tile lies, so a window is read by the tiles that it meets and nothing
else. ``read`` in what follows is a function from (offset, length) to bytes: of a file, or of bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Read = Callable[[int, int], bytes]

#: Fixed values of the format: numbers of tags and their kinds (struct code, bytes).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 277, 284, 317
TILE_WIDTH, TILE_LENGTH, OFFSETS, COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
KINDS = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}
DEFLATE, HORIZONTAL = 8, 2
PNG_MARK = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode_tiff(image: np.ndarray, tile: int = 256, bounds: tuple[float, float, float, float] | None = None, epsg: int | None = None) -> bytes:
    """An image (height, width, bands) of 8 or 16 bits without sign as TIFF; tiles at the edges are filled up with zeros.

    ``bounds`` are west, south, east, north in the units of ``epsg``. A tile's side is a multiple of 16.
    """
    if image.ndim != 3 or image.dtype not in (np.uint8, np.uint16) or 0 in image.shape or tile % 16:
        raise ValueError("an image has height, width and bands of 8 or 16 bits, and tiles of a multiple of 16")
    h, w, bands = image.shape
    down, across = -(-h // tile), -(-w // tile)
    padded = np.zeros((down * tile, across * tile, bands), image.dtype)
    padded[:h, :w] = image
    tiles = []
    for r in range(down):
        for c in range(across):
            own = padded[r * tile : r * tile + tile, c * tile : c * tile + tile]
            told = own.copy()
            told[:, 1:] = own[:, 1:] - own[:, :-1]  # differences wrap around
            tiles.append(zlib.compress(np.ascontiguousarray(told.astype(told.dtype.newbyteorder("<"))).tobytes(), 6))
    tags: list[tuple[int, int, list]] = [
        (WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [image.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [2 if bands >= 3 else 1]), (SAMPLES, 3, [bands]),
        (PLANAR, 3, [1]), (PREDICTOR, 3, [HORIZONTAL]), (TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (OFFSETS, 4, [0] * len(tiles)), (COUNTS, 4, [len(t) for t in tiles]), (FORMAT, 3, [1] * bands),
    ]
    if bounds is not None:
        west, south, east, north = bounds
        tags += [(PIXEL_SCALE, 12, [(east - west) / w, (north - south) / h, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
    if epsg is not None:
        # version 1.1.0; the kind of model (1 projected, 2 in degrees), pixels are areas, the system's number
        degrees = epsg == 4326
        tags.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg]))
    tags.sort()
    extra_at = 8 + 2 + 12 * len(tags) + 4
    extra_size = sum(n for _, kind, v in tags if (n := KINDS[kind][1] * len(v)) > 4)
    at = extra_at + extra_size
    starts = (np.cumsum([0, *[len(t) for t in tiles]])[:-1] + at).tolist()
    tags = [(number, kind, starts if number == OFFSETS else v) for number, kind, v in tags]
    head, extra = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)), b""
    for number, kind, values in tags:
        body = struct.pack(f"<{len(values)}{KINDS[kind][0]}", *values)
        head += struct.pack("<HHI", number, kind, len(values))
        if len(body) <= 4:
            head += body.ljust(4, b"\0")
        else:
            head += struct.pack("<I", extra_at + len(extra))
            extra += body
    return head + struct.pack("<I", 0) + extra + b"".join(tiles)


@dataclass(frozen=True)
class Tiff:
    """The directory of a TIFF: its tags by number."""

    read: Read
    tags: dict[int, tuple]

    @classmethod
    def open(cls, read: Read) -> Tiff:
        """Reads the directory alone; a ValueError says what this can't read."""
        head = read(0, 8)
        if head[:4] != b"II*\0":
            raise ValueError("not a little-endian TIFF")
        at = struct.unpack("<I", head[4:])[0]
        n = struct.unpack("<H", read(at, 2))[0]
        tags = {}
        body = read(at + 2, 12 * n)
        for k in range(n):
            number, kind, count = struct.unpack("<HHI", body[12 * k : 12 * k + 8])
            if kind not in KINDS:
                continue
            code, size = KINDS[kind]
            raw = body[12 * k + 8 : 12 * k + 12]
            data = raw[: size * count] if size * count <= 4 else read(struct.unpack("<I", raw)[0], size * count)
            tags[number] = struct.unpack(f"<{count}{code}", data)
        if OFFSETS not in tags or tags.get(COMPRESSION, (1,))[0] not in (1, DEFLATE) or tags.get(PLANAR, (1,))[0] != 1 or len(set(tags[BITS])) != 1 or tags[BITS][0] not in (8, 16):
            raise ValueError("only tiles of 8 or 16 bits, plain or deflated, with all bands together")
        return cls(read, tags)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.tags[LENGTH][0], self.tags[WIDTH][0], self.tags.get(SAMPLES, (1,))[0]

    @property
    def dtype(self) -> str:
        return self.tags.get(BITS, (8,))[0] // 8 == 1 and "uint8" or "uint16"

    @property
    def bounds(self) -> tuple[float, float, float, float] | None:
        if PIXEL_SCALE not in self.tags or TIE_POINT not in self.tags:
            return None
        (sx, sy, *_), (*_, west, north, _), (h, w, _) = self.tags[PIXEL_SCALE], self.tags[TIE_POINT], self.shape
        return west, north - sy * h, west + sx * w, north

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        return next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072)), None)

    def _tile(self, k: int) -> np.ndarray:
        side_h, side_w, bands = self.tags[TILE_LENGTH][0], self.tags[TILE_WIDTH][0], self.shape[2]
        data = self.read(self.tags[OFFSETS][k], self.tags[COUNTS][k])
        data = zlib.decompress(data) if self.tags[COMPRESSION][0] == DEFLATE else data
        own = np.frombuffer(data, np.dtype(self.dtype).newbyteorder("<")).reshape(side_h, side_w, bands).astype(self.dtype)
        return np.cumsum(own, axis=1, dtype=own.dtype) if self.tags.get(PREDICTOR, (1,))[0] == HORIZONTAL else own

    def window(self, row: int, col: int, last_row: int, last_col: int) -> np.ndarray:
        """The pixels of a window (ends excluded), which must lie in the image; only the tiles that it meets are read."""
        h, w, bands = self.shape
        if not (0 <= row < last_row <= h and 0 <= col < last_col <= w):
            raise ValueError(f"no window of {h} x {w}: {row, col, last_row, last_col}")
        th, tw = self.tags[TILE_LENGTH][0], self.tags[TILE_WIDTH][0]
        out = np.empty((last_row - row, last_col - col, bands), self.dtype)
        for r in range(row // th, (last_row - 1) // th + 1):
            for c in range(col // tw, (last_col - 1) // tw + 1):
                a, b, x, y = max(row, r * th), min(last_row, r * th + th), max(col, c * tw), min(last_col, c * tw + tw)
                out[a - row : b - row, x - col : y - col] = self._tile(r * -(-w // tw) + c)[a - r * th : b - r * th, x - c * tw : y - c * tw]
        return out


def of_bytes(data: bytes) -> Read:
    return lambda at, n: data[at : at + n]


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes without its filter; the bytes of a pixel are ``step``."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"filter {kind}")
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):  # each byte hangs on the one before it
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        out[i] = (out[i] + ((a + up[i]) // 2 if kind == 3 else _paeth(a, up[i], c))) & 255
    return np.array(out, np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The pixels (height, width, channels) of a PNG of 8 bits without palette or interlacing; a ValueError says what this can't read."""
    if data[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"a broken part {name!r}")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        packed += body if name == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6] != 0:
        raise ValueError("only 8 bits without palette or interlacing")
    w, h, step = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step)
    out, above = np.empty((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for r in range(h):
        out[r] = above = _unfiltered(int(rows[r, 0]), rows[r, 1:], above, step)
    return out.reshape(h, w, step)


def encode_png(image: np.ndarray) -> bytes:
    """An image (height, width, channels) of 8 bits as PNG; rows are told by their difference to the row above."""
    h, w, step = image.shape
    kind = next(k for k, n in CHANNELS.items() if n == step)
    flat = image.reshape(h, -1)
    rows = np.concatenate([np.full((h, 1), 2, np.uint8), np.diff(flat, axis=0, prepend=np.zeros((1, w * step), np.uint8))], axis=1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG_MARK + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")
