"""A subset of TIFF in pure Python: stripped or tiled, chunky or planar, uncompressed or deflate, with predictors 1-3."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# TIFF and GeoTIFF tags, field sizes and formats by type, and numpy kinds by sample format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, EXTRA, SAMPLE_FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_ASCII, METADATA, NODATA = 33550, 33922, 34264, 34737, 42112, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
KINDS = {1: "u", 2: "i", 3: "f"}


class TiffError(ValueError):
    pass


@dataclass
class Raster:
    """A decoded file's header; bands are decoded on demand."""

    data: bytes
    tags: dict[int, tuple] = field(default_factory=dict)
    order: str = "<"

    def __post_init__(self) -> None:
        if self.data[:2] not in (b"II", b"MM"):
            raise TiffError("not a TIFF file")
        self.order = "<" if self.data[:2] == b"II" else ">"
        magic = struct.unpack_from(self.order + "H", self.data, 2)[0]
        if magic == 43:
            (at,) = struct.unpack_from(self.order + "Q", self.data, 8)
            head, entry, wide = "Q", 20, 8
        elif magic == 42:
            (at,) = struct.unpack_from(self.order + "I", self.data, 4)
            head, entry, wide = "H", 12, 4
        else:
            raise TiffError("not a TIFF file")
        (count,) = struct.unpack_from(self.order + head, self.data, at)
        at += struct.calcsize(head)
        for i in range(count):
            tag, kind = struct.unpack_from(self.order + "HH", self.data, at + i * entry)
            (n,) = struct.unpack_from(self.order + ("Q" if wide == 8 else "I"), self.data, at + i * entry + 4)
            if kind not in TYPES:
                continue
            size, fmt = TYPES[kind]
            place = at + i * entry + 4 + wide
            if size * n > wide:
                (place,) = struct.unpack_from(self.order + ("Q" if wide == 8 else "I"), self.data, place)
            if fmt == "s":
                self.tags[tag] = (self.data[place : place + n].rstrip(b"\0").decode("latin-1"),)
            else:
                self.tags[tag] = struct.unpack_from(f"{self.order}{n * len(fmt)}{fmt[0]}", self.data, place)

    def _one(self, tag: int, default: int) -> int:
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int]:
        return self._one(HEIGHT, 0), self._one(WIDTH, 0)

    @property
    def bands(self) -> int:
        return self._one(SAMPLES, 1)

    @property
    def geo_transform(self) -> list[float]:
        """x0, dx, rx, y0, ry, dy, as GDAL orders them; the identity without georeferencing."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        if PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            (sx, sy), t = self.tags[PIXEL_SCALE][:2], self.tags[TIE_POINT]
            return [t[3] - t[0] * sx, sx, 0.0, t[4] + t[1] * sy, 0.0, -sy]
        return [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(NODATA, ("",))[0].strip()
        return float(text) if text else None

    @property
    def crs(self) -> str | None:
        return self.tags.get(GEO_ASCII, (None,))[0]

    @property
    def descriptions(self) -> list[str]:
        out = [""] * self.bands
        for m in re.finditer(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', self.tags.get(METADATA, ("",))[0]):
            if int(m[1]) < len(out):
                out[int(m[1])] = m[2].replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
        return out

    def layout(self) -> tuple[int, int, int, int, int]:
        """(block rows, block columns, blocks down, blocks across, bands a block)."""
        rows, cols = self.shape
        tiled = TILES in self.tags
        high, wide = (self._one(TILE_HEIGHT, 0), self._one(TILE_WIDTH, 0)) if tiled else (min(self._one(ROWS_PER_STRIP, rows), rows), cols)
        return high, wide, -(-rows // high), -(-cols // wide), 1 if self._one(PLANAR, 1) == 2 else self.bands

    def places(self) -> list[tuple[int, int, int]]:
        """(first band, first row, first column) of each strip or tile."""
        high, wide, down, across, depth = self.layout()
        count = len(self.tags[TILES] if TILES in self.tags else self.tags[STRIPS])
        out = []
        for k in range(count):
            band, inside = divmod(k, down * across)
            out.append((band if depth == 1 and self.bands > 1 else 0, inside // across * high, inside % across * wide))
        return out

    def block(self, k: int) -> np.ndarray:
        """Values (bands, rows, columns) of one strip or tile."""
        rows, cols = self.shape
        high, wide, _, _, depth = self.layout()
        bits = self.tags.get(BITS, (8,))
        if len(set(bits)) != 1 or bits[0] % 8:
            raise TiffError("bands of different or odd widths are not supported")
        dtype = np.dtype(f"{self.order}{KINDS.get(self._one(SAMPLE_FORMAT, 1), 'u')}{bits[0] // 8}")
        tiled = TILES in self.tags
        at, size = self.tags[TILES if tiled else STRIPS][k], self.tags[TILE_BYTES if tiled else STRIP_BYTES][k]
        _, r, c = self.places()[k]
        raw = self.data[at : at + size]
        kind = self._one(COMPRESSION, 1)
        if kind in (8, 32946):
            raw = zlib.decompress(raw)
        elif kind != 1:
            raise TiffError(f"compression {kind} is not supported")
        x = self._undo(raw, high if tiled else min(high, rows - r), wide, depth, dtype)
        return np.moveaxis(x, 2, 0)[:, : rows - r, : cols - c]

    def blocks(self, row: int = 0, col: int = 0, end_row: int | None = None, end_col: int | None = None, band: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(first band, first row, first column, values) of the blocks that a window of a band (from 1), or of all, touches."""
        for k in self.touching(row, col, end_row, end_col, band):
            yield *self.places()[k], self.block(k)

    def touching(self, row: int = 0, col: int = 0, end_row: int | None = None, end_col: int | None = None, band: int | None = None) -> list[int]:
        high, wide, _, _, depth = self.layout()
        rows, cols = self.shape
        end_row, end_col = rows if end_row is None else end_row, cols if end_col is None else end_col
        return [k for k, (b, r, c) in enumerate(self.places()) if r < end_row and r + high > row and c < end_col and c + wide > col and (band is None or b <= band - 1 < b + depth)]

    def _undo(self, raw: bytes, rows: int, cols: int, depth: int, dtype: np.dtype) -> np.ndarray:
        predictor = self._one(PREDICTOR, 1)
        if predictor == 3:
            wide = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
            runs = wide.reshape(rows, -1, depth).cumsum(1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * depth)
            return np.ascontiguousarray(np.moveaxis(runs, 1, 2)).view(dtype.newbyteorder(">")).reshape(rows, cols, depth).astype(dtype)
        x = np.frombuffer(raw, dtype=dtype, count=rows * cols * depth).reshape(rows, cols, depth)
        return x.cumsum(1, dtype=dtype) if predictor == 2 else x

    def read(self, band: int | None = None, row: int = 0, col: int = 0, rows: int | None = None, cols: int | None = None) -> np.ndarray:
        """A window of all bands, or of one (from 1), clamped to the raster; (bands, rows, columns)."""
        height, width = self.shape
        row, col = max(row, 0), max(col, 0)
        end_row, end_col = min(height, row + (height if rows is None else rows)), min(width, col + (width if cols is None else cols))
        if end_row <= row or end_col <= col:
            raise TiffError("the window is empty")
        if band is not None and not 1 <= band <= self.bands:
            raise TiffError(f"there is no band {band}")
        out = np.empty((self.bands, end_row - row, end_col - col), dtype=np.float64)
        for b, r, c, x in self.blocks(row, col, end_row, end_col, band):
            r0, r1, c0, c1 = max(r, row), min(r + x.shape[1], end_row), max(c, col), min(c + x.shape[2], end_col)
            if r0 < r1 and c0 < c1:
                out[b : b + len(x), r0 - row : r1 - row, c0 - col : c1 - col] = x[:, r0 - r : r1 - r, c0 - c : c1 - c]
        return out if band is None else out[band - 1 : band]


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def encode(values: np.ndarray, geo: list[float] | None = None, descriptions: list[str] | None = None, nodata: float | None = None, crs: str | None = None, tile: int | None = None, deflate: bool = True) -> bytes:
    """A float32 file of values (bands, rows, columns), chunky, in tiles or one strip per 64 rows."""
    x = np.ascontiguousarray(np.moveaxis(np.asarray(values, dtype="<f4"), 0, 2))
    rows, cols, bands = x.shape
    if not bands:
        raise TiffError("a stack has at least one band")
    step_r, step_c = (tile, tile) if tile else (64, cols)
    blocks = []
    for r in range(0, rows, step_r):
        for c in range(0, cols, step_c):
            part = x[r : r + step_r, c : c + step_c]
            if tile and part.shape[:2] != (tile, tile):
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
            blocks.append(zlib.compress(part.tobytes(), 6) if deflate else part.tobytes())
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (cols,)), HEIGHT: (4, (rows,)), BITS: (3, (32,) * bands), COMPRESSION: (3, (8 if deflate else 1,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (bands,)), PLANAR: (3, (1,)), SAMPLE_FORMAT: (3, (3,) * bands),
    }
    if bands > 1:
        tags[EXTRA] = (3, (0,) * (bands - 1))
    if geo:
        tags[PIXEL_SCALE] = (12, (geo[1], -geo[5], 0.0))
        tags[TIE_POINT] = (12, (0.0, 0.0, 0.0, geo[0], geo[3], 0.0))
        if geo[2] or geo[4] or geo[5] > 0:
            del tags[PIXEL_SCALE], tags[TIE_POINT]
            tags[TRANSFORM] = (12, (geo[1], geo[2], 0.0, geo[0], geo[4], geo[5], 0.0, geo[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    if crs:
        tags[GEO_ASCII] = (2, crs.encode("latin-1", "replace") + b"\0")
    if descriptions:
        items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(d)}</Item>' for i, d in enumerate(descriptions))
        tags[METADATA] = (2, f"<GDALMetadata>{items}</GDALMetadata>".encode("latin-1", "replace") + b"\0")
    if nodata is not None:
        tags[NODATA] = (2, f"{nodata:g}".encode() + b"\0")
    places, sizes = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
    tags[places], tags[sizes] = (4, (0,) * len(blocks)), (4, tuple(map(len, blocks)))
    tags.update({TILE_WIDTH: (3, (tile,)), TILE_HEIGHT: (3, (tile,))} if tile else {ROWS_PER_STRIP: (4, (step_r,))})
    body = lambda kind, v: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{TYPES[kind][1]}", *v)
    long = {t: body(k, v) for t, (k, v) in tags.items() if len(body(k, v)) > 4}
    at = 8 + 2 + 12 * len(tags) + 4
    spots = {}
    for t in sorted(long):
        spots[t] = at
        at += len(long[t]) + len(long[t]) % 2
    starts = []
    for b in blocks:
        starts.append(at)
        at += len(b)
    tags[places] = (4, tuple(starts))
    if places in long:
        long[places] = body(4, tags[places][1])
    out = [b"II", struct.pack("<HI", 42, 8), struct.pack("<H", len(tags))]
    for t in sorted(tags):
        kind, v = tags[t]
        n = len(v) if isinstance(v, bytes) else len(v)
        out.append(struct.pack("<HHI", t, kind, n) + (struct.pack("<I", spots[t]) if t in long else body(kind, v).ljust(4, b"\0")))
    out.append(struct.pack("<I", 0))
    for t in sorted(long):
        out.append(long[t] + b"\0" * (len(long[t]) % 2))
    return b"".join([*out, *blocks])
