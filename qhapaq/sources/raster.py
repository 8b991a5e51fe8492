"""Population rasters in GeoTIFF: one band of floats, stripped or tiled, plain, deflate or LZW."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from qhapaq.sources.files import contents, decoded

#: TIFF tags and the sizes and codes of its value types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE, NODATA = 33550, 33922, 42113
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}


def lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes from the most significant bit, 9 to 12 bits, 256 clears and 257 ends."""
    out, table, width, held, bits, last = [], {}, 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = {i: bytes([i]) for i in range(256)}, 9, b""
            size = 258
            continue
        entry = table[code] if code in table else last + last[:1]
        out.append(entry)
        if last:
            table[size] = last + entry[:1]
            size += 1
        last = entry
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


def tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", raw, 4)[0]
    found = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if kind in TYPES:
            size, code = TYPES[kind]
            where = at + 10 + 12 * i if size * n <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
            found[tag] = (raw[where: where + n],) if kind == 2 else struct.unpack_from(f"{order}{code * n}" if len(code) > 1 else f"{order}{n}{code}", raw, where)
    return order, found


def cells(raw: bytes, box: tuple[float, float, float, float] | None = None) -> Iterator[pd.DataFrame]:
    """cx, cy, val of cells with a finite value above 0 that is not "no data", block by block; with a box, of blocks and
    cells in it only."""
    order, t = tags(raw)
    width, height, how = t[WIDTH][0], t[HEIGHT][0], t.get(COMPRESSION, (1,))[0]
    if how not in (1, 5, 8, 32946) or t.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError("the raster's compression is not read")
    kind = np.dtype({(3, 32): "f4", (3, 64): "f8", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4"}[t.get(FORMAT, (1,))[0], t[BITS][0]]).newbyteorder(order)
    tiled = TILE_WIDTH in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, t.get(ROWS, (height,))[0])
    offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[OFFSETS], t[COUNTS])
    sx, sy = t[SCALE][:2]
    x0, y0 = t[TIE][3] - t[TIE][0] * sx, t[TIE][4] + t[TIE][1] * sy
    text = t[NODATA][0].split(b"\0")[0].strip() if NODATA in t else b""
    across = -(-width // bw)
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        col, row = k % across * bw, k // across * bh
        cx, cy = x0 + (col + np.arange(bw) + 0.5) * sx, y0 - (row + np.arange(bh) + 0.5) * sy
        if box and (cx[0] > box[2] or cx[-1] < box[0] or cy[-1] > box[3] or cy[0] < box[1]):
            continue
        data = raw[offset: offset + count]
        data = lzw(data) if how == 5 else zlib.decompress(data) if how != 1 else data
        high = bh if tiled else min(bh, height - row)
        block = np.frombuffer(data, kind, high * bw).reshape(high, bw)
        if t.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        block = block[: max(0, height - row), : max(0, width - col)].astype(float)
        live = np.isfinite(block) & (block > 0)
        if text:
            live &= block != float(np.float32(text)) if kind.itemsize == 4 and kind.kind == "f" else block != float(text)
        i, j = np.nonzero(live)
        d = pd.DataFrame({"cx": cx[j], "cy": cy[i], "val": block[i, j]})
        if box:
            d = d[d["cx"].between(box[0], box[2]) & d["cy"].between(box[1], box[3])]
        if len(d):
            yield d


def read_raster(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    return decoded(contents(spark, path), lambda raw: cells(raw, box), "cx double, cy double, val double")
