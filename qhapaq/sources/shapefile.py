"""Point and polygon shapefiles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qhapaq.sources.files import contents, decoded, head

POINTS, POLYGONS = (1, 11, 21), (5, 15, 25)
BATCH = 10_000


def shapes(raw: bytes) -> Iterator[tuple[int, float | None, float | None, list | None]]:
    """(record number, x, y, rings) from the bytes of a .shp; all null for empty shapes."""
    at = 100
    while at + 8 <= len(raw):
        number, words = struct.unpack_from(">ii", raw, at)
        kind = struct.unpack_from("<i", raw, at + 8)[0]
        if kind in POINTS:
            x, y = struct.unpack_from("<dd", raw, at + 12)
            yield number, x, y, None
        elif kind in POLYGONS:
            parts, points = struct.unpack_from("<ii", raw, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", raw, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", raw, at + 52 + 4 * parts)
            yield number, None, None, [[{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        else:
            yield number, None, None, None
        at += 8 + 2 * words


def fields(raw: bytes) -> list[tuple[str, str, int]]:
    """(name, type, length) of a .dbf."""
    out, at = [], 32
    while raw[at: at + 1] not in (b"\r", b""):
        out.append((raw[at: at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16]))
        at += 32
    return out


def records(raw: bytes, encoding: str) -> Iterator[tuple]:
    """(record number, values as text or null ...) of a .dbf; deleted records keep their number and are left out."""
    n, start, size = struct.unpack_from("<IHH", raw, 4)
    widths = [w for *_, w in fields(raw)]
    for i in range(n):
        row = raw[start + i * size: start + (i + 1) * size]
        if row[:1] == b"*":
            continue
        out, at = [], 1
        for w in widths:
            out.append(row[at: at + w].decode(encoding, "replace").strip() or None)
            at += w
        yield i + 1, *out


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """path names the .shp; the .dbf lies beside it. Columns: _record, lon, lat, rings and the attributes as text."""
    table = path.removesuffix(".shp") + ".dbf"
    names = [n for n, *_ in fields(head(spark, table, 65_536))]
    shape = decoded(contents(spark, path), lambda raw: _batches(shapes(raw), ["_record", "lon", "lat", "rings"]),
                    "_record long, lon double, lat double, rings array<array<struct<x:double,y:double>>>")
    columns = ["_record", *names]
    data = decoded(contents(spark, table), lambda raw: _batches(records(raw, encoding), columns), "_record long, " + ", ".join(f"`{n}` string" for n in names))
    return shape.join(data, "_record")


def text_to_number(df: DataFrame, *columns: str) -> DataFrame:
    from qhapaq.functions.text import number

    return df.withColumns({c: number(F.col(c)) for c in columns})
