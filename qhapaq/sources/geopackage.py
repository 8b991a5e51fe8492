"""GeoPackage layers."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from qhapaq.sources.files import contents, decoded

ENVELOPES = (0, 32, 48, 48, 64)


def well_known(raw: bytes, at: int = 0) -> tuple[str, list, int]:
    """(point or polygon, coordinates, end) of well-known binary; z and m are skipped. Points are [(x, y)], polygons rings."""
    order = "<" if raw[at] else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    kind, size = code % 1000 & 0xFF, 2 + (code // 1000 in (1, 3) or bool(code & 0x80000000)) + (code // 1000 in (2, 3) or bool(code & 0x40000000))
    at += 5 + 4 * bool(code & 0x20000000)

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * size}d", raw, at)
        at += 8 * n * size
        return [(flat[i * size], flat[i * size + 1]) for i in range(n)]

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    if kind == 1:
        return "point", points(1), at
    if kind == 3:
        return "polygon", [points(count()) for _ in range(count())], at
    if kind in (4, 6):
        out, name = [], "polygon" if kind == 6 else "point"
        for _ in range(count()):
            _, part, at = well_known(raw, at)
            out += part
        return name, out, at
    raise ValueError(f"geometry type {kind} is not read")


def geometry(blob: bytes | None) -> tuple[float | None, float | None, list | None]:
    """(lon, lat, rings) of a GeoPackage geometry; null for none or an empty one."""
    if not blob or blob[3] & 16:
        return None, None, None
    kind, found, _ = well_known(blob, 8 + ENVELOPES[blob[3] >> 1 & 7])
    if kind == "point":
        x, y = found[0]
        return (None, None, None) if x != x else (x, y, None)
    return None, None, [[{"x": x, "y": y} for x, y in ring] for ring in found]


def layer(raw: bytes, name: str | None, columns: list[str] | None = None) -> Iterator[pd.DataFrame]:
    """Rows of a layer (the first, if unnamed) as text, with lon, lat and rings."""
    db = sqlite3.connect(":memory:")
    db.deserialize(raw)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    table, shape = db.execute("select table_name, column_name from gpkg_geometry_columns where ? is null or table_name = ? order by 1", (name, name)).fetchone()
    names = [r[1] for r in db.execute(f'pragma table_info("{table}")') if r[1] != shape]
    if columns is None:
        yield pd.DataFrame({"name": names})
        return
    picked = ", ".join(f'"{n}"' for n in [shape, *columns])
    found = db.execute(f'select {picked} from "{table}"')
    while rows := found.fetchmany(5000):
        places = [geometry(r[0]) for r in rows]
        yield pd.DataFrame([(*[None if v is None else str(v) for v in r[1:]], *p) for r, p in zip(rows, places)], columns=[*columns, "lon", "lat", "rings"])


def read_geopackage(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A layer of point or polygon features: attributes as text, and lon, lat or rings (multi-polygons as all rings)."""
    files = contents(spark, path)
    columns = [r[0] for r in decoded(files, lambda raw: layer(raw, name), "name string").collect()]
    schema = ", ".join(f"`{c}` string" for c in columns) + ", lon double, lat double, rings array<array<struct<x:double,y:double>>>"
    return decoded(files, lambda raw: layer(raw, name, columns), schema)
