"""Road ways of OpenStreetMap extracts in PBF.

A file is cut into its compressed blocks, which are spread and decoded in parallel; nodes and ways meet in a join, where
a single machine would keep an index of nodes on disk.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qhapaq.functions.roads import CLOSED, ROADS
from qhapaq.shared import written
from qhapaq.sources.files import contents, decoded

TAGS = ("highway", "maxspeed", "oneway", "junction", "access")


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 2:
            n, at = varint(raw, at)
            value, at = raw[at: at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = raw[at: at + n], at + n
        yield key >> 3, value


def numbers(raw: bytes, signed: bool = False, summed: bool = False) -> list[int]:
    """A packed list, zigzag-decoded and added up as asked."""
    out, at, total = [], 0, 0
    while at < len(raw):
        v, at = varint(raw, at)
        v = (v >> 1) ^ -(v & 1) if signed else v
        total = total + v if summed else v
        out.append(total)
    return out


def blocks(raw: bytes) -> Iterator[bytes]:
    """The compressed data blocks of a file."""
    at = 0
    while at + 4 <= len(raw):
        n = struct.unpack_from(">I", raw, at)[0]
        header = dict(message(raw[at + 4: at + 4 + n]))
        at += 4 + n
        if header[1] == b"OSMData":
            yield raw[at: at + header[3]]
        at += header[3]


def opened(blob: bytes) -> bytes:
    parts = dict(message(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("blocks are read raw or zlib-compressed")


def elements(block: bytes) -> tuple[list[tuple[int, float, float]], list[tuple]]:
    """(id, lon, lat) of nodes, and (id, refs, tags ...) of ways that have a road class of any profile."""
    texts, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for f, v in message(block):
        if f == 1:
            texts = [s.decode("utf-8", "replace") for g, s in message(v) if g == 1]
        elif f == 2:
            groups.append(v)
        elif f == 17:
            grain = v
        elif f in (19, 20):
            v = v - 2**64 if v >= 2**63 else v
            lat0, lon0 = (v, lon0) if f == 19 else (lat0, v)
    degrees = lambda v, base: 1e-9 * (base + grain * v)
    unsigned = lambda v: (v >> 1) ^ -(v & 1)
    nodes, ways, roads = [], [], frozenset().union(*ROADS.values())
    for group in groups:
        for f, v in message(group):
            if f == 1:
                own = {g: x for g, x in message(v) if g in (1, 8, 9)}
                nodes.append((unsigned(own[1]), degrees(unsigned(own[9]), lon0), degrees(unsigned(own[8]), lat0)))
            elif f == 2:
                own = {g: x for g, x in message(v) if g in (1, 8, 9)}
                if 1 in own:
                    ids, lats, lons = (numbers(own[g], True, True) for g in (1, 8, 9))
                    nodes += [(i, degrees(x, lon0), degrees(y, lat0)) for i, x, y in zip(ids, lons, lats)]
            elif f == 3:
                own = dict(message(v))
                tags = {texts[k]: texts[x] for k, x in zip(numbers(own.get(2, b"")), numbers(own.get(3, b"")))}
                if tags.get("highway") in roads:
                    ways.append((own[1], numbers(own.get(8, b""), True, True), *map(tags.get, TAGS)))
    return nodes, ways


def read_roads(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, margin: float = 0.3) -> DataFrame:
    """way_id, pts, highway, maxspeed, oneway, junction, access of open road ways with two known points or more; with a
    box, of those that have a point in it or its margin."""
    files = contents(spark, path)
    cut = written(decoded(files, lambda raw: (pd.DataFrame({"blob": [b]}) for b in blocks(raw)), "blob binary"), "osm-blocks")
    spread = cut.repartition(max(1, min(10_000, cut.count())))

    def nodes(parts):
        for part in parts:
            for blob in part["blob"]:
                yield pd.DataFrame(elements(opened(bytes(blob)))[0], columns=["ref", "lon", "lat"])

    def ways(parts):
        for part in parts:
            for blob in part["blob"]:
                yield pd.DataFrame(elements(opened(bytes(blob)))[1], columns=["way_id", "refs", *TAGS])

    tags = ", ".join(f"{t} string" for t in TAGS)
    way = spread.mapInPandas(ways, f"way_id long, refs array<long>, {tags}").filter(~F.coalesce(F.col("access").isin(*CLOSED), F.lit(False)) & (F.size("refs") >= 2))
    steps = way.select("way_id", F.posexplode("refs").alias("i", "ref"))
    placed = steps.join(spread.mapInPandas(nodes, "ref long, lon double, lat double"), "ref", "left")
    pts = placed.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))).alias("p"))
    pts = pts.filter(~F.exists("p", lambda p: p["lon"].isNull())).select("way_id", F.transform("p", lambda p: F.struct(p["lon"], p["lat"])).alias("pts"))
    out = way.drop("refs").join(pts, "way_id")
    if box:
        out = out.filter(F.exists("pts", lambda p: p["lon"].between(box[0] - margin, box[2] + margin) & p["lat"].between(box[1] - margin, box[3] + margin)))
    return out
