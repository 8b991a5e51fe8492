import io
import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from qhapaq.sources import delimited, geopackage, osm, raster, resolve, shapefile


def test_text_tables(spark, tmp_path):
    text = "COD;NOMBRE;UBIGEO\n1;ÑAÑA;010101\n2;B;\n"
    (tmp_path / "a.csv").write_bytes(text.encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(text.encode("latin-1"))
    for name, used in (("a.csv", "utf-8-sig"), ("b.csv", "ISO-8859-1")):
        df, note = delimited.read_text_table(spark, str(tmp_path / name))
        assert note["encoding_usado"] == used and df.columns == ["COD", "NOMBRE", "UBIGEO"]
        assert [tuple(r) for r in df.collect()] == [("1", "ÑAÑA", "010101"), ("2", "B", None)]
    assert delimited.download(df).startswith(b"\xef\xbb\xbfCOD,NOMBRE")
    with pytest.raises(ValueError):
        delimited.download(df, 1)
    delimited.write_by_department(df.withColumnRenamed("COD", "departamento"), str(tmp_path / "out"))
    plan = spark.read.parquet(str(tmp_path / "out")).filter("departamento = 1")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull" in plan._jdf.queryExecution().executedPlan().toString()


def dbf(names, rows, deleted=()):
    out = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(rows), 32 + 32 * len(names) + 1, 1 + 8 * len(names))
    out += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15) for n in names) + b"\r"
    return out + b"".join((b"*" if i in deleted else b" ") + b"".join(v.encode().ljust(8) for v in r) for i, r in enumerate(rows))


def shp(bodies):
    out = bytes(100)
    for i, b in enumerate(bodies):
        out += struct.pack(">ii", i + 1, len(b) // 2) + b
    return out


def test_shapefiles(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    polygon = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    bodies = [struct.pack("<idd", 1, -77.0, -12.0), struct.pack("<idd", 1, -70.0, -5.0), struct.pack("<i", 0), polygon]
    (tmp_path / "p.shp").write_bytes(shp(bodies))
    (tmp_path / "p.dbf").write_bytes(dbf(["UBIGEO", "NOMCP"], [("010101", "Ñ"), ("020202", "gone"), ("", "none"), ("4", "area")], deleted=[1]))
    got = {r["_record"]: r for r in shapefile.read_shapefile(spark, str(tmp_path / "p.shp")).collect()}
    assert set(got) == {1, 3, 4} and (got[1]["lon"], got[1]["lat"], got[1]["UBIGEO"], got[1]["NOMCP"]) == (-77, -12, "010101", "Ñ")
    assert got[3]["lon"] is None and got[3]["UBIGEO"] is None and [(p["x"], p["y"]) for p in got[4]["rings"][0]] == ring


def test_geopackages(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('d', 'geom')")
    db.execute("create table d (fid integer primary key, geom blob, ubigeo text)")
    head = b"GP\0\x01" + struct.pack("<i", 4326)
    wkb = lambda code, body: struct.pack("<BI", 1, code) + body
    square = struct.pack("<II", 1, 4) + b"".join(struct.pack("<dd", *p) for p in [(0, 0), (1, 0), (1, 1), (0, 0)])
    blobs = [head + wkb(1, struct.pack("<dd", 1, 2)), head + wkb(3, square), head + wkb(6, struct.pack("<I", 2) + wkb(3, square) * 2), head[:3] + b"\x11" + head[4:] + wkb(3, bytes(4)), None,
             b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + struct.pack(">BIddd", 0, 1001, 5, 6, 7)]
    db.executemany("insert into d (geom, ubigeo) values (?, ?)", [(b, f"0{i}") for i, b in enumerate(blobs)])
    db.commit()
    db.close()
    got = {r["ubigeo"]: r for r in geopackage.read_geopackage(spark, str(tmp_path / "g.gpkg")).collect()}
    assert (got["00"]["lon"], got["00"]["lat"]) == (1, 2) and len(got["01"]["rings"]) == 1 and len(got["02"]["rings"]) == 2
    assert got["03"]["rings"] is None and got["04"]["lon"] is None and (got["05"]["lon"], got["05"]["lat"]) == (5, 6) and got["05"]["fid"] == "6"


def vint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def field(n, v):
    return vint(n << 3) + vint(v) if isinstance(v, int) else vint(n << 3 | 2) + vint(len(v)) + v


def packed(values, delta=False):
    out, last = b"", 0
    for v in values:
        d, last = v - last if delta else v, v
        out += vint((d << 1) ^ (d >> 63) if delta else d)
    return out


def pbf(strings, nodes, ways, dense=True):
    table = b"".join(field(1, s.encode()) for s in strings)
    scale = [(i, round(lat * 1e7), round(lon * 1e7)) for i, lon, lat in nodes]
    if dense:
        group = field(2, field(1, packed([n[0] for n in scale], True)) + field(8, packed([n[1] for n in scale], True)) + field(9, packed([n[2] for n in scale], True)))
    else:
        zig = lambda v: (v << 1) ^ (v >> 63)
        group = b"".join(field(1, field(1, zig(i)) + field(8, zig(a)) + field(9, zig(o))) for i, a, o in scale)
    group += b"".join(field(3, field(1, i) + field(2, packed([strings.index(k) for k in t])) + field(3, packed([strings.index(v) for v in t.values()])) + field(8, packed(refs, True))) for i, refs, t in ways)
    raw = field(1, table) + field(2, group)
    blob = field(2, len(raw)) + field(3, zlib.compress(raw))
    header = field(1, b"OSMData") + field(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


def test_road_extracts(spark, tmp_path):
    strings = ["", "highway", "primary", "footway", "maxspeed", "50", "access", "private", "building"]
    first = pbf(strings, [(1, -77.0, -12.0), (2, -77.1, -12.0), (3, 10.0, 10.0)], [])
    second = pbf(strings, [(4, -77.2, -12.1)], [(10, [1, 2, 4], {"highway": "primary", "maxspeed": "50"}), (11, [1, 2], {"highway": "footway", "access": "private"}), (12, [1, 2], {"building": "primary"}),
                                               (13, [1], {"highway": "primary"}), (14, [1, 99], {"highway": "primary"}), (15, [3, 3], {"highway": "footway"})], dense=False)
    skip = field(1, b"OSMHeader") + field(3, 3)
    (tmp_path / "r.pbf").write_bytes(struct.pack(">I", len(skip)) + skip + b"abc" + first + second)
    got = {r["way_id"]: r for r in osm.read_roads(spark, str(tmp_path / "r.pbf")).collect()}
    assert set(got) == {10, 15} and [(round(p["lon"], 7), round(p["lat"], 7)) for p in got[10]["pts"]] == [(-77.0, -12.0), (-77.1, -12.0), (-77.2, -12.1)]
    assert got[10]["maxspeed"] == "50" and got[10]["oneway"] is None
    assert {r["way_id"] for r in osm.read_roads(spark, str(tmp_path / "r.pbf"), (-77.0, -12.0, -76.0, -11.0)).collect()} == {10}


def tiff(values, compression=1, encode=lambda b: b, rows=2):
    h, w = values.shape
    strips = [encode(values[i: i + rows].astype("<f4").tobytes()) for i in range(0, h, rows)]
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [32]), (259, 3, [compression]), (273, 4, None), (278, 3, [rows]), (279, 4, [len(s) for s in strips]), (339, 3, [3]),
               (33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0.0, 0.0, 0.0, -80.0, -4.0, 0.0]), (42113, 2, b"-99999\0")]
    data, at = b"".join(strips), 8
    entries[4] = (273, 4, [8 + sum(map(len, strips[:i])) for i in range(len(strips))])
    at += len(data)
    start = at
    extra, table = b"", b""
    base = start + 2 + 12 * len(entries) + 4
    for tag, kind, v in entries:
        n = len(v)
        body = v if kind == 2 else struct.pack(f"<{n}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *v)
        if len(body) <= 4:
            table += struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, kind, n, base + len(extra))
            extra += body
    return b"II*\0" + struct.pack("<I", start) + data + struct.pack("<H", len(entries)) + table + bytes(4) + extra


def lzw_encoded(raw):
    table, size, width, codes, word = {bytes([i]): i for i in range(256)}, 258, 9, [(256, 9)], b""
    for b in raw:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        codes.append((table[word], width))
        table[word + bytes([b])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes([b])
    codes += [(table[word], width)] if word else []
    size += 1
    codes.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(bits[i: i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("how, encode", [(1, lambda b: b), (8, zlib.compress), (5, lzw_encoded)])
def test_rasters(spark, tmp_path, how, encode):
    values = np.array([[1.5, -99999, 0, 2], [np.nan, -3, 4, 0.25], [7, 0, 0, 0]])
    (tmp_path / "r.tif").write_bytes(tiff(values, how, encode))
    got = {(r["cx"], r["cy"]): r["val"] for r in raster.read_raster(spark, str(tmp_path / "r.tif")).collect()}
    assert got == {(-79.75, -4.25): 1.5, (-78.25, -4.25): 2, (-78.75, -4.75): 4, (-78.25, -4.75): 0.25, (-79.75, -5.25): 7}
    assert raster.read_raster(spark, str(tmp_path / "r.tif"), (-79.0, -5.0, -78.0, -4.5)).count() == 2


def test_lzw_of_longer_data():
    raw = np.random.default_rng(0).integers(0, 6, 9000, np.uint8).tobytes()[:3500]
    assert raster.lzw(lzw_encoded(raw)) == raw


class Page(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.close()


def test_resolving(tmp_path):
    log, local = tmp_path / "log.json", tmp_path / "in" / "x.csv"
    log.write_text("broken")
    page = b"REG_30-04-2026.csv REG_01-05-2026.csv REG_02-01-2026.csv"
    asked = []

    def opener(url):
        asked.append(url)
        if len(asked) == 1:
            raise ConnectionError("once")
        return Page(page if url.endswith("list") else b"data")

    source = resolve.Source("reg", local, url="https://x.test/list", pattern=r"REG_\d{2}-\d{2}-\d{4}\.csv")
    slept = []
    assert resolve.retried(lambda: 5, sleep=slept.append) == 5
    resolve.time.sleep, keep = slept.append, resolve.time.sleep
    try:
        resolve.retried.__defaults__ = (3, 0.0, slept.append)
        assert resolve.resolve(source, log, opener) == "descargado"
    finally:
        resolve.time.sleep = keep
    assert local.read_bytes() == b"data" and asked[-1] == "https://x.test/REG_01-05-2026.csv" and not list(tmp_path.glob("in/*.part"))
    assert resolve.resolve(source, log, opener) == "existente"
    (tmp_path / "c.shp").write_bytes(b"s")
    (tmp_path / "c.dbf").write_bytes(b"d")
    assert resolve.resolve(resolve.Source("shp", tmp_path / "in" / "p.shp", cache=tmp_path / "c.shp"), log) == "cache" and (tmp_path / "in" / "p.dbf").read_bytes() == b"d"
    assert resolve.resolve(resolve.Source("m", tmp_path / "none", manual=True), log) == "manual"
    assert set(json.loads(log.read_text())) == {"reg", "shp", "m"}
    with pytest.raises(OSError):
        resolve.retried(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=slept.append)
