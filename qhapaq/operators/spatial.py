"""Points in polygons, nearest neighbours and population by nearest place, over grid cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.config import SETTINGS
from qhapaq.functions.geo import haversine, local_xy
from qhapaq.operators.ordered import quantiles
from qhapaq.shared import ship, written

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is strictly inside the area of closed rings (odd crossings; the boundary is outside)."""
    def edges(ring: Column) -> Column:
        return F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
                          lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    all_edges = F.flatten(F.transform(rings, edges))
    on = F.exists(all_edges, lambda e: (
        ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))))
    crossed = F.size(F.filter(all_edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (
        x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])))
    return ~on & (crossed % 2 == 1)


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size)


def within(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, *, x: str = "lon", y: str = "lat", cell: float = 0.5) -> DataFrame:
    """points left-joined to the polygon they lie in (null outside all); of several the one with the least id.

    polygons: polygon_id and rings. Both sides meet in grid cells of the polygons' boxes, so the join is on equality; only
    polygons of a cell are tested.
    """
    flat = F.flatten(F.col("rings"))
    low = lambda c: F.array_min(F.transform(flat, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(flat, lambda p: p[c]))
    cells = (polygons.select(F.col(polygon_id).alias("_poly"), "rings", F.explode(F.sequence(_cell(low("x"), cell), _cell(high("x"), cell))).alias("_cx"),
                             _cell(low("y"), cell).alias("_y0"), _cell(high("y"), cell).alias("_y1"))
             .withColumn("_cy", F.explode(F.sequence("_y0", "_y1"))).drop("_y0", "_y1"))
    placed = points.withColumns({"_cx": _cell(F.col(x), cell), "_cy": _cell(F.col(y), cell)})
    hits = placed.select(point_id, x, y, "_cx", "_cy").join(cells, ["_cx", "_cy"]).filter(inside(F.col("rings"), F.col(x), F.col(y)))
    first = hits.groupBy(point_id).agg(F.min("_poly").alias(polygon_id))
    return points.join(first, point_id, "left")


def outside_own_district(points: DataFrame, polygons: DataFrame, point_id: str, own: str, polygon_id: str = "ubigeo", **where) -> DataFrame:
    """points with fuera_de_su_distrito: in no polygon, or in another than the one its code names (as texts)."""
    found = within(points, polygons, point_id, polygon_id, **where)
    other = F.col(polygon_id).isNull() | ~F.coalesce(F.col(polygon_id).cast("string") == F.col(own).cast("string"), F.lit(False))
    return found.withColumn("fuera_de_su_distrito", other)


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, *, x: str = "_x", y: str = "_y", group: str | None = None,
            at_lat: str | float | None = None) -> DataFrame:
    """(point_id, target_id, distance) of the nearest target in the plane, exactly; ties to the least target id.

    Points look into the three by three cells around their own. If what they find is closer than the edge of those
    cells it is the nearest; the other points look again in cells of twice the size. Only unresolved points go on, and
    cells start small where targets are dense on average, so joins stay near linear. With group, only targets of the
    point's group count. With at_lat (a value, or a column of both sides that is one value in a group) x and y are
    degrees and distances are metres of local_xy: differences are taken before they are scaled, since scaled coordinates
    are rounded a hundred times more coarsely than the differences and part or join targets at equal distances.
    """
    same, own = (["_g"] if group else []), (["_at"] if isinstance(at_lat, str) else [])
    plane = (lambda a, b: (a, b)) if at_lat is None else (lambda a, b: local_xy(a, b, F.col("_at") if own else float(at_lat)))

    def pick(d: DataFrame, i: str, name: str) -> DataFrame:
        rows = d.select(F.col(i).alias("_id"), F.col(x).cast("double").alias("_a"), F.col(y).cast("double").alias("_b"), *([F.col(group).alias("_g")] if group else []),
                        *([F.col(at_lat).alias("_at")] if own else []))
        px, py = plane(F.col("_a"), F.col("_b"))
        return rows.withColumns({f"_{name}x": px, f"_{name}y": py}).filter(F.col(f"_{name}x").isNotNull() & F.col(f"_{name}y").isNotNull())

    left = pick(points, point_id, "p")
    right = written(pick(targets, target_id, "t").drop("_at").withColumnsRenamed({"_id": "_t", "_a": "_ta", "_b": "_tb"}), "targets")
    ids = (dict(left.dtypes)["_id"], dict(right.dtypes)["_t"])
    reach = right.agg(F.count("*"), F.min("_tx"), F.max("_tx"), F.min("_ty"), F.max("_ty")).first()
    empty = points.sparkSession.createDataFrame([], f"{point_id} {ids[0]}, {target_id} {ids[1]}, distance double")
    if not reach[0]:
        return empty
    if group:
        left = left.join(right.select("_g").distinct(), "_g", "left_semi")
    around = left.agg(F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py")).first()
    if around[0] is None:
        return empty
    width = max(reach[2] - reach[1], reach[4] - reach[3], 1e-9)
    whole = max(reach[2], around[1]) - min(reach[1], around[0]) + max(reach[4], around[3]) - min(reach[3], around[2])
    rounding = 1e-12 * max(map(abs, [*reach[1:], *around]))  # cells are of rounded coordinates
    size, found = width / max(1.0, reach[0] ** 0.5), []
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while True:
        all_in = size >= whole
        cells = right.withColumns({"_cx": _cell(F.col("_tx"), size), "_cy": _cell(F.col("_ty"), size)}).withColumn("_n", near)
        cells = cells.select("_t", "_ta", "_tb", *same, (F.col("_cx") + F.col("_n.i")).alias("_cx"), (F.col("_cy") + F.col("_n.j")).alias("_cy"))
        placed = left.withColumns({"_cx": _cell(F.col("_px"), size), "_cy": _cell(F.col("_py"), size)})
        dx, dy = plane(F.col("_a") - F.col("_ta"), F.col("_b") - F.col("_tb"))
        met = placed.join(cells, ["_cx", "_cy", *same]).select("_id", "_t", dx.alias("_dx"), dy.alias("_dy"))
        d2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
        best = met.groupBy("_id").agg(F.min(F.struct(d2.alias("d2"), F.col("_t").alias("t"))).alias("_best"))
        edge = F.least(F.col("_px") - F.col("_cx") * size, (F.col("_cx") + 1) * size - F.col("_px"),
                       F.col("_py") - F.col("_cy") * size, (F.col("_cy") + 1) * size - F.col("_py")) + size - rounding
        done = written(placed.join(best, "_id", "left").withColumn("_ok", F.coalesce(F.sqrt("_best.d2") < edge, F.lit(False)) | F.lit(all_in)), "nearest")
        found.append(done.filter(F.col("_ok") & F.col("_best").isNotNull()).select(F.col("_id").alias(point_id), F.col("_best.t").alias(target_id), F.sqrt("_best.d2").alias("distance")))
        left = done.filter(~F.col("_ok")).select(*left.columns)
        if all_in or left.isEmpty():
            break
        size *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def snapped(points: DataFrame, nodes: DataFrame, point_id: str, *, most_m: float = SETTINGS.snap_m) -> DataFrame:
    """Each point with its nearest graph node, the distance on the sphere, and whether it is close enough.

    nodes: node, lon, lat. The plane is scaled at the median latitude of the nodes.
    """
    middle = quantiles(nodes, [], "lat", {"m": 0.5}).first()[0]
    close = nearest(points, nodes, point_id, "node", x="lon", y="lat", at_lat=float(middle or 0.0)).drop("distance")
    joined = points.join(close, point_id).join(nodes.select("node", F.col("lon").alias("nodo_lon"), F.col("lat").alias("nodo_lat")), "node")
    metres = haversine(F.col("lon"), F.col("lat"), F.col("nodo_lon"), F.col("nodo_lat"))
    return joined.withColumn("snap_dist_m", metres).withColumn("snap_ok", F.col("snap_dist_m") <= most_m)


def snap_summary(snaps: DataFrame, *keys: str) -> DataFrame:
    rows = written(snaps.select(*keys, "snap_dist_m", "snap_ok"), "snaps")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_puntos"), F.count_if(~F.col("snap_ok")).alias("n_snap_fallido"),
                                   F.round(F.avg("snap_dist_m"), 1).alias("snap_dist_media_m"), F.round(F.max("snap_dist_m"), 1).alias("snap_dist_max_m"))
    tails = quantiles(rows, keys, "snap_dist_m", {"p95": 0.95})
    return sums.join(tails, list(keys)).select(*keys, "n_puntos", "n_snap_fallido", "snap_dist_media_m", F.round("p95", 1).alias("snap_dist_p95_m"), "snap_dist_max_m")


def people_by_place(cells: DataFrame, places: DataFrame, *, group: str | None = None, polygons: DataFrame | None = None, places_after: int = 1) -> DataFrame:
    """(cod_ccpp, poblacion): each cell's value goes to the nearest place, of the cell's group if there are groups.

    cells: cell_id, cx, cy, val (null, negative and zero values count nothing). With polygons (group, rings) a cell's
    group is the polygon it lies in, and cells in none are left out. Places that get nothing have 0.
    """
    live = cells.filter((F.col("val") > 0) & ~F.isnan("val") & (F.col("val") < float("inf")))
    if polygons is not None:
        live = within(live, polygons, "cell_id", group, x="cx", y="cy").filter(F.col(group).isNotNull())
    if group:
        middle = written(quantiles(places, [group], "lat", {"_lat0": 0.5}), "middles")
        at, near_by = "_lat0", lambda d: d.join(middle, group)
    else:
        at, near_by = float(quantiles(places, [], "lat", {"m": 0.5}).first()[0] or 0.0), lambda d: d
    placed = near_by(places).withColumnsRenamed({"lon": "cx", "lat": "cy"})
    close = nearest(near_by(live), placed, "cell_id", "cod_ccpp", x="cx", y="cy", group=group, at_lat=at)
    sums = close.join(live.select("cell_id", "val"), "cell_id").groupBy("cod_ccpp").agg(F.sum("val").alias("s"))
    return places.select("cod_ccpp").distinct().join(sums, "cod_ccpp", "left").select("cod_ccpp", F.round(F.coalesce("s", F.lit(0.0)), places_after).alias("poblacion"))


def interior_point(rings: list[list[tuple[float, float]]]) -> tuple[float, float] | None:
    """A point inside an area: the middle of the widest inner stretch of the line halfway up (or close to it)."""
    points = np.array([p for ring in rings for p in ring], float)
    if not len(points):
        return None
    low, high = points[:, 1].min(), points[:, 1].max()
    for part in (0.5, 0.4873, 0.3719, 0.6391, 0.2113, 0.8057):
        y, xs = low + (high - low) * part, []
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                if (ay > y) != (by > y):
                    xs.append(ax + (bx - ax) * (y - ay) / (by - ay))
        xs.sort()
        spans = [(b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2]) if b > a]
        if spans:
            return max(spans)[1], y
    return float(points[:, 0].mean()), float(points[:, 1].mean())


def interior_points(polygons: DataFrame, polygon_id: str = "ubigeo") -> DataFrame:
    """(polygon_id, lon, lat) of a point inside each polygon."""
    ship(polygons.sparkSession)
    rows = polygons.select(polygon_id, "rings")
    schema = f"{polygon_id} {dict(rows.dtypes)[polygon_id]}, lon double, lat double"

    def run(parts):
        for d in parts:
            at = [interior_point([[(p["x"], p["y"]) for p in ring] for ring in (rings if rings is not None else [])]) for rings in d["rings"]]
            yield pd.DataFrame({polygon_id: d[polygon_id], "lon": [p[0] if p else None for p in at], "lat": [p[1] if p else None for p in at]})

    return rows.mapInPandas(run, schema)


def buffered_bounds(points: DataFrame, km: float) -> DataFrame:
    """One row minx, miny, maxx, maxy: the box of all points grown by so many (web mercator) kilometres."""
    from qhapaq.functions.geo import from_web_mercator, web_mercator

    x, y = web_mercator(F.col("lon"), F.col("lat"))
    box = points.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    low = from_web_mercator(F.col("x0") - km * 1000, F.col("y0") - km * 1000)
    high = from_web_mercator(F.col("x1") + km * 1000, F.col("y1") + km * 1000)
    return box.select(low[0].alias("minx"), low[1].alias("miny"), high[0].alias("maxx"), high[1].alias("maxy"))
