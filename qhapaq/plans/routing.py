"""From places, facilities and ways to the travel-time matrix and nearest access, for all departments and profiles."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings
from qhapaq.operators import access, graph, paths, spatial
from qhapaq.shared import written

LOG = logging.getLogger(__name__)
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Routed:
    """matrix: cod_ccpp, cod_ipress, profile, duration_s, distance_m. snaps: one row per point and profile. failed: what went
    wrong, by (department, profile); the others go on without it."""

    matrix: DataFrame
    snaps: DataFrame
    failed: dict[tuple[str | None, str], str]

    def access(self) -> DataFrame:
        return access.nearest_access(self.matrix)

    def snap_report(self) -> DataFrame:
        return spatial.snap_summary(self.snaps, "profile", "tipo")


def _node_id(struct: str) -> F.Column:
    """A junction as one text, so that it is a plain key."""
    return F.concat_ws(":", F.col(f"{struct}.x").cast("string"), F.col(f"{struct}.y").cast("string"))


def _graph(ways: DataFrame, profile: str, box: Box | None, settings: Settings) -> DataFrame:
    """The largest component of a profile's edges, written."""
    edges = graph.edges(ways, profile, box, settings=settings).select(_node_id("src").alias("src"), _node_id("dst").alias("dst"), "length", "travel_time")
    return written(graph.largest_component(edges), f"graph-{profile}")


def _cell(places: DataFrame, facilities: DataFrame, edges: DataFrame, profile: str, whole: bool, settings: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """Matrix and snaps of one department and profile, worked out and written."""
    corner = F.split("node", ":")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select(
        "node", (corner[0].cast("double") / 1e7).alias("lon"), (corner[1].cast("double") / 1e7).alias("lat"))
    ends = access.destinations(facilities, settings) if whole else facilities.filter("resolutiva")
    origin = written(spatial.snapped(places.select("cod_ccpp", "lon", "lat"), nodes, "cod_ccpp", most_m=settings.snap_m), "snap")
    end = written(spatial.snapped(ends.select("cod_ipress", "lon", "lat"), nodes, "cod_ipress", most_m=settings.snap_m), "snap")
    snaps = [points.select(F.col(code).cast("string").alias("id"), F.lit(profile).alias("profile"), F.lit(kind).alias("tipo"), "lon", "lat",
                           "nodo_lon", "nodo_lat", "snap_dist_m", "snap_ok")
             for points, kind, code in ((origin, "demanda", "cod_ccpp"), (end, "instalacion", "cod_ipress"))]
    good = end.filter("snap_ok")
    if whole:
        times, lengths = (paths.distances_to(edges, good, c, origins=origin.filter("snap_ok")) for c in ("travel_time", "length"))
        pairs = paths.od_matrix(origin, end, times, lengths)
    else:
        near = paths.nearest_of(edges, good, "travel_time")
        first = good.groupBy("node").agg(F.min("cod_ipress").alias("cod_ipress"))
        pairs = origin.join(near.join(first, "node").select(F.col("src").alias("node"), "cod_ipress", "distance"), "node", "left")
        ok = F.col("snap_ok") & F.col("distance").isNotNull()
        pairs = pairs.select("cod_ccpp", F.when(ok, F.col("cod_ipress")).alias("cod_ipress"), F.when(ok, F.col("distance")).alias("duration_s"), F.lit(None).cast("double").alias("distance_m"))
    return written(pairs.withColumn("profile", F.lit(profile)), "matrix"), snaps


def routed(places: DataFrame, facilities: DataFrame, ways: DataFrame, profiles: Sequence[str] = ("car", "bike", "foot"),
           full: Sequence[str] = ("car",), settings: Settings = SETTINGS, departments: Sequence[str | None] = (None,), department: str = "departamento",
           boxes: Mapping[str | None, Box] | None = None, graphs: dict[tuple, DataFrame] | None = None) -> Routed:
    """places: cod_ccpp, lon, lat; facilities: cod_ipress, lon, lat, categoria_norm, resolutiva; ways: see graph.

    Profiles in full get every pair with all matrix destinations; the others the nearest resolutive facility of each
    place alone, without a length. Both ends must lie within the snapping distance of the graph's largest component.
    With departments (names in the column `department` of places and facilities, in any case) each is routed by itself:
    places reach facilities of their own department alone, over ways that touch its box, if boxes has one. A department
    and profile that fails is logged and left out; if all fail, an error is raised. graphs, if given, keeps the graph of each
    (department, profile, box), so that a later call on the same ways does not build it again.
    """
    graphs, boxes = {} if graphs is None else graphs, boxes or {}
    matrices, snaps, failed = [], [], {}
    for name in departments:
        mine = F.lit(True) if name is None else F.upper(F.col(department)) == name.upper()
        for profile in profiles:
            try:
                key = (name, profile, boxes.get(name))
                if key not in graphs:
                    graphs[key] = _graph(ways, profile, boxes.get(name), settings)
                matrix, points = _cell(places.filter(mine), facilities.filter(mine), graphs[key], profile, profile in full, settings)
            except Exception as e:  # the other cells are good without this one
                LOG.exception("%s/%s failed", name, profile)
                failed[name, profile] = str(e)
                continue
            matrices.append(matrix)
            snaps += points
    if not matrices:
        raise RuntimeError(f"no matrix was made: {failed}")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Routed(union(matrices), union(snaps), failed)
