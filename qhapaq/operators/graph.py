"""Road graphs from ways, and their components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.config import SETTINGS, Settings
from qhapaq.functions import roads
from qhapaq.functions.geo import haversine, node
from qhapaq.shared import drop, written


def relevant_ways(ways: DataFrame, profile: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Ways of the profile's road classes with two points or more and, with a box, a point inside it.

    ways: way_id, pts array<struct<lon,lat>>, highway, maxspeed, oneway, junction and, if there, access.
    """
    rows = ways.filter(F.col("highway").isin(*sorted(roads.ROADS[profile])) & (F.size("pts") >= 2))
    if "access" in ways.columns:
        rows = rows.filter(~F.coalesce(F.col("access").isin(*roads.CLOSED), F.lit(False)))
    if box:
        rows = rows.filter(F.exists("pts", lambda p: p["lon"].between(box[0], box[2]) & p["lat"].between(box[1], box[3])))
    return rows


def way_points(ways: DataFrame, profile: str) -> DataFrame:
    """One row per point of a way, in driving order, with its node (x, y). For cars a way tagged -1 runs backwards."""
    pts = F.when(F.col("oneway") == "-1", F.reverse("pts")).otherwise(F.col("pts")) if profile == "car" else F.col("pts")
    rows = ways.withColumn("pts", pts).select("way_id", "highway", "maxspeed", "oneway", "junction", F.size("pts").alias("n"), F.posexplode("pts").alias("i", "p"))
    return rows.select("way_id", "highway", "maxspeed", "oneway", "junction", "n", "i", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"),
                       F.struct(node(F.col("p.lon")).alias("x"), node(F.col("p.lat")).alias("y")).alias("node"))


def junction_counts(points: DataFrame) -> DataFrame:
    """How often each node occurs on ways."""
    return points.groupBy("node").agg(F.count("*").alias("uso"))


def segments(points: DataFrame) -> DataFrame:
    """Stretches of ways between junctions (nodes used twice or more) or way ends: way_id, seg, a, b, length.

    A step's length is added up from break to break; the windows run inside one way, the largest of which is bounded.
    """
    along = Window.partitionBy("way_id").orderBy("i")
    steps = points.join(junction_counts(points), "node").withColumn("step", F.coalesce(haversine(
        F.lag("lon").over(along), F.lag("lat").over(along), F.col("lon"), F.col("lat")), F.lit(0.0)))
    end = F.last("node").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = steps.withColumn("stop", ((F.col("i") > 0) & ((F.col("uso") >= 2) | (F.col("node") == end))).cast("int"))
    upto = F.coalesce(F.sum("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumns({"seg": upto, "from": F.lag("node").over(along)})
    return (steps.filter("i > 0").groupBy("way_id", "seg", "highway", "maxspeed", "oneway", "junction")
            .agg(F.min_by("from", "i").alias("a"), F.max_by("node", "i").alias("b"), F.sum("step").alias("length"), F.max("stop").alias("closed"))
            .filter((F.col("closed") == 1) & (F.col("a") != F.col("b")) & (F.col("length") > 0)).drop("closed"))


def edges(ways: DataFrame, profile: str, box: tuple[float, float, float, float] | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """Directed edges src, dst, length, highway, maxspeed, speed_kph, travel_time of a profile.

    Only cars heed one-way tags (yes, true, 1, roundabouts, motorways); all other stretches run both ways.
    """
    seg = segments(way_points(relevant_ways(ways, profile, box), profile))
    single = F.lit(False)
    if profile == "car":
        single = F.coalesce(F.col("oneway").isin("yes", "true", "1"), F.lit(False)) | F.coalesce(F.col("junction") == "roundabout", F.lit(False)) | F.col("highway").isin("motorway", "motorway_link")
    ends = F.when(single, F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")))).otherwise(
        F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    both = seg.withColumn("e", F.explode(ends)).select("e.src", "e.dst", "length", "highway", "maxspeed")
    kmh = roads.speed(F.lit(profile), F.col("highway"), roads.max_speed(F.col("maxspeed")), settings)
    return both.withColumn("speed_kph", kmh).withColumn("travel_time", roads.travel_seconds(F.col("length"), F.col("speed_kph")))


def lightest(edges: DataFrame, weight: str) -> DataFrame:
    """One edge per (src, dst): the least weight of parallel ones."""
    return edges.groupBy("src", "dst").agg(F.min(weight).alias("w"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of undirected edges; component is its least node. Null ends are left out.

    Alternates large and small stars: nodes move to the least neighbour until nothing changes, in a number of rounds
    that grows with the logarithm of the longest path. Minima are pre-aggregated, so a node with very many edges is no
    task of its own. Each round is written to the shared folder, which keeps plans short and survives lost executors.
    """
    alone = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component")).distinct()
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges, mark = written(edges.distinct(), "edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join's two sides are plain shuffles, which Spark can split where a node has very many edges
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "edges-least")
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(
            F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, edges = edges, written(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        drop(last, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    joined = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return joined.unionByName(alone.join(joined, "node", "left_anti"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges among the nodes of the largest weakly connected component; of equals the one with the least node."""
    labels = components(edges, "src", "dst")
    top = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    kept = labels.join(F.broadcast(top.select("component")), "component").select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi")


def contracted(edges: DataFrame, rounds: int = 400) -> DataFrame:
    """Undirected edges (a, b, w) without nodes of degree two: their two edges become one of the added length.

    In each round every such node whose hash is less than that of its like neighbours goes, so that no two adjacent ones
    go at once; parallel edges and loops that arise keep the least weight or fall away. About a third go in a round, so the
    number of rounds grows with the logarithm of the longest chain; more than `rounds` raise an error.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")), "chains")
    for r in range(rounds):
        ends = now.select("a", "b", "w").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        two = ends.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("p"), F.max("b").alias("q"), F.sum("w").alias("w")).filter("n = 2 and p <> q")
        h = lambda c: F.xxhash64(c, F.lit(r))
        like = two.select(F.col("a").alias("o"), h("a").alias("ho"))
        near = two.withColumn("o", F.explode(F.array("p", "q"))).join(like, "o").groupBy("a").agg(F.min("ho").alias("ho"))
        gone = written(two.join(near, "a", "left").filter(F.col("ho").isNull() | (h("a") < F.col("ho"))).select("a", "p", "q", "w"), "chains-gone")
        if gone.isEmpty():
            return now
        ids = gone.select("a")
        stay = now.join(ids, "a", "left_anti").join(ids.withColumnRenamed("a", "b"), "b", "left_anti")
        fresh = gone.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "w")
        last, now = now, written(stay.select("a", "b", "w").unionByName(fresh).groupBy("a", "b").agg(F.min("w").alias("w")), "chains")
        drop(last, gone)
    raise RuntimeError("chains did not settle")
