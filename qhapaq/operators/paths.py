"""Shortest paths from origins to facilities over a road graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qhapaq.operators.graph import lightest
from qhapaq.shared import drop, ship, written

#: A graph of up to so many bytes (16 an edge, and its nodes' names) goes to the driver and to every executor; a larger one
#: is relaxed edge by edge in joins.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class Graph:
    """A reversed graph as arrays: the edges that end in node i are at starts[i] to starts[i + 1]; names by number."""

    names: pa.Array
    starts: np.ndarray
    ends: np.ndarray
    weights: np.ndarray

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """Least distance of every node to any source; infinite where there is no path.

        Nodes within a stretch of distance are settled together: all their edges at once, until nothing gets closer.
        """
        best = np.full(len(self.starts) - 1, np.inf)
        best[sources] = 0.0
        front, stretch = np.unique(sources), (float(self.weights.mean()) * 4 if len(self.weights) else 0.0) or 1.0
        while len(front):
            limit = best[front].min() + stretch
            near = best[front] <= limit
            later, front = front[~near], front[near]
            while len(front):
                at, to = self._out(front)
                far = np.repeat(best[front], self.starts[front + 1] - self.starts[front]) + self.weights[at]
                closer = far < best[to]
                to, far = to[closer], far[closer]
                np.minimum.at(best, to, far)
                to = np.unique(to)
                soon = best[to] <= limit
                later, front = np.concatenate([later, to[~soon]]), to[soon]
            front = np.unique(later)
            front = front[best[front] > limit]
        return best

    def owners(self, sources: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Place in sources of each node's nearest one; of equally near ones the first. -1 without a path."""
        owner = np.full(len(best), len(sources), np.int64)
        np.minimum.at(owner, sources, np.arange(len(sources)))
        front = np.unique(sources)
        while len(front):
            at, to = self._out(front)
            of = np.repeat(front, self.starts[front + 1] - self.starts[front])
            tight = (best[of] + self.weights[at] == best[to]) & (owner[of] < owner[to])
            np.minimum.at(owner, to[tight], owner[of[tight]])
            front = np.unique(to[tight])
        return np.where(np.isinf(best), -1, owner)

    def _out(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and far ends of all edges of these nodes."""
        n = self.starts[front + 1] - self.starts[front]
        at = np.repeat(self.starts[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, self.ends[at]


def _weighted(edges: DataFrame, weight: str) -> DataFrame:
    return lightest(edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col(weight).isNotNull() & (F.col(weight) >= 0)), weight)


def numbered(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, i) with numbers from 0 without gaps, and the edges (a, b, w) by them. No task holds all nodes."""
    from pyspark.sql import Window

    nodes = best.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("part", F.pmod(F.xxhash64("node"), F.lit(64)))
    nodes = written(nodes.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("node"))), "graph-nodes")
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in nodes.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("part")) if offsets else F.lit(0)
    nodes = nodes.select("node", (offset + F.col("n") - 1).cast("int").alias("i"))
    ends = best.join(nodes.select(F.col("node").alias("src"), F.col("i").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("i").alias("b")), "dst")
    return nodes, ends.select("a", "b", F.col("w").cast("double").alias("w"))


def _held(best: DataFrame, most: int) -> Graph | None:
    """The graph as arrays, if it is small enough."""
    size = best.agg(F.count("*").alias("n"), F.sum(F.length(F.col("src").cast("string")) + F.length(F.col("dst").cast("string"))).alias("text")).first()
    if 16 * size["n"] + (size["text"] or 0) > most:
        return None
    nodes, ends = numbered(best)
    names = nodes.orderBy("i").select("node").toArrow()["node"].combine_chunks()
    table = ends.toArrow()
    a, b, w = (table[c].to_numpy() for c in ("a", "b", "w"))
    order = np.argsort(b, kind="stable")  # reversed
    return Graph(names, np.searchsorted(b[order], np.arange(len(names) + 1)).astype(np.int64), a[order].astype(np.int32), w[order].astype(np.float64))


def distances_to(edges: DataFrame, facilities: DataFrame, weight: str = "w", origins: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(src, node, distance): from every node of origins (of the graph, if None) to each facility's node; unreachable pairs are absent.

    edges src -> dst; facilities and origins: a column node. Paths are searched from the facilities over the reversed
    graph, since they are fewer, and only what origins ask for leaves a search.
    """
    best = written(_weighted(edges, weight), "graph")
    ends = facilities.select("node").filter(F.col("node").isNotNull()).distinct()
    asked = None if origins is None else origins.select(F.col("node").alias("src")).distinct()
    graph = _held(best, broadcast_bytes)
    if graph is None:
        known = _relaxed(best, ends)
        return known if asked is None else known.join(asked, "src", "left_semi")
    return _searched(best, graph, ends, asked)


def _searched(best: DataFrame, graph: Graph, ends: DataFrame, asked: DataFrame | None) -> DataFrame:
    """One search per facility, facilities spread over tasks, the graph as broadcast arrays."""
    spark, kind = best.sparkSession, dict(best.dtypes)["src"]
    ship(spark)
    if asked is not None:  # at most as many as the graph has nodes, whose size is checked
        inside = best.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
        wanted = asked.join(inside, "src", "left_semi").toArrow()["src"].combine_chunks()
        alone = asked.join(ends, asked["src"] == ends["node"]).join(inside, "src", "left_anti")
    else:
        wanted, alone = None, None
    held = spark.sparkContext.broadcast((graph, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, wanted = held.value
        only = np.arange(len(graph.names)) if wanted is None else _places(graph.names, wanted)
        for b in batches:
            at = _places(graph.names, b.column(0))
            for i, place in enumerate(at.tolist()):
                if place < 0:  # off the graph: only itself, if asked
                    if wanted is None:
                        yield pa.RecordBatch.from_arrays([b.column(0)[i: i + 1], b.column(0)[i: i + 1], pa.array([0.0])], ["src", "node", "distance"])
                    continue
                far = graph.distances(np.array([place]))[only]
                reached = np.flatnonzero(far < np.inf)
                yield pa.RecordBatch.from_arrays([graph.names.take(pa.array(only[reached])), b.column(0).take(pa.array(np.full(len(reached), i))), pa.array(far[reached])],
                                                 ["src", "node", "distance"])

    n = max(1, min(10_000, ends.count()))
    out = ends.repartition(n, "node").mapInArrow(run, f"src {kind}, node {kind}, distance double")
    return out if alone is None else out.unionByName(alone.select("src", "node", F.lit(0.0).alias("distance")))


def _places(names: pa.Array, wanted: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.index_in(wanted, names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _relaxed(best: DataFrame, ends: DataFrame, rounds: int = 100_000) -> DataFrame:
    """Bellman-Ford over joins: only pairs that got closer go on; each round's table is deleted after the next."""
    last = written(ends.select(F.col("node").alias("src"), "node", F.lit(0.0).alias("distance")), "paths")
    front = known = last
    for _ in range(rounds):
        step = front.join(best.select(F.col("dst").alias("src"), F.col("src").alias("s"), "w"), "src")
        step = step.groupBy(F.col("s").alias("src"), "node").agg(F.min(F.col("distance") + F.col("w")).alias("d"))
        merged = written(known.join(step, ["src", "node"], "full"), "paths")
        drop(last)
        last = merged
        closer = F.col("d").isNotNull() & (F.col("distance").isNull() | (F.col("d") < F.col("distance")))
        front = merged.filter(closer).select("src", "node", F.col("d").alias("distance"))
        known = merged.select("src", "node", F.least("distance", "d").alias("distance"))
        if front.isEmpty():
            return known
    raise RuntimeError("paths did not settle")


def nearest_of(edges: DataFrame, facilities: DataFrame, weight: str = "w", rounds: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(src, node, distance): every node's nearest facility node, from one search that starts at all facilities.

    Ties go to the lesser facility node. Nodes that reach none are absent. Graphs beyond the bound are relaxed in joins.
    """
    best = written(_weighted(edges, weight), "graph")
    ends = facilities.select("node").filter(F.col("node").isNotNull()).distinct()
    graph = _held(best, broadcast_bytes)
    if graph is None:
        return _nearest_relaxed(best, ends, rounds)
    spark, kind = best.sparkSession, dict(best.dtypes)["src"]
    ship(spark)
    inside = best.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sources = ends.join(inside, "node", "left_semi").orderBy("node").toArrow()["node"].combine_chunks()  # no more than nodes
    held = spark.sparkContext.broadcast((graph, sources))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            graph, sources = held.value
            at = _places(graph.names, sources)
            far = graph.distances(at)
            owner = graph.owners(at, far)
            found = np.flatnonzero(owner >= 0)
            for part in np.array_split(found, len(found) // 65_536 + 1):
                yield pa.RecordBatch.from_arrays([graph.names.take(pa.array(part)), sources.take(pa.array(owner[part])), pa.array(far[part])], ["src", "node", "distance"])

    one = spark.range(0, 1, 1, 1)  # a single search over the graph
    found = one.mapInArrow(run, f"src {kind}, node {kind}, distance double") if len(sources) else spark.createDataFrame([], f"src {kind}, node {kind}, distance double")
    return found.unionByName(ends.join(inside, "node", "left_anti").select(F.col("node").alias("src"), "node", F.lit(0.0).alias("distance")))


def _nearest_relaxed(best: DataFrame, ends: DataFrame, rounds: int) -> DataFrame:
    last = written(ends.select(F.col("node").alias("src"), F.struct(F.lit(0.0).alias("d"), F.col("node").alias("n")).alias("x")), "nearest")
    front = known = last
    for _ in range(rounds):
        step = front.join(best.select(F.col("dst").alias("src"), F.col("src").alias("s"), "w"), "src")
        step = step.groupBy(F.col("s").alias("src")).agg(F.min(F.struct((F.col("x.d") + F.col("w")).alias("d"), F.col("x.n").alias("n"))).alias("y"))
        merged = written(known.join(step, "src", "full"), "nearest")
        drop(last)
        last = merged
        closer = F.col("y").isNotNull() & (F.col("x").isNull() | (F.col("y") < F.col("x")))
        front = merged.filter(closer).select("src", F.col("y").alias("x"))
        known = merged.select("src", F.when(closer, F.col("y")).otherwise(F.col("x")).alias("x"))
        if front.isEmpty():
            return known.select("src", F.col("x.n").alias("node"), F.col("x.d").alias("distance"))
    raise RuntimeError("paths did not settle")


def od_matrix(origins: DataFrame, facilities: DataFrame, times: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Every (origin, facility) with duration_s and distance_m, null without a path or where either end is too far from
    the graph. Durations and lengths come from two searches of their own.

    origins: cod_ccpp, node, snap_ok; facilities: cod_ipress, node, snap_ok; times, lengths: results of distances_to.
    """
    pairs = origins.select("cod_ccpp", F.col("node").alias("src"), F.col("snap_ok").alias("_a")).crossJoin(
        facilities.select("cod_ipress", F.col("node"), F.col("snap_ok").alias("_b")))  # the matrix itself is this product
    both = times.withColumnRenamed("distance", "_t")
    both = both.join(lengths.withColumnRenamed("distance", "_l"), ["src", "node"], "left") if lengths is not None else both.withColumn("_l", F.lit(None).cast("double"))
    out = pairs.join(both, ["src", "node"], "left")
    ok = F.col("_a") & F.col("_b") & F.col("_t").isNotNull()
    return out.select("cod_ccpp", "cod_ipress", F.when(ok, F.col("_t")).alias("duration_s"), F.when(ok, F.col("_l")).alias("distance_m"))
