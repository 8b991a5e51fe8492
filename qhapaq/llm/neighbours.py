"""Approximate nearest neighbours by inner product with multi-index hashing.

Vectors get binary codes by a learned rotation (iterative quantisation). A code is split into substrings of 16 bits,
each with an index of its own: a table from value to the rows that have it. If two codes differ in at most R bits, R = m * r
+ a with m substrings, then either one of the first a + 1 substrings differs in at most r bits or one of the others in at most
r - 1. So reading the buckets of all values that near, in each table, finds every code within R; other rows are not looked at.
Found codes beyond R fall away, and the rest are ranked by their float vectors. R is learned: the distance that holds
a stated share of the true neighbours of sampled queries, which are found by brute force over all rows in one pass.

Rows are split into blocks by a hash of their id, each vector into one; a block's tables are built once, and the
queries stream past them. A query with fewer than k rows within R asks again, with every row as a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.shared import ship, written

BITS = 16


@dataclass(frozen=True)
class Rules:
    """k neighbours. substrings of 16 bits each. sample: vectors that the rotation is learned on, and asked: queries that
    the radius is learned on (its truth comes from all rows). recall: share of their true neighbours inside the radius.
    block_bytes: vectors of a block, as doubles; least_block: rows that a block has at least, if there are that many."""

    k: int = 20
    substrings: int = 8
    sample: int = 8192
    asked: int = 256
    recall: float = 0.96
    rounds: int = 25
    block_bytes: int = 32 << 20
    least_block: int = 2048


@dataclass(frozen=True)
class Index:
    """rotation: (dimensions + 1, bits). scale: the greatest component. norm: the largest of vectors over scale, by which
    inner products become angles. radius in bits; None takes every row."""

    rotation: np.ndarray
    scale: float
    norm: float
    substrings: int
    radius: int | None = None

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(n, substrings) of 16 bits. Stored vectors get a coordinate that lifts them all to the largest norm."""
        return np.packbits(lifted(vectors / self.scale, self.norm, query) @ self.rotation > 0, axis=1, bitorder="little").view("<u2").reshape(len(vectors), self.substrings)

    def reach(self) -> list[int]:
        """Bits in which each substring may differ; -1 leaves it out."""
        whole, rest = divmod(self.radius, self.substrings)
        return [whole if t <= rest else whole - 1 for t in range(self.substrings)]


def lifted(vectors: np.ndarray, norm: float, query: bool) -> np.ndarray:
    lift = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, lift[:, None]], 1)


def learned(sample: np.ndarray, scale: float, norm: float, rules: Rules) -> Index:
    """Rotations by iterative quantisation of sample vectors, as many as fill the bits."""
    bits, x = BITS * rules.substrings, lifted(sample / scale, norm, False)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, : min(bits, x.shape[1])]
    parts, rng, y = [], np.random.default_rng(5), x @ axes
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rules.rounds):
            left, _, right = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (left @ right).T
        parts.append(axes @ turn)
    return Index(np.concatenate(parts, 1)[:, :bits].copy(), scale, norm, rules.substrings)


#: All values of 16 bits by their number of ones, and how many have at most so many.
_BALL = np.argsort(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint16)), kind="stable").astype(np.uint16)
_UPTO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint16))))


class Tables:
    """One block's rows and, for each substring, the rows in order of its value with every value's first place."""

    def __init__(self, index: Index, ids: np.ndarray, vectors: np.ndarray):
        self.index, self.ids, self.vectors = index, ids, vectors
        codes = index.codes(vectors, False)
        self.wide = np.ascontiguousarray(codes)
        self.rows = [np.argsort(codes[:, t], kind="stable").astype(np.int32) for t in range(index.substrings)]
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, t], minlength=1 << BITS))]).astype(np.int32) for t in range(index.substrings)]
        self.values = [np.flatnonzero(np.diff(f)).astype(np.uint16) for f in self.first]  # those that any row has
        self.seen = np.zeros(len(ids), bool)
        self.probed = self.ranked = 0

    def within(self, code: np.ndarray) -> np.ndarray:
        """The rows whose codes lie within the radius, from the buckets that the pigeonhole principle names."""
        if self.index.radius is None:
            return np.arange(len(self.ids))
        for t, reach in enumerate(self.index.reach()):
            if reach < 0:
                continue
            near, values = _UPTO[min(reach, BITS)], self.values[t]
            if near < len(values):
                buckets = (_BALL[:near] ^ code[t]).astype(np.intp)
            else:  # fewer buckets hold rows than values are near: the near ones of those
                buckets = values[np.bitwise_count(values ^ code[t]) <= reach].astype(np.intp)
            lo = self.first[t][buckets]
            n = self.first[t][buckets + 1] - lo
            ends = np.cumsum(n)
            if len(ends) and ends[-1]:
                self.seen[self.rows[t][np.repeat(lo - (ends - n), n) + np.arange(ends[-1])]] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        self.probed += len(found)
        return found[np.bitwise_count(self.wide[found] ^ code).sum(1, dtype=np.int64) <= self.index.radius]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the k best of the block for each query, its own rows left out."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for me, q, code in zip(query_ids, queries, self.index.codes(queries, True)):
            at = self.within(code)
            at = at[self.ids[at] != me]
            self.ranked += len(at)
            score = (self.vectors[at] * q).sum(1)  # in double precision and one order of additions: equal vectors tie
            if len(at) > k:
                best = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
                at, score = at[best], score[best]
            order = np.lexsort((self.ids[at], -score))[:k]
            out.append((np.full(len(order), me), self.ids[at][order], score[order]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """(n, dims) of doubles; shorter vectors get zeros at their end."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == dims).all():
        return values.reshape(len(flat), dims)
    out = np.zeros((len(flat), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id (long) and embedding of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def learned_radius(rows: DataFrame, drawn: pa.Table, index: Index, dims: int, rules: Rules) -> int:
    """The distance in bits within which a share of the true neighbours of drawn rows lie.

    One pass over all rows keeps each partition's best for every drawn row; Spark merges them to k for each.
    """
    ids, asked = drawn["vec_id"].to_numpy(), _matrix(drawn["embedding"], dims)
    codes, k = index.codes(asked, True), rules.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, differ = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                vectors = _matrix(part.column(1), dims)
                score = asked @ vectors.T
                score[ids[:, None] == part.column(0).to_numpy()[None]] = -np.inf
                keep = np.argpartition(-score, k, axis=1)[:, :k] if score.shape[1] > k else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                bits = np.bitwise_count(codes[:, None] ^ index.codes(vectors, False)[keep]).sum(2, dtype=np.int64)
                best, differ = np.concatenate([best, np.take_along_axis(score, keep, 1)], 1), np.concatenate([differ, bits], 1)
                keep = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, differ = np.take_along_axis(best, keep, 1), np.take_along_axis(differ, keep, 1)
        at, place = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(best[at, place]), pa.array(differ[at, place])], ["q", "score", "differ"])

    first = Window.partitionBy("q").orderBy(F.desc("score"), "differ")
    top = rows.mapInArrow(run, "q long, score double, differ long").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    differ = top.select("differ").toArrow()["differ"].to_numpy()
    return int(np.quantile(differ, rules.recall, method="higher")) if len(differ) else 0


def _found(rows: DataFrame, queries: DataFrame, index: Index, dims: int, blocks: int, k: int) -> DataFrame:
    """(g, query_id, vec_id, score): each block's k best within the index's radius; g is the block.

    A task gets a block's vectors first and then all queries, a batch at a time; Spark sorts them outside memory.
    """
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    stored = rows.select("vec_id", "embedding", block.alias("block"), F.lit(False).alias("ask"))
    asked = queries.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("ask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, tables = None, [], [], None
        for b in batches:
            of, ask = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero(np.diff(of * 2 + ask)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if of[lo] != now:
                    now, ids, parts, tables = of[lo], [], [], None
                part = b.slice(lo, hi - lo)
                if not ask[lo]:
                    ids.append(part.column(0).to_numpy())
                    parts.append(_matrix(part.column(1), dims))
                    continue
                if not ids:
                    continue
                if tables is None:
                    tables = Tables(index, np.concatenate(ids), np.concatenate(parts))
                    ids, parts = [None], []
                q, v, s = tables.search(part.column(0).to_numpy(), _matrix(part.column(1), dims), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), now), pa.int32()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                                                 ["g", "query_id", "vec_id", "score"])

    both = stored.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "ask")
    return both.mapInArrow(run, "g int, query_id long, vec_id long, score double")


def _merged(found: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, best): the k best of all blocks, as structs of negative score and id."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k)
    while blocks > 64:  # lists are merged 64 at a time, so none gets long
        found = found.groupBy("query_id", F.floor(F.col("g") / 64).alias("g")).agg(best.alias("b")).select("query_id", "g", F.explode("b").alias("b"))
        found, blocks = found.select("g", "query_id", F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score")), -(-blocks // 64)
    return found.groupBy("query_id").agg(best.alias("best"))


def nearest(vectors: DataFrame, asked: Column, rules: Rules | None = None, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row that asked (over vec_id) holds for.

    score is the inner product of the original vectors in double precision; ties go to the smaller vec_id. Rows are
    spread over blocks by a hash of their id, so copies of one vector spread too. Runs jobs when called: the rotation is
    learned on a sample, the radius and the queries that ask again need all rows. Defined cases: rows with a null id, a null,
    empty or zero vector, or one with null or non-finite components take no part; of vectors of unequal lengths the shorter
    have zeros at their end; a query's own rows (of the same id) are no candidates; a query id that repeats asks once, with
    its least vector; repeated candidates count each; with fewer candidates than k all are returned; an empty table
    gives no rows; other columns are ignored.
    """
    rules = rules or Rules()
    ship(vectors.sparkSession)
    rows = written(usable(vectors, vec_id, embedding), "vectors")
    peak = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"), F.max(peak).alias("scale")).first()
    if not seen["n"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, scale = seen["dims"], seen["scale"]
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale))
    norm = rows.agg(F.max(square)).first()[0] ** 0.5
    most = max(256, min(rules.sample, rules.block_bytes * 2 // (8 * dims)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(most).toArrow()
    index = learned(_matrix(drawn["embedding"], dims), scale, norm, rules)
    index = replace(index, radius=learned_radius(rows, drawn.slice(0, rules.asked), index, dims, rules))
    queries = written(rows.filter(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-seen["n"] // max(1, rules.block_bytes // (8 * dims))), min(cores, seen["n"] // rules.least_block), 1)
    best = written(_merged(_found(rows, queries, index, dims, blocks, rules.k), blocks, rules.k), "neighbours")
    full = best.filter(F.size("best") >= rules.k)
    short = written(queries.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "queries-short")
    if not short.isEmpty():
        full = full.unionByName(_merged(_found(rows, short, replace(index, radius=None), dims, blocks, rules.k), blocks, rules.k))
    one = full.select("query_id", F.posexplode("best").alias("i", "b"))
    return one.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))
