from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from qhapaq.llm import neighbours, registry

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, asked, k):
    live = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, v in live:
        if asked(q):
            scores = sorted((-float((v * w).sum()), i) for i, w in live if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(1500)]
    rules = neighbours.Rules(block_bytes=400 * 24 * 8, asked=64)
    got = found(neighbours.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, rules))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 20 for q in want]) >= 0.9
    score = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(s == (score[q] * score[i]).sum() for q, v in got.items() for i, s in v)


def test_ties_bad_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(30)] + [(100, None, 0), (101, [0.0, 0.0], 0), (102, [float("nan"), 1.0], 0), (103, [None, 1.0], 0), (104, [float("inf"), 1.0], 0),
                                                      (None, [1.0, 1.0], 0), (105, [1.0, 2.0, 3.0], 0), (106, [], 0), (7, [1.0, 2.0], 0)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5, 6, 7, 7, *range(8, 20)] and [i for i, _ in got[20]][:4] == [0, 1, 2, 3] and set(got) == {0, 20}
    few = found(neighbours.nearest(spark.createDataFrame(rows[:3], SCHEMA), F.col("vec_id") == 0))
    assert few == {0: [(1, 5.0), (2, 5.0)]}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") == 0).count() == 0


def _tables(vectors, rules, radius):
    scale = np.abs(vectors).max()
    index = neighbours.learned(vectors, scale, float(np.sqrt(((vectors / scale) ** 2).sum(1).max())), rules)
    return neighbours.Tables(replace(index, radius=radius), np.arange(len(vectors)), vectors)


def test_probing_finds_every_code_in_the_radius():
    vectors = np.random.default_rng(1).normal(size=(1500, 16))
    for substrings in (2, 5, 8):
        for radius in (0, 3, 7, 19, 30, 16 * substrings):
            tables = _tables(vectors, neighbours.Rules(substrings=substrings), radius)
            codes = tables.index.codes(vectors, False)
            for code in tables.index.codes(vectors[:20], True):
                differ = np.bitwise_count(code ^ codes).sum(1, dtype=int)
                assert tables.within(code).tolist() == np.flatnonzero(differ <= radius).tolist()


def test_few_rows_are_probed_and_ranked_where_vectors_have_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(400, 64))
    vectors = np.repeat(centres, 40, axis=0) + rng.normal(size=(16_000, 64)) * 0.15
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    tables = _tables(vectors, neighbours.Rules(), 20)
    ids, found, _ = tables.search(np.arange(0, 16_000, 160), vectors[::160], 20)
    assert (ids // 40 == found // 40).mean() > 0.98 and len(ids) == 2000
    assert tables.probed < 0.1 * 100 * 16_000 and tables.ranked < 0.01 * 100 * 16_000


def test_query_recall(spark):
    d = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_list()).astype(float)
    got = found(registry.op4_neighbours(spark, d))
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    score = vectors[asked] @ vectors.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    recall = [len({i for i, _ in got[ids[q]]} & set(ids[b].tolist())) / 20 for q, b in zip(asked, best)]
    assert np.mean(recall) >= 0.9


def test_queries_with_too_few_rows_in_the_radius_ask_all(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=16) + rng.normal(size=(600, 16)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(near)] + [(1000, (-near[0]).tolist()), (1020, (-near[1] * 2).tolist())]
    got = found(neighbours.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 20 == 0))
    for q in (1000, 1020):
        scores = sorted((-float((np.array(dict(rows)[q]) * np.array(v)).sum()), i) for i, v in rows if i != q)[:20]
        assert got[q] == [(i, -s) for s, i in scores]


def test_unequal_lengths_and_huge_components(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0, 5.0], 0), (2, [3.0], 0), (3, [2.0**100, 2.0**100], 0)]
    assert found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), F.col("vec_id") == 0)) == {0: [(3, 3 * 2.0**100), (1, 5.0), (2, 3.0)]}
