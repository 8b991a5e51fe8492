import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from qhapaq.llm import mixing, registry


def test_targets():
    assert mixing.targets([10, 10, 80], [3, 1, 2], 150, 2) == pytest.approx([20, 20, 110])
    assert mixing.targets([10, 10], [1, 1], 100, 2) == [20, 20]
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0, 5], [1, 1], 3, 2) == [0, 3]


def test_flow_is_greatest_and_cheapest():
    capacity, quota = {("a",): 2, ("b",): 2, ("a", "b"): 3}, {"a": 6, "b": 4}
    flow = mixing.route(capacity, quota, 2)
    assert sum(sum(f.values()) for f in flow.values()) == 10
    cost = sum(max(0, sum(f.values()) - capacity[p]) for p, f in flow.items())
    best = min(sum(max(0, x - c) for x, c in zip((u, v, w), (2, 2, 3))) for u, v, w in itertools.product(range(5), range(5), range(7))
               if u + v + w == 10 and any(u + k == 6 and v + w - k == 4 for k in range(w + 1)))
    assert cost == best
    assert mixing.route({("a", "b"): 5, ("a",): 5}, {"a": 5, "b": 5}, 1) == {("a", "b"): {"a": 0, "b": 5}, ("a",): {"a": 5}}


def test_query_meets_targets_and_reruns_agree(spark, documents):
    got = registry.op1_mixing(spark, "/root/testdata/sf0.001").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in documents.collect()}
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    assert len(got) == len(size) and all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in set(source.values()):
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine) and sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=1)
    assert sum({source[r["doc_id"]]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, registry.op1_mixing(spark, "/root/testdata/sf0.001").collect()))


def test_odd_rows(odd, none):
    plan, mixed = mixing.mix(odd, mixing.in_turn(3, 1, 2))
    rows = mixed.collect()
    assert plan.sources == ["a", "b", "c", None] and len(rows) == odd.count() and mixed.select("row.*").columns == odd.columns
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if not (r["row"]["text"] or "").strip())
    for s, target in zip(plan.sources, plan.targets):
        assert sum(r["taken"] for r in rows if r["row"]["source"] == s) == pytest.approx(target, abs=1)
    assert mixing.mix(none, mixing.in_turn(1))[1].count() == 0


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", "b"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    plan, mixed = mixing.mix(docs, mixing.in_turn(1, 3), share=1.0)
    assert mixed.agg(F.sum("taken")).first()[0] == pytest.approx(sum(plan.targets), abs=2)
    assert {tuple(r["pattern"]) for r in mixed.collect()} == {("a",), ("b",), ("a", "b")}


def cheapest(capacity, quota, repeats):
    """(flow, cost) by shortest augmenting paths, a token at a time, over the whole network."""
    nodes = ["s", *capacity, *[("q", x) for x in quota], "t"]
    arcs = [["s", p, n, r + 1] for p, n in capacity.items() for r in range(repeats)] + [[p, ("q", x), 10**6, 0] for p in capacity for x in p] + [[("q", x), "t", n, 0] for x, n in quota.items()]
    arcs = [a for x in arcs for a in (x, [x[1], x[0], 0, -x[3]])]
    flow = cost = 0
    while True:
        best, came = {"s": 0}, {}
        for _ in nodes:
            for i, (a, b, n, c) in enumerate(arcs):
                if n and a in best and best[a] + c < best.get(b, 10**9):
                    best[b], came[b] = best[a] + c, i
        if "t" not in best:
            return flow, cost
        at = "t"
        while at != "s":
            arcs[came[at]][2] -= 1
            arcs[came[at] ^ 1][2] += 1
            at = arcs[came[at]][0]
        flow, cost = flow + 1, cost + best["t"]


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_the_cheapest_greatest(seed):
    rng = random.Random(seed)
    sources = "abcd"[: rng.randint(2, 4)]
    capacity = {tuple(sorted(rng.sample(sources, rng.randint(1, len(sources))))): rng.randint(1, 6) for _ in range(5)}
    quota, repeats = {x: rng.randint(0, 9) for x in sources}, rng.randint(1, 3)
    flow = mixing.route(capacity, quota, repeats)
    out = {p: sum(f.values()) for p, f in flow.items()}
    assert all(sum(f.get(x, 0) for f in flow.values()) <= n for x, n in quota.items()) and all(out[p] <= repeats * n for p, n in capacity.items())
    price = sum(min(max(out[p] - r * n, 0), n) * (r + 1) for p, n in capacity.items() for r in range(repeats))
    assert (sum(out.values()), price) == cheapest(capacity, quota, repeats)


def test_many_patterns_are_planned_in_time():
    rng = random.Random(1)
    names = [f"s{i}" for i in range(60)]
    capacity = {tuple(sorted(rng.sample(names, rng.randint(1, 4)))): rng.randint(1, 1000) for _ in range(20_000)}
    size = sum(capacity.values())
    began = time.perf_counter()
    flow = mixing.route(capacity, {x: int(size * 1.5 * (3 if i % 3 == 0 else 1) / 100) for i, x in enumerate(names)}, 2)
    assert time.perf_counter() - began < 60 and sum(sum(f.values()) for f in flow.values()) > size


def test_more_patterns_than_are_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "w " * (i % 7), [f"s{i % 5}", f"s{i % 3}"]) for i in range(300)], "doc_id long, text string, source array<string>")
    want = sorted(tuple(r) for r in mixing.mix(rows, mixing.in_turn(3, 1, 2))[1].select("row.doc_id", "taken").collect())
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 0)
    assert sorted(tuple(r) for r in mixing.mix(rows, mixing.in_turn(3, 1, 2))[1].select("row.doc_id", "taken").collect()) == want
