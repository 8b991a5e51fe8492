import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qhapaq.llm import dedup


def shingle_set(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent=80):
    nodes = {}
    for i, t in rows:
        nodes.setdefault(i, []).append(shingle_set(t, width))
    label = {i: i for i in nodes}

    def of(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(nodes)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in nodes[a] for t in nodes[b]):
                x, y = of(a), of(b)
                label[max(x, y)] = min(x, y)
    return {i: of(i) for i in ids}


def check(spark, rows, **rules):
    rules = dedup.Rules(**rules)
    got = dedup.linked(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()
    want = brute([r for r in rows if r[0] is not None], rules.shingle, rules.percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    sizes = sorted(r["n_shingles"] for r in got)
    assert sizes == sorted(len(shingle_set(t, rules.shingle)) for _, t in rows)


def variants(rng, n, words, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, block", [(16, 256), (3, 7)])
def test_groups_around_the_threshold(spark, small, block):
    rng = random.Random(small)
    texts = variants(rng, 90, 120, 14) + variants(rng, 40, 60, 3) + [" ".join(f"u{rng.randrange(900)}" for _ in range(80)) for _ in range(60)]
    texts += texts[:20] + ["A B c", "a b C", "a", "a", "b"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    check(spark, [(i, texts[k]) for i, k in enumerate(order)], shingle=2, small=small, block=block)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, rows, shingle=2)
    assert dedup.linked(none).count() == 0
    kept = dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_only_ascii_letters_lose_their_case(spark):
    check(spark, [(1, "É ß A"), (2, "é ß a"), (3, "É ß a"), (4, "x y z"), (5, "x y z")], shingle=2)


def test_sketch_estimates_similarity():
    rules, rng = dedup.Rules(), np.random.default_rng(0)
    for similarity in (0.7, 0.8, 0.9):
        seen = []
        for _ in range(60):
            common = int(800 * similarity / (1 + similarity))
            u = rng.integers(0, 2**63, 800 - common).astype(np.uint64)
            a, b = (dedup.features(np.sort(x), rules)[2] for x in (u[:400], u[len(u) - 400:]))
            seen.append(dedup.estimate(sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(a, b)), rules))
        assert np.mean(seen) == pytest.approx(similarity, abs=0.02) and np.std(seen) < 0.06
    assert dedup.estimate(dedup.most_differing(rules), rules) >= 0.62


def test_block_links_join_what_is_similar():
    rng = np.random.default_rng(2)
    base = rng.choice(10_000, 200, replace=False)
    sets = []
    for i in range(30):
        s = base.copy()
        s[rng.choice(200, i % 12 + 4, replace=False)] = rng.integers(10_000, 10**6, i % 12 + 4)
        sets.append(np.unique(s))
    size = np.array([len(s) for s in sets])
    found = dedup.block_links(np.arange(30), np.arange(30), np.arange(30), size, np.zeros((30, 8), np.uint64), sets, dedup.Rules())
    alike = {(i, j) for i in range(30) for j in range(30) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}

    def parts(pairs):
        label = list(range(30))
        for _ in range(30):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert set(found) <= alike and parts(found) == parts(alike) and len(found) < 30


def test_repeated_ids_with_different_texts_link_by_each(spark):
    rng = random.Random(5)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, near(c)), (5, " ".join(b)), (6, " ".join(c)), (7, "alone in the world"), (7, "")]
    check(spark, rows, shingle=2)
    check(spark, [(9 - i, t) for i, t in rows], shingle=2)


def test_a_bitmap_finds_the_same(spark):
    rng = random.Random(6)
    texts = variants(rng, 40, 60, 8) + variants(rng, 20, 90, 12)
    check(spark, list(enumerate(texts)), shingle=2, broadcast=0, bitmap_bits=20)


def test_a_hot_bucket_of_unlike_members(spark):
    """Members that share a bucket but no words: sketches send none of them on, and no pairs are made."""
    rng = random.Random(7)
    texts = [" ".join(f"h{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6000)]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, texts[i] + " more") for i in range(0, 6000, 500)]
    rules = dedup.Rules(shingle=2, block=1500)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    found = dedup.described(docs, rules, "doc_id", "text").withColumnRenamed("set_key", "node").withColumn("rep", F.col("doc_id"))
    meeting = found.select(F.lit(b"main").alias("main"), "node", F.col("node").alias("component"))
    links = dedup._met(meeting, docs, found, rules)
    names = {bytes(r["node"]): r["doc_id"] for r in found.collect()}
    assert {tuple(sorted((names[bytes(r["a"])], names[bytes(r["b"])]))) for r in links.collect()} == {(i, 10_000 + i) for i in range(0, 6000, 500)}
