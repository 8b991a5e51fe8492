import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qhapaq.llm import dedup, mixing, secret_scan
from tests_brute import near_groups

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, written as the driver does."""
    from qhapaq.shared import written

    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = written(f(spark, docs, D), "test")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_quality_drops_only_what_fails(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in before.collect()}
    assert all(words[i] >= 18 for i in kept) and all(i not in kept for i, n in words.items() if n < 15) and len(kept) > 0.8 * len(words)


def test_dedup_keeps_one_of_each_group(stages):
    _, before, after = stages[1]
    group = near_groups([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(group.values()))


def test_secrets_are_gone(stages):
    _, before, after = stages[2]
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert not secret_scan.base_findings(r["text"].replace("[SECRET]", "\n")) and r["n_chars"] == len(r["text"])
        if not secret_scan.base_findings(text[r["doc_id"]]) and "[SECRET]" not in r["text"]:
            assert r["text"] == text[r["doc_id"]]


def test_mix_takes_whole_documents_near_the_targets(stages):
    _, before, after = stages[3]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before.collect()}
    source = {r["doc_id"]: r["source"] for r in before.collect()}
    times = Counter(r["doc_id"] for r in after.collect())
    names = sorted(set(source.values()))
    sizes = [sum(n for i, n in size.items() if source[i] == s) for s in names]
    goal = mixing.targets(sizes, mixing.in_turn(3, 1, 2)(names), 1.5 * sum(sizes), 2)
    assert max(times.values()) <= 2
    for s, g in zip(names, goal):
        got = sum(size[i] * k for i, k in times.items() if source[i] == s)
        assert abs(got - g) <= max(n for i, n in size.items() if source[i] == s)


def test_packing_takes_every_row(stages):
    _, before, after = stages[4]
    assert after.agg(F.sum("length")).first()[0] == sum(r["doc_tokens"] * Counter(d["doc_id"] for d in before.collect())[r["doc_id"]] for r in after.select("doc_id", "doc_tokens").distinct().collect())


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == stages[-1][2].columns and out.agg(F.sum("length")).first() == stages[-1][2].agg(F.sum("length")).first()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_rows_pass_through(spark, odd, none):
    for docs in (odd, none):
        for _, f in corpus_pipeline.STAGES[:-1]:
            before, docs = docs.columns, f(spark, docs, D)
            assert docs.columns == before
        assert all(set(r[c] for c in r.asDict() if c == "size") <= {"clash"} for r in docs.collect())
        corpus_pipeline.STAGES[-1][1](spark, docs, D).count()


def test_one_row_of_repeated_ids(spark, odd):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words, "a"), (1, words, "a"), (2, words + " x", "b"), (None, words, "c")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] or 0 for r in dedup.one_of_each(docs).collect()) == [0, 1]
