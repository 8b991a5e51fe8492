import zlib

import pytest
from pyspark.sql import functions as F

from qhapaq.llm import language, registry


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.op5_language(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows) and all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, ("the cat and the dog of the house " if i % 2 else "der hund und die katze im haus ") * (3 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "nothing", None)]
    return language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_odd_rows(odd, none, model, spark):
    assert model.languages == ("de", "en")
    got = language.predict(odd, model)
    assert got.count() == odd.count()
    for r in got.collect():
        blank = not any(map(str.isalpha, r["row"]["text"] or ""))
        assert (r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]) if blank else r["lang_pred"] in model.languages
    assert language.predict(none, model).count() == 0
    nothing = language.trained(none)
    assert [r["lang_pred"] for r in language.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), nothing).collect()] == ["und"]


def test_narrow_margins_are_rejected(spark, model):
    rows = spark.createDataFrame([(1, "the dog and the cat of the house and the dog"), (2, "zq")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in language.predict(rows, model).collect()}
    assert got[1]["lang_pred"] == "en" and not got[1]["rejected"] and got[2]["rejected"]


def test_training_ignores_what_is_held_out(spark):
    rows = spark.createDataFrame([(1, "aaa bbb " * 20, "x"), (2, "ccc ddd " * 20, "y")], "doc_id long, text string, lang string")
    assert language.trained(rows, where=F.col("doc_id") == 1).languages == ("x",)
