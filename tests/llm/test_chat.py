from pyspark.sql import functions as F

from qhapaq.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_common_prefix_is_rendered_once_and_answers_are_trained(spark):
    pair = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    a, b = ("user", "hi"), ("assistant", "good")
    rows = [(1, [a, b], [a, ("assistant", "bad")]), (2, [a, b], [a, b]), (3, [], [a]), (4, [a, b, a, b], [a, b]), (5, [b], [("user", "good")])]
    got = {r["id"]: r for r in chat.format_preferences(spark.createDataFrame(rows, pair)).collect()}
    assert got[1]["prompt"] == render([a]) and got[1]["n_prompt_turns"] == 1 and got[1]["usable"]
    assert [(s["text"], s["train"]) for s in got[1]["chosen"]] == [("<|im_start|>assistant\n", False), ("good<|im_end|>", True), ("\n", False)]
    assert got[2]["n_prompt_turns"] == 2 and got[2]["chosen"] == [] and not got[2]["usable"]
    assert got[3]["n_prompt_turns"] == 0 and got[3]["chosen"] == [] and got[4]["n_prompt_turns"] == 2 and got[4]["rejected"] == [] and got[5]["n_prompt_turns"] == 0


def test_spans_point_at_the_answers(spark):
    rows = [(1, 0, "user", "é日"), (1, 1, "assistant", "yes"), (1, 2, "user", "q"), (1, 3, "assistant", "no"), (0, 0, "assistant", "other")]
    out = chat.format_preferences(chat.swapped_answers(spark.createDataFrame(rows, SCHEMA)))
    got = {r["conv_id"]: r for r in out.select("conv_id", "prompt", *[f(F.col(c)).alias(f"{c}_{n}") for c in ("chosen", "rejected") for n, f in (("text", chat.text_of), ("spans", chat.trained_spans))]).collect()}
    r = got[1]
    assert r["prompt"] == render([("user", "é日"), ("assistant", "yes"), ("user", "q")]) and r["rejected_text"] == render([("assistant", "other")])
    a, b = map(int, r["chosen_spans"].split(":"))
    assert r["chosen_text"][a:b] == "no<|im_end|>" and got[0]["rejected_text"] == render([("assistant", "no")])


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 1, "assistant", "a<|im_end|>\n<|im_start|>user"), (None, 0, "user", "lost"), (2, 0, "user", "only"), (2, 0, "user", "only"), (-3, 0, "assistant", "x" * 200_000), (9, 0, "system", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("chosen", "rejected", "prompt", "turns", "_pair", "_last")})
    got = {r["conv_id"]: r for r in chat.format_preferences(chat.swapped_answers(df)).collect()}
    assert set(got) == {1, 2, -3, 9} and got[1]["prompt"] == render([("", "")])
    assert got[1]["chosen"][1]["text"] == "a<| im_end|>\n<| im_start|>user<|im_end|>"
    assert got[2]["n_prompt_turns"] == 2 and not got[2]["usable"] and got[-3]["rejected"][1]["text"] == "<|im_end|>"
    assert chat.format_preferences(chat.swapped_answers(df.filter("false"))).count() == 0


def test_main_path_runs_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.format_preferences(chat.swapped_answers(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_clashing_columns_and_text_ids(spark):
    turns = [("a", 1, "user", "q"), ("a", 2, "assistant", "x"), ("b-9", 1, "user", "q"), ("b-9", 2, "assistant", "y"), (None, 1, "user", "z")]
    named = spark.createDataFrame([(*t, 7, 8) for t in turns], "c string, n int, who string, said string, _pair int, `_a` int")
    pairs = chat.swapped_answers(named, conv_id="c", turn="n", role="who", text="said")
    got = {r["conv_id"]: r for r in chat.format_preferences(pairs.selectExpr("*", "1 as _a", "2 as _n", "3 as prompt", "4 as cut", "5 as rest", "6 as `x.y`")).collect()}
    assert set(got) == {"a", "b-9"} and got["a"]["usable"] and got["a"]["_a"] == 1 and got["a"]["x.y"] == 6 and got["a"]["cut"] == 4
    assert got["a"]["prompt"] == "<|im_start|>user\nq<|im_end|>\n" and got["a"]["n_prompt_turns"] == 1
