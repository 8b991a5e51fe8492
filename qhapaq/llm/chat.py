"""Preference formatting of chat transcripts, in DataFrame functions only.

A pair of conversations (chosen, rejected) is cut at the longest prefix of equal turns. The prefix is rendered
once, as the prompt; what follows in each is rendered as a completion with a loss mask that covers the words of
the trained role and their end marker, and nothing else.

Defined cases: a null text is an empty text; a null role is the role ""; a null turn number sorts first; turns
that share a number are ordered by role, then text, and repeated rows stay as repeated turns; turns whose
conversation id is null belong to no conversation and are left out; an empty table gives an empty table; columns
other than the four named ones are ignored, whatever their names. Turn markers that occur inside a text are
broken up with a blank so that no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qhapaq.llm.batches import named

#: Columns that format_preferences gives.
ADDED = ("n_prompt_turns", "prompt", "chosen", "rejected", "usable")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """text without working turn markers."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _segments(turns: Column, trained_role: str) -> Column:
    """Alternating (text, train) pieces whose texts add up to the rendered turns."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("train")),
        F.struct(_body(t).alias("text"), (t["role"] == trained_role).alias("train")),
        F.struct(F.lit("\n").alias("text"), F.lit(False).alias("train")))))


def conversations(turns: DataFrame, *keys: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per conversation: the keys, conv_id and its turns in order, array<struct<role,text>>."""
    row = F.struct(F.col(turn).alias("turn"), _plain(F.coalesce(F.col(role), F.lit(""))).alias("role"),
                   _plain(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return (turns.filter(F.col(conv_id).isNotNull())
            .groupBy(*keys, F.col(conv_id).alias("conv_id"))
            .agg(F.array_sort(F.collect_list(row)).alias("turns"))
            .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"]))))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                       trained_role: str = "assistant") -> DataFrame:
    """Replace the two turn arrays of each row by prompt, n_prompt_turns and two masked completions.

    The completions, chosen and rejected, are array<struct<text,train>>. usable says that both completions have something to
    train on and differ; rows that aren't usable are returned too. Other columns of pairs stay, but for those named as one
    of the five that are added, which these replace.
    """
    a, b = named(chosen), named(rejected)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    n = F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")
    rest = [named(c) for c in pairs.columns if c not in (chosen, rejected, *ADDED)]
    # one struct holds what is worked out, so that no column of pairs can clash with it
    cut = pairs.select(F.struct(*rest).alias("rest"), F.struct(a.alias("a"), b.alias("b"), n.alias("n")).alias("cut")) if rest else pairs.select(
        F.struct(a.alias("a"), b.alias("b"), n.alias("n")).alias("cut"))
    a, b, n = F.col("cut.a"), F.col("cut.b"), F.col("cut.n")
    made = cut.select(*(["rest"] if rest else []), n.cast("long").alias("n_prompt_turns"), _render(F.slice(a, F.lit(1), n)).alias("prompt"),
                      _segments(F.slice(a, n + 1, F.size(a)), trained_role).alias("chosen"), _segments(F.slice(b, n + 1, F.size(b)), trained_role).alias("rejected"))
    trains = lambda c: F.exists(c, lambda s: s["train"])
    return made.select(*(["rest.*"] if rest else []), "n_prompt_turns", "prompt", "chosen", "rejected",
                       (trains(F.col("chosen")) & trains(F.col("rejected"))).alias("usable"))


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def trained_spans(segments: Column) -> Column:
    """start:end of the trained pieces, in code points of text_of(segments), comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.concat_ws(":", acc["at"].cast("string"), end.cast("string"))
        return F.struct(end.alias("at"),
                        F.when(s["train"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(segments, start, step, lambda acc: acc["spans"]), ",")


def swapped_answers(turns: DataFrame, trained_role: str = "assistant", **names: str) -> DataFrame:
    """Make preference pairs out of single conversations: conv_id, chosen, rejected.

    chosen is the conversation; rejected is the same with its last answer (last turn of the role) replaced by the
    last answer of its partner, the conversation whose id differs in the last bit, and cut after it. Without such a
    partner or answer the replaced answer is the empty text. A conversation without an answer of its own is both
    chosen and rejected. Ids that are no whole numbers have no such bit; among them partners are those that a hash of the id
    puts into one of 2**62 pairs, so nearly all are without. names: the columns of turns, as for conversations. Both
    partners share a shuffle key, so turns are shuffled once and no key holds more than a few conversations; one
    conversation is the unit, and is gathered whole.
    """
    last = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == trained_role, i + 1)))
    four = {k: names.get(k, k) for k in ("conv_id", "turn", "role", "text")}
    turns = turns.select(*[named(c).alias(k) for k, c in four.items()])  # nothing else, so nothing can clash
    whole = F.col("conv_id").cast("string").try_cast("long")
    pair = F.shiftright(F.coalesce(whole, F.xxhash64("conv_id")), 1)
    convs = conversations(turns.withColumn("_pair", pair).repartition("_pair"), "_pair")
    convs = convs.withColumn("_last", F.coalesce(last, F.lit(0))).withColumn(
        "_answer", F.when(F.col("_last") > 0, F.element_at("turns", F.greatest(F.col("_last"), F.lit(1)))["text"]))
    both = F.collect_list(F.struct("conv_id", "turns", "_last", "_answer"))
    pairs = convs.groupBy("_pair").agg(both.alias("_both"))
    one = pairs.select("_both", F.explode("_both").alias("_one"))
    other = F.array_sort(F.filter("_both", lambda c: c["conv_id"] != F.col("_one.conv_id")))
    swapped = F.struct(F.lit(trained_role).alias("role"), F.coalesce(F.get(other, F.lit(0))["_answer"], F.lit("")).alias("text"))
    n = F.col("_one._last")
    return one.select(F.col("_one.conv_id").alias("conv_id"), F.col("_one.turns").alias("chosen"),
                      F.when(n == 0, F.col("_one.turns")).otherwise(
                          F.array_append(F.slice(F.col("_one.turns"), F.lit(1), F.greatest(n - 1, F.lit(0))), swapped)).alias("rejected"))
