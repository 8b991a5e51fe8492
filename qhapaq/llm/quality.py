"""Quality rules: repetition and symbol counts, and the fertility of public tokenisers with bands per language.

A subword vocabulary spends an ordinary number of characters per token on text of the languages it knows. Texts of
noise, broken encodings, shouting, symbols or endless repetition spend too few or too many, fall back to bytes, or use few different
tokens. Each document's measures (characters per token of two vocabularies, share of byte-fallback tokens, entropy of
its tokens) are held against the distinct texts of its language and length class that pass the repetition rules;
where a document has no language, its script stands in. Classes go by characters, as the tokens are under test. Where a
class has too few texts, the language is asked, then the script, then fixed bands, so that every document is judged.

A band is the median and a multiple of a spread, which is the lesser of the distances from the median to the 10th and
the 90th percentile: bad texts lie on one side, so they do not widen it (of a script, which has many languages, the
greater). Percentiles come from counts of the measures rounded to
a grid, so they are exact for any partitioning and no task holds more than the grid.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.llm.batches import flat, row_of, steps
from qhapaq.shared import ship, written

#: The six blanks that part words, and the characters that count as symbols.
BLANKS, SYMBOLS = "\t\n\v\f\r ", "#*$%&|<>"
MEASURES = T.StructType([T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("n_tokens", T.LongType()), ("chars_per_token", T.DoubleType()),
    ("byte_share", T.DoubleType()), ("token_entropy", T.DoubleType()), ("script", T.StringType()), ("chars_per_token_2", T.DoubleType()))])


@dataclass(frozen=True)
class Rules:
    """window: words of a repeated passage. width: spreads (10th percentile to median, over 1.28, as for a normal distribution) that a measure may lie under the
    median, and width_above over it; groups of n texts get 1 + 2 / sqrt(n) times that.

    The least_ values keep a band from closing where most documents are alike, the most_ values from opening where a
    group of near copies holds a percentile (as shares of the median for characters per token, else absolute); groups of
    fewer than support texts have no band, and the next wider one judges. The script's band is for languages that are too
    rare for one, which may differ from those that fill it: its spread is the greater of the two sides, and the script_
    values are its least_ ones. Over all lengths the spread of characters per
    token is that of an endless text; one of c characters has sqrt(1 + short_chars / c) times it. There, and in the fixed
    bands, the least entropy is at most short_entropy of what the number of tokens allows, and short_bytes more byte
    tokens are allowed, as line ends are some of few tokens. The fixed_ bands hold for texts of any script that the
    vocabulary spells in up to three bytes a character.
    """

    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    width: float = 3.5
    width_above: float = 5.0
    least_chars: float = 0.035
    least_bytes: float = 0.05
    least_entropy: float = 0.35
    most_chars: float = 0.5
    most_bytes: float = 0.25
    most_entropy: float = 2.5
    script_chars: float = 0.25
    script_entropy: float = 1.0
    support: int = 30
    short_chars: float = 330.0
    short_entropy: float = 0.5
    short_bytes: int = 8
    fixed_chars: tuple[float, float] = (0.3, 12.0)
    fixed_bytes: float = 0.9
    fixed_entropy: float = 3.5


def repeated_words(words: list, window: int) -> int:
    """Words that lie in a window of so many words that occurs twice or more, each counted once."""
    n = len(words)
    if n <= window:
        return 0
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(place) == n:
        return 0
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    power = np.uint64(0x9E3779B97F4A7C15)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    hashed = mixed[: n - window + 1].copy()
    for k in range(1, window):
        hashed = hashed * power + mixed[k: n - window + 1 + k]
    ordered = np.sort(hashed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)  # those of equal hashes are compared as they are
    doubtful = np.flatnonzero(np.isin(hashed, ordered[1:][ordered[1:] == ordered[:-1]]))
    _, inverse, counts = np.unique(rows[doubtful], axis=0, return_inverse=True, return_counts=True)
    starts = doubtful[counts[inverse.reshape(-1)] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


@functools.lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "unknown").split(" ")[0].lower()


def script_of(text: str) -> str:
    """The script of most letters of a text, by their Unicode names; none without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    found: Counter = Counter()
    for ch, k in Counter(text).items():
        if ch.isalpha():
            found[_script(ch)] += k
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


@functools.lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


@functools.lru_cache(maxsize=2)
def _second(path: str):
    import base64

    import tiktoken

    from qhapaq.llm.tokens import PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("second", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _measures(text: str | None, model_path: str, rules: Rules, second_path: str | None = None) -> tuple:
    text = text or ""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    sp, is_byte = _model(model_path)
    ids = np.array(sp.encode(text, num_threads=1), np.int64) if words else np.empty(0, np.int64)
    counts = np.bincount(ids)
    p = counts[counts > 0] / max(1, len(ids))
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words, rules.window), len(ids), word_chars / len(ids) if len(ids) else None,
            float(is_byte[ids].mean()) if len(ids) else None, float(-(p * np.log2(p)).sum()) if len(ids) else None, script_of(text),
            word_chars / len(_second(second_path).encode_ordinary(text)) if words and second_path else None)


def _key(text: str | None) -> int:
    """64 bits of a text's hash: copies have the same."""
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "big", signed=True)


def measure(docs: DataFrame, model_path: str, rules: Rules, *, text: str = "text", lang: str | None = "lang", keep: list[str] | None = None,
            second_path: str | None = None) -> DataFrame:
    """The columns keep (all, if None) as c0, c1, ..., lang, text_key (equal for copies) and a struct measures; one pass without a shuffle."""
    rows, keep, at = flat(docs, keep, text=text, **({"lang": lang} if lang else {}))
    rows = rows if lang else rows.withColumn("lang", F.lit(None).cast("string"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], rows.schema["lang"], T.StructField("text_key", T.LongType()), T.StructField("measures", MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found, keys = [], []
            for t in b.column(at):
                found.append(dict(zip(MEASURES.names, _measures(value := t.as_py(), model_path, rules, second_path))))
                keys.append(_key(value))
            kind = pa.struct([(f.name, {"bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string())) for f in MEASURES])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], b.column("lang"), pa.array(keys, pa.int64()), pa.array(found, kind)], schema.names)

    return rows.mapInArrow(run, schema)


def base_failed(rules: Rules) -> F.Column:
    m = F.col("measures")
    return (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])


#: Steps of the grid for each measure, and the greatest step counted: what is beyond is counted there.
GRID = {"chars_per_token": (1e-3, 20_000), "chars_per_token_2": (1e-3, 20_000), "byte_share": (1e-3, 1000), "token_entropy": (5e-3, 6000)}


def _spread(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _n, _mid and _sd of counted values; a key's rows are no more than the grid has steps and classes."""
    upto = Window.partitionBy(*keys).orderBy(value)
    placed = (counts.groupBy(*keys, value).agg(F.sum("_c").alias("_c"))
              .withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*keys))}))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_n"), F.col(value)))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), at(0.1).alias("_lo"), at(0.5).alias("_mid"), at(0.9).alias("_hi"))
    sides = F.col("_hi") - F.col("_mid"), F.col("_mid") - F.col("_lo")
    spread = F.when(F.col("_level") == SCRIPT_LEVEL, F.greatest(*sides)).otherwise(F.least(*sides))  # a script's languages lie on either side
    return found.select(*keys, "_n", "_mid", (spread / 1.28).alias("_sd"))


def bands(measured: DataFrame, rules: Rules) -> DataFrame:
    """low and high bounds of the measures by LEVELS, from the distinct texts that pass the base rules.

    Copies are brought together by text first, so that a text counts once in its group however often it occurs. What is
    left is one histogram by group, script, class and measure, from which all levels are made.
    """
    m = F.col("measures")
    texts = (_grouped(measured).filter(~base_failed(rules) & (m["n_tokens"] > 0))
             .groupBy("_group", "_class", "_script", "text_key").agg(*[F.min(m[c]).alias(c) for c in GRID]))
    steps_ = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.least(F.round(F.col(c) / step), F.lit(most)).cast("int").alias("s")) for c, (step, most) in GRID.items()]))
    counts = written(texts.select("_group", "_class", "_script", steps_.alias("x")).filter("x.s is not null")
                     .groupBy("_group", "_class", "_script", F.col("x.c").alias("_c_name"), F.col("x.s").alias("_s")).agg(F.count("*").alias("_c")), "quality-counts")
    step = F.create_map(*[x for c, (width, _) in GRID.items() for x in (F.lit(c), F.lit(width))])
    counts = counts.withColumn("_v", F.col("_s") * F.element_at(step, F.col("_c_name")))
    none, parts = F.lit(None).cast("long"), []
    for i, at in enumerate(LEVELS):
        rows = counts.select(F.lit(i).alias("_level"), F.col(at[0]).alias("_key"), (F.col(at[1]) if at[1:] else none).alias("_size"), "_class", "_c_name", "_v", "_c")
        keys = ["_level", "_key", "_size", "_c_name"]
        found = _spread(rows, keys, "_v")
        if not at[1:]:  # of all lengths: spreads as if every text were endless
            longer = F.when(F.col("_c_name").startswith("chars"), F.sqrt(1 + rules.short_chars / F.pow(F.lit(2.0), F.col("_class") + 0.5))).otherwise(1.0)
            mids = found.select("_key", "_c_name", F.col("_mid").alias("_m"))
            scaled = rows.join(mids, ["_key", "_c_name"]).withColumn("_z", F.round((F.col("_v") - F.col("_m")) / longer, 4))
            found = found.drop("_sd").join(_spread(scaled, keys, "_z").select("_key", "_c_name", "_sd"), ["_key", "_c_name"]).select(*keys, "_n", "_mid", "_sd")
        parts.append(found)
    found = functools.reduce(DataFrame.unionByName, parts).filter(F.col("_n") >= rules.support)
    more = (1 + 2 / F.sqrt("_n")) * F.col("_sd")
    of = lambda c, what: F.max(F.when(F.col("_c_name") == c, what))
    by = lambda one, other: F.when(F.col("_level") == SCRIPT_LEVEL, one).otherwise(other)
    share = lambda w: F.least(F.greatest(w * more, by(rules.script_chars, rules.least_chars) * F.col("_mid")), rules.most_chars * F.col("_mid"))
    within = lambda least, most: F.least(F.greatest(rules.width * more, least), F.lit(most))
    return found.groupBy("_level", "_key", "_size").agg(
        *[of(c, x).alias(n) for c, k in (("chars_per_token", ""), ("chars_per_token_2", "_2")) for n, x in (
            (f"_mid_chars{k}", F.col("_mid")), (f"_below_chars{k}", share(rules.width)), (f"_above_chars{k}", share(rules.width_above)))],
        of("byte_share", F.col("_mid") + within(F.lit(rules.least_bytes), rules.most_bytes)).alias("_high_bytes"),
        of("token_entropy", F.col("_mid") - within(by(rules.script_entropy, rules.least_entropy), rules.most_entropy)).alias("_low_entropy"))


def _grouped(measured: DataFrame) -> DataFrame:
    group = F.coalesce(F.concat(F.lit("lang:"), F.col("lang").cast("string")), F.concat(F.lit("script:"), F.col("measures.script")))
    return measured.withColumns({"_group": group, "_class": F.floor(F.log2(F.greatest(F.col("measures.word_chars"), F.lit(1)))),
                                 "_script": F.col("measures.script")})


#: Keys of the bands from the narrowest, which is asked first, to the widest.
LEVELS = (("_group", "_class"), ("_group",), ("_script",))
SCRIPT_LEVEL = 2
BOUNDS = ("_mid_chars", "_below_chars", "_above_chars", "_mid_chars_2", "_below_chars_2", "_above_chars_2", "_high_bytes", "_low_entropy")


def _with_band(rows: DataFrame, limits: DataFrame, rules: Rules) -> DataFrame:
    """A struct _band of BOUNDS beside every row: that of the first level that has one, else the fixed one."""
    share = F.broadcast if limits.count() <= BROADCAST_BANDS else lambda df: df
    for i, at in enumerate(LEVELS):
        names = [F.col(c).alias(name) for c, name in zip(("_key", "_size"), at)]
        rows = rows.join(share(limits.filter(F.col("_level") == i).select(*names, F.struct(*BOUNDS).alias(f"_band{i}"))), list(at), "left")
    low, high = rules.fixed_chars
    fixed = dict(zip(BOUNDS, (low, 0.0, high - low, low, 0.0, high - low, rules.fixed_bytes, rules.fixed_entropy)))
    longer = F.sqrt(1 + rules.short_chars / F.greatest(F.col("measures.word_chars"), F.lit(1)))
    n = F.greatest(F.col("measures.n_tokens"), F.lit(1))

    def widened(c: str, value: Column, mid: Column | None) -> Column:
        """A bound of all lengths for this row's length; mid: None in the fixed bands, whose characters a token stay."""
        if c == "_low_entropy":
            return F.least(value, rules.short_entropy * F.log2(n))
        if c == "_high_bytes":
            return F.least(value + rules.short_bytes / n, F.lit(rules.fixed_bytes))
        return value if mid is None or "mid" in c else F.least(value * longer, rules.most_chars * mid)

    def bound(c: str) -> Column:
        """Of the first band there is. Every bound is an expression of its own: updates of a struct would repeat it whole in each
        of its fields, until the driver has more of a plan than it can hold or compile."""
        mid = "_mid_chars_2" if c.endswith("_2") else "_mid_chars"
        found = F.when(F.col("_band0").isNotNull(), F.col(f"_band0.{c}"))
        for i in range(1, len(LEVELS)):
            found = found.when(F.col(f"_band{i}").isNotNull(), widened(c, F.col(f"_band{i}.{c}"), F.col(f"_band{i}.{mid}")))
        return found.otherwise(widened(c, F.lit(fixed[c]), None))

    return rows.withColumn("_band", F.struct(*[bound(c).alias(c) for c in BOUNDS]))


#: Bands are broadcast up to so many; more (which would take thousands of languages) are joined by shuffle.
BROADCAST_BANDS = 20_000


def judge(docs: DataFrame, model_path: str, rules: Rules | None = None, *, text: str = "text", lang: str | None = "lang",
          keep: list[str] | None = None, second_path: str | None = None) -> DataFrame:
    """row (a struct of the columns keep, all if None), struct measures, boolean base_failed and boolean kept.

    base_failed: fewer than least_words words, or over repeat_percent of the words in repeated windows. kept: not
    base_failed and inside the narrowest band there is for it. The measured rows are written once to the shared folder, since the
    bands need them all before any can be judged; model_path is a sentencepiece model, second_path (none, if None) a file of tiktoken ranks. Copies of a text count once in the bands. Defined cases: a null or empty text has no words and fails; equal
    rows get equal verdicts; a null language is replaced by the script; an empty table gives no rows; other columns
    stay in row untouched.
    """
    rules = rules or Rules()
    ship(docs.sparkSession)
    measured = written(measure(docs, model_path, rules, text=text, lang=lang, keep=keep, second_path=second_path), "quality")
    limits = written(bands(measured, rules), "quality-bands")
    m, band = F.col("measures"), F.col("_band")
    failed = base_failed(rules)
    ordinary = lambda c, k: (m[c] >= band[f"_mid_chars{k}"] - band[f"_below_chars{k}"]) & (m[c] <= band[f"_mid_chars{k}"] + band[f"_above_chars{k}"])
    inside = (m["n_tokens"] == 0) | (
        ordinary("chars_per_token", "") & F.coalesce(ordinary("chars_per_token_2", "_2"), F.lit(True)) & (m["byte_share"] <= band["_high_bytes"])
        & (m["token_entropy"] >= band["_low_entropy"]))
    return (_with_band(_grouped(measured), limits, rules)
            .withColumns({"base_failed": failed, "kept": ~failed & inside}).select(row_of(docs.columns if keep is None else keep), "measures", "base_failed", "kept"))
