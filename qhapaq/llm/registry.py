"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qhapaq.llm import chat, dedup, language, mixing, neighbours, packing, personal, quality, secret_scan, tokens
from qhapaq.shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2, repeating, at 150% of all words."""
    made, mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), mixing.in_turn(3, 1, 2), keep=["doc_id"])
    goals = spark.createDataFrame([([s], n, t) for s, n, t in zip(made.sources, made.sizes, made.targets)],
                                  "pattern array<string>, source_size long, target double")
    if len(made.sources) <= mixing.BROADCAST_PATTERNS:
        goals = F.broadcast(goals)
    return mixed.join(goals, "pattern").select("row.doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level vocabulary."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to each of which the id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = language.trained(docs, where=~held_out)
    found = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score", "rejected").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by two-word shingles."""
    return dedup.linked(table(spark, sf_dir, "documents"), dedup.Rules(shingle=2))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal.digest(personal.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair against its partner's last answer."""
    out = chat.format_preferences(chat.swapped_answers(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "n_prompt_turns", "prompt", "usable",
                      *[f(F.col(c)).alias(f"{c}_{name}") for c in ("chosen", "rejected")
                        for name, f in (("text", chat.text_of), ("spans", chat.trained_spans))])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"],
                           second_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return judged.select("row.doc_id", *[f"measures.{c}" for c in quality.MEASURES.names], "base_failed", "kept")


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from w
), n as (
  select doc_id, len(s) as n from s
), e as (
  select doc_id, unnest(s) as g from s
), f as (
  select g, count(*) as c from e group by g
), r as (
  select e.doc_id, e.g, row_number() over (partition by e.doc_id order by f.c, e.g) as i from e join f using (g)
), p as (
  select r.doc_id, r.g, n.n from r join n using (doc_id) where r.i <= n.n - ceil(0.8 * n.n) + 1
), c as (
  select distinct x.doc_id as a, y.doc_id as b from p x join p y on x.g = y.g and x.doc_id < y.doc_id
  where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), l as (
  select a, b from (
    select c.a, c.b, len(list_intersect(x.s, y.s)) as k, len(x.s) + len(y.s) as t
    from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b)
  where 100 * k >= 80 * (t - k)
), u as (
  select a, b from l union select b, a from l
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, u.b from reach join u on u.a = reach.b
), m as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select n.doc_id, cast(n.n as bigint) as n_shingles, m.component_id, n.doc_id = m.component_id as kept from n join m using (doc_id)
"""

OP9_SQL = r"""
with t as (
  select conv_id, replace(replace(coalesce(role, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') as role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') as text, turn
  from conversations where conv_id is not null
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from t
), l as (
  select conv_id, coalesce(max(i) filter (where role = 'assistant'), 0) as n_last from n group by conv_id
), a as (
  select l.conv_id, l.n_last, case when l.n_last > 0 then n.text end as answer
  from l left join n on n.conv_id = l.conv_id and n.i = l.n_last
), s as (
  select a.conv_id, a.n_last, coalesce(b.answer, '') as swapped
  from a left join a b on b.conv_id = xor(a.conv_id, 1)
), sides as (
  select conv_id, 'chosen' as side, i, role, text from n
  union all
  select n.conv_id, 'rejected', n.i, n.role, case when n.i = s.n_last then s.swapped else n.text end
  from n join s using (conv_id) where s.n_last = 0 or n.i <= s.n_last
), k as (
  select c.conv_id, min(c.i) as first_diff
  from sides c left join sides r on r.conv_id = c.conv_id and r.side = 'rejected' and r.i = c.i
  where c.side = 'chosen' and (r.i is null or r.role <> c.role or r.text <> c.text) group by c.conv_id
), z as (
  select l.conv_id, coalesce(k.first_diff - 1, m.n) as n_prompt
  from l left join k using (conv_id) join (select conv_id, count(*) as n from n group by conv_id) m using (conv_id)
), r as (
  select sides.*, z.n_prompt, '<|im_start|>' || role || chr(10) as head, text || '<|im_end|>' as body from sides join z using (conv_id)
), c as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, side order by i rows between unbounded preceding and 1 preceding), 0) as pos
  from r where i > n_prompt
), d as (
  select conv_id, side, string_agg(head || body || chr(10), '' order by i) as txt,
    coalesce(string_agg(cast(pos + length(head) as bigint)::varchar || ':' || cast(pos + length(head) + length(body) as bigint)::varchar, ',' order by i)
      filter (where role = 'assistant'), '') as spans
  from c group by conv_id, side
), p as (
  select conv_id, string_agg(head || body || chr(10), '' order by i) as prompt from r where side = 'chosen' and i <= n_prompt group by conv_id
)
select z.conv_id, cast(z.n_prompt as bigint) as n_prompt_turns, coalesce(p.prompt, '') as prompt,
  coalesce(x.spans, '') <> '' and coalesce(y.spans, '') <> '' as usable,
  coalesce(x.txt, '') as chosen_text, coalesce(x.spans, '') as chosen_spans,
  coalesce(y.txt, '') as rejected_text, coalesce(y.spans, '') as rejected_spans
from z left join p using (conv_id)
left join d x on x.conv_id = z.conv_id and x.side = 'chosen'
left join d y on y.conv_id = z.conv_id and y.side = 'rejected'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_token_counts": op2_token_counts,
        "op3_packing": op3_packing,
        "op4_neighbours": op4_neighbours,
        "op5_language": op5_language,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_secrets": op7_secrets,
        "op8_personal_data": op8_personal_data,
        "op9_preferences": op9_preferences,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_near_duplicates": OP6_SQL, "op9_preferences": OP9_SQL}
