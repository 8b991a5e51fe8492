"""Language identification by compression.

Each language has a zstandard dictionary of raw training text. A text belongs to the language whose dictionary
compresses it best. Sizes become probabilities through a temperature fitted on training documents that are in no
dictionary; narrow margins are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.llm.batches import flat, row_of, steps
from qhapaq.shared import ship

UNKNOWN = "und"


@dataclass(frozen=True)
class Rules:
    """Bounds of the training sample: documents a language, of each an excerpt of so many characters from its middle; three
    quarters of them are its dictionary, whole. level is zstandard's. reject: least score."""

    documents: int = 80
    excerpt: int = 1600
    level: int = 9
    reject: float = 0.6


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    temperature: float
    level: int
    reject: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for d in self.dictionaries:
            data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes by each; case carries no language, so both sides are lower case."""
    data = text.lower().encode()
    return [len(c.compress(data)) for c in compressors]


def _probabilities(size: np.ndarray, temperature: float) -> np.ndarray:
    bits = -(size - size.min(axis=-1, keepdims=True)) / temperature
    p = np.exp(np.clip(bits, -700, 0))
    return p / p.sum(axis=-1, keepdims=True)


def trained(docs: DataFrame, rules: Rules | None = None, *, where: Column | None = None, doc_id: str = "doc_id",
            text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows that where holds for (all, if None) with text and language.

    The sample is by a hash of the id, so reruns and other partitionings draw the same. Excerpts only bound what
    the dictionaries hold; classification reads whole texts. Every language that has such a row is learned; the driver holds
    at most documents + 4 * sqrt(documents) excerpts of each, or so. Rows with a null id are not learned from. Without any
    row the model knows no language.
    """
    rules = rules or Rules()
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    rows = rows.filter(where) if where is not None else rows
    order = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(11)), F.lit(1 << 40))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model((), (), 1.0, rules.level, rules.reject)
    share = {k: min(1.0, (rules.documents + 4 * rules.documents**0.5) / n) for k, n in counts.items()}
    limit = F.create_map(*[x for k, s in share.items() for x in (F.lit(k), F.lit(int(s * (1 << 40))))])
    middle = F.greatest(F.lit(1), F.floor((F.length(text) - rules.excerpt) / 2)).cast("int")
    drawn = (rows.filter(order < F.element_at(limit, F.col(lang)))
             .select(F.col(lang).alias("l"), order.alias("o"), F.substring(F.col(text), middle, F.lit(rules.excerpt)).alias("t")))
    sample: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.collect():
        sample.setdefault(r["l"], []).append((r["o"], r["t"]))
    languages = tuple(sorted(sample))
    chosen = {k: [t for _, t in sorted(sample[k])[: rules.documents]] for k in languages}
    fit, held = {k: v[: max(1, len(v) * 3 // 4)] for k, v in chosen.items()}, {k: v[len(v) * 3 // 4:] for k, v in chosen.items()}
    model = Model(languages, tuple("\n".join(dict.fromkeys(fit[k])).lower().encode() for k in languages), 1.0, rules.level, rules.reject)
    made = model.compressors()
    tests = [(i, sizes(t, made)) for i, k in enumerate(languages) for t in held[k] if t]
    if not tests:
        return model
    truth, size = np.array([i for i, _ in tests]), np.array([s for _, s in tests], float)
    loss = {t: -np.log(np.maximum(_probabilities(size, t)[np.arange(len(truth)), truth], 1e-6)).mean() for t in np.geomspace(0.5, 200, 40)}
    return Model(languages, model.dictionaries, float(min(loss, key=loss.get)), rules.level, rules.reject)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns keep, all if None), lang_pred, score and rejected, from the whole text; no shuffle.

    score is the best language's probability; rejected says that it is below the model's limit. Defined cases: a null
    text, one without letters, or a model that learned nothing give "und", score 0, rejected; ties go to the language
    that sorts first; repeated rows are predicted each; an empty table gives no rows; other columns stay in row.
    """
    ship(docs.sparkSession)
    rows, keep, at = flat(docs, keep, text=text)
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors()
        for b in steps(batches):
            best, score = [], []
            for t in b.column(at):
                t = t.as_py()
                if not made or not t or not any(map(str.isalpha, t)):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = _probabilities(np.array(sizes(t, made), float), model.temperature)
                i = int(p.argmax())
                best.append(model.languages[i])
                score.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score, pa.float64()),
                                              pa.array([s < model.reject for s in score], pa.bool_())], schema.names)

    return rows.mapInArrow(run, schema).select(row_of(keep), "lang_pred", "score", "rejected")
