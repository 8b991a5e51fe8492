"""Personal data by weak supervision.

Fixed patterns find emails, IP addresses, card and phone numbers; looser patterns propose further spans. Labelers
(shape, checksum, gazetteer, context, surroundings, digits) vote yes, no or nothing on each span. Expectation-maximisation
over the vote patterns of the whole corpus estimates how reliable each labeler is on each kind and how likely each pattern
is personal data. These soft labels train a logistic classifier that reads the span and the text around it as hashed
character trigrams beside the votes; it decides about the proposed spans. Pattern findings of the four fixed kinds
always stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.llm.batches import flat, row_of, steps
from qhapaq.shared import ship, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "at_email", "local_phone", "social", "account", "person")

#: Patterns. The atomic forms match what the plain ones do, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I | re.A)
LOCAL_PHONE = re.compile(r"(?<![\d+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])", re.A)
SOCIAL = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A)
ACCOUNT = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.A)
PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?|(?:(?<=name is )|(?<=Name: ))[A-Z][a-z]{1,30} [A-Z][a-z]{1,30}", re.A)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us pe mx ar it nl pt br ch at ca au".split())
DIAL_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "49", "51", "52", "54", "55", "56", "57", "61", "81", "86", "91")
CARD_STARTS = ("34", "36", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65")
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
FIRST_NAMES = frozenset("Anna Ana Maria Marie Juan Jose John Jane Peter Pedro Paul Pierre Hans Karl Carlos Laura Lucia David Thomas Michael Sarah Emma Luis".split())
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write to", "correo"), "at_email": ("email", "e-mail", "mail", "contact", "correo"),
    "ip": ("ip", "address", "host", "server", "from"), "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"), "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "social": ("ssn", "social security", "social"), "account": ("iban", "account", "konto", "compte", "cuenta"), "person": ("name", "contact", "patient", "dear")}
AGAINST = ("version", "isbn", "order", "invoice no", "serial", "section", "release", "figure", "table")

LABELERS = ("shape", "checksum", "gazetteer", "context", "surroundings", "digits")
CONTEXT_CHARS, MOST_CHARS = 32, 80
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, i = 0, text.find("@")
    while i >= 0:
        a = i
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, i + 1) if a < i else None
        if m:
            yield a, m.end()
            done = m.end()
        i = text.find("@", max(i + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the four fixed kinds, sorted."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def proposed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser kinds that touch no pattern finding; the first kind wins where they overlap."""
    taken = sorted((a, b) for _, a, b in base)  # spans of fixed kinds may overlap one another
    out: list[tuple[int, int, int]] = []
    for k, pattern, sure in ((4, AT_EMAIL, "at"), (5, LOCAL_PHONE, ""), (6, SOCIAL, "-"), (7, ACCOUNT, ""), (8, PERSON, "")):
        if sure in text or sure == "at" and sure in text.lower():
            starts, furthest = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
            free = [m.span() for m in pattern.finditer(text) if not (n := bisect_left(starts, m.end())) or furthest[n - 1] <= m.start()]
            out += [(k, a, b) for a, b in free]
            taken = sorted([*taken, *free]) if free else taken
    return sorted(out)


def _checked(kind: str, s: str, digits: str) -> int:
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind == "account":
        plain = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "social":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    return 0


def _listed(kind: str, s: str, digits: str) -> int:
    if kind in ("email", "at_email"):
        return 1 if re.split(r"[^a-z0-9-]+", s.lower())[-1].strip("-") in TOP_DOMAINS or s.lower().rstrip(")]").rsplit(".", 1)[-1] in TOP_DOMAINS else -1
    if kind == "phone":
        return 1 if digits.startswith(DIAL_CODES) else -1
    if kind == "card":
        return 1 if digits.startswith(CARD_STARTS) else 0
    if kind == "account":
        return 1 if s[:2] in COUNTRIES else -1
    if kind == "ip":
        return -1 if s.startswith(("0.", "127.", "255.")) else 0
    if kind == "person":
        return 1 if any(w in FIRST_NAMES for w in s.split()) else 0
    return 0


def votes(text: str, k: int, a: int, b: int) -> str:
    """One character (+, -, 0) per labeler for a span."""
    kind, s = KINDS[k], text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    before, after = text[max(0, a - CONTEXT_CHARS): a].lower(), text[b: b + 8].lower()
    shape = {"email": len(s) <= 254 and "." in s.rsplit("@", 1)[-1], "ip": all(len(p) < 4 for p in s.split(".")), "card": len(digits) in (16, 19),
             "phone": s.count("(") == s.count(")"), "person": len(s) < 40}.get(kind, True)
    near = any(w in before for w in CONTEXT[kind])
    against = any(w in before for w in AGAINST)
    tight = (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-_/#.")) or (after[:1].isalnum() or after[:1] in ("_", "/"))
    plain = len(set(digits)) <= 2 if digits else None
    cast = (1 if shape else -1, _checked(kind, s, digits), _listed(kind, s, digits), -1 if against else 1 if near else 0,
            -1 if tight else 1, 0 if plain is None else -1 if plain else 1)
    return "".join("-0+"[v + 1] for v in cast)


def around(text: str, a: int, b: int) -> str:
    """What the classifier reads: the span between marks in its surroundings, in small letters, every digit a 0."""
    seen = f"{text[max(0, a - CONTEXT_CHARS): a]}\x01{text[a: min(b, a + MOST_CHARS)]}\x02{text[b: b + 8]}"
    return DIGIT.sub("0", seen.lower())


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = 30, strength: float = 10.0) -> tuple[dict[str, float], dict[str, np.ndarray], dict[tuple[str, str], float]]:
    """Expectation-maximisation over counted (kind, votes): priors by kind, P(vote | class) by kind and labeler, soft labels.

    The start believes labelers: a span with more yes than no votes is likely personal. A kind's table leans on that of
    all kinds as if that were `strength` more spans of each class, so that rare kinds have sensible ones.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["-0+".index(c) for c in votes] for _, votes in keys], int).reshape(len(keys), -1)
    kinds = np.array([k for k, _ in keys])
    p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
    prior: dict[str, float] = {}
    tables: dict[str, np.ndarray] = {}

    def counted(at: np.ndarray) -> np.ndarray:
        out = np.zeros((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            out[j, 1] = np.bincount(v[at, j], (n * p)[at], 3)
            out[j, 0] = np.bincount(v[at, j], (n * (1 - p))[at], 3)
        return out

    for _ in range(rounds):
        pooled = counted(np.ones(len(keys), bool)) + 1
        pooled /= pooled.sum(2, keepdims=True)
        odds = np.zeros(len(keys))
        new = {}
        for kind in sorted(set(kinds)):
            at = kinds == kind
            table = counted(at) + strength * pooled
            new[kind] = table / table.sum(2, keepdims=True)
            prior[kind] = ((n * p)[at].sum() + 1) / (n[at].sum() + 2)
            odds[at] = np.log(prior[kind] / (1 - prior[kind])) + sum(np.log(new[kind][j, 1, v[at, j]] / new[kind][j, 0, v[at, j]]) for j in range(v.shape[1]))
        tables, p = new, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return prior, tables, dict(zip(keys, p.tolist()))


#: Buckets of hashed trigrams.
HASHED = 1024
_VOTED = 1 + len(KINDS) + 3 * len(LABELERS)


def _features(spans: list[tuple[str, str, str]]) -> np.ndarray:
    """(spans, features) of (kind, votes, around): kind, votes and trigrams, these to a length of one."""
    x = np.zeros((len(spans), _VOTED + HASHED))
    x[:, 0] = 1
    for i, (kind, vote, seen) in enumerate(spans):
        x[i, 1 + KINDS.index(kind)] = 1
        for j, c in enumerate(vote):
            x[i, 1 + len(KINDS) + 3 * j + "-0+".index(c)] = 1
        grams = [zlib.crc32(seen[k: k + 3].encode("utf-8", "replace")) % HASHED for k in range(len(seen) - 2)]
        np.add.at(x[i], _VOTED + np.array(grams, int), 1 / max(1, len(grams)) ** 0.5)
    return x


@dataclass(frozen=True)
class Model:
    """weights over _features. tables: P(vote | class) by kind, as learned."""

    weights: np.ndarray
    tables: dict[str, np.ndarray]

    def probabilities(self, spans: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(spans) @ self.weights, -30, 30))) if spans else np.empty(0)


def train(patterns: dict[tuple[str, str], int], sample: list[tuple[str, str, str]], ridge: float = 1.0) -> Model:
    """From counted (kind, votes) of the whole corpus and a sample of (kind, votes, around) to read."""
    if not patterns or not sample:
        return Model(np.zeros(_VOTED + HASHED), {})
    _, tables, soft = reliabilities(patterns)
    x, y = _features(sample), np.array([soft[k, v] for k, v, _ in sample])
    w = np.zeros(x.shape[1])
    for _ in range(15):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return Model(w, tables)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("votes", T.StringType()), T.StructField("around", T.StringType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("around", pa.string())]))


def _spans(text: str | None) -> list[dict]:
    if not text:
        return []
    base = base_spans(text)
    return [dict(zip(_SPAN.names, (KINDS[k], a, b, votes(text, k, a, b), around(text, a, b)))) for k, a, b in [*base, *proposed_spans(text, base)]]


def propose(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns keep, all if None) and found: spans with votes and what is around them. One pass, no shuffle.

    Defined cases: a null or empty text has no spans; repeated rows are read each; an empty table gives no rows; other
    columns stay in row.
    """
    ship(docs.sparkSession)
    rows, keep, at = flat(docs, keep, text=text)
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("found", T.ArrayType(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = pa.array([_spans(t.as_py()) for t in b.column(at)], _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], found], schema.names)

    return rows.mapInArrow(run, schema).select(row_of(keep), "found")


def learned(proposed: DataFrame, *, most: int = 4000) -> Model:
    """A model from proposed spans: vote patterns (at most 9 * 3**6) are counted over all rows, and the classifier reads a
    sample of at most `most` distinct spans of each kind, by a hash."""
    one = proposed.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.around")
    patterns = {(r["kind"], r["votes"]): r["count"] for r in one.groupBy("kind", "votes").count().collect()}
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("votes", "around"), "votes", "around"))
    drawn = one.distinct().withColumn("n", order).filter(F.col("n") <= most).select("kind", "votes", "around").orderBy("kind", "votes", "around").toArrow()
    return train(patterns, list(zip(*(c.to_pylist() for c in drawn.columns))))


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """row (a struct of the columns keep, all if None) and found, the accepted spans by kind, then start, of whole texts.

    The first pass writes each row's spans to the shared folder (a small fraction of the texts), from which the model is
    learned when this is called; the second pass scores what was written. A proposed span that fails its checksum is never
    accepted. Offsets are code points, ends exclusive. Defined cases: a null text has no spans; repeated rows are read
    each; an empty table gives no rows; other columns stay in row.
    """
    proposed = written(propose(docs, text=text, keep=keep), "personal")
    model, checksum = learned(proposed), LABELERS.index("checksum")
    names = docs.columns if keep is None else keep
    rows = proposed.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)], "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = b.column(b.num_columns - 1).to_pylist()
            asked = [s for spans in found for s in spans if s["kind"] not in BASE and s["votes"][checksum] != "-"]
            good = {id(s) for s, p in zip(asked, model.probabilities([(s["kind"], s["votes"], s["around"]) for s in asked])) if p >= threshold}
            kept = [[s for s in spans if s["kind"] in BASE or id(s) in good] for spans in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, _ARROW_SPANS)], b.schema.names)

    return rows.mapInArrow(run, rows.schema).select(row_of(names), F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"], s["votes"])).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """row's columns with counts by fixed kind, base_sha256 and spans from found."""
    spans = F.col("found")
    joined = lambda fs: F.array_join(F.transform(fs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    base = F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256)
    return found.select("row.*", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base_sha256"), joined(spans).alias("spans"))
