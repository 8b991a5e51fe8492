"""Secret scanning: three fixed patterns, and a character convolutional network over further candidates.

Candidates are the pattern findings and every other run of 16 or more token characters that mixes digits,
small or capital letters (runs joined by single dots are one). The network (numpy only) reads each candidate whole, with the characters
around it: its filters are pooled over the candidate and over each side by themselves. It is trained on labelled findings:
pattern findings of the corpus in their real surroundings against mined runs that no pattern touches, and strings made by
rule, since one corpus has few kinds of either. It is calibrated on documents held out from training, and each shape of
candidate has the highest threshold that keeps a stated recall there. Pattern findings always stay; the network adds
findings of kind "model".
"""

from __future__ import annotations

import functools
import random
import re
import string
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
from qhapaq.shared import ship

#: The patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "model")

#: Characters that the network reads left and right of a candidate, width of its filters, and the most positions read at once.
LEFT, RIGHT, KERNEL, PIECE, AT_ONCE = 24, 16, 5, 4096, 1 << 17
_CLASS = np.zeros(256, np.uint8)
for _c in "0123456789abcdef":
    _CLASS[ord(_c)] |= 1
for _c in string.ascii_letters + string.digits + "+/_=-":
    _CLASS[ord(_c)] |= 2


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true values of at least so many."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(a, 2, b) for a, b in _runs(_classes(text) & 1, 24)]
    return sorted(out)


def _classes(text: str) -> np.ndarray:
    """Character classes; the one-byte encoding keeps code point offsets, other characters have none."""
    return _CLASS[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def other_candidates(text: str, base: list[tuple[int, int, int]], mixed: bool = True) -> list[tuple[int, int]]:
    """Runs of token characters that no pattern finding touches; with mixed only those in which digits, small and
    capital letters (beyond the first character) meet, two of the three at least."""
    out: list[tuple[int, int]] = []
    joined: list[list[int]] = []
    for a, b in _runs((_classes(text) & 2) > 0, 16):
        if joined and a == joined[-1][1] + 1 and text[a - 1] == ".":
            joined[-1][1] = b
        else:
            joined.append([a, b])
    starts, furthest = [a for a, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for a, b in joined:
        s = text[a:b]
        fits = not mixed or sum(any(map(kind, s[1:])) for kind in (str.isdigit, str.islower, str.isupper)) >= 2
        before = bisect_left(starts, b)
        if fits and not (before and furthest[before - 1] > a):
            out.append((a, b))
    return out


def window(text: str, a: int, b: int) -> tuple[str, str, str]:
    """A candidate with what stands around it, filled up with NUL at the text's ends."""
    return text[max(0, a - LEFT): a].rjust(LEFT, "\0"), text[a:b], text[b: b + RIGHT].ljust(RIGHT, "\0")


def shape(s: str) -> int:
    """0: lower case and digits only; 1: anything else."""
    return int(not (s.islower() and s.isalnum()))


@dataclass(frozen=True)
class Ragged:
    """Windows laid end to end. zones: the first position of each window's left side, inside and right side."""

    codes: np.ndarray
    marks: np.ndarray
    zones: np.ndarray
    inside: np.ndarray


def laid_out(windows: list[tuple[str, str, str]]) -> Ragged:
    """Each window with two NULs at either end, so that no filter sees two windows."""
    gap = "\0" * (KERNEL // 2)
    text = "".join(gap + left + s + right + gap for left, s, right in windows)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.int64)
    inside = np.fromiter((len(s) for _, s, _ in windows), np.int64, len(windows))
    whole = inside + LEFT + RIGHT + 2 * len(gap)
    first = np.cumsum(whole) - whole + len(gap)
    zones = np.stack([first, first + LEFT, first + LEFT + inside], 1)
    marks = np.zeros((len(codes), 3), np.float32)
    for k, n in enumerate((np.full(len(windows), LEFT), inside, np.full(len(windows), RIGHT))):
        marks[np.repeat(zones[:, k] - (np.cumsum(n) - n), n) + np.arange(n.sum()), k] = 1
    return Ragged(codes, marks, zones, inside)


@dataclass
class CharNet:
    """Embedding, one convolution, its greatest values left of, inside and right of a candidate and the mean inside, a logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)
    held_out: tuple[int, float] = (0, 0.0)

    @staticmethod
    def fresh(seed: int, channels: int = 8, filters: int = 24) -> CharNet:
        rng = np.random.default_rng(seed)
        f = np.float32
        return CharNet(rng.normal(0, 0.5, (128, channels)).astype(f), rng.normal(0, 0.2, (KERNEL * (channels + 3), filters)).astype(f),
                       np.zeros(filters, f), rng.normal(0, 0.2, 4 * filters).astype(f), np.zeros(1, f))

    def _filtered(self, x: Ragged) -> tuple[np.ndarray, np.ndarray]:
        z = np.concatenate([self.embed[x.codes], x.marks], 1)
        cols = np.concatenate([z[k: len(z) - KERNEL + 1 + k] for k in range(KERNEL)], 1)
        h = np.zeros((len(z), len(self.conv_bias)), np.float32)
        h[KERNEL // 2: len(z) - KERNEL // 2] = np.maximum(cols @ self.conv + self.conv_bias, 0)
        return cols, h

    def pooled(self, x: Ragged) -> np.ndarray:
        """(windows, 4 * filters): maxima of the three zones and the sum inside."""
        h = self._filtered(x)[1] * (x.marks.sum(1, keepdims=True) > 0)
        most = np.maximum.reduceat(h, x.zones.ravel()).reshape(len(x.zones), -1)  # gaps are 0, as nothing is below 0
        ends = np.stack([x.zones[:, 1], x.zones[:, 2]], 1).ravel()
        return np.concatenate([most, np.add.reduceat(h, ends)[::2]], 1)

    def logits(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        """Of whole candidates: long ones are read in pieces, whose maxima and sums are put together."""
        parts: list[tuple[str, str, str]] = []
        of: list[int] = []
        for i, (left, s, right) in enumerate(windows):
            for at in range(0, max(1, len(s)), PIECE):
                parts.append(((left + s)[at: at + LEFT] if at else left, s[at: at + PIECE], (s[at + PIECE: at + PIECE + RIGHT] + right)[:RIGHT]))
                of.append(i)
        if not parts:
            return np.empty(0, np.float32)
        found, lo, size = [], 0, 0
        for i, p in enumerate(parts):
            size += len(p[1]) + LEFT + RIGHT
            if size >= AT_ONCE or i + 1 == len(parts):
                found.append(self.pooled(laid_out(parts[lo: i + 1])))
                lo, size = i + 1, 0
        pooled, n = np.concatenate(found), len(self.conv_bias)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        last = np.append(first[1:], len(of)) - 1
        length = np.array([len(s) for _, s, _ in windows], np.float32)[:, None]
        x = np.concatenate([pooled[first, :n], np.maximum.reduceat(pooled[:, n: 2 * n], first), pooled[last, 2 * n: 3 * n],
                            np.add.reduceat(pooled[:, 3 * n:], first) / np.maximum(length, 1)], 1)
        return x @ self.out + self.out_bias

    def probabilities(self, windows: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(windows).astype(float) + self.shift, -30, 30)))

    def fit(self, windows: list[tuple[str, str, str]], y: np.ndarray, seed: int, epochs: int = 8, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on the logistic loss."""
        rng, f = np.random.default_rng(seed), len(self.conv_bias)
        weights = [self.embed, self.conv, self.conv_bias, self.out, self.out_bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i: i + batch]
                x = laid_out([windows[k] for k in at.tolist()])
                cols, h = self._filtered(x)
                dh, pooled, places = np.zeros_like(h), np.zeros((len(at), 4 * f), np.float32), []
                for k in range(3):
                    n = x.inside if k == 1 else np.full(len(at), (LEFT, 0, RIGHT)[k])
                    seg = np.repeat(np.arange(len(at)), n)
                    pos = np.repeat(x.zones[:, k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    part, starts = h[pos], np.cumsum(n) - n
                    top = np.maximum.reduceat(part, starts)
                    pooled[:, k * f: (k + 1) * f] = top
                    places.append((pos, seg, part == top[seg]))
                    if k == 1:
                        pooled[:, 3 * f:] = np.add.reduceat(part, starts) / n[:, None]
                logit = pooled @ self.out + self.out_bias
                d = ((1 / (1 + np.exp(-logit)) - y[at]) / len(at)).astype(np.float32)
                dp = d[:, None] * self.out
                for k, (pos, seg, best) in enumerate(places):
                    dh[pos] += best * dp[seg, k * f: (k + 1) * f]  # equal maxima share a gradient each; rare beyond zero
                    if k == 1:
                        dh[pos] += (dp[:, 3 * f:] / x.inside[:, None])[seg]
                dh = (dh * (h > 0))[KERNEL // 2: len(h) - KERNEL // 2]
                dcols = (dh @ self.conv.T).reshape(len(dh), KERNEL, -1)
                dz = np.zeros((len(x.codes), dcols.shape[2]), np.float32)
                for k in range(KERNEL):
                    dz[k: k + len(dh)] += dcols[:, k]
                de = np.stack([np.bincount(x.codes, dz[:, c], 128) for c in range(self.embed.shape[1])], 1)
                grads = [de, cols.T @ dh, dh.sum(0), pooled.T @ d, d.sum(keepdims=True)]
                step += 1
                for w, g, (m, v) in zip(weights, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, windows: list[tuple[str, str, str]], y: np.ndarray, shapes: np.ndarray, recall: float) -> None:
        """Fit slope and shift by Newton steps; set each shape's threshold.

        It keeps the recall of the shape's held-out secrets. Where nearly all harmless ones (999 of 1000) lie lower still, it
        goes halfway down to them, so that secrets of a new make have room.
        """
        x = self.logits(windows).astype(float)
        w = np.array([1.0, 0.0])
        design = np.stack([x, np.ones_like(x)], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hessian, design.T @ (p - y) + 1e-3 * (w - [1, 0]))
        self.slope, self.shift = map(float, line := w)
        z, p = np.clip(design @ line, -30, 30), self.probabilities(windows)
        limits = []
        for k in (0, 1):
            secrets, harmless = np.sort(z[(y == 1) & (shapes == k)]), z[(y == 0) & (shapes == k)]
            keeps = secrets[int(np.floor((1 - recall) * len(secrets)))] if len(secrets) else 31.0
            below = np.quantile(harmless, 0.999) if len(harmless) else keeps
            limits.append(float(1 / (1 + np.exp(-((keeps + below) / 2 if below < keeps < 31 else keeps)))))
        self.thresholds = tuple(limits)
        hit = p[y == 1] >= np.array(self.thresholds)[shapes[y == 1]]
        self.held_out = (len(hit), float(hit.mean()) if len(hit) else 0.0)


def rule_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, candidate, right, label) made by rule; label 1 is a secret."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfghlmnprst" for b in "aeiou"] + ["er", "an", "in", "or", "the", "ing", "tion", "ent"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    b64 = string.ascii_letters + string.digits

    def drawn(letters: str, least: int, most: int) -> str:
        while True:
            s = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
            if sum(map(str.isdigit, s)) >= 2 and sum(map(str.isalpha, s)) >= 2:
                return s

    def secret() -> str:
        return rng.choice([
            lambda: drawn(b64, 18, 48), lambda: drawn(b64 + "+/", 20, 64), lambda: drawn(b64 + "-_", 20, 48),
            lambda: drawn(string.ascii_lowercase + string.digits, 20, 40), lambda: drawn("0123456789abcdef", 24, 64),
            lambda: "AKIA" + drawn(string.ascii_uppercase + string.digits, 16, 16),
            lambda: word()[:4] + rng.choice("_-") + drawn(b64, 20, 40)])()

    def harmless() -> str:
        number = lambda: str(rng.randint(10, 10 ** rng.randint(2, 5)))
        joined = lambda sep, k: sep.join(word() for _ in range(k))
        s = rng.choice([
            lambda: joined("", 5) + number(), lambda: joined("-", 4) + "-" + number(), lambda: joined("_", 4) + "_" + number(),
            lambda: joined("/", 4) + "/" + number(), lambda: "".join(word().title() for _ in range(4)) + number(),
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-" + number(),
            lambda: word() + "=" * rng.randint(8, 20) + number(), lambda: (word() + number()) * 4,
            lambda: joined("", 3).upper() + "-" + number() + "-" + number() + joined("", 2)])()
        return s if len(s) >= 16 else s + "-" + joined("-", 4) + "10"

    out = []
    for i in range(n):
        s = secret() if i % 2 else harmless()
        left = rng.choice(["", prose() + " ", prose() + " ", prose() + ' "', "key = ", "Bearer ", "id: ", prose() + ": "])
        right = rng.choice(["", " " + prose(), " " + prose(), '" ' + word(), ".", ", " + word(), ")"])
        out.append((left, s, right, i % 2))
    return out


@functools.lru_cache(maxsize=4)
def rule_trained(n: int = 4000, seed: int = 7, recall: float = 0.98) -> CharNet:
    """A network from strings made by rule alone, for texts that are no corpus."""
    return trained([(left, s, right, y, i // 2 % 4 == 3) for i, (left, s, right, y) in enumerate(rule_findings(n, seed))], seed, recall)


def trained(findings: list[tuple[str, str, str, int, bool]], seed: int = 7, recall: float = 0.98) -> CharNet:
    """A network from labelled findings (left, candidate, right, label, held out): those held out calibrate, the rest train."""
    windows = [window(a + s + b, len(a), len(a) + len(s)) for a, s, b, *_ in findings]
    y, shapes = np.array([f[3] for f in findings], np.float32), np.array([shape(f[1]) for f in findings])
    held = np.array([f[4] for f in findings], bool)
    net = CharNet.fresh(seed)
    net.fit([w for w, h in zip(windows, held) if not h], y[~held], seed)
    net.calibrate([w for w, h in zip(windows, held) if h], y[held], shapes[held], recall)
    return net


def labelled(docs: DataFrame, *, text: str = "text", most: int = 1500, longest: int = 512) -> list[tuple[str, str, str, int, bool]]:
    """Labelled findings of a corpus, a bounded sample: at most `most` secrets (what the patterns find, without the keyword)
    and as many harmless runs that no pattern touches; every fourth document, by a hash of its text, is held out.

    Half of the secrets lose their surroundings, so that the network does not lean on the keywords that the patterns know. Copies
    count once, and runs longer than `longest` train no network; both bound the sample, not what is scanned.
    """
    rows = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            out = []
            for t in b.column(0).to_pylist():
                base = base_findings(t)
                plain = [(a, e) for a, e in other_candidates(t, base, mixed=False) if e - a <= longest]
                if base or plain:
                    fold = zlib.crc32(t.encode()) % 4 == 3
                    spans = [(e - len(m[2]), e, 1) if k == 0 and (m := ASSIGN.match(t, a)) else (a, e, 1) for a, k, e in base if e - a <= longest]
                    out += [(*window(t, a, e), y, fold) for a, e, y in [*spans, *((a, e, 0) for a, e in plain[:4] + [p for p in plain[4:] if any(map(str.isdigit, t[p[0]: p[1]]))])]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()))],
                                             ["l", "s", "r", "y", "held"])

    found = rows.mapInArrow(run, "l string, s string, r string, y int, held boolean").distinct()
    order = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("l", "s", "r"), "l", "s", "r"))
    drawn = found.withColumn("n", order).filter(F.col("n") <= most).orderBy("y", "n").collect()
    bare = ("\0" * LEFT, "\0" * RIGHT)
    return [(bare[0] if r["y"] and r["n"] % 2 else r["l"], r["s"], bare[1] if r["y"] and r["n"] % 2 else r["r"], r["y"], r["held"]) for r in drawn]


def corpus_trained(docs: DataFrame, *, text: str = "text", made: int = 4000, seed: int = 7, recall: float = 0.98, doubtful: float = 0.05) -> CharNet:
    """A network from a corpus's labelled findings and strings made by rule; one more pass over the texts.

    Mined runs may hold secrets that no pattern knows. A first network, trained without mined runs, says which may be
    such, with a probability from doubtful up; those have no label and train nothing.
    """
    rule = [(left, s, right, y, i // 2 % 4 == 3) for i, (left, s, right, y) in enumerate(rule_findings(made, seed))]
    found = labelled(docs, text=text)
    secrets, mined = [f for f in found if f[3]], [f for f in found if not f[3]]
    first = trained(secrets + rule, seed, recall)
    doubt = first.probabilities([f[:3] for f in mined]) >= doubtful
    return trained(secrets + [f for f, d in zip(mined, doubt) if not d] + rule, seed, recall)


FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()),
                                     T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(texts: list[str], net: CharNet) -> list[list[dict]]:
    """Findings of each text by start, then kind; the network scores every candidate, in one call for all texts."""
    spans, windows = [], []
    for i, text in enumerate(texts):
        base = base_findings(text)
        for a, k, b in [*base, *((a, 3, b) for a, b in other_candidates(text, base))]:
            spans.append((i, a, k, b))
            windows.append(window(text, a, b))
    out: list[list[dict]] = [[] for _ in texts]
    if spans:
        p = net.probabilities(windows).tolist()
        for (i, a, k, b), score in zip(spans, p):
            if k < 3 or score >= net.thresholds[shape(texts[i][a:b])]:
                out[i].append({"start": a, "kind": KINDS[k], "end": b, "score": score})
    for found in out:
        found.sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
    return out


def _redacted(text: str | None, found: list[dict], mark: str) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for f in found:
        if f["start"] >= at:
            parts += [text[at: f["start"]], mark]
        at = max(at, f["end"])
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, net: CharNet | None = None, *, text: str = "text", keep: list[str] | None = None,
         redact: str | None = None) -> DataFrame:
    """row (a struct of the columns keep, all if None) and findings, array<struct<start,kind,end,score>>, of whole texts.

    With redact, findings in row's text are replaced by that mark. Without a net one is trained on docs first, when this is
    called. One pass without a shuffle; the model is a few kilobytes in the closure. Offsets are code points, ends exclusive. Defined cases: a null text has no
    findings and stays null; repeated rows are scanned each; an empty table gives no rows; other columns stay in row.
    """
    ship(docs.sparkSession)
    net = net or corpus_trained(docs, text=text)
    rows, keep, at = flat(docs, keep, text=text)
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("findings", FINDINGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts, columns = b.column(at).to_pylist(), b.columns[: len(keep)]
            found = _scan([t or "" for t in texts], net)
            if redact is not None and at < len(keep):
                columns[at] = pa.array([_redacted(t, f, redact) for t, f in zip(texts, found)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW)], schema.names)

    return rows.mapInArrow(run, schema).select(row_of(keep), "findings")


def digest(scanned: DataFrame) -> DataFrame:
    """row's columns with counts by kind, base_sha256 and spans from findings."""
    found = F.col("findings")
    of = lambda kind: F.filter(found, lambda f: f["kind"] == kind)
    joined = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.sha2(joined(F.filter(found, lambda f: f["kind"] != "model")), 256)
    return scanned.select("row.*", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base_sha256"), joined(found).alias("spans"))
