"""Exact token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A batch of distinct pre-tokens is held as one flat array of symbols plus sequence numbers. In each round every
sequence finds its own lowest merge rank and all places of that rank merge at once; a sequence that has no merge
left drops out with its count. A merge makes a symbol that only later ranks use, so a round gives what one merge
at a time would give. Pre-tokens beyond LONG bytes go through a heap of ranks instead, whose cost is linear-logarithmic.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.llm.batches import steps
from qhapaq.shared import ship

#: The published pre-token pattern of the byte-level vocabularies, and its form for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters whose letter, number and blank classes are the same in all Unicode versions of the libraries here.
SETTLED = r"[\x00-\u0557\u2000-\u206f\u20a0-\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
LONG = 4096
#: Bounds of a worker's memory: characters cut at a time, and distinct pre-tokens whose counts are kept.
SLICE_CHARS, KEPT = 2_000_000, 200_000
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """(left, right) -> merge rank, as an open-addressed numpy hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, n_symbols: int):
        self.n, self.bits = np.uint64(n_symbols), max(4, (8 * len(left)).bit_length())
        keys = left.astype(np.uint64) * self.n + right.astype(np.uint64)
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32)
        todo, at, self.reach = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.reach += 1
            free = self.ranks[at] == NONE
            place, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[place], self.ranks[place] = keys[won], won
            left_over = ~np.isin(todo, won)
            todo, at = todo[left_over], (at[left_over] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * self.n + right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.ranks[at] != NONE))
        for _ in range(self.reach):
            if not len(todo):
                break
            at_todo = at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at_todo] == keys[todo]
            out[todo[hit]] = self.ranks[at_todo[hit]]
            todo = todo[~hit & (self.ranks[at_todo] != NONE)]
        return out


def _refuse_others(spec: dict) -> None:
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
             and not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")))
    if not plain:
        raise ValueError("not a plain byte-level BPE file")


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form. Files that ask for more than this class does
    (other models or pre-tokens, normalizers, prefix blanks, unlike added tokens) raise ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        alphabet = byte_alphabet()
        self.first = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.first[b] = vocab[ch]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]), len(vocab))
        specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.any, self.ascii, self.settled = regex.compile(PATTERN), re.compile(ASCII_PATTERN), re.compile(SETTLED)
        self._path, self._library = path, None
        self.counts: dict[str, int] = {}

    def spans(self, text: str) -> Iterable[str]:
        """The pre-tokens of a text without special strings."""
        if text.isascii():
            return self.ascii.findall(text) if len(text) < SLICE_CHARS else (m[0] for m in self.ascii.finditer(text))
        if self.settled.fullmatch(text):
            return self.any.findall(text) if len(text) < SLICE_CHARS else (m[0] for m in self.any.finditer(text))
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return (text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text))

    def count_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left in each pre-token."""
        out = np.zeros(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._count_long(pieces[i])
        short = np.flatnonzero((lengths <= LONG) & (lengths > 0))
        if len(short):
            flat = np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)
            out[short] = self._count_ragged(self.first[flat], lengths[short])
        return out

    def _count_ragged(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, live = lengths.copy(), np.arange(len(lengths))
        rank = np.full(len(symbols), NONE, np.int32)
        starts = np.cumsum(lengths) - lengths
        while len(live):
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1] = self.pairs.look_up(symbols[:-1], symbols[1:])
            rank[starts + lengths - 1] = NONE  # a sequence's last symbol has no right neighbour
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest != NONE
            if not going.all():
                out[live[~going]] = lengths[~going]
                stays = np.repeat(going, lengths)
                symbols, rank = symbols[stays], rank[stays]
                live, lengths, lowest = live[going], lengths[going], lowest[going]
                if not len(live):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, lengths))
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # equal neighbours overlap: every second one merges
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            starts = np.cumsum(lengths) - lengths
            lengths = np.add.reduceat(kept, starts, dtype=np.int64)
            symbols, starts = symbols[kept], np.cumsum(lengths) - lengths
        return out

    def _count_long(self, piece: bytes) -> int:
        sym = np.append(self.first[np.frombuffer(piece, np.uint8)], np.int32(0))
        n = len(piece)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n is the end
        rank = np.full(n + 1, NONE, np.int32)
        rank[: n - 1] = self.pairs.look_up(sym[: n - 1], sym[1:n])
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def listed(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(part)

        listed(np.arange(n - 1))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])  # equal neighbours overlap: every second one merges
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            gone = after[at]
            sym[at], rank[gone] = self.merged[r], NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            right = after[touched]
            rank[touched] = np.where(right < n, self.pairs.look_up(sym[touched], sym[np.minimum(right, n)]), NONE)
            listed(touched)
        return left

    def _learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.counts]
        self.counts.update(zip(new, self.count_pieces([p.encode() for p in new]).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; memory is bounded by the slice, or by the distinct pre-tokens of a longer text."""
        out: list[int] = []
        for part in _slices(texts):
            if len(self.counts) > KEPT:
                self.counts.clear()
            rows: list[tuple[int, list]] = []
            for text in part:
                plain, n_special = [text], 0
                if self.special and self.special.search(text):
                    plain, n_special = self.special.split(text), sum(1 for _ in self.special.finditer(text))
                rows.append((n_special, [Counter(self.spans(t)) if len(t) >= SLICE_CHARS else self.spans(t) for t in plain]))
            rows = [(n, [s if isinstance(s, (list, Counter)) else [*s] for s in spans]) for n, spans in rows]
            self._learn({p for _, spans in rows for s in spans for p in s})
            known = self.counts
            for n, spans in rows:
                out.append(n + sum(sum(known[p] * k for p, k in s.items()) if isinstance(s, Counter)
                                   else sum(map(known.__getitem__, s)) for s in spans))
        return out


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """The vocabulary at path, once for each worker process."""
    return ByteBpe(path)


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text, in one pass without a shuffle.

    The counts are those of the tokenizers library for the JSON file at path, without added begin or end tokens;
    its special strings inside a text count as one token each. Defined cases: a null text counts as empty (0, 0);
    repeated rows and ids give a row each; null ids stay; other columns are ignored; an empty table gives none.
    """
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema[0]
    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in steps(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                              pa.array(bpe.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
