"""Order-preserving packing of documents into training sequences by dynamic programming.

The documents of a partition form one stream of tokens in id order. A sequence is a window of the stream. Windows
may be cut at document ends (free) and at sentence ends (a small penalty, and a larger one in a document that would fit
into a sequence). Only where neither comes within a whole length may a cut fall on every grid-th token. Among all ways to
cut a block of the stream, the programme takes one with the least padding plus penalties; a block's last window moves on
into the next block. A window's padding is linear in its start, so the best start among the last `length` tokens is the front of a
monotone queue; windows of the unpadded short lengths are tried beside it.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qhapaq.llm.batches import steps
from qhapaq.llm.tokens import PATTERN, byte_alphabet, vocabulary
from qhapaq.shared import ship

PIECES = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                       T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                       T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


@dataclass(frozen=True)
class Rules:
    """length: tokens of a sequence. short: lengths that need no padding either. Costs are in padding tokens: of a cut at a
    sentence's end, of any cut in a document that would fit into a sequence (added to the others), of a cut off a
    boundary, and of a sequence."""

    length: int = 2048
    short: tuple[int, ...] = (256, 512, 1024)
    end_id: int = 1
    sentence_cut: float = 4.0
    fitting_cut: float = 64.0
    word_cut: float = 24.0
    per_sequence: float = 16.0
    grid: int = 16
    block_tokens: int = 1_000_000


class Encoder:
    """Token ids by a byte-level BPE file of the tokenizers library.

    ranks_path names the same vocabulary as tiktoken ranks. That library takes a sixth of the time, and gives the same ids for
    texts without special strings whose characters have the same classes in both libraries; all others, and all if there
    are no ranks, go to tokenizers.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        bpe = vocabulary(path)
        self.special, self.settled, self.fast = bpe.special, bpe.settled, None
        if ranks_path:
            import base64

            import tiktoken
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        n = self.library.get_vocab_size() + 1
        self.ends, self.opens = np.zeros(n, bool), np.zeros(n, bool)  # tokens that can end a sentence, and follow one
        alphabet = byte_alphabet()
        for token, i in self.library.get_vocab().items():
            plain = bytes(alphabet.get(c, 63) for c in token)
            self.ends[i] = b"\n" in plain or plain.rstrip()[-1:] in (b".", b"!", b"?")
            self.opens[i] = plain[:1].isspace()

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not (self.special and self.special.search(text)) and (text.isascii() or self.settled.fullmatch(text)):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None) -> Encoder:
    return Encoder(path, ranks_path)


def best_cuts(at: np.ndarray, penalty: np.ndarray, rules: Rules) -> np.ndarray:
    """Which of the positions at (from 0 to the stream's end, no two further apart than a length) to cut at.

    penalty[i] is what a cut at at[i] costs. Returns the positions of the cheapest cuts, with both ends.
    """
    n, length, fixed = len(at), rules.length, rules.per_sequence
    where = at.tolist()
    cost = (penalty + fixed).tolist()
    exact: dict[int, list[int]] = {}
    for p in rules.short:
        i = np.searchsorted(at, at - p)
        for j in np.flatnonzero((at >= p) & (at[i] == at - p)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    total, came, keyed = [0.0] * n, [0] * n, [0.0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        key = keyed[j - 1] = total[j - 1] + where[j - 1]
        while queue and keyed[queue[-1]] > key:
            queue.pop()
        queue.append(j - 1)
        here = where[j]
        while where[queue[0]] < here - length:
            queue.popleft()
        source = queue[0]
        best = keyed[source] + length - here
        if j in exact:
            for i in exact[j]:
                if total[i] < best:
                    best, source = total[i], i
        total[j], came[j] = best + cost[j], source
    cuts, j = [where[-1]], n - 1
    while j:
        j = came[j]
        cuts.append(where[j])
    return np.array(cuts[::-1], np.int64)


def candidates(lengths: np.ndarray, inner: np.ndarray, rules: Rules, fits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and penalties for documents of these lengths with sentence ends at the positions inner.

    fits: whether each document would fit into a sequence, where lengths are of parts of them.
    """
    ends = np.cumsum(lengths)
    at = np.unique(np.concatenate([[0], ends, inner]))
    wide = np.flatnonzero(np.diff(at) > rules.length)
    grid = [np.arange(at[i] + rules.grid, at[i + 1], rules.grid) for i in wide]
    every = np.unique(np.concatenate([at, *grid])) if grid else at
    penalty = np.full(len(every), rules.word_cut)
    penalty[np.searchsorted(every, inner)] = rules.sentence_cut
    of = np.minimum(np.searchsorted(ends, every, "right"), len(ends) - 1)
    penalty += rules.fitting_cut * (lengths <= rules.length if fits is None else fits)[of]
    penalty[np.searchsorted(every, ends)] = 0
    penalty[0] = 0
    return every, penalty


@dataclass
class _Stream:
    """Pieces of documents that have not been given to a sequence yet."""

    ids: list[np.ndarray] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    key: list = field(default_factory=list)
    tokens: int = 0

    def add(self, key, ids: np.ndarray, start: int, of: int) -> None:
        self.ids.append(ids)
        self.start.append(start)
        self.of.append(of)
        self.key.append(key)
        self.tokens += len(ids)


def _cut(stream: _Stream, enc: Encoder, rules: Rules, last: bool, first_id: int) -> tuple[dict[str, list], _Stream, int]:
    """Cut a block; unless it is the last, its last window stays in the stream for the next block."""
    flat = np.concatenate(stream.ids)
    lengths = np.fromiter(map(len, stream.ids), np.int64, len(stream.ids))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inner = np.flatnonzero(enc.ends[flat[:-1]] & (enc.opens[flat[1:]] | (flat[:-1] == flat[1:]))) + 1
    at, penalty = candidates(lengths, inner, rules, np.array(stream.of) <= rules.length)
    cuts = best_cuts(at, penalty, rules)
    if not last:
        cuts = cuts[:-1]
    upto = cuts[-1]
    edges = np.unique(np.concatenate([cuts, starts[starts < upto]]))
    doc = np.searchsorted(starts, edges[:-1], "right") - 1
    seq = np.searchsorted(cuts, edges[:-1], "right") - 1
    size = np.diff(edges)
    start = edges[:-1] - starts[doc] + np.array(stream.start, np.int64)[doc]
    raw = flat.astype("<u4").tobytes()
    out = {"key": [stream.key[d] for d in doc.tolist()], "start": start, "length": size,
           "ids_crc32": [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())],
           "doc_tokens": np.array(stream.of, np.int64)[doc], "sequence_id": seq + first_id, "offset": edges[:-1] - cuts[seq]}
    rest = _Stream()
    if not last:
        for d in range(int(np.searchsorted(ends, upto, "right")), len(lengths)):
            skip = max(0, int(upto - starts[d]))
            rest.add(stream.key[d], stream.ids[d][skip:], stream.start[d] + skip, stream.of[d])
    return out, rest, first_id + len(cuts) - 1


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, *, doc_id: str = "doc_id", text: str = "text",
         rules: Rules | None = None) -> DataFrame:
    """Pack every document into sequences of at most rules.length tokens; one row per piece.

    Columns: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as unsigned little-endian
    32-bit), doc_tokens (with the end id), sequence_id and offset (its place there, without gaps from 0). Each
    partition is a stream of its own, so nothing is shuffled; sequence_id holds the partition above bit 36.
    Memory is bounded by block_tokens plus the longest document. Defined cases: a null text is empty and gives the
    end id alone; repeated rows are packed each; ties in doc_id go by text; null ids come first; other columns are
    ignored; an empty table gives no rows.
    """
    rules = rules or Rules()
    ship(docs.sparkSession)
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema[0]
    schema = T.StructType([id_field, *PIECES.fields])
    names = [f.name for f in PIECES.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stream, next_id, id_type = encoder(path, ranks_path), _Stream(), TaskContext.get().partitionId() << 36, None

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal stream, next_id
            out, stream, next_id = _cut(stream, enc, rules, last, next_id)
            return pa.RecordBatch.from_arrays([pa.array(out["key"], id_type), *[pa.array(out[n], pa.int64()) for n in names]],
                                              ["doc_id", *names])

        for b in steps(batches):
            id_type = b.schema.field(0).type
            for key, words in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(enc.encode(words.as_py()), np.uint32(rules.end_id))
                stream.add(key, ids, 0, len(ids))
                if stream.tokens >= rules.block_tokens:
                    yield cut(False)
        if stream.tokens:
            yield cut(True)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)
