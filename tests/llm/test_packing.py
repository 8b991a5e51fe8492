import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from qhapaq.llm import packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(docs, rules=packing.Rules(), ranks=RANKS):
    library = Tokenizer.from_file(PATH)
    ids = [(r["doc_id"], np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")) for r in docs.collect()]
    rows = packing.pack(docs, PATH, ranks, rules=rules).collect()
    expect = sorted((-1 if i is None else i, len(x)) for i, x in ids)
    whole = defaultdict(list)
    for r in rows:
        whole[-1 if r["doc_id"] is None else r["doc_id"]].append(r)
    assert sum(r["length"] for r in rows) == sum(n for _, n in expect)
    known = {-1 if i is None else i: x for i, x in ids}
    for i, pieces in whole.items():
        times = sum(1 for j, _ in expect if j == i)
        covered = np.zeros(len(known[i]), int)
        for p in pieces:
            assert p["doc_tokens"] == len(known[i]) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(known[i][p["start"]: p["start"] + p["length"]].tobytes())
            covered[p["start"]: p["start"] + p["length"]] += 1
        assert (covered == times).all()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= rules.length
        total += at
        padding += 0 if at & (at - 1) == 0 else rules.length - at
    return padding / max(1, total)


def test_documents(documents):
    assert check(documents.coalesce(1)) < 0.02
    check(documents.repartition(3), packing.Rules(block_tokens=5000))
    rows = packing.pack(documents.coalesce(1), PATH, RANKS).collect()
    cut = {r["doc_id"] for r in rows if r["doc_tokens"] <= 2048 and r["length"] < r["doc_tokens"]}
    assert len(cut) < 0.27 * len({r["doc_id"] for r in rows if r["doc_tokens"] <= 2048})


def test_odd_rows(odd, none):
    check(odd)
    check(odd, ranks=None)
    assert packing.pack(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    rules = packing.Rules(length=16, short=(4, 8), sentence_cut=1, word_cut=3, per_sequence=2, grid=2, fitting_cut=int(rng.integers(0, 5)))
    lengths = rng.integers(1, 12, rng.integers(1, 8))
    inner = np.unique(rng.integers(1, lengths.sum() + 1, 5))
    at, penalty = packing.candidates(lengths, inner[inner < lengths.sum()], rules)
    cuts = packing.best_cuts(at, penalty, rules)
    pad = lambda n: 0 if n in (4, 8, 16) else 16 - n
    price = sum(pad(b - a) + penalty[np.searchsorted(at, b)] + 2 for a, b in zip(cuts, cuts[1:]))
    best = {0: 0.0}
    for j in range(1, len(at)):
        best[at[j]] = min(best[a] + pad(at[j] - a) + penalty[j] + 2 for a in at[:j] if at[j] - a <= 16)
    assert price == pytest.approx(best[at[-1]]) and all(0 < b - a <= 16 for a, b in zip(cuts, cuts[1:]))
