import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qhapaq.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_on_documents(documents, library):
    got = {r["doc_id"]: r for r in tokens.count_tokens(documents, PATH).collect()}
    rows = documents.collect()
    assert [got[r["doc_id"]]["n_tokens"] for r in rows] == counts(library, [r["text"] for r in rows])
    assert all(got[r["doc_id"]]["n_bytes"] == len(r["text"].encode()) and got[r["doc_id"]]["over_limit"] == (got[r["doc_id"]]["n_tokens"] > 1024) for r in rows)


def test_odd_rows(odd, none, library):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(odd, PATH).collect())
    texts = [(r["doc_id"] or 0, r["text"] or "") for r in odd.collect()]
    assert got == sorted((i, len(t.encode()), n) for (i, t), n in zip(texts, counts(library, [t for _, t in texts])))
    assert tokens.count_tokens(none, PATH).count() == 0


def test_special_and_long_pieces(library):
    rng = random.Random(4)
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 700, "ab" * 900, "".join(rng.choice("etaoin") for _ in range(5000)), " " * 600 + "x", "՘࢏", "a\x85b\x1cc  d\r\n\r\n"]
    assert tokens.vocabulary(PATH).count(texts) == counts(library, texts)


@pytest.mark.parametrize("letters", ["etaoin", "a", "aab", "abcdefghijklmnopqrstuvwxyz", "éüñß"])
def test_long_sequences_merge_by_rank(library, monkeypatch, letters):
    monkeypatch.setattr(tokens, "LONG", 1)
    rng = random.Random(letters)
    bpe = tokens.ByteBpe(PATH)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (*range(2, 60), 500, 3001, 20_000)]
    assert bpe.count_pieces([t.encode() for t in texts]).tolist() == counts(library, texts)


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
                   {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"type": "WordPiece"}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokens.ByteBpe(str(tmp_path / "other.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co")), st.sampled_from(" \n'tsreeaaabc01")), max_size=60))
def test_any_text(text):
    assert tokens.vocabulary(PATH).count([text]) == counts(_library(), [text])


def _library(held=[]):
    if not held:
        held.append(Tokenizer.from_file(PATH))
    return held[0]
