"""Texts that fool sums of bytes must keep their own hashes and ids."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corroborate.llm import words as W
from corroborate.llm.bottom_k import fingerprint_edits
from corroborate.llm.elias_fano_lm import score_documents
from corroborate.llm.encode import Encoder, _Memo
from corroborate.llm.jaccard_join import similar_documents
from corroborate.llm.queries import tokenizer_path
from corroborate.llm.sum_of_squares import pack_documents

from .conftest import DOCS


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def pairs():
    for n in (64, 128, 1024, 2048):
        for letters in ("ab", "xy"):
            yield thue_morse(n, letters), thue_morse(n, letters[::-1])


def test_complements_have_hashes_of_their_own():
    texts = [t for pair in pairs() for t in pair]
    _, found = next(W.text_slices(pa.array(texts), 1 << 30))
    assert len(set(W.Words(found).hash.tolist())) == len(texts)


def test_hash_depends_on_the_bytes_alone():
    texts = ["alpha beta alpha", "Beta ALPHA", "x" * 7 + " " + "x" * 8 + " " + "x" * 9, "x" * 300 + " " + "x" * 300]
    _, found = next(W.text_slices(pa.array(texts), 1 << 30))
    h = W.Words(found).hash.tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3]
    assert len(set(h[5:8])) == 3 and h[8] == h[9]


@pytest.mark.parametrize(("name", "end", "spaced"), [("word_bpe_49k.json", 1, False), ("byte_bpe_50k.json", 0, True)])
def test_ids_are_those_of_each_text(name, end, spaced):
    path = tokenizer_path(name)
    texts = [t for pair in pairs() for t in pair]
    made = [ids[a:b].tolist() for _, ids, at in Encoder(path, end, spaced).batches(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    library = Tokenizer.from_file(path)
    assert made == [library.encode(t, add_special_tokens=False).ids + [end] for t in texts]


@pytest.mark.parametrize(("name", "end", "spaced"), [("word_bpe_49k.json", 1, False), ("byte_bpe_50k.json", 0, True)])
def test_equal_hashes_do_not_mix_ids(monkeypatch, name, end, spaced):
    real = W.hash_spans
    monkeypatch.setattr(W, "hash_spans", lambda *a, **b: real(*a, **b) & np.uint64(3))  # four hashes in all
    path = tokenizer_path(name)
    texts = ["one two three four five", "six seven one eight " * 5, "z" * 400 + " " + "z" * 399 + "y", "z" * 399 + "y"]
    own, library = Encoder(path, end, spaced), Tokenizer.from_file(path)
    for _ in range(2):
        made = [ids[a:b].tolist() for _, ids, at in own.batches(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
        assert made == [library.encode(t, add_special_tokens=False).ids + [end] for t in texts]
    assert isinstance(own.memo, _Memo)


@pytest.fixture(scope="module")
def twins(spark):
    rows = [(i, t, "en", None, None) for i, t in enumerate(t for n in (1024, 2048) for t in (thue_morse(n), thue_morse(n, "ba")))]
    return spark.createDataFrame(rows, DOCS)


def test_operators_tell_the_twins_apart(twins):
    packed = {r.doc_id: r.ids_crc32 for r in pack_documents(twins, tokenizer_path("word_bpe_49k.json"), capacity=1 << 14).collect()}
    assert len(set(packed.values())) == 4
    assert sorted(r.component_id for r in similar_documents(twins).collect()) == [0, 1, 2, 3]
    prints = fingerprint_edits(twins).collect()
    assert len({r.fingerprint for r in prints}) == 4
    scored = score_documents(twins.selectExpr("doc_id", "text", "doc_id = 0 AS learn"), "learn").collect()
    assert {r.doc_id: r.n_known for r in scored} == {0: 2, 1: 1, 2: 1, 3: 1}
