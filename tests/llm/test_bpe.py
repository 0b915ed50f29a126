import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe
from tests.llm.helpers import EDGES, table

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_are_those_of_the_library(spark, library):
    found = sorted(bpe.encoding_digests(table(spark, EDGES, clash=True), PATH).collect(), key=str)
    wanted = []
    for doc_id, text, *_ in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert [tuple(r) for r in found] == sorted(wanted, key=str)


def test_encoding_and_decoding_is_a_round_trip(spark):
    docs = table(spark, EDGES)
    back = bpe.decoded(bpe.encoded(docs, PATH), PATH)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in EDGES)


def test_empty_table(spark):
    assert bpe.encoding_digests(table(spark, []), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  \n\t'strevmld1é.,<|>日 ́"), max_size=60), max_size=6))
def test_random_texts(vocab, library, texts):
    for text, (ids, spelt) in zip(texts, bpe.Encoder(vocab).encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert spelt == ",".join(map(str, wanted))
        assert vocab.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


def test_bytes_that_are_no_text(vocab, library):
    for ids in ([160, 50256, 220], [127, 222, 96], list(range(188, 256)), [50257 + 5, 64]):
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    monkeypatch.setattr(bpe, "PASS_BYTES", 8)
    encoder = bpe.Encoder(vocab)
    first = [ids.tolist() for ids, _ in encoder.encode(["some words here", "and there"])]
    assert [ids.tolist() for ids, _ in encoder.encode(["some words here", "and there"])] == first
