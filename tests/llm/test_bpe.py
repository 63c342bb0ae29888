import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ByteBPE(f.read())


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["'ll", " 's", "<|endoftext|>", "  ", "\n\n ", "123", "é"]))).map("".join))
def test_as_the_library(own, public, text):
    ids = own.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == public.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_any_ids_decode_alike(own, public, ids):
    assert own.decode(ids) == public.decode(ids, skip_special_tokens=False)


def test_letters_newer_than_the_library(own, public):
    for first, last in bpe.NEWER:
        for c in (first, last):
            for text in (f"{chr(c)}'ll", f"a{chr(c)} {chr(c)}1 {chr(c)}{chr(c)}b"):
                assert own.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_cache_generations(own, public, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 4)
    text = " ".join(f"wordlike{i % 7}" for i in range(50))
    assert own.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_rows(odd, empty, public):
    got = {(r.doc_id, r.n_tokens, r.decoded) for r in bpe.encode_documents(odd, PATH).collect()}
    want = {(r.doc_id, len(public.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in odd.collect()}
    assert got == want
    assert bpe.encode_documents(empty, PATH).count() == 0
    one = bpe.encode_documents(odd.where("doc_id = 8"), PATH).first()
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, one.ids)).encode()).hexdigest()
