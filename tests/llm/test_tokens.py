"""Byte-level BPE and token files against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, token_files


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    found.encode_special_tokens = True
    return found


def coder():
    return byte_bpe.codec(byte_bpe.default_ranks(), public_tokenizers.PATTERN)


def expected(text):
    ids = coder().encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip(odd):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(odd).collect())
    assert got == sorted((r.doc_id is not None, r.doc_id or 0, *expected(r.text)) for r in odd.collect())


def test_encode_then_decode(odd):
    tokens = byte_bpe.encode(odd)
    assert sorted(bytes(r.data) for r in byte_bpe.decode(tokens).collect()) == sorted((r.text or "").encode() for r in odd.collect())


def test_empty_tables(empty, tmp_path):
    assert byte_bpe.round_trip(empty).collect() == []
    assert token_files.write_and_read(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9 \n\t'sé.!　 "), max_size=300), st.integers(1, 40))
def test_cut_texts_have_the_same_tokens(text, size):
    assert "".join(byte_bpe.pieces(text, size)) == text
    assert byte_bpe.encode_text(coder(), text, size) == coder().encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_words_have_the_tokens_of_the_text(text):
    own = token_files.codec(public_tokenizers.path(token_files.VOCABULARY))
    try:
        data = text.encode()
    except UnicodeEncodeError:
        return
    ids = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([data])[0], "<u4").tolist() == ids


def test_memory_of_words_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 5)
    own = token_files.WordCodec(public_tokenizers.path(token_files.VOCABULARY))
    texts = [f"Word{k} other{k}, same same" for k in range(20)]
    for k in range(0, 20, 4):
        got = own.encode([t.encode() for t in texts[k : k + 4]])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k : k + 4]]


def test_token_files(spark, odd, tokenizer, tmp_path):
    out = str(tmp_path / "files")
    got = token_files.write_and_read(odd, out=out).collect()
    start = 0
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(got, key=lambda r: r.start)
    for row, found in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, token_files.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(found) == (row.doc_id, start, len(ids), crc)
        start += len(ids)
    plan = token_files.read(spark, out).filter("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan
    assert token_files.read(spark, out).filter("doc_id = 5").count() == 2


def test_a_word_is_looked_up_once_in_a_batch():
    own = token_files.WordCodec(public_tokenizers.path(token_files.VOCABULARY))

    class Counted(dict):
        asked = 0

        def get(self, word, default=None):
            Counted.asked += 1
            return dict.get(self, word, default)

        def __getitem__(self, word):
            Counted.asked += 1
            return dict.__getitem__(self, word)

    own.words = Counted()
    texts = [b" Plain words plain\x0bwords  ", None, b"", b"\xff\xc3 plain \xc3", "Wörter É words".encode()] * 50
    ids, starts = own.encode_lists(texts)
    plain = [own.tokenizer.encode((t or b"").decode(errors="replace"), add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == plain
    assert Counted.asked <= 7  # different words, the empty one before a leading blank among them
