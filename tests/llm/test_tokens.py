import functools
import zlib

import numpy as np
import pytest
from common_cases import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from penumbra.llm import token_output
from penumbra.llm.common import shared_folder
from penumbra.llm.queries import tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=1500))
def test_coding_is_reversible(ids):
    x = np.array(ids, np.uint32)
    payload = token_output.encode(x)
    assert (token_output.decode(payload) == x).all()
    blocks = -(-len(x) // token_output.BLOCK)
    for b in range(blocks):
        assert (token_output.decode(payload, b, b + 1) == x[b * token_output.BLOCK : (b + 1) * token_output.BLOCK]).all()


def test_small_ids_take_few_bits():
    assert len(token_output.encode(np.zeros(60_000, np.uint32))) < 60_000 / 4
    rare = np.zeros(60_000, np.uint32)
    rare[::100] = 2**32 - 1
    assert len(token_output.encode(rare)) < 60_000 / 3
    with pytest.raises(ValueError):
        token_output.decode(b"oops" + bytes(20))


def test_word_encoder_equals_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    ids_of = token_output.word_encoder(tokenizer)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["it's I'LL don't''", "İstanbul ΑΣ. ŉab ǅ ſt K Å ﬁ", "é ña á.", "日本語 한가 1a a1 a_b", "<|endoftext|>. x<|startoftext|>", "\x1c \x85   z", "É. ÉTÉ!! x’s"]
    for text in texts:
        got = np.frombuffer(b"".join(ids_of[w] for w in text.encode().split()), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


@functools.cache
def loaded():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    assert token_output.by_words(tokenizer)
    return tokenizer, token_output.text_encoder(tokenizer)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_tokenizer(text):
    tokenizer, encode = loaded()
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_that_keeps_white_space_encodes_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    text = "Two  spaces, a\ttab\n\nand lines"
    assert not token_output.by_words(tokenizer)
    assert np.frombuffer(token_output.text_encoder(tokenizer)(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_payloads_are_coded_in_parts(monkeypatch):
    ids = np.random.default_rng(0).integers(0, 50_000, 20_000).astype(np.uint32)
    ids[::1000] = 2**32 - 1
    whole = token_output.encode(ids)
    monkeypatch.setattr(token_output, "AT_ONCE", 3)
    parts = token_output.encode(ids)
    assert (token_output.decode(whole) == ids).all() and (token_output.decode(parts) == ids).all()
    assert (token_output.decode(parts, 5, 17) == ids[5 * token_output.BLOCK : 17 * token_output.BLOCK]).all()


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def write(spark, docs, **options):
    path = shared_folder(spark, "tokens")
    token_output.write_tokens(docs, path, FILE, **options)
    return path


def test_files_hold_all_documents_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = write(spark, docs, shards=5, chunk_ids=3000)
    got = [tuple(r) for r in token_output.read_token_digests(spark, path).orderBy("start").collect()]
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    whole = token_output.read_tokens(spark, path).orderBy("start").first()
    assert len(whole.ids) == whole.n_tokens and whole.ids[-1] == 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = [tuple(r) for r in token_output.read_token_digests(spark, write(spark, docs)).orderBy("start").collect()]
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert token_output.read_token_digests(spark, write(spark, empty(spark))).count() == 0
