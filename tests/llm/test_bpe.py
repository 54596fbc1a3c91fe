import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from codetrail.llm import bpe

from .helpers import ODD_TEXTS, SF, docs, odd_docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_random_texts_match_the_library(library):
    rng = random.Random(5)
    signs = list(" '\n\ts tredvl1é漢 !a\0\xa0½") + ["<|endoftext|>", "'ll", "  ", "\U0001f642"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["don't we'll I've 'tis ''s 'sabc x's", "1's 2'll 'd   x", "aaaa" * 50 + "aaa", "<|endoftext|>" * 3]
    codec = bpe.Codec(bpe.default_tokenizer())
    ids, first = codec.encode(texts)
    for text, a, b in zip(texts, first, first[1:]):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == expected, text
        assert codec.decode(ids[a:b]) == library.decode(expected, skip_special_tokens=False)


def test_all_code_points_have_the_librarys_class(library):
    points = [chr(c) for c in range(0, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} {c}{c}" for c in points]
    codec = bpe.Codec(bpe.default_tokenizer())
    ids, first = codec.encode(texts)
    for text, a, b, e in zip(texts, first, first[1:], library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, ascii(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 5)
    codec = bpe.Codec(bpe.default_tokenizer())
    for text in ["one two three four five six", "five six seven", "one"]:
        assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text_decode_to_replacement_characters(library):
    ids = [bpe.Codec(bpe.default_tokenizer()).tokenizer.byte_ids[b] for b in (0xE6, 0xBC, 0x61, 0xFF)]
    assert bpe.Codec(bpe.default_tokenizer()).decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_table_matches_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {r["doc_id"]: _digests(library, r["text"]) for r in rows}


def test_odd_rows(spark, library):
    df = odd_docs(spark)
    got = sorted((tuple(r) for r in bpe.round_trip(df).collect()), key=str)
    want = sorted(((r["doc_id"], *_digests(library, r["text"])) for r in df.collect()), key=str)
    assert got == want
    assert bpe.round_trip(docs(spark, [])).collect() == []


def test_encode_and_decode_operators(spark):
    df = docs(spark, [(i, t) for i, t in enumerate(ODD_TEXTS)])
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD_TEXTS)}


def test_words_whose_patterns_cancel_out(library):
    """The Thue-Morse word over two letters and its mirror have equal polynomial hashes modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    texts = []
    for n in (1024, 2048, 4096):
        for a, b in ("ab", "xy", "ba", "yx"):
            texts.append("".join(b if bit else a for bit in bits[:n]))
    codec = bpe.Codec(bpe.default_tokenizer())
    ids, first = codec.encode(texts)
    for text, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
