import base64
import itertools
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetrail.llm import langid as m
from codetrail.llm.words import words_of

from .helpers import docs, odd_docs


@pytest.fixture
def vocabulary(tmp_path):
    path = tmp_path / "pieces"
    pieces = [b" a", b"ab", b"b", b"abc", b" ab", b"c", b"bc", b"abcabcabcabc", b"cabcabcabca", b"A", b"a b", "é".encode(),
              "aé".encode(), "é".encode()[1:] + b"a", b"1"]
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" 0" for p in pieces))
    return str(path)


def _segmentations(word):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def _known(path):
    with open(path, "rb") as f:
        found = {base64.b64decode(x.split()[0]) for x in f} | {bytes([b]) for b in (32, *range(97, 123), *range(128, 256))}
    letters = lambda p: all(b >= 128 or 97 <= b <= 122 for b in p)
    return sorted(p for p in found if letters(p) or p[:1] == b" " and letters(p[1:]))


def _brute(word, number, prob):
    total, counts = np.zeros(prob.shape[1]), np.zeros_like(prob)
    for parts in _segmentations(word):
        if all(p in number for p in parts):
            p = np.prod([prob[number[x]] for x in parts], axis=0)
            total += p
            for x in parts:
                counts[number[x]] += p
    return total, counts / total


def test_forward_sums_all_segmentations_and_counts_are_expectations(vocabulary):
    found = _known(vocabulary)
    known = m.pieces(vocabulary)
    assert known.size == len(found) and known.longest == 12
    rng = np.random.default_rng(1)
    prob = np.concatenate([rng.random((len(found), 3)), np.zeros((1, 3))])
    number = {p: i for i, p in enumerate(found)}
    for word in (" abcab", " abcabcabcabcabc", " é", " aéaéb", " a"):
        word = word.encode()
        total, counts = _brute(word, number, prob)
        matrix = np.frombuffer(word, np.uint8)[None]
        assert np.allclose(m.forward_logs(matrix, np.array([len(word)]), prob, known), np.log(total))
        assert np.allclose(m.expected(matrix, prob, np.array([[3.0, 5.0, 0.0]]), known), counts * [3, 5, 0])


def test_texts_sum_over_words_of_any_length(vocabulary):
    found = _known(vocabulary)
    rng = np.random.default_rng(3)
    prob = np.concatenate([rng.random((len(found), 4)) * 1e-7, np.zeros((1, 4))])
    number = {p: i for i, p in enumerate(found)}

    def word_log(word):
        word = b" " + word.encode()
        logs = []
        for k in range(4):
            alpha = [Decimal(1)]
            for j in range(1, len(word) + 1):
                alpha.append(sum(alpha[i] * Decimal(prob[number[word[i:j]], k])
                                 for i in range(max(0, j - known.longest), j) if word[i:j] in number))
            logs.append(float(alpha[-1].ln()))
        return np.array(logs)

    known = m.pieces(vocabulary)
    texts = ["abcab 12 Cab", "abc" * 700, "", "é" * 150 + " a", "abcabcabcabc" * 3 + "c", "abc" * 11, "b"]
    got = m.Scorer(prob, vocabulary).text_logs(texts)
    for text, logs in zip(texts, got, strict=True):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        assert np.allclose(logs, sum(map(word_log, words), np.zeros(4)))


def test_remembering_changes_no_score(monkeypatch):
    rng = np.random.default_rng(2)
    path = m.default_vocabulary()
    n = m.pieces(path).size
    prob = np.concatenate([rng.random((n, 3)) / n, np.zeros((1, 3))])
    texts = ["the cat and the dog", "le chat et le chien", "", "x" * 300, "a"]
    whole = m.Scorer(prob, path).text_logs(texts)
    monkeypatch.setattr(m, "REMEMBER", 2)
    scorer = m.Scorer(prob, path)
    assert np.allclose(np.concatenate([scorer.text_logs([t]) for t in texts]), whole)
    assert (whole[2] == 0).all() and np.isfinite(whole).all()


def test_words_to_learn_from_are_cut_between_characters():
    text = "x" * 300 + " a" + "é" * 300 + " " + "x€" * 200 + " short"
    w = words_of([text], letters_only=True, longest=50)
    raw = w.data.tobytes()
    parts = [raw[a:b].decode() for a, b in zip(w.start, w.end)]
    assert "".join(parts) == text.replace(" ", "") and max(len(p.encode()) for p in parts) <= 53


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.predict_languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_not_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz"))
                          .otherwise(F.col("lang")))
    a, b = (sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in m.predict_languages(x).collect()) for x in (df, wrong))
    assert a == b


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = m.predict_languages(df).collect()
    assert len(got) == df.count()
    by_id = {r["doc_id"]: r for r in got}
    for i in (0, 1, 2, 3, 9, 10):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    assert by_id[6]["lang_pred"] == "en" and math.isclose(by_id[6]["score"], 1.0)
    assert m.predict_languages(docs(spark, [])).collect() == []
    unlabelled = m.predict_languages(docs(spark, [(1, "some text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]
    kept = m.keep_identified(spark, df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 11, None}


def test_number_signs_are_no_letters(spark):
    from codetrail.llm import langid
    from .helpers import docs
    rows = [(i, f"the quick brown fox number {i}", "en") for i in range(60)] + [(100, "½ ² ①", None), (101, "Ⅷ", None), (102, "Ⅷ ª", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs(spark, rows)).collect()}
    assert got[100] == got[101] == "und" and got[102] == "en"
    kept = langid.keep_identified(spark, docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] > 99) == [102]
