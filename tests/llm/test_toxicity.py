import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetrail.llm import toxicity as m

from .helpers import docs, odd_docs


def _auc(pos, neg):
    return (np.searchsorted(np.sort(neg), pos).sum() + np.searchsorted(np.sort(neg), pos, side="right").sum()) / 2 / len(pos) / len(neg)


def test_features_are_distinct_words_and_prefixes():
    a, first = m.features(["bad bad words", "", "words BAD", "übergröße"])
    rows = [set(a[x:y].tolist()) for x, y in zip(first, first[1:])]
    assert rows[0] == rows[2] and not rows[1]
    # the word and its beginnings of 4, 5, 6 and 7 letters (not bytes)
    assert len(rows[3]) == 5 and len(rows[3] & set(m.features(["übergrößen"])[0].tolist())) == 4


def test_the_risk_separates_without_negative_labels():
    rng = random.Random(1)
    vocab = [f"w{i}x" for i in range(300)]

    def text(toxic):
        return " ".join([rng.choice(vocab) for _ in range(60)] + ([rng.choice(["slur", "insult"])] if toxic else []))

    truth = [rng.random() < 0.1 for _ in range(4000)]
    texts = [text(True) for _ in range(400)] + [text(t) for t in truth]
    numbers, first = m.features(texts)
    positive = np.arange(len(texts)) < 400
    weights, bias = m.train(numbers, first, positive, 0.1)
    value = m.margins(numbers, first, weights, bias)[400:]
    t = np.array(truth)
    assert _auc(value[t], value[~t]) > 0.99
    assert (m._sigmoid(value[t]) >= 0.7).mean() > 0.95 and (m._sigmoid(value[~t]) < 0.5).mean() > 0.95


def _table(name):
    return f"/root/testdata/sf0.1/{name}.parquet"


def test_held_out_documents(spark):
    d, l = spark.read.parquet(_table("documents")), spark.read.parquet(_table("labels"))
    rows = m.score(d, l).where("held_out").join(l.select("doc_id", "toxic"), "doc_id").toPandas()
    assert _auc(rows.score[rows.toxic == 1].values, rows.score[rows.toxic == 0].values) > 0.9
    assert rows.predicted[rows.toxic == 1].mean() > 0.85 and rows.predicted[rows.toxic == 0].mean() < 0.06
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_held_out_labels_are_not_read(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = l.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic"))
                          .otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in m.score(d, x).collect()) for x in (l, turned))
    assert a == b


def test_odd_rows(spark):
    df = odd_docs(spark)
    schema = "doc_id long, quality int, toxic int, score string, pos int"
    labels = spark.createDataFrame([(6, 1, 1, "x", 0), (6, 1, 0, "x", 0), (4, None, None, None, 0), (None, 1, 1, None, 0), (5, 0, 0, "", 0),
                                    (999, 1, 1, "", 0)], schema)
    for l in (labels, spark.createDataFrame([], schema), labels.where("toxic = 0")):
        got = m.score(df, l).collect()
        assert len(got) == df.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        scores = {r["doc_id"]: r["score"] for r in got}
        assert scores[0] == scores[1] == scores[3]
    assert m.score(docs(spark, []), labels).collect() == []


def _plain_training(rows, positive, prior, steps, size):
    """The same steps with the two risks written out row by row and gradients by differences; also how often the negative
    risk was below zero."""
    def risks(theta):
        value = [theta[-1] + sum(theta[f] for f in row) for row in rows]
        loss = lambda z: math.log1p(math.exp(-z))
        pos, unl = [v for v, p in zip(value, positive) if p], [v for v, p in zip(value, positive) if not p]
        on_positive = prior * sum(map(loss, pos)) / len(pos)
        on_negative = sum(loss(-v) for v in unl) / len(unl) - prior * sum(loss(-v) for v in pos) / len(pos)
        return on_positive, on_negative

    theta = np.zeros(size + 1)
    theta[-1] = math.log(prior / (1 - prior))
    mean, square, below = np.zeros_like(theta), np.zeros_like(theta), 0
    for turn in range(1, steps + 1):
        negative = risks(theta)[1] < 0
        below += negative
        wanted = (lambda t: -risks(t)[1]) if negative else (lambda t: sum(risks(t)))
        g = np.array([(wanted(theta + d) - wanted(theta - d)) / 2e-5 for d in np.eye(size + 1) * 1e-5])
        g[:-1] += m.DECAY * theta[:-1]
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        rate = m.STEP * min(1.0, 3 * (1 - (turn - 1) / steps))
        theta = theta - rate * mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return theta, below


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_training_equals_a_plain_computation_of_the_risk(monkeypatch, prior):
    monkeypatch.setattr(m, "STEPS", 60)
    monkeypatch.setattr(m, "STEP", 0.2)
    rng = np.random.default_rng(4)
    positive = np.arange(240) < 80
    shares = np.array([[0.9, 0.2], [0.1, 0.6], [0.5, 0.05]])
    rows = [[f for f in range(3) if rng.random() < shares[f][0 if p else 1]] for p in positive]
    numbers = np.array([f for row in rows for f in row])
    first = np.cumsum([0, *map(len, rows)])
    assert m.telling(numbers, first, positive, 2)[:3].all()
    weights, bias = m.train(numbers, first, positive, prior, bits=2)
    want, below = _plain_training(rows, positive, prior, 60, 3)
    # with the small prior the negative risk is on either side of zero
    assert 0 < below and (prior > 0.5 or below < 60)
    assert np.allclose([*weights[:3], bias], want, rtol=1e-4, atol=1e-5) and weights[3] == 0
