"""Operator 2: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other text is unlabelled, whatever a label says.  With the class prior
p, the risk of a classifier f is estimated as  p * E+[loss(f)] + max(0, Eu[loss(-f)] - p * E+[loss(-f)]):  the toxic share is
taken out of the unlabelled risk, and where that makes it negative (overfitting) the step goes the other way.  Several
logistic classifiers are trained in numpy, each in a task of its own on its own bounded sample; a score is their mean.

Features are the distinct words of a text and the distinct beginnings (``PREFIXES`` letters) of its longer words, hashed
into ``2 ** BITS`` weights; a text has a feature or not, so neither its length nor a repeated line changes much.

The prior is the share of toxic rows among the labelled training rows.  Labels are read only from the training part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.llm.common import by_slice, in_training, landed, map_arrow, mix, strings
from codetrail.llm.words import hash_spans, words_of

BITS = 18
PREFIXES = (4, 5, 6, 7)
#: Classifiers, and documents of each kind that one is trained on (about so many: chosen by the hash of the id).
MODELS = 3
SAMPLE_POSITIVES = 3_000
SAMPLE_UNLABELLED = 9_000
STEPS = 600
STEP = 0.05
DECAY = 1e-5
THRESHOLD = 0.7
#: Standard errors by which a feature's shares have to differ.
TELLING = 4.5
COMMON = 0.02


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, distinct in each text and sorted; for each text its first one (and the end)."""
    words = words_of(texts, letters_only=True)
    count = words.counts()
    text = np.repeat(np.arange(len(count)), count)
    parts = [(text, words.hash)]
    letter = (words.data & 0xC0) != 0x80
    upto = np.append(0, np.cumsum(letter))
    at_letter = np.append(np.flatnonzero(letter), len(words.data))
    length = upto[words.end] - upto[words.start]
    for n in PREFIXES:
        long = np.flatnonzero(length > n)
        end = at_letter[upto[words.start[long]] + n]
        parts.append((text[long], mix(hash_spans(words.data, words.start[long], end) + np.uint64(n))))
    text = np.concatenate([t for t, _ in parts])
    number = (np.concatenate([h for _, h in parts]) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique(text << bits | number)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(len(count) + 1))


def margins(numbers: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The classifier's value for each text; a text's features add up."""
    n = np.diff(first)
    sums = np.add.reduceat(np.append(weights[numbers], 0.0), first[:-1]) * (n > 0)
    return bias + sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(numbers: np.ndarray, first: np.ndarray, positive: np.ndarray, bits: int, least: float = TELLING) -> np.ndarray:
    """A flag per feature: a share of ``COMMON`` of the positives or the others have it, and the two shares differ by
    ``least`` standard errors."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    in_pos = np.bincount(numbers[positive[row]], minlength=1 << bits)
    in_all = np.bincount(numbers, minlength=1 << bits)
    n1, n = int(positive.sum()), len(positive)
    both = in_all / n
    error = np.sqrt(np.maximum(both * (1 - both), 1 / n) * (1 / n1 + 1 / (n - n1)))
    share, other = in_pos / n1, (in_all - in_pos) / (n - n1)
    return (np.abs(share - other) > least * error) & (np.maximum(share, other) >= COMMON)


def train(numbers: np.ndarray, first: np.ndarray, positive: np.ndarray, prior: float,
          bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam over the whole sample.

    Rows flagged ``positive`` are confirmed toxic, the others a draw of all documents.  Only ``telling`` features get a
    weight.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kept = telling(numbers, first, positive, bits)[numbers]
    row = row[kept]
    own, cell = np.unique(numbers[kept], return_inverse=True)
    n, n_pos = len(positive), int(positive.sum())
    n_unl = n - n_pos
    theta = np.zeros(len(own) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, STEPS + 1):
        value = theta[-1] + np.bincount(row, theta[cell], minlength=n)
        q = _sigmoid(value)
        negative_risk = (np.logaddexp(0, value[~positive]).mean() - prior * np.logaddexp(0, value[positive]).mean())
        if negative_risk >= 0:
            grad = np.where(positive, -prior / n_pos, q / n_unl)
        else:
            grad = np.where(positive, prior * q / n_pos, -q / n_unl)
        g = np.append(np.bincount(cell, grad[row], minlength=len(own)) + DECAY * theta[:-1], grad.sum())
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        rate = STEP * min(1.0, 3 * (1 - (turn - 1) / STEPS))
        theta -= rate * mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    weights = np.zeros(1 << bits)
    weights[own] = theta[:-1]
    return weights, float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, models: int = MODELS, positives: int = SAMPLE_POSITIVES,
          unlabelled: int = SAMPLE_UNLABELLED, bits: int = BITS) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The classifiers and the prior.  Without a confirmed positive no classifier is learnt."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")).where(
        in_training(F.col("__id")) & F.col("__id").isNotNull()).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    rates = known.agg(F.count("__toxic").alias("n"), F.coalesce(F.sum("__toxic"), F.lit(0)).alias("t")).first()
    prior = min(max(rates["t"] / rates["n"], 1e-3), 0.5) if rates["n"] else 0.0
    own = docs.select("doc_id", "text").where(in_training() & F.col("doc_id").isNotNull())
    total, toxic = own.count(), int(rates["t"])
    if not toxic or not total:
        return [], prior

    def chance(name: str):
        return F.abs(F.xxhash64(F.lit(name), "doc_id") % 1_000_003) / F.lit(1_000_003.0)

    confirmed = known.where("__toxic = 1").select(F.col("__id").alias("doc_id"))
    # about models * (positives + unlabelled) rows, whatever the size of the tables; a document can be in several draws
    draws = [own.select("doc_id").distinct().where(chance(f"unlabelled {m}") < unlabelled / total)
             .select(F.col("doc_id").alias("__id"), F.lit(False).alias("pos"), F.lit(m).cast("long").alias("model"))
             for m in range(models)]
    draws += [confirmed.where(chance(f"positive {m}") < positives / toxic)
              .select(F.col("doc_id").alias("__id"), F.lit(True).alias("pos"), F.lit(m).cast("long").alias("model"))
              for m in range(models)]
    ids = landed(reduce(DataFrame.unionByName, draws), "draws")
    sample = own.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("text", "pos", "model")

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, first = features(strings(batch), bits)
        return pa.RecordBatch.from_arrays(
            [batch.column("model"), batch.column("pos"), pa.ListArray.from_arrays(first.astype(np.int32), numbers.astype(np.int32))],
            names=["model", "pos", "numbers"])

    def fit(table: pa.Table) -> pa.Table:
        lists = table["numbers"].combine_chunks()
        numbers, first = np.asarray(lists.flatten()).astype(np.int64), np.append(0, np.cumsum(np.asarray(
            lists.value_lengths()))).astype(np.int64)
        positive = np.asarray(table["pos"].combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        model = int(table["model"][0].as_py())
        if not positive.any() or positive.all():
            return pa.table({"model": pa.array([], pa.int64()), "bias": pa.array([], pa.float64()),
                             "weights": pa.array([], pa.binary())})
        weights, bias = train(numbers, first, positive, prior, bits)
        return pa.table({"model": pa.array([model]), "bias": pa.array([bias]),
                         "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    rows = landed(sample.transform(map_arrow, by_slice(featured), "model long, pos boolean, numbers array<int>"), "toxicity")
    fitted = rows.groupBy("model").applyInArrow(fit, "model long, bias double, weights binary").collect()
    return [(np.frombuffer(r["weights"], "<f4").astype(np.float64), r["bias"]) for r in sorted(fitted)], prior


def score(docs: DataFrame, labels: DataFrame, models: int = MODELS, positives: int = SAMPLE_POSITIVES,
          unlabelled: int = SAMPLE_UNLABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), with ``labels`` (doc_id, toxic): doc_id, held_out, score, predicted.

    ``score`` is in 0..1; null and empty texts, and texts without letters, get the classifiers' value without features.
    Where nothing can be learnt every score is the prior.  Repeated rows give repeated rows; a document with several
    labels is toxic if one says so; null labels count as none; an empty table gives no rows; other columns aren't read.
    """
    fitted, prior = learn(docs, labels, models, positives, unlabelled)
    own = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, first = features(strings(batch))
        value = (np.mean([_sigmoid(margins(numbers, first, w, b)) for w, b in fitted], axis=0) if fitted
                 else np.full(batch.num_rows, prior))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(value)})

    scored = own.transform(map_arrow, by_slice(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
