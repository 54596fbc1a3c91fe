"""Operator 5: language ID by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary that can occur in a word, however long the
piece is (all single bytes belong to it, so every text has a segmentation).  The probability of a word in a
language is the sum, over all ways to cut it into pieces, of the product of their probabilities (forward algorithm).
A text's log-likelihood adds up over its words; its score is the softmax over the languages.  Probabilities are
learnt by expectation maximisation, whose expected counts come from the same lattice (forward-backward).

Words are longest runs of letters in lower case with a leading space, of any length: sums are rescaled on the way, so
that long words don't vanish, and only the positions that a piece can bridge are held.  Time grows with the length of
a run.  Only for learning, runs of more than ``LEARN_WORD`` bytes are cut at character limits.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.llm.common import by_slice, in_training, landed, map_arrow, set_aside, strings
from codetrail.llm.words import Words, keyed_hash_spans, words_of

#: Bytes of the words that the model is fitted on.
LEARN_WORD = 256
#: Words up to this length meet others of their length, longer ones others up to twice as long.
SHORT_WORD = 32
#: Cells (words x bytes) that are worked out together, and numbers held for them.
CELLS = 1 << 19
HELD = 1 << 22
#: Labelled documents per language that the model is fitted on (about so many: a document is in by the hash of its id).
SAMPLE_DOCS = 1500
ROUNDS = 3
#: Distinct words whose expected counts are worked out together, and bytes of them.
EXPECT_WORDS = 10_000
EXPECT_CELLS = 1 << 18
#: Words whose probabilities a Python worker remembers.
REMEMBER = 200_000
UNDETERMINED = "und"
#: Letters and the number signs that aren't decimal digits; what is a letter is up to its category.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m.group())[0] == "L" for m in _LETTER.finditer(text))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass
class Pieces:
    step: np.ndarray    #: (states, kinds of bytes): the state after one more byte; state 0 has left the vocabulary, 1 is the start
    number: np.ndarray  #: for each state the piece that ends there, or ``size``
    kind: np.ndarray    #: for each byte its kind; bytes that no word holds are kind 0
    size: int           #: how many pieces there are
    longest: int        #: bytes of the longest


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The pieces that can occur in a word (letters and bytes beyond ASCII, after a space at most) as a table of prefixes;
    their numbers are in the order of their bytes."""
    inside = frozenset([*range(97, 123), *range(128, 256)])
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    found |= {bytes([b]) for b in (32, *inside)}
    found = sorted(p for p in found if p and (p[0] == 32 or p[0] in inside) and inside.issuperset(p[1:]))
    kind = np.zeros(256, np.int64)
    kind[[32, *sorted(inside)]] = np.arange(1, len(inside) + 2)
    states: dict[bytes, int] = {b"": 1}
    for p in found:
        for n in range(1, len(p) + 1):
            states.setdefault(p[:n], len(states) + 1)
    step = np.zeros((len(states) + 1, len(inside) + 2), np.int32)
    number = np.full(len(states) + 1, len(found), np.int64)
    for prefix, state in states.items():
        if prefix:
            step[states[prefix[:-1]], kind[prefix[-1]]] = state
    number[[states[p] for p in found]] = np.arange(len(found))
    return Pieces(step, number, kind, len(found), max(map(len, found)))


def word_matrix(words: Words, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The chosen words in blocks of similar length: (positions in ``chosen``, byte matrix with a leading space, zeros past
    each word's end, and lengths with the space)."""
    start, length = words.start[chosen], (words.end - words.start)[chosen]
    group = np.where(length <= SHORT_WORD, length, SHORT_WORD + np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        for at in np.array_split(own, -(-len(own) * int(length[own].max()) // CELLS)):
            body = np.zeros((len(at), int(length[at].max()) + 1), np.uint8)
            body[:, 0] = 32
            column = np.arange(body.shape[1] - 1)
            for rows in np.array_split(np.arange(len(at)), -(-body.size // CELLS)):
                place = start[at[rows]][:, None] + column
                fits = column < length[at[rows]][:, None]
                body[rows, 1:] = np.where(fits, words.data[np.minimum(place, len(words.data) - 1)], 0)
            yield at, body, length[at] + 1


def edges(matrix: np.ndarray, known: Pieces) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each position in turn the pieces that start there: (length, the words that hold one, its numbers)."""
    width = matrix.shape[1]
    kinds = np.ascontiguousarray(known.kind[matrix].T)
    for i in range(width):
        state = known.step[1, kinds[i]]
        rows = np.flatnonzero(state)
        state, out, n = state[rows], [], 1
        while len(rows):
            ids = known.number[state]
            ends = np.flatnonzero(ids < known.size)
            if len(ends):
                out.append((n, rows[ends], ids[ends]))
            if i + n >= width:
                break
            state = known.step[state, kinds[i + n][rows]]
            alive = np.flatnonzero(state)
            rows, state, n = rows[alive], state[alive], n + 1
        yield out


def forward_logs(matrix: np.ndarray, length: np.ndarray, prob: np.ndarray, known: Pieces) -> np.ndarray:
    """Log probabilities (words, languages): the logarithm of the sum over all segmentations.  prob: (pieces + 1,
    languages).  Only the sums of the positions that one piece can reach are held."""
    n_words, width, n_langs = len(matrix), matrix.shape[1], prob.shape[1]
    round_ = min(known.longest, width) + 1
    if n_words > 1 and n_words * round_ * n_langs > HELD:
        parts = np.array_split(np.arange(n_words), min(n_words, -(-n_words * round_ * n_langs // HELD)))
        return np.concatenate([forward_logs(matrix[p], length[p], prob, known) for p in parts])
    held = np.zeros((round_, n_words, n_langs))
    held[0] = 1.0
    scale = np.zeros((n_words, n_langs))
    out = np.full((n_words, n_langs), -np.inf)
    with np.errstate(divide="ignore"):
        for i, own in enumerate(edges(matrix, known)):
            now = held[i % round_]
            ended = np.flatnonzero(length == i)
            if len(ended):
                out[ended] = np.log(now[ended]) + scale[ended]
            for n, rows, ids in own:
                held[(i + n) % round_][rows] += now[rows] * prob[ids]
            now[:] = 0.0
            if i % 8 == 7:
                peak = held.max(axis=0)
                low = (peak < 1e-100) & (peak > 0)
                if low.any():
                    held *= np.where(low, 1e100, 1.0)
                    scale -= np.where(low, np.log(1e100), 0.0)
        ended = np.flatnonzero(length == width)
        out[ended] = np.log(held[width % round_][ended]) + scale[ended]
    return out


def expected(matrix: np.ndarray, prob: np.ndarray, weight: np.ndarray, known: Pieces) -> np.ndarray:
    """Expected piece counts (pieces + 1, languages) of words of one length that occur ``weight`` (words, languages) times."""
    n_words, width = matrix.shape
    logs = forward_logs(matrix, np.full(n_words, width), prob, known)
    # every byte of a word counts as its mean, so that sums of parts stay near 1; the whole sum becomes 1
    tilt = np.exp(-logs / width)
    power = [np.ones_like(tilt)]
    for _ in range(min(known.longest, width)):
        power.append(power[-1] * tilt)
    lattice = list(edges(matrix, known))
    alpha = [np.zeros((n_words, prob.shape[1])) for _ in range(width + 1)]
    beta = [np.zeros_like(alpha[0]) for _ in range(width + 1)]
    alpha[0] += 1.0
    beta[width] += 1.0
    for i, own in enumerate(lattice):
        for n, rows, ids in own:
            alpha[i + n][rows] += alpha[i][rows] * prob[ids] * power[n][rows]
    numbers, gains = [np.zeros(0, np.int64)], [np.zeros((0, prob.shape[1]))]
    for i in range(width - 1, -1, -1):
        for n, rows, ids in lattice[i]:
            step = prob[ids] * power[n][rows] * beta[i + n][rows]
            beta[i][rows] += step
            numbers.append(ids)
            gains.append(alpha[i][rows] * step * weight[rows])
    numbers, gains = np.concatenate(numbers), np.concatenate(gains)
    return np.stack([np.bincount(numbers, gains[:, k], minlength=len(prob)) for k in range(prob.shape[1])], axis=1)


def _gathered(batches, rows: int):
    """The same rows in batches of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def learn(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS,
          rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces + 1, languages), from documents of the training part with a language.

    Fitted on about ``sample_docs`` documents of each language; the expected counts are summed on the executors and
    their size is bounded by the vocabulary.  Empty input, or no language: no languages.
    """
    vocabulary = vocabulary or default_vocabulary()
    own = docs.select("doc_id", "text", "lang").where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    none = pieces(vocabulary).size
    prob = np.zeros((none + 1, len(langs)))
    prob[:none] = 1.0 / none
    if not langs:
        return langs, prob
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / sizes[k])))])
    chance = F.abs(F.xxhash64(F.lit("langid"), "doc_id") % 1_000_003) / F.lit(1_000_003.0)
    sample = own.where(chance < F.element_at(rate, F.col("lang"))).select("text", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(strings(batch), letters_only=True, longest=LEARN_WORD)
        lang = np.repeat(np.searchsorted(langs, batch.column("lang").to_pylist()), words.counts())
        pairs, first, n = np.unique(np.stack([words.hash, lang.astype(np.uint64)]), axis=1, return_index=True,
                                    return_counts=True)
        raw = words.data.tobytes()
        return pa.RecordBatch.from_pydict({
            "word": pa.array([raw[a:b] for a, b in zip(words.start[first], words.end[first], strict=True)], pa.binary()),
            "lang": pa.array(pairs[1].astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = landed(sample.transform(map_arrow, by_slice(count), "word binary, lang long, n long")
                    .groupBy("word", "lang").agg(F.sum("n").alias("n"))
                    .groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")), "langid")
    for _ in range(rounds):
        model = prob

        def expect(batches, model=model):
            total = np.zeros_like(model)
            for batch in _gathered(batches, EXPECT_WORDS):
                weight = np.zeros((batch.num_rows, len(langs)))
                for i, m in enumerate(batch.column("n").to_pylist()):
                    for k, v in m:
                        weight[i, k] = v
                raw = batch.column("word").to_pylist()
                size = np.array([len(w) for w in raw])
                for n in np.unique(size):
                    own = np.flatnonzero(size == n)
                    for at in np.array_split(own, -(-len(own) * int(n) // EXPECT_CELLS)):
                        body = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
                        matrix = np.concatenate([np.full((len(at), 1), 32, np.uint8), body], axis=1)
                        total += expected(matrix, model, weight[at], pieces(vocabulary))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece), "lang": pa.array(lang),
                                              "n": pa.array(total[piece, lang])})

        sums = (counts.transform(map_arrow, expect, "piece long, lang long, n double").groupBy("piece", "lang")
                .agg(F.sum("n").alias("n")).toArrow())
        total = np.zeros_like(prob)
        total[np.asarray(sums["piece"]), np.asarray(sums["lang"])] = np.asarray(sums["n"])
        total = total[:none] + 0.01
        prob = np.concatenate([total / total.sum(axis=0), np.zeros((1, len(langs)))])
    return langs, prob


class Scorer:
    """Log-likelihoods of texts; words once scored are remembered (up to ``REMEMBER`` of them)."""

    def __init__(self, prob: np.ndarray, vocabulary: str):
        self.prob, self.vocabulary = prob, vocabulary
        self.known = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, prob.shape[1]))

    def word_logs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words' log probabilities, and for each word which of them it is."""
        own, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, own)
        have = np.zeros(len(own), bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == own[inside]
        logs = np.empty((len(own), self.prob.shape[1]))
        logs[have] = self.logs[at[have]]
        new = np.flatnonzero(~have)
        if len(new):
            for rows, matrix, length in word_matrix(words, first[new]):
                logs[new[rows]] = forward_logs(matrix, length, self.prob, pieces(self.vocabulary))
            if len(self.known) + len(new) > REMEMBER:
                self.known, self.logs = self.known[:0], self.logs[:0]
            place = np.searchsorted(self.known, own[new])
            self.known = np.insert(self.known, place, own[new])
            self.logs = np.insert(self.logs, place, logs[new], axis=0)
        return logs, which

    def text_logs(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts, letters_only=True)
        long = np.flatnonzero(words.end - words.start > SHORT_WORD)
        words.hash[long] = keyed_hash_spans(words.data, words.start[long], words.end[long])
        out = np.zeros((len(texts), self.prob.shape[1]))
        full = np.flatnonzero(words.counts())
        if len(full):
            logs, which = self.word_logs(words)
            for k in range(out.shape[1]):
                out[full, k] = np.add.reduceat(logs[which, k], words.first[full])
        return out


def _with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str | None = None,
             lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """``docs`` with the likeliest language (``und`` where the text is null or has no letter, or no language was learnt)
    and its posterior (0 for ``und``); ties go to the first language by name."""
    vocabulary = vocabulary or default_vocabulary()
    langs, prob = model
    schema = f"{_ddl(docs)}, `{lang_column}` string, `{score_column}` double"

    def run(batches):
        scorer = Scorer(prob, vocabulary)

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch)
            lettered = np.array([has_letter(t) for t in texts])
            if langs:
                logs = scorer.text_logs(texts)
                best = logs.argmax(axis=1)
                value = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                names = [langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                value = np.where(lettered, value, 0.0)
            else:
                names, value = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            return _with_columns(batch, {lang_column: pa.array(names, pa.string()), score_column: pa.array(value)})

        return by_slice(score)(batches)

    return docs.transform(map_arrow, run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def predict_languages(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Null and empty texts, and texts without a letter, are ``und`` with score 0; repeated rows give repeated rows; an
    empty table gives none; other columns aren't read.
    """
    model = learn(docs, vocabulary, sample_docs)
    own = docs.select("doc_id", "text")
    return (identify(own, model, vocabulary)
            .select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score"))


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` without the documents that have no language (``und``), nor a score under ``least`` where that is asked for."""
    plain, restored = set_aside(docs)
    scored = identify(plain, learn(docs), lang_column="__lang", score_column="__score")
    return restored(scored.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least)))
