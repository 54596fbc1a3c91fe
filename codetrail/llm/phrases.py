"""Operator 11: phrase collocation mining by best-first branch-and-bound growth.

Phrases grow word by word.  The counts of what a phrase grows from bound its score from above, so a prefix is expanded only
while something that grows from it can still belong to the first ``top`` phrases of its language:

* words are counted, and pairs of which both words are frequent enough to be part of a candidate;
* a score is ``1000000 a a / (l r)`` at the worst cut.  As ``r >= a`` and ``a <= f(w1 w2)``, no triple that starts with
  ``w1 w2`` scores more than ``1000000 f(w1 w2) / f(w1)``; in the same way none that ends with ``w2 w3`` scores more than
  ``1000000 f(w2 w3) / f(w3)``.  A triple is counted only where both bounds reach its language's floor, or where a pair that
  scores the floor or more lies inside it (the triple may drop that pair);
* floors start high and fall wave by wave.  A wave counts only what no wave before it has counted.  A language is settled
  when 2000 phrases that survive score its floor or more: everything not counted scores less.

Tasks that scan texts learn which words and pairs belong to the frontier from a bit table of at most ``FILTER_BITS`` bits,
which errs only by letting too much through; counts are exact, and all decisions use exact joins.
Every task sums its own counts before anything is shuffled, and the keys are single phrases, so neither a language with
most of the texts nor a very frequent word makes a large group.

Results for odd rows: a null text is empty, a null language is ``und``; null, repeated or clashing ids and further columns
play no part (repeated rows count as often as they occur); an empty table gives no rows; a text of any length is read in
windows that share the words at their edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrail.llm.common import landed, map_arrow, private, slices

#: A candidate occurs at least so often; a phrase that holds another drops it from this percentage of its count on.
LEAST, DROP_PERCENT = 10, 50
#: Phrases returned per language.
TOP = 2000
#: Most bits of the table that tells tasks the frontier: 32 MB.
FILTER_BITS = 1 << 28
#: Bytes of text whose words are handled at once.
WINDOW = 4 << 20

#: A-Z to a-z; tab separates words like a space; ``.,;:!?`` and the characters 0A to 0D end a piece.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_END = b"\n"
_COUNTS = "lang string, w1 string, w2 string, w3 string, a long"


def _tokens(blob: bytes, size: int, window: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Distinct tokens and the sequence of their numbers, a window at a time; windows share ``size - 1`` tokens.  The end of
    a piece is a token of its own."""
    at, carry = 0, b""
    while at < len(blob):
        end = len(blob)
        if end - at > window:
            end = blob.rfind(b" ", at, at + window)
            if end <= at:
                end = blob.find(b" ", at + window)
            if end < 0:
                end = len(blob)
        split = pc.split_pattern(pa.array([carry + b" " + blob[at:end]], pa.large_binary()), b" ").values
        split = split.filter(pc.greater(pc.binary_length(split), 0)).dictionary_encode()
        words, ids = split.dictionary.cast(pa.binary()), split.indices.to_numpy().astype(np.int64)
        if len(ids):
            yield words, ids
            carry = b" ".join(words[int(i)].as_py() for i in ids[len(ids) - size + 1:]) if size > 1 else b""
        at = end


def word_hash(lang: str) -> Callable[[bytes], int]:
    """The same hash of a word in a language as Spark's ``xxhash64(lang, word)``."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8"), 42)
    return lambda word: xxhash.xxh64_intdigest(word, seed)


def _slot(hashes: list[Column], bits: int) -> Column:
    """The place of a word, or of a pair, in a table of ``bits`` places."""
    h = hashes[0]
    for g in hashes[1:]:
        h = F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)).bitwiseXOR(g)
    return h.bitwiseAND(F.lit(bits - 1))


def _slots(first: np.ndarray, second: np.ndarray | None, bits: int) -> np.ndarray:
    h = first if second is None else ((first << np.uint64(21)) | (first >> np.uint64(43))) ^ second
    return h & np.uint64(bits - 1)


#: What the four bits of a place say: the word or pair is frequent; triples may start, or end, with it; it needs a verdict.
FREQUENT, PREFIX, SUFFIX, SCORED = 1, 2, 4, 8


class Frontier:
    """A bit table with four bits for each place, made by Spark and read by tasks."""

    def __init__(self, table: bytes, places: int):
        self.table, self.places = np.frombuffer(table, dtype=np.uint8), places

    def flags(self, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        slot = _slots(first, second, self.places)
        return (self.table[(slot >> np.uint64(1)).astype(np.int64)] >> ((slot & np.uint64(1)) * np.uint64(4)).astype(np.uint8)) & 15


def frontier(rows: DataFrame, words: list[str], flags: Column, most_bits: int = FILTER_BITS) -> Frontier:
    """The table for ``rows``: built by bitmap aggregates, so what reaches the driver is the table (``most_bits`` at most)."""
    n = rows.count()
    places = 1 << max(12, min(most_bits.bit_length() - 3, (16 * n).bit_length()))
    bits = (rows.withColumn("f", flags).withColumn("s", _slot([F.xxhash64("lang", w) for w in words], places))
            .select(F.explode(F.expr("filter(array(0, 1, 2, 3), i -> (f & shiftleft(1, i)) != 0)")).alias("i"), "s")
            .select((F.col("s") * 4 + F.col("i") + 1).alias("p")))
    pages = (bits.groupBy(F.bitmap_bucket_number("p").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    table = bytearray(max(places // 2, 4096))
    for r in pages.toLocalIterator():
        table[(r["page"] - 1) * 4096:r["page"] * 4096] = r["bits"]
    return Frontier(bytes(table), places)


def _wanted(flags: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a triple is to be counted, by the flags of its two pairs."""
    p, s = flags[before], flags[after]
    return (((p & PREFIX) != 0) & ((s & SUFFIX) != 0)) | (((p & SCORED) != 0) & ((s & FREQUENT) != 0)) | (
        ((p & FREQUENT) != 0) & ((s & SCORED) != 0))


def _grams(words: pa.Array, ids: np.ndarray, size: int, hashed: Callable[[bytes], int], vocabulary: Frontier | None,
           now: Frontier | None, before: list[Frontier]) -> tuple[list[pa.Array], np.ndarray]:
    """The words and counts of the distinct phrases of ``size`` words in one window."""
    listed = words.to_pylist()
    plain = np.array([w != _END for w in listed])
    if size == 1:
        n = np.bincount(ids, minlength=len(listed)) * plain
        return [words.take(pa.array(np.flatnonzero(n)))], n[n > 0]
    h = np.fromiter((hashed(w) for w in listed), dtype=np.uint64, count=len(listed))
    known = plain & (vocabulary.flags(h) != 0)
    at = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
    pair, where, n = np.unique(ids[at] * len(listed) + ids[at + 1], return_inverse=True, return_counts=True)
    first, second = pair // len(listed), pair % len(listed)
    if size == 2:
        return [words.take(pa.array(first)), words.take(pa.array(second))], n
    linked = np.flatnonzero(at[1:] == at[:-1] + 1)
    left, right = where[linked], where[linked + 1]
    take = _wanted(now.flags(h[first], h[second]), left, right)
    for f in before:
        take &= ~_wanted(f.flags(h[first], h[second]), left, right)
    triple, n = np.unique(left[take] * len(listed) + second[right[take]], return_counts=True)
    head, third = triple // len(listed), triple % len(listed)
    return [words.take(pa.array(x)) for x in (first[head], second[head], third)], n


def _counted(docs: DataFrame, size: int, vocabulary: Frontier | None = None, now: Frontier | None = None,
             before: list[Frontier] | None = None, window: int = WINDOW) -> DataFrame:
    """lang, w1..w<size>, a: occurrences of the phrases that the frontier lets through."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, now, before or []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, done = shared.value
        for part in slices(batches, limit=window):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts):
                of.setdefault(lang, []).append(text.encode("utf-8", "replace").translate(_FOLD).replace(_END, b" \n "))
            for lang, blobs in of.items():
                hashed = word_hash(lang)
                for words, ids in _tokens(b" \n ".join(blobs), size, window):
                    parts, n = _grams(words, ids, size, hashed, known, wanted, done)
                    if len(n):
                        parts = [p.cast(pa.string()) for p in parts] + [pa.nulls(len(n), pa.string())] * (3 - size)
                        yield pa.record_batch([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))),
                                               *parts, pa.array(n.astype(np.int64))], names=["lang", "w1", "w2", "w3", "a"])

    keys = ["lang", *[f"w{i + 1}" for i in range(size)]]
    return map_arrow(docs, run, _COUNTS).groupBy(*keys).agg(F.sum("a").alias("a"))


def _score(a: str, left: str, right: str) -> str:
    """floor(1000000 a a / (l r)) in decimals of 38 digits."""
    d = "cast({} as decimal(18, 0))"
    return (f"cast((cast({d.format(a)} * {d.format(a)} as decimal(32, 0)) * 1000000) div "
            f"({d.format(left)} * {d.format(right)}) as long)")


def _floors(pairs: DataFrame, rank: int) -> DataFrame:
    """lang, floor: a score that at least ``rank`` pairs of the language reach, 0 where there are fewer.  Scores are first
    counted in steps of a sixteenth of a power of two, so a language is a few hundred rows."""
    steps = (pairs.groupBy("lang", F.floor(F.log2(F.col("score") + 1.0) * 16).alias("step"))
             .agg(F.count("*").alias("n"), F.min("score").alias("low")))
    above = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (steps.withColumn("n", F.sum("n").over(above)).groupBy("lang")
            .agg(F.coalesce(F.max(F.when(F.col("n") >= rank, F.col("low"))), F.lit(0)).alias("floor")))


def _pairs(counts: DataFrame, words: DataFrame) -> DataFrame:
    one = words.select("lang", F.col("w1"), F.col("a").alias("l"))
    two = words.select("lang", F.col("w1").alias("w2"), F.col("a").alias("r"))
    return counts.join(one, ["lang", "w1"]).join(two, ["lang", "w2"]).withColumn("score", F.expr(_score("a", "l", "r")))


def _triples(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lower of both cuts, the one after the first word where they tie."""
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    both = (counts.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
            .withColumn("s1", F.expr(_score("a", "f1", "f23"))).withColumn("s2", F.expr(_score("a", "f12", "f3"))))
    late = F.col("s2") < F.col("s1")
    return both.withColumns({"l": F.when(late, F.col("f12")).otherwise(F.col("f1")),
                             "r": F.when(late, F.col("f3")).otherwise(F.col("f23")),
                             "score": F.least("s1", "s2")})


def _survivors(pairs: DataFrame, triples: DataFrame, drop_percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of all pairs that no triple drops, and of all triples."""
    inside = (triples.select("lang", "w1", "w2", F.col("a").alias("most"))
              .unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("most")))
              .groupBy("lang", "w1", "w2").agg(F.max("most").alias("most")))
    kept = (pairs.join(inside, ["lang", "w1", "w2"], "left")
            .where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * drop_percent)))
    out = ["lang", "phrase", "a", "l", "r", "score"]
    return (kept.withColumn("phrase", F.concat_ws(" ", "w1", "w2")).select(out)
            .unionByName(triples.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).select(out)))


def collocations(docs: DataFrame, least: int = LEAST, drop_percent: int = DROP_PERCENT, top: int = TOP,
                 first_rank: int | None = None, filter_bits: int = FILTER_BITS, window: int = WINDOW) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` collocations of each language.

    ``first_rank``: the floor of the first wave is the score of about so many pairs of the language (twice ``top``)."""
    docs = private(docs, {"lang": F.coalesce(docs["lang"], F.lit("und")), "text": F.coalesce(docs["text"], F.lit(""))})
    counted = landed(_counted(docs, 1, window=window), "words")
    words = counted.where(F.col("a") >= least)
    vocabulary = frontier(words, ["w1"], F.lit(FREQUENT), filter_bits)
    pairs = landed(_pairs(_counted(docs, 2, vocabulary, window=window).where(F.col("a") >= least), words), "pairs")
    rank, before, triples, floors = first_rank or 2 * top, [], None, None
    while True:
        lower = _floors(pairs, rank)
        if floors is not None:  # a settled language keeps its floor, so nothing new is counted for it
            lower = (lower.join(floors.select("lang", F.col("floor").alias("kept"), "settled"), "lang")
                     .select("lang", F.when(F.col("settled"), F.col("kept")).otherwise(F.col("floor")).alias("floor")))
        marked = pairs.join(lower, "lang")
        reach = {PREFIX: F.col("a") * 1000000 >= F.col("floor") * F.col("l"),
                 SUFFIX: F.col("a") * 1000000 >= F.col("floor") * F.col("r"), SCORED: F.col("score") >= F.col("floor")}
        flags = F.lit(FREQUENT)
        for bit, holds in reach.items():
            flags = flags + F.when(holds, F.lit(bit)).otherwise(F.lit(0))
        now = frontier(marked, ["w1", "w2"], flags, filter_bits)
        new = landed(_triples(_counted(docs, 3, vocabulary, now, before, window).where(F.col("a") >= least), pairs), "triples")
        triples = new if triples is None else triples.unionByName(new)
        before.append(now)
        found = landed(_survivors(pairs, triples, drop_percent).join(lower, "lang").where(F.col("score") >= F.col("floor")), "found")
        reached = found.groupBy("lang").agg(F.count("*").alias("n"))
        floors = landed(lower.join(reached, "lang", "left")
                        .select("lang", "floor", ((F.coalesce("n", F.lit(0)) >= top) | (F.col("floor") == 0)).alias("settled")), "floors")
        if not floors.where(~F.col("settled")).take(1):
            break
        rank *= 8
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x : x <> '') AS ws FROM pieces),
seq AS (
  SELECT lang, unnest(ws) AS w1, unnest(list_concat(ws[2:], [NULL])) AS w2, unnest(list_concat(ws[3:], [NULL, NULL])) AS w3
  FROM split WHERE len(ws) > 0),
f1 AS (SELECT lang, w1, count(*) AS a FROM seq WHERE w1 IS NOT NULL GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM seq WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM seq WHERE w3 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, x.a AS l, y.a AS r, 1 AS k
  FROM f2 JOIN f1 x ON f2.lang = x.lang AND f2.w1 = x.w1 JOIN f1 y ON f2.lang = y.lang AND f2.w2 = y.w1
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, x.a, y.a, 1
  FROM f3 JOIN f1 x ON f3.lang = x.lang AND f3.w1 = x.w1 JOIN f2 y ON f3.lang = y.lang AND f3.w2 = y.w1 AND f3.w3 = y.w2
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, x.a, y.a, 2
  FROM f3 JOIN f2 x ON f3.lang = x.lang AND f3.w1 = x.w1 AND f3.w2 = x.w2 JOIN f1 y ON f3.lang = y.lang AND f3.w3 = y.w1),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f3),
dropped AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inner_pairs i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE 100 * i.a >= {DROP_PERCENT} * b.a),
kept AS (SELECT * FROM best ANTI JOIN dropped USING (lang, phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= {TOP}
"""
