"""Operator 8: benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over successive words: the words under a 1 are hashed together, those under a 0 are ignored, so a
hit survives substitutions at the ignored places.  The seeds of the test items are joined with those of the training
documents, and each hit is verified on its diagonal (the alignment that puts the hit's words on each other): an overlap
of at least ``OVERLAP`` words, or of the whole item if that is shorter, in which at least 80 % of the words agree,
contaminates the document.

The masks miss no such overlap: any of 10 words or more holds one of 10 to 19 words with at least 80 % agreement, and in
every layout of the substitutions in those one of ``MASKS`` fits; in items of 5 to 9 words, which may differ in one word,
one of ``SHORT_MASKS`` does (both are tested over all layouts).  Items under ``SHORTEST`` words can't be told from
ordinary text and contaminate nothing.

Only seeds that the benchmark may hold leave a task: they are looked up in a bit table (four bits a seed, ``MOST_BITS`` at
most however large the benchmark is; a full table lets more through and drops nothing).  They travel with the words
around them, in windows of ``WINDOW`` positions and the longest item on both sides, and meet the items by joins whose
frequent keys are dealt over many parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.llm.common import by_slice, landed, map_arrow, mix, set_aside, strings
from codetrail.llm.words import Words, words_of

#: 1: the word counts, 0: it is ignored.
MASKS = ("11111", "111011", "11001011")
#: For items shorter than OVERLAP.
SHORT_MASKS = ("1111", "11011", "11101", "10111")
OVERLAP = 10
SHORTEST = 5
SHARE = 0.8
#: Positions whose hits travel together.
WINDOW = 256
MOST_BITS = 1 << 28
_PROBES = 4
#: A key with more rows than this, and more than a thousandth of all rows, is dealt over several parts.
HOT_ROWS = 10_000
_SHARES = 1000


def seeds(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the mask at each position where it fits into a text; the positions (of the first word)."""
    n, width = len(words.hash), len(mask)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n - width + 1, len(mask), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                total += words.hash[k:n - width + 1 + k] * np.uint64(2 * k + 0x9E3779B1)
        total = mix(total ^ np.uint64(int(mask, 2)))
    left = np.repeat(words.first[1:], words.counts())[:len(total)] - np.arange(len(total))
    fits = np.flatnonzero(left >= width)
    return total[fits], fits


def _lists(values: np.ndarray, ends: Iterable[int]) -> pa.ListArray:
    """``values`` cut into lists that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def items_of(benchmark: DataFrame, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of the benchmark with at least SHORTEST words: (item, words, seeds, places), words as hashes and
    places the positions of the seeds; and (item, item_id), the ids of each."""
    texts = benchmark.select("text").where(F.col("text").isNotNull()).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = words_of(strings(batch))
        counts = words.counts()
        text = np.repeat(np.arange(batch.num_rows), counts)
        short = (counts < overlap)[text]
        found, places = [], []
        for masks, wanted in ((MASKS, ~short), (SHORT_MASKS, short)):
            for mask in masks:
                value, at = seeds(words, mask)
                found.append(value[wanted[at]])
                places.append(at[wanted[at]])
        value, at = np.concatenate(found), np.concatenate(places)
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
        ends = np.searchsorted(at, words.first[1:])
        out = pa.RecordBatch.from_pydict({
            "item": batch.column("item"), "text": batch.column("text"), "words": _lists(words.hash, words.first[1:]),
            "seeds": _lists(value, ends), "places": _lists(at - words.first[text[at]], ends)})
        return out.filter(pa.array(counts >= SHORTEST))

    known = landed(texts.withColumn("item", F.monotonically_increasing_id()).transform(
        map_arrow, by_slice(run), "item long, text string, words array<long>, seeds array<long>, places array<long>"),
        "benchmark_items")
    names = known.select("item", "text").join(benchmark.select("text", "item_id"), "text").select("item", "item_id").distinct()
    return known.drop("text"), names


def _bits(value: np.ndarray, size: int) -> np.ndarray:
    """The places (probes, seeds) of seeds in a table of ``size`` bits, a power of two."""
    with np.errstate(over="ignore"):
        step = (value >> np.uint64(32)) | np.uint64(1)
        return np.stack([(value + np.uint64(k) * step) & np.uint64(size - 1) for k in range(_PROBES)])


def seed_table(items: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """The bit table of all seeds of ``items``: 64 bits a seed, at most ``most``, in 64-bit words."""
    n = items.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0))).first()[0]
    size = min(most, 1 << max(16, int(64 * n).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.asarray(batch.column("seeds").flatten()).astype(np.int64).view(np.uint64)
            bits = np.unique(_bits(value, size))
            word, first = np.unique(bits >> np.uint64(6), return_index=True)
            if len(word):
                own = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first)
                yield pa.RecordBatch.from_pydict({"word": pa.array(word.astype(np.int64)), "own": pa.array(own.view(np.int64))})

    rows = (items.select("seeds").transform(map_arrow, run, "word long, own long")
            .groupBy("word").agg(F.bit_or("own").alias("own")).toArrow())
    table = np.zeros(size >> 6, np.uint64)
    table[np.asarray(rows["word"])] = np.asarray(rows["own"]).astype(np.int64).view(np.uint64)
    return table


def _held(value: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in ``value`` of the seeds whose bits are all set."""
    at = np.arange(len(value))
    for k in range(_PROBES):
        bits = _bits(value[at], len(table) << 6)[k]
        at = at[(table[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _windows(docs: DataFrame, masks: tuple[str, ...], table: np.ndarray, reach: int) -> DataFrame:
    """The rows of ``docs`` (row, name, text) with their hits: (row, name, head, part, start, words, seeds, places), a row
    for each window with hits (``part`` numbers it, ``start`` is its first word), or one without lists.  ``head`` marks
    one row of each row of ``docs``; ``reach`` is the number of words of the longest item."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(strings(batch))
        counts = words.counts()
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for mask in masks:
            value, at = seeds(words, mask)
            keep = _held(value, table)
            found.append(value[keep])
            places.append(at[keep])
        value, at = np.concatenate(found), np.concatenate(places)
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
        text = np.searchsorted(words.first, at, side="right") - 1
        place = at - words.first[text]
        part = place // WINDOW
        edge = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(part, prepend=-1))
        ends = np.append(edge, len(at))[1:]
        low = np.maximum(0, place[edge] - reach)
        high = np.minimum(counts[text[edge]], place[ends - 1] + reach) if len(edge) else low
        clean = np.setdiff1d(np.arange(batch.num_rows), text)
        owner = np.concatenate([text[edge], clean])
        head = np.concatenate([np.diff(text[edge], prepend=-1) != 0, np.ones(len(clean), bool)])
        none = np.zeros(len(clean), np.int64)
        spans = [words.hash[words.first[t] + a:words.first[t] + b] for t, a, b in zip(text[edge], low, high, strict=True)]
        size = np.concatenate([high - low, none])
        hits = np.concatenate([ends - edge, none])
        rows = batch.select(["row", "name"]).take(pa.array(owner))
        return pa.RecordBatch.from_pydict({
            "row": rows.column("row"), "name": rows.column("name"), "head": pa.array(head),
            "part": pa.array(np.concatenate([part[edge], none - 1])), "start": pa.array(np.concatenate([low, none])),
            "words": _lists(np.concatenate([np.zeros(0, np.uint64), *spans]), np.cumsum(size)),
            "seeds": _lists(value, np.cumsum(hits)), "places": _lists(place, np.cumsum(hits))})

    kind = docs.schema["name"].dataType.simpleString()
    return docs.transform(map_arrow, by_slice(run), f"row long, name {kind}, head boolean, part long, start long, "
                                                    "words array<long>, seeds array<long>, places array<long>")


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join on ``key``.  A key with more than a thousandth of the rows of ``left`` (fewer than a thousand are) is
    dealt over as many parts as it has thousandths, and its rows of ``right`` go to each; ``left`` is read twice."""
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    hot = counts.where((F.col("n") > hot_rows) & (F.col("n") * _SHARES > total)).select(
        key, F.ceil(F.col("n") * _SHARES / F.lit(max(total, 1))).alias("parts")).collect()
    if not hot:
        return left.join(right, key)
    parts = left.sparkSession.createDataFrame([(r[key], int(r["parts"])) for r in hot], f"`{key}` long, parts long")
    n = F.coalesce("parts", F.lit(1))
    own = left.join(F.broadcast(parts), key, "left").withColumn("deal", F.pmod(F.xxhash64(*left.columns), n)).drop("parts")
    each = right.join(F.broadcast(parts), key, "left").withColumn(
        "deal", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("parts")
    return own.join(each, [key, "deal"]).drop("deal")


def agreement(text: np.ndarray, item: np.ndarray, skipped: int, overlap: int, share: float) -> tuple[int, float] | None:
    """Words that agree where ``text`` lies on ``item`` from its word ``skipped`` on, and their share of the item, if some
    stretch is long enough and holds the share of agreeing words."""
    same = text == item[skipped:skipped + len(text)]
    need = min(overlap, len(item))
    if len(same) < need:
        return None
    # a stretch has the share of agreeing words where the sum of (agrees - share) over it isn't negative
    total = np.append(0.0, np.cumsum(same - share))
    if (total[need:] - np.minimum.accumulate(total)[:len(total) - need]).max() < -1e-9:
        return None
    return int(same.sum()), float(same.sum() / len(item))


def _verified(pairs: DataFrame, overlap: int, share: float) -> DataFrame:
    """(row, item, matched, best_share) of the pairs (row, item, skipped, words, item_words) that overlap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            lists = {c: (np.asarray(batch.column(c).flatten()), np.cumsum([0, *batch.column(c).value_lengths().to_pylist()]))
                     for c in ("words", "item_words")}
            for i, skipped in enumerate(batch.column("skipped").to_pylist()):
                ok = agreement(*(v[e[i]:e[i + 1]] for v, e in lists.values()), skipped, overlap, share)
                found.append(ok or (None, None))
            matched, best = zip(*found, strict=True) if found else ((), ())
            out = pa.RecordBatch.from_pydict({"row": batch.column("row"), "item": batch.column("item"),
                                              "matched": pa.array(matched, pa.int64()),
                                              "best_share": pa.array(best, pa.float64())})
            yield out.filter(out.column("matched").is_valid())

    return pairs.select("row", "item", "skipped", "words", "item_words").transform(
        map_arrow, run, "row long, item long, matched long, best_share double")


def _found(docs: DataFrame, benchmark: DataFrame, overlap: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows of ``docs`` (name, text); the verified overlaps (row, item, matched, best_share), of which a row and an
    item may have several; and the ids of the items."""
    items, names = items_of(benchmark, overlap)
    short = F.coalesce(F.min(F.size("words")) < overlap, F.lit(False))
    has_short, reach = items.agg(short, F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    own = docs.withColumn("row", F.monotonically_increasing_id())
    windows = landed(_windows(own, MASKS + SHORT_MASKS if has_short else MASKS, seed_table(items), reach), "seed_windows")
    crowded = windows.where(F.size("seeds") > 0)
    hits = crowded.select("row", "part", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select(
        "row", "part", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
    places = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select(
        "item", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("off"))
    pairs = landed(dealt_join(hits, places, "seed").select("row", "part", "item", (F.col("at") - F.col("off")).alias("diagonal"))
                   .distinct(), "seed_pairs")
    low = F.greatest("diagonal", "start")
    high = F.least(F.col("diagonal") + F.size("item_words"), F.col("start") + F.size("words"))
    met = (dealt_join(pairs, items.select("item", F.col("words").alias("item_words")), "item")
           .join(crowded.select("row", "part", "start", "words"), ["row", "part"])
           .select("row", "item", "item_words", (low - F.col("diagonal")).alias("skipped"),
                   F.slice("words", (low - F.col("start") + 1).cast("int"),
                           F.greatest(high - low, F.lit(0)).cast("int")).alias("words")))
    return windows, landed(_verified(met, overlap, share), "overlaps"), names


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, contaminated, items (ids of ``benchmark`` (item_id, text) that
    the document holds, sorted, a null id last), n_items, matched (most words of one item that agree) and best_share
    (their share of the item).  The masks miss nothing where ``overlap`` and ``share`` aren't below the defaults.

    Null and empty texts are clean and null items match nothing; repeated rows of ``docs`` give repeated rows, repeated
    items one id; an empty benchmark leaves all clean, an empty ``docs`` gives no rows.  Other columns aren't read.
    """
    windows, found, names = _found(docs.select(F.col("doc_id").alias("name"), "text"), benchmark, overlap, share)
    best = found.groupBy("row", "item").agg(F.max("matched").alias("matched"), F.max("best_share").alias("best_share"))
    marked = dealt_join(landed(best, "overlaps_by_item"), names, "item").groupBy("row").agg(
        F.collect_set(F.struct("item_id")).alias("items"), F.max("matched").alias("matched"),
        F.max("best_share").alias("best_share"))
    items = F.array_sort(F.transform("items", lambda s: s["item_id"]))
    return windows.where("head").select("row", "name").join(marked, "row", "left").select(
        F.col("name").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(items, F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>")).alias("items"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark.  What a document holds is up to its text, so
    the SHA-256 of the contaminated texts decide; texts don't move where Spark measures that those are few."""
    plain, restored = set_aside(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    windows, found, _ = _found(docs.select(digest.alias("name"), "text"), benchmark, OVERLAP, SHARE)
    bad = landed(windows.where("head").join(found.select("row").distinct(), "row", "left_semi")
                 .select(F.col("name").alias("__digest")).distinct(), "contaminated")
    return restored(plain.withColumn("__digest", digest).join(bad, "__digest", "left_anti").drop("__digest"))
