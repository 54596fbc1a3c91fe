"""Operator 4: near duplicates by DartMinHash signatures and banded joining.

Each element of a weighted set owns a region: its weight, in intervals [0,1), [1,2), [2,4), ..., times an unbounded
time axis.  Hashed darts hit an interval of width w as a Poisson process of rate K*w, the same for every set that holds
the element; a dart counts where its weight position lies below the element's weight.  A dart has a coordinate out of
K; per coordinate the earliest one is kept.  Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity.  Only darts up to a horizon that gives about log K + 2 of them per coordinate are thrown, whatever
the size of the set; a set with an empty coordinate throws again to twice the horizon, which changes no kept dart.

Near duplicates have a Jaccard similarity of 0.8 or more of their sets of five-word shingles (weights 1; ``weighted``
takes the number of occurrences instead).  Candidates share a band of ``ROWS`` coordinates, which misses a pair of
similarity 0.8 with a chance of about 6e-5.  They are checked in two steps, neither of which writes out the pairs of a
bucket:

1. each document against the smallest of each of its buckets;
2. then, in buckets that still hold several classes, the members of all classes but the bucket's largest against each other
   and against that one, in blocks of at most ``BLOCK`` documents inside a task, once for each pair: those of different
   classes whose signatures agree in enough coordinates (``likely_share``) are verified, the most alike first, until the
   classes that have a link are joined.

Both are verified with the shingle sets (40 bits of each shingle's hash) before they count as links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.llm.common import by_slice, landed, map_arrow, mix, set_aside, strings
from codetrail.llm.components import components
from codetrail.llm.words import shingles_of, words_of

K = 192
ROWS = 6
SIMILAR = 0.8
BLOCK = 256
#: A key with more than this part of all rows is looked up in a broadcast table, which so has fewer than PARTS rows.
PARTS = 1000
#: Documents whose darts are thrown together (about 1,400 for each, whatever its length).
SKETCH_ROWS = 128
WORDS = 5


def likely_share(similar: float, k: int) -> float:
    """Agreement of signatures below which a pair of step 2 isn't verified: ``similar`` less 5.2 standard deviations, which
    leaves out a pair of that similarity with a chance of 1e-7, far less often than the bands do."""
    return similar - 5.2 * (similar * (1 - similar) / k) ** 0.5


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int = K) -> np.ndarray:
    """(sets, k) dart ids; ``first`` has each set's first element and the end.  Empty sets get zeros."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(owner, weights, minlength=n)
    best, out = np.full(n * k, np.inf), np.zeros(n * k, dtype=np.uint64)
    horizon = (np.log(k) + 2) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        _throw(elements[mine], weights[mine], owner[mine], horizon, k, best, out)
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        horizon = horizon * 2
    return out.reshape(n, k)


def _throw(elements, weights, owner, horizon, k, best, out) -> None:
    low, width, band = 0.0, 1.0, 0
    while (weights > low).any():
        at = np.flatnonzero(weights > low)
        with np.errstate(over="ignore"):
            state = mix(elements[at] + np.uint64(band + 1) * np.uint64(0xA0761D6478BD642F))
        time, turn, end = np.zeros(len(at)), 0, horizon[owner[at]]
        while len(at):
            turn += 1
            with np.errstate(over="ignore"):
                h = mix(state + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15))
                dart = mix(h ^ np.uint64(0xE7037ED1A0B428DB))
                time = time - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (k * width)
            live = time <= end
            at, state, time, end, dart, h = at[live], state[live], time[live], end[live], dart[live], h[live]
            if low + width > 1.0 or weights[at].min(initial=1.0) < 1.0:
                place = low + width * (mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                hit = np.flatnonzero(place < weights[at])
                _keep(owner[at[hit]], dart[hit], time[hit], k, best, out)
            else:
                _keep(owner[at], dart, time, k, best, out)
        low, width, band = low + width, max(1.0, low + width), band + 1


def _keep(owner, dart, time, k, best, out) -> None:
    cell = owner * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(best, cell, time)
    won = time == best[cell]
    out[cell[won]] = dart[won]


def sketches(docs: DataFrame, k: int = K, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """node, doc_id, key (of the words in order), n (total weight), sketch (a byte per coordinate), bands."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(strings(batch))
        elements, first = shingles_of(words, WORDS)
        weights = shingle_weights(words, elements, first) if weighted else np.ones(len(elements))
        sig = signatures(elements, weights, first, k)
        bands = np.zeros((len(sig), k // rows), dtype=np.uint64)
        for r in range(rows):
            bands = mix(bands ^ sig[:, r:(k // rows) * rows:rows] + np.uint64(r))
        bands = mix(bands ^ (np.arange(k // rows, dtype=np.uint64) << np.uint64(50))).view(np.int64)
        full = np.diff(first) > 0
        small = sig.astype(np.uint8)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "key": pa.array(keys_of(words), pa.binary()),
            "n": pa.array(np.add.reduceat(np.append(weights, 0.0), first[:-1]) * full),
            "sketch": pa.array([s.tobytes() if f else b"" for s, f in zip(small, full, strict=True)], pa.binary()),
            "bands": pa.array([b if f else [] for b, f in zip(bands, full, strict=True)], pa.list_(pa.int64()))})

    return (docs.select("doc_id", "text")
            .transform(map_arrow, by_slice(run, rows=SKETCH_ROWS), f"doc_id {kind}, key binary, n double, sketch binary, bands array<long>")
            .withColumn("node", F.monotonically_increasing_id()))


def keys_of(words) -> list[bytes]:
    """128 bits that stand for a text's words in order; a text without words has the key of its bytes."""
    raw, first, start = words.hash.tobytes(), words.first.tolist(), words.text_start.tolist()
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a
            else hashlib.blake2b(words.data[s:e].tobytes(), digest_size=16, person=b"no words").digest()
            for a, b, s, e in zip(first, first[1:], start, start[1:], strict=False)]


def shingle_weights(words, elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Occurrences of each shingle in its text."""
    out = np.ones(len(elements))
    for i in range(len(first) - 1):
        own = words.hash[words.first[i]:words.first[i + 1]]
        if len(own) > WORDS:
            with np.errstate(over="ignore"):
                base = np.uint64(0x9E3779B97F4A7C15)
                sums = sum(own[j:len(own) - WORDS + 1 + j] * np.uint64(2 * j + 1) * base for j in range(WORDS))
            out[first[i]:first[i + 1]] = np.unique(mix(sums), return_counts=True)[1]
    return out


def _pack(values: np.ndarray, weights: np.ndarray | None) -> bytes:
    """Five bytes of each sorted hash, then its weight as a float where sets are weighted."""
    five = (values >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return five.tobytes() + (b"" if weights is None else weights.astype("<f4").tobytes())


def _unpack(blob: bytes, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (9 if weighted else 5)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(n, 5)
    return wide.view("<u8").ravel(), np.frombuffer(blob, "<f4", n, 5 * n) if weighted else np.ones(n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted elements, weights)."""
    (x, v), (y, w) = a, b
    _, i, j = np.intersect1d(x, y, return_indices=True)
    shared = float(np.minimum(v[i], w[j]).sum())
    union = float(v.sum() + w.sum()) - shared
    return shared / union if union else 1.0


def shingle_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, weighted: bool) -> DataFrame:
    """node, set (packed) of the texts of ``nodes``; a text is found by its doc_id and the key of its words."""
    wanted = nodes.select("node").distinct().join(
        reps.select("node", F.col("doc_id").alias("__id"), F.col("key").alias("__key")), "node")
    texts = wanted.join(docs.select(F.col("doc_id").alias("__doc"), "text"), F.col("__id").eqNullSafe(F.col("__doc")))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(strings(batch))
        elements, first = shingles_of(words, WORDS)
        weights = shingle_weights(words, elements, first) if weighted else None
        blobs = [_pack(elements[a:b], None if weights is None else weights[a:b])
                 for a, b in zip(first, first[1:], strict=False)]
        right = [k == w for k, w in zip(keys_of(words), batch.column("__key").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_pydict({"node": batch.column("node"), "set": pa.array(blobs, pa.binary())})
        return out.filter(pa.array(right))

    return landed(texts.select("node", "__key", "text").transform(map_arrow, by_slice(pack), "node long, set binary")
                  .dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similar: float, weighted: bool) -> DataFrame:
    """The pairs (a, b nodes of ``sets``) whose sets are similar enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def check(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(
                [similarity(_unpack(x.as_py(), weighted), _unpack(y.as_py(), weighted)) >= similar
                 for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)], pa.bool_()))

    return both.select("a", "b", "sa", "sb").transform(map_arrow, check, "a long, b long")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal coordinates, less what bytes agree by chance."""
    same = np.empty((len(x), len(y)), dtype=np.float32)
    for i in range(0, len(x), 64):
        same[i:i + 64] = (x[i:i + 64, None, :] == y[None, :, :]).mean(axis=2, dtype=np.float32)
    return (same - 1 / 256) / (1 - 1 / 256)


def _between(rows: dict[str, np.ndarray], similar: float, likely: float, weighted: bool) -> list[tuple[int, int]]:
    """Links between the classes of a group, as many as hold them together: pairs that agree most are verified first, and
    none whose documents are connected by then.  A pair counts only in the first bucket that both are in."""
    left, right = np.flatnonzero(rows["side"] <= 0), np.flatnonzero(rows["side"] >= 0)
    node, comp, n = rows["node"], rows["comp"], rows["n"]
    fit = comp[left][:, None] != comp[right][None, :]
    if not (rows["side"] != 0).any():
        fit &= node[left][:, None] < node[right][None, :]
    fit &= np.minimum.outer(n[left], n[right]) >= similar * np.maximum.outer(n[left], n[right])
    if not fit.any():
        return []
    agree = agreement(rows["sketch"][left], rows["sketch"][right])
    i, j = np.nonzero(fit & (agree >= likely))
    agree, i, j = agree[i, j], left[i], right[j]
    shared = rows["bands"][i] == rows["bands"][j]
    here = rows["bands"][i] == rows["bucket"][i][:, None]
    mine = shared.argmax(axis=1) == here.argmax(axis=1)
    i, j = i[mine], j[mine]
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    links = []
    for k in np.argsort(-agree[mine], kind="stable"):
        a, b = int(i[k]), int(j[k])
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y:
            for r in (a, b):
                if r not in sets:
                    sets[r] = _unpack(rows["set"][r], weighted)
            if similarity(sets[a], sets[b]) >= similar:
                parent[x] = y
                links.append((int(node[a]), int(node[b])))
    return links


def dealt_blocks(buckets: DataFrame, block: int) -> DataFrame:
    """``buckets`` (bucket, node, comp, others) dealt into groups (bucket, i, j) with the side of each row in its group.

    ``others`` has a row for each bucket: major (the class with most members there), m (members) and m_major (of that
    class).  Members of the other classes are dealt into blocks 0, 1, ... of at most about ``block`` by a hash of the node,
    those of the major class into the blocks after them; two blocks are a group unless both are of the major class, whose
    members never meet each other.  So a million members with one outlier are copied once each.
    """
    minor = F.ceil((F.col("m") - F.col("m_major")) / block).cast("int")
    major = F.ceil(F.col("m_major") / block).cast("int")
    inside = F.col("comp") == F.col("major")
    at = F.xxhash64("node")
    own = F.when(inside, minor + F.pmod(at, major)).otherwise(F.pmod(at, minor)).cast("int")
    other = F.sequence(F.lit(0), F.when(inside, minor - 1).otherwise(minor + major - 1))
    return (buckets.withColumn("own", own).withColumn("other", F.explode(other))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("side", F.signum(F.col("own") - F.col("other")).cast("int")).drop("own", "other"))


def cross_links(buckets: DataFrame, similar: float, likely: float, block: int, weighted: bool) -> DataFrame:
    """a, b: links between different classes, out of ``buckets`` (bucket, major, m, m_major, node, comp, n, sketch, bands,
    set).  A task holds one group of ``dealt_blocks`` at a time, two blocks of a bucket."""
    dealt = dealt_blocks(buckets, block).select("bucket", "i", "j", "side", "node", "comp", "n", "sketch", "bands", "set")
    ordered = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compared(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
        rows = {c: np.asarray(table[c].combine_chunks()) for c in ("bucket", "side", "node", "comp", "n")}
        rows["sketch"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        rows["bands"] = np.asarray(table["bands"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        rows["set"] = np.array(table["set"].to_pylist(), dtype=object)
        found = []
        for at, end in zip([0, *ends], ends, strict=False):
            found += _between({c: v[at:end] for c, v in rows.items()}, similar, likely, weighted)
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()),
                                           "b": pa.array([b for _, b in found], pa.int64())})

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables(
                [rest, pa.Table.from_batches([batch])])
            bucket, i, j = (np.asarray(table[c].combine_chunks()) for c in ("bucket", "i", "j"))
            ends = (np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()
            if ends:
                yield compared(table.slice(0, ends[-1]), ends)
            rest = table.slice(ends[-1] if ends else 0)
        if rest is not None and rest.num_rows:
            yield compared(rest, [rest.num_rows])

    return ordered.transform(map_arrow, run, "a long, b long")


def with_row_of_key(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the row of ``table`` that has their key; ``table`` has each key once and in ``n`` how many rows have it.

    Keys with more than a PARTS-th of the ``total`` rows, fewer than PARTS of them, are broadcast, so that no task receives all
    rows of such a key; the others are joined."""
    heavy = F.col(n) * PARTS > total
    many = table.where(heavy)
    return rows.join(F.broadcast(many), key).unionByName(
        rows.join(F.broadcast(many.select(key)), key, "left_anti").join(table.where(~heavy), key))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, k: int = K, rows: int = ROWS, weighted: bool = False,
                    likely: float | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (the smallest doc_id of its class), class_size (rows),
    n_copies (rows with the same words in order, itself included), n_spanning_links (verified links of its words to other
    texts, of a set of links just large enough to hold the class together) and kept.

    Classes are connected components of the near-duplicate links; texts of the same words are copies of one class.  Null
    and empty texts, and texts without a word, have no shingles: they are in one class with texts that have the same
    bytes.  Texts of fewer than five words have one shingle of all their words.  ``kept`` marks the document that stays:
    the smallest doc_id (a null id comes last; of rows that repeat a doc_id all are marked).  An empty table gives no
    rows; other columns aren't read.
    """
    likely = likely_share(similar, k) if likely is None else likely
    own = landed(sketches(docs, k, rows, weighted), "sketches")
    total = own.count()
    first_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    reps_of = own.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n_copies"), first_id.alias("best"))
    reps = own.join(reps_of.select(F.col("rep").alias("node")), "node", "left_semi")
    members = reps.select("node", F.explode("bands").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    shared = landed(members.join(pivots, "bucket").select("bucket", "node", "pivot"), "shared")
    star = shared.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    # both steps compare documents of these buckets only: texts travel once for the two
    sets = shingle_sets(shared, reps, docs, weighted)
    first = landed(verified(star, sets, similar, weighted), "links")
    comp = landed(components(first), "classes")
    held = shared.select("bucket", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = held.groupBy("bucket", "comp").agg(F.count("*").alias("of_class"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("of_class", "comp")).alias("top"), F.sum("of_class").alias("m")).select(
        "bucket", "m", F.col("top.comp").alias("major"), F.col("top.of_class").alias("m_major")).where("m > m_major")
    rest = held.join(mixed, "bucket").join(reps.select("node", "n", "sketch", "bands"), "node")
    rest = rest.join(sets, "node")
    links = landed(first.unionByName(cross_links(rest, similar, likely, block, weighted)), "links")
    comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    texts = landed(reps_of.withColumnRenamed("rep", "node").join(comp, "node", "left").join(degree, "node", "left").select(
        "key", "n_copies", "best", F.coalesce("comp", "node").alias("comp"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_spanning_links")), "texts")
    classes = texts.groupBy("comp").agg(F.min("best").alias("class_best"), F.sum("n_copies").alias("class_size"),
                                        F.count("*").alias("n_texts"))
    of_texts = landed(with_row_of_key(texts, classes, "comp", "n_texts", total).select(
        "key", "n_copies", "n_spanning_links", "class_size", F.col("class_best.id").alias("class_id")), "texts")
    return with_row_of_key(own.select("doc_id", "key"), of_texts, "key", "n_copies", total).select(
        "doc_id", "class_id", "class_size", "n_copies", "n_spanning_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one_of_class(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of near duplicates."""
    chosen = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    plain, restored = set_aside(docs)
    return restored(plain.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"))
