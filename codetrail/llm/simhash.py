"""Operator 12: SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most three of 64 bits agree in at least one of four blocks, so equal blocks are joined and
only pairs inside such a bucket are compared.  Copies meet as one fingerprint beforehand.  A bucket of more than ``CROWD``
fingerprints is cut again by the same rule: of the bits in which its members differ at all, four new blocks are made, and
a close pair agrees in at least one of them.  Distinct fingerprints that agree in all but n bits are at most 2^n, so this
ends with buckets of bounded size, whatever the data; no bucket is skipped, and no task holds an unbounded one.

Inside a task all pairs of a bucket are compared (the buckets of a batch at once), and what leaves it is not every close
pair but a spanning forest of them: one link per fingerprint, which keeps all components whole.

Words, hashes and results for odd rows: a null text is empty; an empty text, or one of separators only, has fingerprint
zero and is linked like any other; a null ``doc_id`` is never the smallest, so a component without any other has a null
``component_id``; repeated rows come out as often as they went in; further columns play no part; an empty table gives no
rows; a text of any length is hashed in windows of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.llm.common import by_slice, landed, map_arrow, private, strings
from codetrail.llm.components import components

#: Words in a shingle; bits that may differ; blocks, so that one of them must agree; members of a bucket compared pairwise.
SHINGLE, DIFFER, BLOCKS, CROWD = 3, 3, 4, 256
#: Words whose shingles are hashed at once.
WINDOW = 1 << 16
_SEED = 42
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _hashes(low: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one lower-case text, a window of words at a time."""
    start = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[np.frombuffer(low, dtype=np.uint8)]]).view(np.int8)) < 0)
    for at in range(0, max(len(start) - n + 1, min(len(start), 1)), WINDOW):
        stop = at + WINDOW + n - 1  # past the last word of this window
        words = low[start[at]:start[stop] if stop < len(start) else len(low)].split()
        text = b" ".join(words)
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        k = min(n, len(words))
        spans = zip(begins[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
        yield np.fromiter((xxhash.xxh64_intdigest(text[a:b], _SEED) for a, b in spans), dtype=np.uint64,
                          count=len(words) - k + 1)


def _bits_of(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 bits, lowest first, for each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints_of(texts: list[str], n: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if more than half of the shingles' hashes have it."""
    sums, total = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    waiting, of = [], []

    def flush() -> None:
        if not waiting:
            return
        h, sizes = np.concatenate(waiting), np.array([len(w) for w in waiting])
        rows = np.add.reduceat(_bits_of(h), np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        np.add.at(sums, of, rows)
        np.add.at(total, of, sizes)
        waiting.clear()
        of.clear()

    held = 0
    for i, text in enumerate(texts):
        for h in _hashes(text.encode("utf-8", "replace").lower(), n):
            waiting.append(h)
            of.append(i)
            held += len(h)
            if held >= WINDOW:
                flush()
                held = 0
    flush()
    return np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(strings(batch), n).view(np.int64)
        return pa.record_batch([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return map_arrow(private(docs, {"doc_id": "doc_id", "text": "text"}), by_slice(run), "doc_id long, fp long")


def _parted(bits: int, parts: int = BLOCKS) -> list[int]:
    """The set bits of ``bits``, cut into ``parts`` runs of nearly equal size, as signed masks."""
    places = [i for i in range(64) if bits >> i & 1]
    edges = [len(places) * i // parts for i in range(parts + 1)]
    masks = [sum(1 << i for i in places[a:b]) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _cuts(crowded: DataFrame, parts: int) -> DataFrame:
    """bucket, masks: the blocks of the bits in which the members of a crowded bucket differ."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [_parted(v & ((1 << 64) - 1), parts) for v in b.column("varying").to_pylist()]
            yield pa.record_batch([b.column("bucket"), pa.array(masks, pa.list_(pa.int64()))], names=["bucket", "masks"])

    return map_arrow(crowded.select("bucket", "varying"), run, "bucket long, masks array<long>")


def buckets(distinct: DataFrame, crowd: int = CROWD, differ: int = DIFFER) -> DataFrame:
    """bucket, fp: every fingerprint in all of its buckets, each of at most ``crowd`` members (or 2^(differ + 1)); any two
    fingerprints that differ in at most ``differ`` bits share one.  Buckets of a single member are left out."""
    parts = differ + 1
    masks = F.array(*[F.lit(m) for m in _parted((1 << 64) - 1, parts)])
    level = distinct.select("fp", F.lit(0).cast("long").alias("bucket"), masks.alias("masks"))
    settled = None
    while True:
        inside = landed(level.select("fp", "bucket", F.explode("masks").alias("mask"))
                        .select("fp", F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket")), "buckets")
        sizes = (inside.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"))
                 .where(F.col("n") > 1))
        sizes = landed(sizes.withColumn("crowded", (F.col("n") > crowd) & (F.bit_count("varying") > parts)), "sizes")
        done = inside.join(sizes.where(~F.col("crowded")).select("bucket"), "bucket").select("bucket", "fp")
        settled = done if settled is None else settled.unionByName(done)
        crowded = sizes.where("crowded")
        if not crowded.take(1):
            return settled
        level = inside.join(_cuts(crowded, parts), "bucket").select("fp", "bucket", "masks")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def close_in_buckets(bucket: np.ndarray, fp: np.ndarray, differ: int = DIFFER) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of fingerprints that span what ``differ`` bits or fewer connect inside the buckets; rows of a bucket
    are adjacent."""
    n, left, right = len(fp), [], []
    at = np.arange(n)
    step = 1
    while True:
        at = at[at + step < n]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= differ]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left:
        return fp[:0], fp[:0]
    root = forest(np.concatenate(left), np.concatenate(right), n)
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def links(settled: DataFrame, differ: int = DIFFER) -> DataFrame:
    """a, b: links between fingerprints; all close pairs of a bucket are connected by them.  Each bucket is in one task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_b, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = False
        source = iter(batches)
        while not last:
            part = next(source, None)
            last = part is None
            if not last:
                rest_b = np.concatenate([rest_b, part.column("bucket").to_numpy()])
                rest_f = np.concatenate([rest_f, part.column("fp").to_numpy().view(np.uint64)])
            # the last bucket of a batch may go on in the next one
            cut = len(rest_b) if last else int(np.searchsorted(rest_b, rest_b[-1])) if len(rest_b) else 0
            a, b = close_in_buckets(rest_b[:cut], rest_f[:cut], differ)
            rest_b, rest_f = rest_b[cut:], rest_f[cut:]
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    together = settled.repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(together, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, differ: int = DIFFER, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) of every row."""
    rows = landed(fingerprints(docs, n), "fingerprints")
    distinct = landed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(landed(links(buckets(distinct, crowd, differ), differ), "links"))
    of = distinct.join(linked.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    member = of.join(least, "comp").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
