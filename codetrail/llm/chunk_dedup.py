"""Operator 3: exact duplicates by content-defined chunk recipes.

A text without white space is cut where a rolling hash of its last ``WINDOW`` bytes has ``CUT_BITS`` zero bits, so equal
texts are cut alike whatever stands around them.  A chunk's identifier is its 64-bit hash, verified: the distinct
(hash, SHA-256) pairs of the corpus are counted, and chunks that share a hash but not the SHA-256 get ordinals, which
become part of the recipes they occur in.  Documents are then compared by their ordered identifier lists; about
eight bytes move for a chunk of a kilobyte, and the texts themselves stay where they are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetrail.llm.common import by_slice, is_empty, landed, map_arrow, set_aside, strings

WINDOW = 32
CUT_BITS = 10
SHORTEST, LONGEST = 256, 8192
#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, start: np.ndarray) -> list[list[int]]:
    """For each text (its bytes from start[i] to start[i + 1]) the ends of its chunks.

    The rolling hash is the sum of the gear values of the window, each shifted by its distance; it is built by doubling.
    No chunk but a text's last is under SHORTEST bytes, none over LONGEST; an empty text has no chunk.
    """
    rolling = _GEAR[data]
    step = 1
    while step < WINDOW:
        rolling[step:] = rolling[step:] + (rolling[:-step] << np.uint32(step))
        step *= 2
    candidates = np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1
    first = np.searchsorted(candidates, start)
    out = []
    for i in range(len(start) - 1):
        at, end, own = int(start[i]), int(start[i + 1]), []
        for c in candidates[first[i]:first[i + 1]].tolist():
            while c - at > LONGEST:
                at += LONGEST
                own.append(at)
            if c - at >= SHORTEST:
                own.append(at := c)
        while end - at > LONGEST:
            at += LONGEST
            own.append(at)
        if at < end:
            own.append(end)
        out.append(own)
    return out


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, row, n_points, text_sha256, hashes, digests of every row: the chunks in order.  ``hash_bits``: shorter
    hashes clash more often, which tests use."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch)
        bodies = [t.encode().translate(None, WHITE) for t in texts]
        start = np.concatenate([[0], np.cumsum([len(b) for b in bodies], dtype=np.int64)]).astype(np.int64)
        ends = cuts(np.frombuffer(b"".join(bodies), np.uint8), start)
        hashes, digests, whole = [], [], []
        for body, own, base in zip(bodies, ends, start.tolist(), strict=False):
            chunks = [body[a - base:b - base] for a, b in zip([base, *own], own, strict=False)]
            hashes.append([_signed(xxhash.xxh3_64_intdigest(c) >> (64 - hash_bits)) for c in chunks])
            digests.append([hashlib.sha256(c).digest() for c in chunks])
            whole.append(hashlib.sha256(body).hexdigest())
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_points": pa.array([len(t) for t in texts], pa.int64()),
            "text_sha256": pa.array(whole, pa.string()), "hashes": pa.array(hashes, pa.list_(pa.int64())),
            "digests": pa.array(digests, pa.list_(pa.binary()))})

    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", "text")
            .transform(map_arrow, by_slice(run), f"doc_id {kind}, n_points long, text_sha256 string, hashes array<long>, "
                                       "digests array<binary>")
            .withColumn("row", F.monotonically_increasing_id()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_identifiers(own: DataFrame) -> DataFrame:
    """``own`` with ``ids``, the recipe of verified identifiers: the hashes, and (position, ordinal) of the chunks whose
    hash stands for several contents."""
    chunks = own.select("row", F.posexplode(F.arrays_zip("hashes", "digests")).alias("pos", "chunk")).select(
        "row", "pos", "chunk.hashes", "chunk.digests")
    catalog = chunks.groupBy("hashes", "digests").agg(F.lit(1).alias("one"))
    clashing = catalog.groupBy("hashes").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("digests")).alias("all"))
    clashing = landed(clashing.where("n > 1").select("hashes", F.posexplode("all").alias("ordinal", "digests")), "clashes")
    none = F.array().cast("array<struct<pos:int,ordinal:int>>")
    if is_empty(clashing):
        return own.withColumn("ordinals", none)
    fixed = (chunks.join(clashing, ["hashes", "digests"]).where("ordinal > 0").groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("ordinals")))
    return own.join(fixed, "row", "left").withColumn("ordinals", F.coalesce("ordinals", none))


def exact_duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty, and all empty
    texts are one group.  Of a group the row with the most code points, then the smallest doc_id stays (a null id comes
    last).  A repeated row (same doc_id and text) is listed as often as it occurs, ``kept`` alike; ``group_size`` counts
    rows.  An empty table gives no rows; other columns aren't read.
    """
    own = with_identifiers(landed(recipes(docs, hash_bits), "recipes")).drop("digests")
    groups = own.groupBy("hashes", "ordinals").agg(
        F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"))).alias("best"),
        F.count("*").alias("group_size")).select("hashes", "ordinals", F.col("best.id").alias("keep_id"), "group_size")
    return own.join(groups, ["hashes", "ordinals"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; of a repeated row one stays.  The texts are shuffled once."""
    def key(doc_id, sha):
        return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), sha)

    chosen = exact_duplicates(docs).where("kept").select(key("doc_id", F.col("text_sha256")).alias("__key")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]", "").cast("binary"), 256)
    plain, restored = set_aside(docs)
    marked = plain.withColumn("__key", key("doc_id", sha)).join(chosen, "__key", "left_semi")
    numbered = marked.withColumn("__n", F.row_number().over(
        Window.partitionBy("__key").orderBy(F.length("text").desc_nulls_last())))
    return restored(numbered.where("__n = 1"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
