"""Operator 13: vector code compression by member-resident Lloyd iterations.

A vector is cut into parts, and each part becomes the number of the nearest entry of its position's codebook.  Parts live
with their owner, (position, entry, salt): the state of a round is a table bucketed by these three, so that

* owners sum up the parts that are resident with them, in place: the scan already has the distribution that the sums need;
* the new codebooks (``entries`` rows of a vector's length, whatever the number of vectors) go to all owners, who reassign
  their members in place and write them without a shuffle;
* only parts whose entry changed move to their new owner, as a second bucketed table; the next round reads residents that
  stayed and parts that arrived bucket by bucket.

The salt spreads a popular entry over many owners: it takes as many values as the entry's last known number of members asks
for, ``PER_OWNER`` each.  All arithmetic is exact: integers, squared distances, and sums.

Results for odd rows: a vector that is null, or that holds a null or a component that isn't finite, is left out.  The first
kept vector (by id, then by its components) gives the length; vectors of another length can't be coded with it and are left
out too, and so is every vector if that length isn't a multiple of the number of parts, or zero.  Components are clamped to
+-2^24 after scaling (a value of 16384).  Null ids come last among the ids; repeated ids and rows are rows of their own;
fewer than ``entries`` vectors make a smaller codebook; null labels are one label; further columns play no part; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.llm.common import landed, map_arrow, private, shared_path

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied with.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members that an owner is meant to have at most.
PER_OWNER = 1 << 14
#: Largest size of a scaled component.
BOUND = 1 << 24
_OWNER = ["pos", "entry", "salt"]


def nearest(parts: np.ndarray, book: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the lowest-numbered nearest row of ``book`` and the squared distance, in exact integers."""
    entry, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * largest * largest * book.shape[1] < 1 << 53  # every intermediate sum is a whole number that a double holds
    if exact:
        turned, norms = (-2.0 * book.T), (book.astype(np.float64) ** 2).sum(axis=1)
    for at in range(0, len(parts), rows):
        p = parts[at:at + rows]
        if exact:
            far = p.astype(np.float64) @ turned + norms
            entry[at:at + rows] = far.argmin(axis=1)
        else:
            far = np.stack([((p - b) ** 2).sum(axis=1) for b in book], axis=1)
            entry[at:at + rows] = far.argmin(axis=1)
        error[at:at + rows] = ((p - book[entry[at:at + rows]]) ** 2).sum(axis=1)
    return entry, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (whole numbers): the rows whose vector is complete and finite."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(v), 0))
            flat = pc.list_flatten(v)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = ~np.isfinite(x) | np.asarray(flat.is_null())
            holds = np.concatenate([[0], np.cumsum(bad)])
            ends = np.cumsum(sizes)
            good = np.asarray(v.is_valid()) & (holds[ends] == holds[ends - sizes])
            whole = np.clip(np.floor(np.where(bad, 0, x) * scale), -BOUND, BOUND).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(whole))
            keep = pa.array(good)
            yield pa.record_batch([b.column("vec_id").filter(keep), b.column("label").filter(keep), lists.filter(keep)],
                                  names=["vec_id", "label", "v"])

    return map_arrow(vectors, run, "vec_id long, label string, v array<int>")


def first_codebooks(whole: DataFrame, entries: int, parts: int) -> np.ndarray:
    """parts x entries x width: the parts of the ``entries`` first vectors; nothing where they can't be cut."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries * 2).collect()
    length = len(rows[0]["v"]) if rows else 0
    if not length or length % parts:
        return np.zeros((parts, 0, 0), np.int64)
    rows = (whole.where(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
            if any(len(r["v"]) != length for r in rows) else rows[:entries])
    v = np.array([r["v"] for r in rows], dtype=np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, length // parts).transpose(1, 0, 2))


class _Bucketed:
    """Tables bucketed by owner, in the shared folder; their names leave the catalog at the end, their files stay."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"codetrail_{name}_{uuid.uuid4().hex}"
        (df.write.format("parquet").bucketBy(self.n, *_OWNER).option("path", shared_path(self.spark, name)).saveAsTable(table))
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _salt(members: np.ndarray, entry: Column, pos: Column, per_owner: int, buckets: int) -> Column:
    """A salt from as many values as the entry's last known members need: no owner is meant to be more than ``per_owner``,
    nor more than a bucket's fair share."""
    fair = max(1, min(per_owner, int(members.sum()) // buckets))
    owners = F.array(*[F.lit(int(-(-m // fair) or 1)) for m in members.ravel()])
    return F.pmod(F.xxhash64("rid", "pos"), F.get(owners, (pos * members.shape[1] + entry).cast("int"))).cast("int")


def _assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The members with ``next``, the entry that is nearest now; in place."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books_ = shared.value
            part, pos = _matrix(b.column("part"), books_.shape[2]), np.asarray(b.column("pos"))
            to = np.zeros(len(pos), np.int32)
            for p in np.unique(pos):
                to[pos == p] = nearest(part[pos == p], books_[p])[0]
            yield pa.record_batch([*b.columns, pa.array(to)], names=[*b.schema.names, "next"])

    return map_arrow(state, run, "rid long, pos int, entry int, salt int, part array<int>, next int")


def _sums(residents: list[DataFrame], shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the parts of each entry.  Each owner sums up the members resident with it (its bucket is the group,
    so nothing moves); one row for each owner then goes to its entry."""
    columns = [F.sum(F.get("part", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(shape[2])]
    owned = None
    for table in residents:
        own = table.groupBy(*_OWNER).agg(F.count("*").alias("n"), *columns)
        owned = own if owned is None else owned.unionByName(own)
    total = owned.groupBy("pos", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(shape[2])]]])
    sums, n = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for r in total.collect():  # one row for each entry in use
        n[r["pos"], r["entry"]] = r["n"]
        sums[r["pos"], r["entry"]] = [r[f"s{i}"] for i in range(shape[2])]
    return sums, n


def _updated(books: np.ndarray, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], books)


def learned(whole: DataFrame, books: np.ndarray, rounds: int = ROUNDS, per_owner: int = PER_OWNER) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over ``whole`` (rid, v)."""
    spark = whole.sparkSession
    parts, entries, width = books.shape
    tables = _Bucketed(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), parts * width).reshape(-1, width).astype(np.int32)
            ends = np.arange(0, v.size + 1, width, dtype=np.int32)
            pos = np.tile(np.arange(parts, dtype=np.int32), b.num_rows)
            zero = pa.array(np.zeros(len(pos), np.int32))
            yield pa.record_batch([pa.array(np.repeat(np.asarray(b.column("rid")), parts)), pa.array(pos), zero, zero,
                                   pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))],
                                  names=["rid", "pos", "entry", "salt", "part"])

    try:
        start = _assigned(map_arrow(whole.select("rid", "v"), cut, "rid long, pos int, entry int, salt int, part array<int>"), books)
        # nobody owns a part yet: the first assignment says how many members each entry gets, then everything moves once
        start = landed(start.select("rid", "pos", F.col("next").alias("entry"), "part"), "parts")
        members = np.zeros((parts, entries), np.int64)
        for r in start.groupBy("pos", "entry").count().collect():
            members[r["pos"], r["entry"]] = r["count"]
        moved = start.select("rid", "pos", "entry", _salt(members, F.col("entry"), F.col("pos"), per_owner, tables.n).alias("salt"), "part")
        residents = [tables.write(moved.repartition(tables.n, *_OWNER), "residents")]
        for step in range(rounds):
            sums, members = _sums(residents, books.shape)
            books = _updated(books, sums, members)
            if step + 1 == rounds:
                return books
            placed = tables.write(_assigned(reduce(DataFrame.unionByName, residents), books), "assigned")
            stay = placed.where(F.col("next") == F.col("entry")).drop("next")
            leave = placed.where(F.col("next") != F.col("entry"))
            salt = _salt(members, F.col("next"), F.col("pos"), per_owner, tables.n)
            leave = leave.select("rid", "pos", F.col("next").alias("entry"), salt.alias("salt"), "part")
            residents = [stay, tables.write(leave.repartition(tables.n, *_OWNER), "arrived")]
    finally:
        tables.forget()
    return books


def _encoded(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""
    shared = whole.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books_ = shared.value
            v = _matrix(b.column("v"), books_.shape[0] * books_.shape[2]).reshape(b.num_rows, books_.shape[0], -1)
            codes, error = np.zeros((b.num_rows, len(books_)), np.int64), np.zeros(b.num_rows, np.int64)
            for p, book in enumerate(books_):
                codes[:, p], e = nearest(v[:, p], book)
                error += e
            digits = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(digits, pa.string()), pa.array(error)],
                                  names=["vec_id", "label", "code", "error"])

    return map_arrow(whole.select("vec_id", "label", "v"), run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             per_owner: int = PER_OWNER) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as text, code, error of every kept vector; the codebooks, parts x entries x width)."""
    plain = private(vectors, {"vec_id": vectors["vec_id"].cast("long"), "label": vectors["label"].cast("string"),
                              "v": vectors["embedding"]})
    whole = landed(_whole(plain, scale).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    books = first_codebooks(whole, entries, parts)
    whole = whole.where(F.size("v") == parts * books.shape[2]) if books.size else whole.where(F.lit(False))
    if books.size:
        books = learned(whole, books, rounds, per_owner)
    return _encoded(whole, books), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode("ascii")).hexdigest()


def coded_vectors(vectors: DataFrame, **parameters: int) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    coded, books = compress(vectors, **parameters)
    coded = landed(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _oracle_sql() -> str:
    """The same in DuckDB: every round is a pair of tables, the assignment and the new entries."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid,
         list_transform(embedding, lambda x : CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT rid, p.pos AS pos, v[p.pos * len(v) // {PARTS} + 1 : (p.pos + 1) * len(v) // {PARTS}] AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS pos) p),
book0 AS MATERIALIZED (SELECT pos, rid - 1 AS entry, x FROM part WHERE rid <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
far{k} AS MATERIALIZED (
  SELECT a.rid, a.pos, b.entry, list_sum(list_transform(list_zip(a.x, b.x), lambda z : (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM part a JOIN book{k} b ON a.pos = b.pos),
near{k} AS MATERIALIZED (SELECT rid, pos, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM far{k} GROUP BY rid, pos)""")
        if k < ROUNDS:
            steps.append(f"""
sum{k} AS (
  SELECT pos, entry, i, sum(c)::BIGINT AS s, count(*) AS n
  FROM (SELECT n.pos, n.entry, unnest(p.x) AS c, unnest(range(len(p.x))) AS i FROM near{k} n JOIN part p ON n.rid = p.rid AND n.pos = p.pos)
  GROUP BY pos, entry, i),
mean{k} AS (SELECT pos, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sum{k} GROUP BY pos, entry),
book{k + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON b.pos = m.pos AND b.entry = m.entry)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.pos) AS code, sum(n.d)::BIGINT AS error
  FROM near{ROUNDS} n JOIN kept k ON n.rid = k.rid GROUP BY k.rid, k.vec_id, k.label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


ORACLE_SQL = _oracle_sql()
