"""Helpers shared by the training-data operators.

Operators read only the columns that they need, under private names, so extra columns of an input never clash.
Intermediate tables are Parquet files in the folder that the session names in ``spark.checkpoint.dir``: they
survive the loss of executors and are read back with column pruning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.session import ensure_checkpoint_dir

#: Bytes of text that one Python task works on at a time; a longer text stands alone.
SLICE_BYTES = 1 << 20
#: ... and documents.
SLICE_ROWS = 2048


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def in_training(doc_id: str | Column = "doc_id") -> Column:
    """False on the held-out third: crc32 of the id as text, modulo 3, is 1.  A null id counts as the text ''."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % 3 != 1


#: Rows of the Arrow batches between the JVM and Python.  Texts are much longer than the rows that Spark's default of
#: 10,000 is meant for.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows, unless the session asks for fewer: the setting is one of
    the session's, read when the plan runs."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_CONF)) > BATCH_ROWS:
        conf.set(_BATCH_CONF, BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES,
           rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``limit`` bytes of ``column`` (at least one row each)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def by_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text",
             limit: int = SLICE_BYTES, rows: int = SLICE_ROWS,
             ) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``fn`` to slices of bounded size."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit, rows):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
    return run


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps around on purpose."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def private(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Only the named columns, renamed: {new name: old name or expression}."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with only doc_id, text and lang under their own names, the other columns under names that clash with
    nothing; and a function that gives a result of that table its columns back."""
    names = docs.columns
    plain = [n if n in ("doc_id", "text", "lang") else f"c{i}" for i, n in enumerate(names)]
    return docs.toDF(*plain), lambda df: df.select(*plain).toDF(*names)
