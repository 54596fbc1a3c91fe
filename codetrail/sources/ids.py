"""Dense row ids without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetrail.functions.lineage import materialize


def assign_ids(df: DataFrame, order_by: Sequence[str], base: int = 0, out: str = "id",
               reuse_col: str | None = None) -> DataFrame:
    """Dense ids in ``order_by`` order starting at ``base`` (0 for calls/declarations,
    1 for packages, types and files), or the stored ids of ``reuse_col`` when given.

    Rows that share a key are put in the order of a hash of the whole row, so the ids don't depend on how the rows arrive.
    Keys and hashes are range-partitioned, sorted, counted and numbered in one move.  The other columns (file text, bodies)
    don't take part in that: they move once, to the place of their key, where equal rows take the ids after each other.  Rows
    without other columns are their own keys, and are numbered where they are sorted.
    """
    if reuse_col is not None:
        return df.withColumn(out, F.col(reuse_col).cast("long"))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if set(df.columns) <= set(order_by):
        order = [F.col(c) for c in order_by]
        placed = _placed(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
        placed = materialize(placed)
        first = _firsts(placed.groupBy("_pid").agg(F.min("_mid").alias("_mid0"), F.count(F.lit(1)).alias("_n")))
        return (placed.join(F.broadcast(first), "_pid")
                .select(*df.columns, (F.col("_mid") - F.col("_mid0") + F.col("_before") + F.lit(base)).cast("long").alias(out)))
    key = [*order_by, "_hash"]
    rows = df.withColumn("_hash", F.xxhash64(*[_hashable(df, c) for c in df.columns]))
    # the counts need no move of their own: equal keys are in one range
    keys = _placed(rows.select(*key).repartitionByRange(n, *key).sortWithinPartitions(*key)).groupBy(*key).agg(
        F.min("_mid").alias("_mid"), F.first("_pid").alias("_pid"), F.count(F.lit(1)).alias("_rows"))
    keys = materialize(keys)
    first = _firsts(keys.groupBy("_pid").agg(F.min("_mid").alias("_mid0"), F.sum("_rows").alias("_n")))
    numbered = keys.join(F.broadcast(first), "_pid").select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], (F.col("_mid") - F.col("_mid0") + F.col("_before")).alias("_first"))
    same = None
    for i, c in enumerate(key):
        test = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        same = test if same is None else same & test
    among = Window.partitionBy(*key).orderBy("_hash")
    return (rows.withColumn("_nth", F.row_number().over(among)).join(numbered, same)
            .select(*df.columns, (F.col("_first") + F.col("_nth") + F.lit(base - 1)).cast("long").alias(out)))


def _placed(ordered: DataFrame) -> DataFrame:
    """Sorted range partitions with their number and each row's place."""
    return ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())


def _firsts(parts: DataFrame) -> DataFrame:
    """A row per range partition: its first place and the number of rows before it."""
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("_pid", "_mid0", F.coalesce(before, F.lit(0)).alias("_before"))


def _hashable(df: DataFrame, name: str) -> Column:
    """A column as something that can be hashed: a map as its entries in order."""
    column, kind = F.col(name), df.schema[name].dataType
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else column
