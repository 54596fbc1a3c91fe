"""Skew-safe ordered computations.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task.
Repository histories are heavy-tailed (one repository, or one file, may own a
third of all commits), so the ordered helpers here split a key into bounded
segments and stitch the segments back together with a small per-segment table:

* ``ordered_index``  - dense 1-based position per key (range-partitioned,
  ``monotonically_increasing_id`` inside each range, per-range offsets);
* ``next_in_order``  - the next larger order value per key (``lead``), computed
  inside fixed-width order buckets plus one lead over bucket heads;
* ``running_total``  - inclusive running sum per key, again bucketed.

Each segment holds at most ``width`` order values, so no task receives an
unbounded group, and the stitching tables have one row per (key, segment).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from codetrail.functions.lineage import materialize

DEFAULT_WIDTH = 4096


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  out: str = "idx", base: int = 1,
                  num_partitions: int | None = None) -> DataFrame:
    """Dense position of each row inside its key, in ``order`` (which must be total).

    Rows are range-partitioned on (keys, order) so a hot key spans many tasks.
    Inside a range partition the rows are sorted, hence consecutive, so the
    position is ``mid - first_mid_of(key, partition) + rows of the key in
    earlier partitions``.  The ordered frame is written to the shared folder,
    so that a lost executor cannot renumber rows.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *_cols(keys), *_cols(order))
               .sortWithinPartitions(*_cols(keys), *_cols(order))
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = materialize(ordered)
    stats = ordered.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
    joined = ordered.join(stats.select(*keys, "_pid", "_m0", "_off"), [*keys, "_pid"]) if keys else \
        ordered.join(F.broadcast(stats.select("_pid", "_m0", "_off")), ["_pid"])
    return (joined.withColumn(out, (F.col("_mid") - F.col("_m0") + F.col("_off") + F.lit(base)).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off"))


def next_in_order(df: DataFrame, keys: Sequence[str], order: str, out: str,
                  width: int = DEFAULT_WIDTH) -> DataFrame:
    """``lead(order)`` per key for integer ``order`` unique within a key, skew-safe.

    Rows that come with their bucket (``_b``, the floor of order / width) and are dealt by it and the keys stay where they are.
    """
    b = df if "_b" in df.columns else df.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    b = b.withColumn(out, F.lead(order).over(inner))
    heads = b.groupBy(*keys, "_b").agg(F.min(order).alias("_head"))
    heads = heads.withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_b")))
    return (b.join(heads.select(*keys, "_b", "_next_head"), [*keys, "_b"], "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_next_head")))
            .drop("_b", "_next_head"))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                  width: int = DEFAULT_WIDTH) -> DataFrame:
    """Inclusive running ``sum(value)`` per key ordered by integer ``order`` (unique per key)."""
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn(out, F.sum(value).over(inner))
    totals = b.groupBy(*keys, "_b").agg(F.sum(value).alias("_bt"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_carry", F.coalesce(F.sum("_bt").over(before), F.lit(0)))
    return (b.join(totals.select(*keys, "_b", "_carry"), [*keys, "_b"], "left")
            .withColumn(out, F.col(out) + F.col("_carry"))
            .drop("_b", "_carry"))
