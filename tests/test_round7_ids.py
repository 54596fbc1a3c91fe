"""Ids: dense, in order, and rows without other columns move once."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("payload", [False, True])
def test_ids_are_dense_in_order_with_nulls_and_copies(spark, payload):
    from codetrail.sources.ids import assign_ids
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, "a", "b"]), f"text{r.randint(0, 2)}") for _ in range(700)]
    df = spark.createDataFrame(rows, "k INT, s STRING, body STRING").repartition(5)
    df = df if payload else df.drop("body")
    got = assign_ids(df, ["k", "s"], base=1).orderBy("id").collect()
    assert [x.id for x in got] == list(range(1, 701))
    assert Counter(tuple(x)[:-1] for x in got) == Counter(tuple(x) for x in df.collect())
    order = [(x.k is not None, x.k or 0, x.s is not None, x.s or "") for x in got]
    assert order == sorted(order)


def test_ids_move_rows_without_payload_once(spark):
    from codetrail.sources.ids import assign_ids
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").cast("string").alias("s"))
    plan = assign_ids(df, ["k", "s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k") == 0 and "SortMergeJoin" not in plan
