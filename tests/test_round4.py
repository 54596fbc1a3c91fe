"""Joins by measured size, intervals met on as many widths as they need, file versions grouped once, whole histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.functions.lineage import materialize


def test_tables_that_shrink_on_disk_are_not_broadcast(spark):
    # 40 MB of rows, a few hundred KB of Parquet: the file size alone would make it the broadcast side
    t = materialize(spark.range(100_000).select((F.col("id") % 1000).alias("k"), F.lit("x" * 400).alias("text")))
    q = materialize(spark.range(100_000).select((F.col("id") % 1000).alias("k")))
    assert "Broadcast" not in q.join(t, "k")._jdf.queryExecution().sparkPlan().toString()


def _tables(spark, folder):
    """One customer's nine orders of three lines each, and another's one, with their parts."""
    import datetime as dt
    day = dt.datetime(1996, 1, 1)
    orders = [(o, 1 if o < 9 else 2, "F", 1.0, day + dt.timedelta(days=o), "1-URGENT") for o in range(10)]
    lines = [(o, (o + 7 * n) % 12, (o * 5 + n) % 12, n, float(n), 1.0, 0.0, 0.0, "NAR"[(o + n) % 3], "O", day)
             for o in range(10) for n in range(1, 4)]
    parts = [(p, f"{'hot cold'.split()[p % 2]} bolt", f"Brand#{p % 3}", ("LARGE", "PROMO")[p % 2], p, 1.0) for p in range(12)]
    spark.createDataFrame(orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                          "o_orderdate TIMESTAMP, o_orderpriority STRING").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                          "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                          "l_shipdate TIMESTAMP").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
                          "p_retailprice DOUBLE").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_whole_histories_are_asked_for(spark, tmp_path):
    from codetrail.plans.q_history import q_h6, q_h7
    sf = _tables(spark, tmp_path)
    asked = {(r["repo"], r["idx"]) for r in q_h7(spark, sf).collect()}
    assert asked == {(1, i) for i in range(1, 10)} | {(2, 1)}
    # files that stay are listed at every commit, not only at the last one of a year
    assert len({r["idx"] for r in q_h6(spark, sf).collect() if r["repo"] == 1}) > 1


def test_texts_are_made_where_their_items_are(spark, tmp_path, monkeypatch):
    from codetrail.sources import carriers
    sf = _tables(spark, tmp_path)
    landed = carriers.Landed(spark, sf)
    _ = landed.file_changes, getattr(landed, "file_items", None), landed.live_items
    plans = []
    monkeypatch.setattr(carriers, "materialize", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or df)
    assert landed.snapshots.count() and landed.parsed_xml.count() and landed.diffs.count()
    assert len(plans) == 3 and not [p for p in plans if "Exchange" in p]


def test_points_are_looked_up_on_as_many_widths_as_histories_need(spark):
    import random
    from codetrail.functions.joins import binned_interval_join
    rnd = random.Random(5)
    for longest, widths in ((50, 1), (5000, 3)):
        spans = [(n, rnd.randrange(3), a, rnd.choice([None, a + rnd.randrange(longest)])) for n, a in
                 enumerate(rnd.randrange(longest) for _ in range(80))] + [(80, 0, longest - 1, longest)]
        points = [(rnd.randrange(3), rnd.randrange(3 * longest)) for _ in range(150)]
        p = spark.createDataFrame(points, "pk INT, at INT").distinct()
        iv = spark.createDataFrame(spans, "n INT, ik INT, valid_from INT, valid_to INT")
        got = sorted((r["pk"], r["at"], r["n"]) for r in binned_interval_join(p, iv, ["pk"], ["ik"], "at").collect())
        assert got == sorted((k, at, n) for k, at in set(points) for n, ik, a, b in spans
                             if k == ik and a <= at and (b is None or b > at))
        from codetrail.functions.joins import levels_up_to
        top = max(max(a, b or 0) for _, _, a, b in spans)
        assert len(spark.range(1).select(levels_up_to(F.lit(top))).first()[0]) == widths


def test_parsed_calls_are_worked_out_once(spark, tmp_path):
    from codetrail.operators.facts import add_default_constructors
    from codetrail.sources.writers import write_method_invocations
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed(name):
        seen.add(1)
        return name

    calls = spark.createDataFrame([("p", "c", f"f{n}", "k", f"m{n}", n, [3, n]) for n in range(20)], (
        "project_name STRING, commit_sha STRING, path STRING, qualified_class_name STRING, name STRING, n_args INT, lines ARRAY<INT>"))
    out = write_method_invocations(calls.withColumn("method_name", parsed("name")).drop("name"), str(tmp_path / "out"))
    assert spark.read.parquet(out["main"]).count() == 20 and spark.read.parquet(out["lines"]).count() == 40
    assert seen.value == 20

    seen.value = 0
    decls = spark.createDataFrame([("r", 1, f"f{n}", f"m{n}", 0, False, False, 1, 2) for n in range(20)], (
        "repo STRING, idx INT, path STRING, raw STRING, n_args INT, varargs BOOLEAN, is_constructor BOOLEAN, line_start INT, line_end INT"))
    decls = decls.withColumn("name", parsed("raw")).drop("raw")
    types = spark.createDataFrame([("r", 1, "f1", "m1", 1, 9), ("r", 1, "f2", "T", 1, 9)],
                                  "repo STRING, idx INT, path STRING, name STRING, line_start INT, line_end INT")
    assert add_default_constructors(decls, types).count() == 21
    assert seen.value == 20
