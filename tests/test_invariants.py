"""Invariants: intervals never overlap, totals equal a replay, results do not depend on partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from codetrail.functions.windows import next_in_order, ordered_index, running_total
from codetrail.plans.q_history import removed_local_calls
from codetrail.sources.carriers import Landed

SF = "/root/testdata/sf0.001"


def test_intervals_do_not_overlap(spark):
    iv = Landed(spark, SF).intervals
    w = Window.partitionBy("repo", "path").orderBy("valid_from")
    x = iv.withColumn("prev_from", F.lag("valid_from").over(w)).withColumn("prev_to", F.lag("valid_to").over(w))
    bad = x.filter(F.col("prev_from").isNotNull() & (F.col("prev_to").isNull() | (F.col("prev_to") > F.col("valid_from"))))
    assert bad.count() == 0


def test_bucketed_windows_equal_plain_windows(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 3001).alias("o"), F.lit(1).alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    plain = df.withColumn("nxt", F.lead("o").over(w)).withColumn("run", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ours = running_total(next_in_order(df, ["k"], "o", "nxt", width=16), ["k"], "o", "v", "run", width=16)
    cols = ["k", "o", "nxt", "run"]
    assert sorted(plain.select(cols).collect()) == sorted(ours.select(cols).collect())


def test_ordered_index_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") % 4).alias("k"), F.col("id").alias("o"))
    got = ordered_index(df, ["k"], ["o"], out="i", num_partitions=7)
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert sorted(got.collect()) == sorted(want.select("k", "o", "i").collect())


def test_flagship_independent_of_partitions(spark):
    a = sorted(removed_local_calls(spark, SF).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(removed_local_calls(spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) > 0


def _alive(at):
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def test_state_checks_match_plain_joins(spark):
    from codetrail.operators.replace import gone_after, was_local_before
    L = Landed(spark, SF)
    d = L.decl_versions.select(F.col("repo").alias("r"), F.col("name").alias("nm"), F.col("n_args").alias("na"), "varargs",
                               "valid_from", "valid_to")
    fits = ((F.col("repo") == F.col("r")) & (F.col("name") == F.col("nm"))
            & F.when(F.col("varargs"), F.col("na") <= F.col("n_args")).otherwise(F.col("na") == F.col("n_args")))
    want = L.calls.join(d, fits & _alive(F.col("idx") - 1), "left_semi").join(d, fits & _alive(F.col("idx")), "left_anti")
    got = gone_after(was_local_before(L.calls, L.decl_versions), L.decl_versions)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() > 0


def test_imported_targets_match_plain_contains(spark):
    from codetrail.operators.deps import base_packages, imported_targets
    L = Landed(spark, SF)
    pk = [r["package"] for r in base_packages(L.library_packages).collect()] + ["zz", "lib.small"]
    got = {(r["repo"], r["idx"], r["path"]): r["packages"]
           for r in imported_targets(L.snapshots, spark.createDataFrame([(p,) for p in pk], "package string")).collect()}
    want = {}
    for r in L.snapshots.collect():
        names = set()
        for line in r["content"].split("\n"):
            if "class " in line or "interface " in line:
                break
            hits = [p for p in pk if p in line] if "import" in line else []
            if hits:
                names.add(min(hits, key=lambda p: (-len(p), p)))
        if names:
            want[(r["repo"], r["idx"], r["path"])] = sorted(names)
    assert got == want and got


def test_binned_range_join_matches_plain(spark):
    from codetrail.operators.history import files_at_commit
    L = Landed(spark, SF)
    got = sorted(files_at_commit(L.intervals, L.commits).collect())
    iv, c = L.intervals.alias("v"), L.commits.alias("c")
    want = sorted(c.join(iv, (F.col("c.repo") == F.col("v.repo")) & (F.col("v.valid_from") <= F.col("c.idx"))
                         & (F.col("v.valid_to").isNull() | (F.col("v.valid_to") > F.col("c.idx"))))
                  .select(F.col("c.repo").alias("repo"), F.col("c.idx").alias("idx"), F.col("v.path").alias("path")).collect())
    assert got == want and len(got) > 0


def test_interval_bins_cover_exactly_and_stay_few(spark):
    import random

    from codetrail.functions.joins import FAN, interval_bins
    rng = random.Random(7)
    spans = [(0, 0), (0, 15_625), (5, FAN**7 - 1)] + [tuple(sorted(rng.sample(range(20_000), 2))) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "id int, a long, b long")
    rows = interval_bins(df, F.col("a"), F.col("b"), "x").select("id", "x.level", "x.bin").collect()
    for i, (a, b) in enumerate(spans):
        parts = sorted((r["bin"] * FAN ** r["level"], (r["bin"] + 1) * FAN ** r["level"]) for r in rows if r["id"] == i)
        assert parts[0][0] == a and parts[-1][1] == b + 1
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 2 * FAN * 8


def test_hot_name_in_a_long_history(spark):
    """One repository of 100,000 commits, one method name with 2,000 versions and 5,000 calls."""
    from codetrail.operators.replace import was_local_before
    decls = spark.range(2000).select(
        F.lit(1).alias("repo"), F.lit("hot").alias("name"), F.lit(1).alias("n_args"), F.lit(False).alias("varargs"),
        (F.col("id") * 50).alias("valid_from"), F.when(F.col("id") % 100 != 99, F.col("id") * 50 + 25).alias("valid_to"))
    decls = decls.filter(F.col("valid_from") < 4950).unionByName(
        spark.createDataFrame([(1, "hot", 1, False, 90_000, None)], decls.schema))
    calls = spark.range(5000).select(F.lit(1).alias("repo"), (F.col("id") * 20).alias("idx"), F.lit("hot").alias("name"),
                                     F.lit(1).alias("n_args"))
    got = {r["idx"] for r in was_local_before(calls, decls).collect()}
    assert got == {i for i in range(0, 100_000, 20) if (0 <= i - 1 < 4950 and (i - 1) % 50 < 25) or i - 1 >= 90_000}


def test_old_declaration_matches_plain_join(spark):
    from codetrail.operators.replace import old_declaration
    L = Landed(spark, SF)
    groups = L.calls.select("repo", "idx", F.col("name").alias("old_name"), F.col("n_args").alias("old_n_args"),
                            F.lit("x").alias("new_name"), F.lit(0).alias("new_n_args"), F.lit(1).alias("gid"))
    d = L.decl_versions.select(*[F.col(c).alias("d_" + c) for c in L.decl_versions.columns])
    cond = ((F.col("repo") == F.col("d_repo")) & (F.col("old_name") == F.col("d_name"))
            & F.when(F.col("d_varargs"), F.col("d_n_args") <= F.col("old_n_args")).otherwise(F.col("d_n_args") == F.col("old_n_args"))
            & (F.col("d_valid_from") <= F.col("idx") - 1) & (F.col("d_valid_to").isNull() | (F.col("d_valid_to") > F.col("idx") - 1)))
    best = groups.join(d, cond).groupBy(*groups.columns).agg(F.min(F.struct("d_path", "d_line_start")).alias("b"))
    want = {tuple(r[c] for c in groups.columns): tuple(r["b"]) for r in best.collect()}
    got = {tuple(r[c] for c in groups.columns): (r["old_decl"]["path"], r["old_decl"]["line_start"])
           for r in old_declaration(groups, L.decl_versions).collect() if r["old_decl"] is not None}
    assert got == want and got
