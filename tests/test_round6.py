"""Short intervals, short diffs and fragments without commas: same results by a shorter way."""

import random
import time

from pyspark.sql import functions as F

from codetrail.functions.arrays import BLOCK, running_sum
from codetrail.functions.calls import calls_from_text
from codetrail.functions.joins import _BINS, FAN, LEVELS, interval_bins
from codetrail.operators.diffs import diff_lines


def _seconds(df):
    def once():
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0
    return min(once() for _ in range(3))


def test_short_intervals_are_cut_as_the_general_way_cuts_them(spark):
    rows = [(a, a + n) for a in [*range(0, 130), 4093, 4096, 32767] for n in range(0, 20)]
    df = spark.createDataFrame(rows, "first long, last long")
    got = interval_bins(df, F.col("first"), F.col("last"), "b").groupBy("first", "last").agg(F.sort_array(F.collect_list("b")).alias("b"))
    want = df.select("first", "last", F.col("first").alias("_first"), F.col("last").alias("_last")).select(
        "first", "last", F.sort_array(F.expr(_BINS)).alias("w"))
    seen = got.join(want, ["first", "last"]).filter(F.to_json("b") == F.to_json("w"))
    assert seen.count() == len(rows)
    for r in got.collect():
        covered = [x for b in r["b"] for x in range(b["bin"] * FAN ** b["level"], (b["bin"] + 1) * FAN ** b["level"])]
        assert sorted(covered) == list(range(r["first"], r["last"] + 1)) and all(b["level"] < LEVELS for b in r["b"])


def test_short_intervals_cost_less_than_long_ones(spark):
    base = spark.range(0, 60000, numPartitions=4)

    def bins(n):
        return interval_bins(base, F.col("id") % 5, F.col("id") % 5 + n, "b")
    bins(0).count()
    assert _seconds(bins(0)) < _seconds(bins(FAN - 1)) / 2


def test_running_sum_across_block_sizes(spark):
    for n in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK):
        values = [(i * 7) % 5 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(running_sum(F.col("v")).alias("s")).head()["s"]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_diff_lines_keeps_all_counters_in_one_fold(spark):
    text = "x\n@@ -3,2 +5,2 @@\n a\n\n[-b-]\n{+c+}\nd\n--- a/f\ngone\n@@ -9 +12 @@\ne\n@@ broken\nf"
    df = spark.createDataFrame([(1, 0, "o", "p", text)], "repo int, idx int, old_path string, path string, word_diff string")
    lines = diff_lines(df)
    assert [tuple(r)[4:] for r in lines.collect()] == [
        (2, 1, "a", 3, 5), (3, 1, "", 4, 6), (4, 1, "[-b-]", 5, 7), (5, 1, "{+c+}", 6, 7), (6, 1, "d", 6, 8),
        (10, 2, "e", 9, 12), (12, 2, "f", 10, 13)]
    plan = lines._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 3  # a block, a short array, the blocks' totals


def _plain_walk(text):
    """A plain walk over a text without literals, comments, types or declarations: the calls with their commas."""
    import re
    from codetrail.functions.calls import NOT_CALLS
    tokens = re.findall(r"[^\W\d][\w$]*\s*\(|[^\W\d][\w$]*|\S", text)
    open_, calls = [], []
    for i, t in enumerate(tokens):
        name = t[:-1].rstrip(" ") if t.endswith("(") else ""
        if name and name not in NOT_CALLS:
            calls.append([name, 0, i + 1 < len(tokens) and tokens[i + 1] not in (")", "]", "}")])
            open_.append(calls[-1])
        elif t.endswith("(") or t in ("[", "{"):
            open_.append(None)
        elif t in (")", "]", "}"):
            open_ and open_.pop()
        elif t == "," and open_ and open_[-1]:
            open_[-1][1] += 1
    return [(n, c + 1 if c else int(full)) for n, c, full in calls]


def test_flat_and_nested_fragments_against_a_plain_walk(spark):
    rng = random.Random(3)
    parts = ["foo(", "a1(", "if(", "(", ")", ")", ",", ",", "[", "]", "{", "}", " ", "\t", ".", "b", "12", ";", "f(a, b)", "g()"]
    texts = ["", "f( , )", "f(,", "f(", "f(a", "1abc(x)", "f(a, b).g(c, d, e)", "f(g(a, b), c)", "f(a[1, 2], b)", "if (a, b) f(c, d)"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [t for t in texts if not _declares(t)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", calls_from_text(F.col("t")).alias("c")).collect():
        assert [tuple(c) for c in r["c"]] == _plain_walk(texts[r["i"]]), texts[r["i"]]


def _declares(text):
    import re
    return re.search(r"[\w.\]]\s+[^\W\d]\w*\s*\(", text) and not re.search(r"^if \(a", text)
