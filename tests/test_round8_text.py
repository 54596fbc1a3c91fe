"""Diff lines by stretches of hunks, a walk over what can own a comma, and pairs that are made once."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codetrail.functions import calls as C
from codetrail.operators import diffs as D

LINES = ["@@ -1,3 +4 @@", "@@ -7 +2,9 @@ class X", "@@ bad", "@@ -99999999999 +4 @@", "@@ -3 +99999999999 @@", "diff --git a b", "--- a", "+++ b", "",
         " ", "{+x+}", "[-y-]", "[-a-]{+b+}", "{+a-]", "{++}", "[--]", "  code(a);", "[-p-] q [-r-]", "x\r", "{+}", "[-]"]


def _numbered(text):
    """D1 said in a loop."""
    out, hunk, at = [], 0, None
    for pos, line in enumerate(x.strip() for x in text.split("\n")):
        if m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
            hunk, at = hunk + 1, [n if (n := int(m[i])) < 2**31 else None for i in (1, 2)]
        elif line.startswith(("diff --git", "---", "+++")):
            at = None
        elif not line.startswith("@@") and at and at[0] is not None:
            out.append((pos, hunk, line, *at))
            added, removed = line.startswith("{+") and line.endswith("+}"), line.startswith("[-") and line.endswith("-]")
            at = [n if n is None or same else n + 1 for n, same in zip(at, (added, removed and not added), strict=True)]
    return out


def test_lines_are_numbered_as_in_a_loop(spark):
    r = random.Random(5)
    texts = ["\n".join(r.choice(LINES) for _ in range(r.choice([0, 1, 3, 9, 20, 150, 400]))) for _ in range(300)]
    got = {}
    for x in D.diff_lines(spark.createDataFrame([(1, i, "o", f"p{i}", t) for i, t in enumerate(texts)] + [(1, -1, "o", "p", None)],
                                                "repo long, idx long, old_path string, path string, word_diff string")).collect():
        got.setdefault(x.idx, []).append((x.pos, x.hunk, x.line, x.before, x.after))
    assert got == {i: rows for i, t in enumerate(texts) if (rows := _numbered(t))}


def test_a_header_is_read_once(spark):
    plan = D.diff_lines(spark.createDataFrame([(1, 1, "o", "p", "x")], "repo long, idx long, old_path string, path string, word_diff string"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_only_calls_brackets_and_commas_are_walked(spark, monkeypatch):
    walked = C.scan
    monkeypatch.setattr(C, "scan", lambda kinds, *rest: F.when(F.array_contains(kinds, 0), F.raise_error(F.lit("a name")).cast("array<int>"))
                        .otherwise(walked(kinds, *rest)))
    x = spark.createDataFrame([("x.y . f(a + b, c, g(d, e))",)], "c string").select(C.calls_from_text(F.col("c")).alias("x")).first().x
    assert [(y.name, y.n_args) for y in x] == [("f", 3), ("g", 2)]


@pytest.mark.parametrize("code, want", [("f(a, b)", [("f", 2)]), ("f(a, g(b, c), d)", [("f", 3), ("g", 2)]), ("if (a, b", []), ("f(,", [("f", 2)])])
def test_calls_with_commas(spark, code, want):
    got = spark.createDataFrame([(code,)], "c string").select(C.calls_from_text(F.col("c")).alias("x")).first().x
    assert [(y.name, y.n_args) for y in got] == want


def test_d7_makes_its_pairs_once(spark):
    word = "@@ -1 +1 @@\n[-a-]{+b+}\n[-c-]{+d+}"
    diffs = spark.createDataFrame([(1, 1, "o", "p", word), (1, 1, None, "q", word), (2, 1, "o", "p", word)],
                                  "repo long, idx long, old_path string, path string, word_diff string")
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda t: made.add(1) or t)
    pairs = D.paired_replacements(D.diff_lines(diffs.withColumn("word_diff", counted("word_diff"))))
    edited = spark.createDataFrame([(1, 1, "p"), (1, 1, "q")], "repo long, idx long, path string")
    rows = D.size_guard(pairs, edited, max_files=1, max_pairs=1, warn_pairs=2).collect()
    # a file without an old path, and a commit without edited files, have no size
    assert [(r.repo, r.path, r.n_pairs, r.n_edited, r.many_files, r.many_pairs, r.many_changes) for r in rows] == [(1, "p", 2, 2, True, True, False)] * 2
    assert made.value == 3
