"""Fragments without commas aren't walked; those with commas agree with a plain walk."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codetrail.functions import calls as C


def _read(spark, fragments):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fragments)], "i int, f string")
    got = {r.i: r.c for r in df.select("i", C.calls_from_text(F.col("f")).alias("c")).collect()}
    return [None if got[i] is None else [(c.name, c.n_args) for c in got[i]] for i in range(len(fragments))]


def test_only_fragments_with_commas_are_walked(spark, monkeypatch):
    monkeypatch.setattr(C, "scan", lambda *a: F.raise_error(F.lit("walked")).cast("array<int>"))
    assert _read(spark, ["x.size().f(a)", "f()", "f(g(h()))", "no call", "", None, "f("]) == [
        [("size", 0), ("f", 1)], [("f", 0)], [("f", 1), ("g", 1), ("h", 0)], [], [], None, [("f", 0)]]
    with pytest.raises(Exception, match="walked"):
        _read(spark, ["f(a, b)"])


def _plain_walk(text):
    """The calls of a text of names, brackets and commas: each with its direct commas plus one, if anything stands in it."""
    calls, held = [], []
    for t in re.findall(r"[a-z]+\s*\(|[a-z]+|[^\s]", text):
        if t in ")]}":
            held = held[:-1]
            continue
        owner = held[-1] if held else None
        if owner is not None:
            calls[owner][1 if t == "," else 2] += 1
        if t.endswith("(") and t[:-1].rstrip(" ") and t[:-1].rstrip(" ") != "if":
            calls.append([t[:-1].rstrip(" "), 0, 0])
            held = [*held, len(calls) - 1]
        elif t in "[{" or t.endswith("("):
            held = [*held, None]
    return [(n, c + 1 if c else int(o > 0)) for n, c, o in calls]


def test_calls_agree_with_a_plain_walk(spark):
    rng = random.Random(5)
    pieces = ["f(", "g (", "if(", "(", ")", "]", "}", "[", "{", ",", ";", "+", ".", "a;", "b,"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, n))) for n in (4, 12, 40, 300) for _ in range(60)]
    assert _read(spark, texts) == [_plain_walk(t) for t in texts]
