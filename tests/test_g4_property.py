"""G4 on random call sequences: the Spark expression against a direct pointer walk."""

import random

from pyspark.sql import functions as F

from codetrail.functions.calls import calls_from_text
from codetrail.operators import replace as G

NAMES = ["f", "fo", "foo", "bar", "log", "logger", "get", "x"]


def _code(rng):
    parts = []
    for _ in range(rng.randint(1, 5)):
        lead = rng.choice(["", "a.", "b.", ".", " ", "new "])
        args = rng.choice(["", "1", "a, b"])
        parts.append(f"{lead}{rng.choice(NAMES)}({args})")
    return rng.choice(["", "y = "]) + ".".join(parts) if rng.random() < 0.5 else "".join(parts)


def _index(text, needle, start):
    return text.find(needle, max(start, 0))


def _walk(removed, added, rc, ac):
    """Direct walk over both call lists with character cursors (expected semantics of G4)."""
    if not rc or not ac or rc == ac:
        return None
    common = set(rc) & set(ac)
    if all(c in common for c in rc) or all(c in common for c in ac):
        return None
    i = j = ci = cj = 0
    while i < len(rc) and j < len(ac):
        old, new = rc[i], ac[j]
        if old == new or old in common or new in common:
            if old == new or old in common:
                ci = _index(removed, old[0], ci) + len(old[0])
                i += 1
            if old == new or (new in common and old not in common):
                cj = _index(added, new[0], cj) + len(new[0])
                j += 1
            continue
        oi = next((p for p in (_index(removed, old[0] + s, ci) for s in ("(", "<", "")) if p != -1), -1)
        ni = next((p for p in (_index(added, new[0] + s, cj) for s in ("(", "<", "")) if p != -1), -1)
        if oi == -1 or ni == -1:
            return None
        left_r, left_a = removed[:oi], added[:ni]
        if left_r == left_a and left_r.strip() not in ("", "."):
            ci = _index(removed, old[0], ci) + len(old[0])
            cj = _index(added, new[0], cj) + len(new[0])
            i += 1
            j += 1
            continue
        return old[0], new[0]
    return None


def test_g4_matches_walk(spark):
    rng = random.Random(7)
    rows = [(k, _code(rng), _code(rng)) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, removed string, added string")
    p = df.withColumn("removed_calls", calls_from_text(F.col("removed"))).withColumn("added_calls", calls_from_text(F.col("added")))
    c = G.drop_pure_add_remove(G.common_calls(G.comparable_pairs(p)))
    got = {r.k: (r.old_name, r.new_name) for r in G.first_changed_call(c).collect()}
    calls = {r.k: [[(c.name, c.n_args) for c in x] for x in (r.removed_calls, r.added_calls)] for r in p.collect()}
    want = {k: w for k, r, a in rows if (w := _walk(r, a, *calls[k])) is not None}
    assert got == want
    assert len(want) > 50
