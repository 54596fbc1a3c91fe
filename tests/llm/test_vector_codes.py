import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from codetrail.llm import vector_codes as m

from .helpers import SF


def brute(rows, entries=256, rounds=4, parts=4):
    """Plain Python integers, one vector after the other."""
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [max(-m.BOUND, min(m.BOUND, math.floor(1024 * x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    kept = [r for r in kept if len(r[1]) == width * parts] if width and len(kept[0][1]) % parts == 0 else []
    if not kept:
        return []
    cut = [[r[1][p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            row = []
            for p in range(parts):
                far = [sum((x - y) ** 2 for x, y in zip(c[p], e)) for e in books[p]]
                row.append((far.index(min(far)), min(far)))
            out.append(row)
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            members = defaultdict(list)
            for c, row in zip(cut, codes):
                members[row[p][0]].append(c[p])
            for e, group in members.items():
                books[p][e] = [sum(col) // len(group) for col in zip(*group)]
    codes = assign()
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    by_label = defaultdict(int)
    for r, row in zip(kept, codes):
        by_label[r[2]] += sum(d for _, d in row)
    return sorted(((r[0], "".join(f"{e:02x}" for e, _ in row), sum(d for _, d in row), by_label[r[2]], sha)
                   for r, row in zip(kept, codes)), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, pos int, entry int, salt int, part string, error long, rid long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "p", 4, 5) for r in rows], SCHEMA)


def got(df, **k):
    return sorted((tuple(r) for r in m.coded_vectors(df, **k).collect()), key=str)


def test_equals_brute_force_and_moves(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=8) + 3 * (i % 3)).tolist(), int(i % 4) if i % 5 else None) for i in rng.permutation(160)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(120)]  # a vector that many rows hold
    df = table(spark, rows)
    want = brute(rows, entries=12)
    assert got(df, entries=12) == want
    assert got(df, entries=12, per_owner=3) == want
    assert len({r[1] for r in want}) > 10


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert got(df) == sorted(con.execute(m.ORACLE_SQL).fetchall(), key=str)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.5, -2.25, 0.0, 1e30], None), (3, [1.5, -2.25, 0.0, 1e30], None), (None, [0.1, 0.2, 0.3, -0.0004], 1),
            (1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (4, [nan, 1.0, 1.0, 1.0], 2), (5, [inf, 1.0, 1.0, 1.0], 2),
            (6, [-inf, 1.0, 1.0, 1.0], None), (7, [1.0] * 8, 1), (8, [], 1), (9, [0.5, 0.5, 0.5, 0.5], 1), (None, [0.1, 0.2, 0.3, -0.0004], 1)]
    df = table(spark, rows)
    assert got(df) == brute(rows)
    assert [r[0] for r in got(df)] == [3, 3, 9, None, None]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 4, 1)], [(1, [], 1)]])
def test_nothing_to_code(spark, rows):
    assert got(table(spark, rows)) == []


def test_nearest_is_exact_for_large_values():
    rng = np.random.default_rng(2)
    big = rng.integers(-m.BOUND, m.BOUND, (50, 4))
    book = np.concatenate([big[:5], big[:5], big[5:6] + 1])
    entry, error = m.nearest(big, book)
    far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in book] for a in big]
    assert entry.tolist() == [f.index(min(f)) for f in far] and error.tolist() == [min(f) for f in far]


def test_only_changed_parts_move(spark, monkeypatch):
    """Rows written as arrivals are those whose entry changed, not all."""
    written = {}
    plain = m._Bucketed.write

    def write(self, df, name):
        out = plain(self, df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(m._Bucketed, "write", write)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    m.compress(df, entries=64)
    n = df.count() * 4
    assert written["residents"] == [n] and written["assigned"] == [n] * 3
    assert all(x < n / 2 for x in written["arrived"]) and written["arrived"][2] < written["arrived"][0]
