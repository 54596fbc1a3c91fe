import hashlib
import random

import numpy as np
import pytest

from codetrail.llm import suffix_dedup as m
from codetrail.llm import suffix_sort as s

from .helpers import SF, docs, odd_docs

LAST = 2**63 - 1


def _brute(rows):
    """The definition: windows that start in a document with a smaller id."""
    texts = [((LAST if i is None else i), i, (t or "").encode()) for i, t in rows]
    least = {}
    for order, _, b in texts:
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            least[w] = min(least.get(w, LAST), order)
    out = []
    for order, i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < order:
                gone[p] += 1
                gone[p + 50] -= 1
        mask = np.cumsum(gone)[:len(b)] > 0
        spans = int((mask & ~np.append(False, mask[:-1])[:len(b)]).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", [2, 4, 256])
def test_two_stage_order_is_the_suffix_order(alphabet):
    rng = np.random.default_rng(alphabet)
    text = rng.integers(0, alphabet + 1, 700).astype(np.int16)
    text[100:180] = 1
    text[300:360] = text[500:560]
    key = s.keys(text)
    order = s.suffix_order(text, key)
    assert sorted(order.tolist()) == list(range(len(text)))

    def head(p):
        return tuple(np.append(text[p:p + s.DEPTH], np.zeros(s.DEPTH, np.int16))[:s.DEPTH].tolist())

    heads = [head(p) for p in order]
    assert heads == sorted(heads)
    prefix = s.common_prefixes(order, key, 50)
    for k in range(1, len(order)):
        a, b = heads[k - 1], heads[k]
        same = next((d for d in range(50) if a[d] != b[d]), 50)
        assert prefix[k] == same


def test_types_follow_the_definition():
    text = np.array([3, 3, 1, 2, 2, 5, 0, 0, 4, 4], np.int16)
    suffixes = [tuple(text[i:].tolist()) for i in range(len(text) + 1)]
    assert s.is_type_a(text).tolist() == [suffixes[i] > suffixes[i + 1] for i in range(len(text))]


def _rows(rng, n):
    lines = ["".join(rng.choice("ab c") for _ in range(rng.randint(20, 130))) for _ in range(15)]
    rows = []
    for i in rng.sample(range(1000), n):
        parts = [rng.choice(lines) if rng.random() < 0.6 else "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 90)))
                 for _ in range(rng.randint(0, 7))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 23), (900, 700)])
def test_against_the_definition(spark, sizes):
    rows = _rows(random.Random(sizes[0]), 60)
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [(3000, "a" * 300), (3001, "a" * 60), (3002, "b" + "a" * 49), (3003, "ab" * 80)]
    got = m.repeated_strings(docs(spark, rows), *sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)


def test_given_documents_match_the_definition(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r) for r in m.repeated_strings(df).collect()), key=str) == _brute(rows)


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = sorted((tuple(r) for r in m.repeated_strings(df).collect()), key=str)
    assert got == _brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert m.repeated_strings(docs(spark, [])).collect() == []


def _short_line_rows(rng):
    """A line of 40 bytes in varied surroundings in a third of the rows; some surroundings come again."""
    rows = [(i, "".join(rng.choice("uvwxyz é") for _ in range(150))) for i in rng.sample(range(5000), 900)]
    for k in range(0, 900, 3):
        i, t = rows[k]
        rows[k] = (i, t[:60] + "Permission is granted free of any charge" + t[60:])
        if k % 30 == 0:
            rows[k + 1] = (rows[k + 1][0], rows[k][1][30:130] + rows[k + 1][1])
    return rows + [(9000, None), (None, rows[0][1]), (rows[3][0], rows[0][1]), (9001, "x" * 500), (9002, "x" * 500)]


@pytest.mark.parametrize("sizes, most", [((1 << 22, 1 << 23), 20_000), ((9000, 1 << 23), 20_000), ((9000, 15_000), 5_000)])
def test_a_short_line_in_varied_surroundings_is_not_sorted_at_once(spark, monkeypatch, sizes, most):
    real = m.smallest_documents

    def bounded(data, length, least, sort_us):
        assert int(length[sort_us].sum()) < most
        return real(data, length, least, sort_us)

    monkeypatch.setattr(m, "smallest_documents", bounded)
    monkeypatch.setattr(m, "MOST_SEGMENTS", 20, raising=False)
    rows = _short_line_rows(random.Random(8))
    got = m.repeated_strings(docs(spark, rows), *sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)


def test_all_windows_one_by_one_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(m, "MOST_SEGMENTS", 0, raising=False)
    rows = _rows(random.Random(4), 60) + [(3000, "a" * 300), (3001, "a" * 60), (3002, "b" + "a" * 49), (3003, "ab" * 80)]
    got = m.repeated_strings(docs(spark, rows), 900, 700)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows)
