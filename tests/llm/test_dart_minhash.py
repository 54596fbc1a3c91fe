import random

import numpy as np
import pytest

from codetrail.llm import dart_minhash as m
from codetrail.llm.components import components
from codetrail.llm.words import shingles_of, words_of

from .helpers import SF, docs, odd_docs


def _set(text):
    e, f = shingles_of(words_of([text or ""]))
    return set(e[f[0]:f[1]].tolist())


def _classes(rows, similar=0.8):
    """Brute force: connected components of all pairs; texts without shingles by their lower-case bytes."""
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b) / len(a | b) >= similar if a and b else not a and not b and (
                (rows[i][1] or "").lower() == (rows[j][1] or "").lower())
            if same and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(g, key=str) for g in out.values())


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["class_id"], []).append(r["doc_id"])
    return sorted(sorted(g, key=str) for g in out.values())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600).astype(np.uint64)
    x, y = np.sort(pool[:500]), np.sort(pool[100:])
    w = dict(zip(x.tolist(), rng.random(500) * 5))
    v = np.array([w.get(e, 0) * 0.5 + rng.random() for e in y.tolist()])
    both = dict(zip(y.tolist(), v))
    true = (sum(min(w.get(e, 0), both.get(e, 0)) for e in set(w) | set(both))
            / sum(max(w.get(e, 0), both.get(e, 0)) for e in set(w) | set(both)))
    s = m.signatures(np.concatenate([x, y]), np.concatenate([[w[e] for e in x.tolist()], v]), np.array([0, 500, 1000]), 4000)
    assert abs((s[0] == s[1]).mean() - true) < 0.035
    s = m.signatures(np.concatenate([x, y]), np.ones(1000), np.array([0, 500, 1000]), 4000)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.035


def test_a_longer_horizon_changes_no_kept_dart():
    x = np.sort(np.random.default_rng(2).integers(0, 2**63, 40).astype(np.uint64))
    best, out = np.full(64, np.inf), np.zeros(64, np.uint64)
    m._throw(x, np.ones(40), np.zeros(40, np.int64), np.array([1.0]), 64, best, out)
    assert (m.signatures(x, np.ones(40), np.array([0, 40]), 64)[0] == out).all()


def _families(rng, n, members, edits):
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 150))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_classes_match_all_pairs(spark, block):
    rows = _families(random.Random(block), 6, 25, 6)
    got = m.near_duplicates(docs(spark, rows), block=block)
    assert _got(got) == _classes(rows)
    assert all((r["doc_id"] == r["class_id"]) == r["kept"] for r in got.collect())


def test_given_documents_match_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert _got(m.near_duplicates(df)) == _classes([(r["doc_id"], r["text"]) for r in df.collect()])


def test_one_outlier_copies_its_bucket_once(spark):
    rows = [(7, n, 0 if n else 5, 0, 1000, 999) for n in range(1000)]
    dealt = m.dealt_blocks(spark.createDataFrame(rows, "bucket long, node long, comp long, major long, m long, m_major long"), 10)
    got = [(r.node, r.comp, r.i, r.j, r.side) for r in dealt.collect()]
    assert len(got) == 999 + 1 + 100  # the outlier meets its own block and each block of the others
    groups = {}
    for node, comp, i, j, side in got:
        groups.setdefault((i, j), []).append((node, comp, side))
    met = {n for g in groups.values() if any(c == 5 for _, c, _ in g) for n, c, _ in g if c == 0}
    assert met == set(range(1, 1000))


def test_all_pairs_of_different_classes_meet_once(spark):
    rng = random.Random(5)
    comps = {n: rng.choice([0, 0, 0, 1, 2, 3]) for n in range(120)}
    size = sum(c == 0 for c in comps.values())
    rows = [(7, n, c, 0, len(comps), size) for n, c in comps.items()]
    dealt = m.dealt_blocks(spark.createDataFrame(rows, "bucket long, node long, comp long, major long, m long, m_major long"), 10)
    groups = {}
    for r in dealt.collect():
        groups.setdefault((r.i, r.j), []).append((r.node, r.side))
    pairs = []
    for (i, j), g in groups.items():
        pairs += [tuple(sorted((a, b))) for a, x in g for b, y in g if x <= 0 <= y and comps[a] != comps[b] and (i != j or a < b)]
    assert sorted(pairs) == sorted((a, b) for a in comps for b in comps if a < b and comps[a] != comps[b])


def test_a_template_with_outliers_matches_all_pairs(spark):
    """Texts of one template with a varying middle: near copies, outliers of the bucket and chains of links."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in range(rng.randint(0, 3)):
            text[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(text)))
    assert _got(m.near_duplicates(docs(spark, rows), block=8)) == _classes(rows)


def test_hot_copies_and_their_counts(spark):
    rows = [(i, "the same words over and over again here") for i in range(50)] + [(60, "The same words over and over again here")]
    rows += [(100 + i, f"text number {i} with words of its own {i} {i} {i}") for i in range(20)]
    got = {r["doc_id"]: r for r in m.near_duplicates(docs(spark, rows)).collect()}
    assert len(got) == 71 and got[7]["class_id"] == 0 and got[7]["class_size"] == got[7]["n_copies"] == 51
    assert got[7]["n_spanning_links"] == 0 and got[105]["n_copies"] == got[105]["class_size"] == 1


def test_weighted_sets_count_occurrences(spark):
    line = "one two three four five six seven eight nine ten "
    rows = [(0, line * 10), (1, line * 20), (2, line * 19)]
    assert _got(m.near_duplicates(docs(spark, rows))) == [[0, 1, 2]]
    assert _got(m.near_duplicates(docs(spark, rows), weighted=True)) == [[0], [1, 2]]


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = df.select("doc_id", "text").collect()
    got = m.near_duplicates(df).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r["class_id"]] = size.get(r["class_id"], 0) + 1
    assert all(r["class_size"] == size[r["class_id"]] for r in got)
    same = {(r["doc_id"]): r["class_id"] for r in got}
    assert same[6] == 6 and same[11] == 6 and same[0] == same[1] == 0
    assert m.near_duplicates(docs(spark, [])).collect() == []
    kept = m.keep_one_of_class(spark, df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {0, 4, 5, 6}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(1, 200)]
    edges += [(i, i + 1) for i in range(1000, 1064)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_texts_travel_once_for_both_steps(spark, monkeypatch):
    """Both steps compare documents of the same buckets: their shingle sets are made once."""
    made, plain = [], m.shingle_sets
    monkeypatch.setattr(m, "shingle_sets", lambda *a: made.append(1) or plain(*a))
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1:])) for k in range(4)] + [(9, "another text of other words only")]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(docs(spark, rows)).collect()}
    assert len(made) == 1
    assert got[9] == 9 and sorted(sorted(k for k in got if got[k] == c) for c in set(got.values())) == _classes(rows)
