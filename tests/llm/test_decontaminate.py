import itertools
import random

from codetrail.llm import decontaminate as m

from .helpers import SF, docs, odd_docs


def _items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, row int, items string")


def _words(text):
    return "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split()


def _brute(text, item):
    """Some alignment has a stretch of OVERLAP words (or the whole item) of which 80 % agree."""
    a, b = _words(text), _words(item)
    need = min(m.OVERLAP, len(b))
    if len(b) < m.SHORTEST:
        return False
    for d in range(-len(b) + 1, len(a)):
        low, high = max(0, d), min(len(a), d + len(b))
        same = [a[p] == b[p - d] for p in range(low, high)]
        for i in range(len(same) - need + 1):
            for j in range(i + need, len(same) + 1):
                if sum(same[i:j]) >= m.SHARE * (j - i) - 1e-9:
                    return True
    return False


def test_planted_passages_with_substitutions(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.randint(12, 40))) for i in range(12)] + [(50, say(6)), (51, say(3))]
    rows, planted = [], {}
    for k in range(60):
        text = say(rng.randint(0, 80))
        if k % 3 == 0:
            i, words = items[rng.randrange(len(items))]
            copy = list(words)
            if k % 2 and len(copy) >= 12:
                copy[len(copy) // 2] = "changed"
            at = rng.randint(0, len(text))
            text = text[:at] + copy + text[at:]
            planted[k] = i
        rows.append((k, " ".join(text).title()))
    bench = [(i, ", ".join(w)) for i, w in items]
    got = {r["doc_id"]: r for r in m.contamination(docs(spark, rows), _items(spark, bench)).collect()}
    for k, text in rows:
        want = sorted(i for i, t in bench if _brute(text, t))
        assert got[k]["items"] == want
        if k in planted and planted[k] != 51:
            assert planted[k] in got[k]["items"]
        assert got[k]["contaminated"] == bool(got[k]["items"]) and got[k]["n_items"] == len(got[k]["items"])
    assert all(51 not in r["items"] for r in got.values())


def test_every_layout_of_substitutions_is_found(spark):
    rows, bench, clean = [], [], set()
    for n in (*range(5, 17), 19, 20):
        most = n // 5
        for changed in itertools.combinations(range(n), most):
            k = len(rows)
            words = [f"w{n}x{i}" for i in range(n)]
            rows.append((k, " ".join(["before", *(f"c{k}" if i in changed else w for i, w in enumerate(words)), "after"])))
        # one more than allowed, so that no stretch of the item keeps the share
        step = [f"c{len(rows)}" if i % 3 == 1 else f"w{n}x{i}" for i in range(n)]
        clean.add(len(rows))
        rows.append((len(rows), " ".join(step)))
        bench.append((n, " ".join(f"w{n}x{i}" for i in range(n))))
    got = {r["doc_id"]: r["items"] for r in m.contamination(docs(spark, rows), _items(spark, bench)).collect()}
    assert len(rows) > 7000
    for k, text in rows:
        n = int(text.split("x")[0].split("w")[-1]) if k in clean else len(text.split()) - 2
        assert got[k] == ([] if k in clean else [n]), (k, text)


def test_random_overlaps_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(30)]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 24)))) for i in range(15)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 400 if k % 10 == 0 else 30))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(bench)[1].split()
            low = rng.randint(0, len(item) // 2)
            piece = [rng.choice(vocab) if rng.random() < 0.15 else w for w in item[low:]]
            at = rng.randint(0, len(words))
            words = words[:at] + piece + words[at:]
        rows.append((k, " ".join(words)))
    want = {k: [i for i, t in bench if _brute(text, t)] for k, text in rows}
    got = {r["doc_id"]: r["items"] for r in m.contamination(docs(spark, rows), _items(spark, bench)).collect()}
    assert got == want and sum(map(bool, want.values())) > 50


def test_small_table_and_windows_change_nothing(spark, monkeypatch):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = sorted(map(tuple, m.contamination(d, b).collect()), key=lambda r: r[0])
    want = {r["doc_id"]: sorted(i["item_id"] for i in b.collect() if i["text"] in r["text"]) for r in d.collect()}
    assert any(want.values()) and all(set(want[r[0]]) <= set(r[2]) for r in plain)
    assert sum(r[1] for r in plain) == sum(bool(v) for v in want.values())
    table, deal = m.seed_table, m.dealt_join
    monkeypatch.setattr(m, "seed_table", lambda items: table(items, 1 << 8))
    monkeypatch.setattr(m, "dealt_join", lambda left, right, key: deal(left, right, key, 1))
    assert sorted(map(tuple, m.contamination(d, b).collect()), key=lambda r: r[0]) == plain


def test_dealt_join_is_the_join(spark):
    left = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS a")
    right = spark.range(100).selectExpr("id % 20 AS k", "id AS b")
    order = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()))
    assert order(m.dealt_join(left, right, "k", 10)) == order(left.join(right, "k"))


def test_odd_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    df = odd_docs(spark).unionAll(docs(spark, [(100, f"x {passage} y"), (101, passage.upper()), (101, passage.upper())]))
    bench = _items(spark, [(1, passage), (1, passage), (None, passage), (2, None), (3, ""), (4, "two words"), (5, "x" * 100_000)])
    got = m.contamination(df, bench).collect()
    assert len(got) == df.count()
    bad = {r["doc_id"]: r["items"] for r in got if r["contaminated"]}
    assert bad == {100: [1, None], 101: [1, None]}
    assert not any(r["contaminated"] for r in m.contamination(df, _items(spark, [])).collect())
    assert m.contamination(docs(spark, []), bench).collect() == []
    kept = m.keep_uncontaminated(spark, df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
