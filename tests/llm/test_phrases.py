import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from codetrail.llm import phrases as p

from .helpers import SF, docs, odd_docs


def brute(rows, least=10, drop=50, top=2000):
    """Everything counted, every cut scored, in Python's integers."""
    count, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        c = count.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                c.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in count.items():
        cands = {w: a for w, a in c.items() if len(w) > 1 and a >= least}
        inner = Counter()
        for w, a in cands.items():
            if len(w) == 3:
                for part in (w[:2], w[1:]):
                    inner[part] = max(inner[part], a)
        best = []
        for w, a in cands.items():
            s, _, left, right = min((10**6 * a * a // (c[w[:k]] * c[w[k:]]), k, c[w[:k]], c[w[k:]]) for k in range(1, len(w)))
            if len(w) == 3 or 100 * inner[w] < drop * a or w not in inner:
                best.append((-s, -a, " ".join(w).encode(), left, right))
        for i, (s, a, w, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, w.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def run(df, **k):
    return sorted(tuple(r) for r in p.collocations(df, **k).collect())


def test_word_hash_is_sparks(spark):
    row = spark.createDataFrame([("en", "wörd")], "l string, w string").select(F.xxhash64("l", "w").alias("h")).first()
    assert p.word_hash("en")("wörd".encode()) == row["h"] % 2**64 and xxhash.VERSION


@pytest.mark.parametrize("first_rank", [2, 4000])
def test_equals_brute_force_through_all_waves(spark, first_rank):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    # a low first rank forces further waves; a tiny bit table and short windows must not change a row
    small = dict(filter_bits=1 << 15, window=1 << 12) if first_rank == 2 else {}
    assert run(df, top=40, first_rank=first_rank, **small) == brute(rows, top=40)


def test_trigram_drops_its_pairs_and_ties_are_ordered(spark):
    rows = [("The big cat, the big cat! the big", "en")] * 6 + [("big cat; big cat", "en")] * 3 + [("ä ö. z y. a b", None)] * 10
    rows += [("x x x x x x x x x x x x x", "en"), ("p\tq  r\vp q\n", "xx")] * 1 + [("one two", "xx")] * 10
    df = docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)])
    got = run(df)
    assert got == brute(rows) and got
    assert [r[2] for r in got if r[0] == "und"] == ["a b", "z y", "ä ö"]


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
    assert run(df, least=2) == brute(rows, least=2)
    assert run(df.limit(0)) == []


def test_long_text_in_windows(spark):
    text = "alpha beta gamma delta. " * 400 + "w" * 9000 + " alpha beta"
    df = docs(spark, [(1, text, "en"), (2, None, None)])
    assert run(df, window=1000) == brute([(text, "en"), (None, None)])


def test_oracle_sql_is_brute_force():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rows = con.execute("SELECT text, lang FROM documents").fetchall()
    assert sorted(con.execute(p.ORACLE_SQL).fetchall()) == brute(rows)
