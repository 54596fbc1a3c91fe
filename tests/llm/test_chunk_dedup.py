import random
import re

import duckdb
import numpy as np
import pytest

from codetrail.llm import chunk_dedup as m

from .helpers import docs, odd_docs


def _brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for members in groups.values():
        keep = min(members)[3]
        out += [(i, keep, len(members), i == keep) for *_, i in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 4])
def test_against_brute_force_with_and_without_clashing_hashes(spark, bits):
    rng = random.Random(bits)
    base = ["".join(rng.choice("ab cd\n") for _ in range(rng.randint(0, 6000))) for _ in range(12)]
    rows = [(i, rng.choice(base).replace("a ", rng.choice(["a", "a ", "a\t"]))) for i in range(80)]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in
                  m.exact_duplicates(docs(spark, rows), bits).collect()), key=str)
    assert got == _brute(rows)


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in m.exact_duplicates(df).collect()), key=str)
    assert got == _brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert m.exact_duplicates(docs(spark, [])).collect() == []


def test_stage_keeps_one_row_of_each_group(spark):
    kept = m.keep_distinct(spark, odd_docs(spark))
    rows = kept.collect()
    assert kept.columns == odd_docs(spark).columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in odd_docs(spark).collect()})


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = m.exact_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(m.ORACLE_SQL).fetchall())


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 256, 60_000).astype(np.uint8)
    whole = m.cuts(text, np.array([0, len(text)]))[0]
    shifted = m.cuts(np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), text]), np.array([0, 777, 777 + len(text)]))[1]
    assert [c - 777 for c in shifted] == whole
    sizes = np.diff([0, *whole])
    assert whole[-1] == len(text) and sizes.max() <= m.LONGEST and sizes[:-1].min() >= m.SHORTEST
    # an inserted byte moves the cuts near it only
    changed = m.cuts(np.insert(text, 30_000, 7), np.array([0, len(text) + 1]))[0]
    assert len({c for c in whole if c < 29_000} - set(changed)) == 0
    assert len({c + 1 for c in whole if c > 45_000} - set(changed)) == 0
