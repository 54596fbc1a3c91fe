import duckdb
import pytest

from codetrail.llm import licence_scan as m
from codetrail.llm.licence_texts import KNOWN

from .helpers import docs, odd_docs

MIT = next(t for i, t in KNOWN if i == "MIT")
BSD3 = next(t for i, t in KNOWN if i == "BSD-3-Clause")


def _variants():
    return [
        ("MIT", MIT), ("MIT", MIT.upper()), ("MIT", "Copyright (c) 2020 A. Person\n\n" + MIT),
        ("MIT", "© 1999, someone\r\nAll rights reserved.\r\n" + MIT.replace("\n", "\r\n")),
        ("MIT", "/* " + MIT.replace("\n", "\n * ") + " */"), ("MIT", "MIT LICENCE\n(c) 2001 x\n" + MIT),
        ("MIT", MIT.replace("sublicense", "sub-license").replace("COPYRIGHT HOLDERS", "copyright owners").replace(" and ", " & ")),
        (None, MIT + "\nand more"), (None, MIT.replace("free of charge", "for a fee")), (None, "x " + BSD3),
        ("BSD-3-Clause", BSD3.replace("copyright holder", "Copyright owner").replace("“", '"')),
        ("BSD-3-Clause", BSD3.replace("written permission", "written   permission")),
        ("GPL-3.0-only", "this work is LICENCED under the gnu general public licence — version 3"),
    ]


def test_variants_are_recognised_and_changes_are_not(spark):
    rows = [(k, t) for k, (_, t) in enumerate(_variants())]
    got = {r["doc_id"]: r["license"] for r in m.scan(docs(spark, rows)).collect()}
    assert got == {k: want for k, (want, _) in enumerate(_variants())}


def test_lines_are_notices(spark):
    text = "Some prose.\nReleased under the MIT License.\n# licensed under the apache licence, version 2.0\nReleased under the MIT License"
    r = m.scan(docs(spark, [(1, text), (2, "Licensed under CC BY-NC 4.0.")])).orderBy("doc_id").collect()
    assert (r[0]["license"], r[0]["notices"], r[0]["n_notices"]) == (None, ["Apache-2.0", "MIT"], 3)
    assert (r[1]["license"], r[1]["notices"], r[1]["n_notices"]) == ("CC-BY-NC-4.0", ["CC-BY-NC-4.0"], 1)


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = m.scan(df).collect()
    assert len(got) == df.count()
    assert all((r["license"], r["notices"], r["n_notices"]) == (None, [], 0) for r in got)
    assert m.scan(docs(spark, [])).collect() == []


@pytest.mark.parametrize("extra", [False, True])
def test_rows_match_sql(spark, extra):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    if extra:
        rows = [(k, t) for k, (_, t) in enumerate(_variants())] + [(1000 + i, t) for i, t in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted((r["doc_id"], r["license"], tuple(r["notices"]), r["n_notices"]) for r in m.scan(df).collect())
    want = sorted((i, k, tuple(n), c) for i, k, n, c in con.execute(m.ORACLE_SQL).fetchall())
    assert [g[:1] for g in got] == [w[:1] for w in want] and got == want


def test_no_python_in_the_plan(spark):
    plan = m.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


ENTIRE = ("Apache-2.0", "CC0-1.0", "GFDL-1.2-only", "GFDL-1.3-only", "GPL-1.0-only", "GPL-2.0-only", "GPL-3.0-only",
          "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-1.1", "MPL-2.0")


def test_entire_long_licences_are_recognised(spark):
    text = {i: max((t for k, t in KNOWN if k == i), key=len, default="") for i in ENTIRE}
    rows = [(i, text[i]) for i in ENTIRE]
    rows += [(i, "# " + text[i].replace("\n", "\r\n# ")) for i in ENTIRE]
    rows += [("Apache-2.0", text["Apache-2.0"].split("   APPENDIX")[0]), ("GPL-3.0-only", text["GPL-3.0-only"].split("           How to Apply")[0]),
             ("GFDL-1.3-only", text["GFDL-1.3-only"].split("ADDENDUM")[0]), ("GPL-2.0-only", text["GPL-2.0-only"].upper())]
    rows += [(None, text[i].replace(" not ", " ", 1)) for i in ENTIRE]
    assert all(len(t) > 5000 for _, t in rows)
    got = {r["doc_id"]: r["license"] for r in m.scan(docs(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()}
    assert got == {k: want for k, (want, _) in enumerate(rows)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (_, t) in enumerate(rows)])
    assert {r[0]: r[1] for r in con.execute(m.ORACLE_SQL).fetchall()} == got
