import random
import re

import duckdb

from codetrail.llm import url_automaton as m


def _regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out + r"\Z")


def test_all_globs_at_once_match_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "\\*", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    globs += ["a" * 150 + "*b", "**" + "ab" * 70, "", "*", "**", "***", "****"]
    texts = ["".join(rng.choice("ab/.*é") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += ["a" * 150 + "xb", "a" * 150 + "/b", "zz" + "ab" * 70, "", "é"]
    automaton = m.Automaton(globs)
    assert automaton.words > 3
    hit = automaton.matches([t.encode() for t in texts])
    for k, glob in enumerate(globs):
        shape = _regex(glob)
        assert [bool(shape.match(t)) for t in texts] == hit[:, k].tolist(), glob


URLS = [None, "", "no scheme", "http://", "http://NET", "http://NET/", "https://a.Example.net/en/x?y#z", "http://example.net/en",
        "http://example.net?/en/", "http://xnet/a", "http://a.com/x.net/", "x://y.org/fr/", "x://y.org/FR/", "a://b://c.net/",
        "http://www.cheap-pills.example.com/en/1", "http://example.com/de/", "http://my.example.com:80/de/", "http://.net/",
        "http://ÉXAMPLE.ORG/fr/é", "http://line\nbreak.net/a\nb?c", "x://" + "a" * 20_000 + ".net/" + "b" * 20_000,
        "http://spam-farm.example.com", "http://xcasino.com/", "http://casino.com", "://net/"]


def _pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)],
                                 "page_id long, url string, host string, rule string, verdict int")


def test_rows_match_sql(spark):
    rng = random.Random(9)
    hosts = ["net", "a.net", "example.net", "x.example.com", "org", "b.org", "free-bets.com", "NET", "é.net"]
    urls = URLS + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/a', '/fr/', '?q', '#f'])}"
                   for _ in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    got = sorted(tuple(r) for r in m.judge(_pages(spark, urls)).collect())
    assert got == sorted(con.execute(m.ORACLE_SQL).fetchall())


def test_longest_rule_wins_and_ties_go_to_the_first(spark):
    rules = (("block", "a.net/"), ("allow", "net/x/"), ("block", "net/x"), ("allow", "net/y"), ("block", "net/y"))
    urls = ["http://a.net/x/", "http://a.net/x", "http://net/y", "http://net/z"]
    got = [(r["rule"], r["verdict"]) for r in m.judge(_pages(spark, urls), rules, ()).orderBy("page_id").collect()]
    assert got == [("a.net/", "block"), ("a.net/", "block"), ("net/y", "allow"), (None, "allow")]


def test_empty_table_and_repeated_rows(spark):
    assert m.judge(_pages(spark, [])).collect() == []
    twice = _pages(spark, ["http://net/"]).unionAll(_pages(spark, ["http://net/"]))
    assert [tuple(r) for r in m.judge(twice).collect()] == [(0, "net", "/", "net/", "block")] * 2
    assert [r["verdict"] for r in m.judge(_pages(spark, URLS), (), ()).collect()] == ["allow"] * len(URLS)


def _host_and_path(url):
    _, found, rest = (url or "").partition("://")
    front = re.split("[?#]", rest, maxsplit=1)[0] if found else ""
    host, slash, path = front.partition("/")
    return re.sub("[A-Z]+", lambda x: x[0].lower(), host), slash + path


def test_urls_within_a_query_or_fragment_have_no_say(spark):
    urls = ["http://a.net?u=http://b.org/fr/x", "http://a.net#http://b.org/fr/x", "http://a.net?http://b.org", "http://?u=x://net/",
            "http://a.net/?u=http://b.org/fr/x", "http://b.org/fr/?u=http://a.net/", "http://xcasino.com?u=http://b.com/a",
            "http://example.com#a?b://c/de/", "x?u=http://a.net?v=http://b.net/"] + URLS
    got = m.judge(_pages(spark, urls)).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in got] == [_host_and_path(u) for u in urls]
    assert [tuple(r)[1:] for r in got[:3]] == [("a.net", "", None, "allow")] * 3
    assert [(r["rule"], r["verdict"]) for r in got[4:7]] == [("net/", "block"), ("org/fr/", "allow"), (None, "allow")]


def test_sql_keeps_to_the_first_scheme(spark):
    urls = ["http://a.net?u=http://b.org/fr/x", "http://a.net#http://b.org/fr/x", "http://?u=x://net/", "x?u=http://a.net?v=http://b.net/",
            "http://line\nbreak.net/a?u=x://b/c"] + URLS
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    got = sorted(tuple(r) for r in m.judge(_pages(spark, urls)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [r[1:3] for r in got] == [tuple(r) for r in con.execute(
        "SELECT host, path FROM (" + m.ORACLE_SQL + ") ORDER BY page_id").fetchall()]


def test_columns_with_clashing_names_have_no_say(spark):
    rows = [(1, "http://example.net/en/x"), (2, "https://a.org/fr/y?z"), (3, None), (3, None), (4, "x")]
    schema = "page_id long, url string"
    more = "path string, host string, rule string, verdict string, html string, row long, masks string"
    plain = spark.createDataFrame(rows, schema)
    clashing = spark.createDataFrame([(*r, "q", "q", "q", "q", "q", 7, "q") for r in rows], f"{schema}, {more}")
    a, b = (m.judge(df) for df in (plain, clashing))
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and b.count() == len(rows)
