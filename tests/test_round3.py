"""Build knowledge, library pages, groups as child tables, linear walks, skew splits, mergeable history state, stable ids."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codetrail.functions.arrays import NONE_OPEN, open_blocks
from codetrail.functions.calls import calls_from_text
from codetrail.functions.html import decoded
from codetrail.operators import deps as R
from codetrail.operators import diffs as D
from codetrail.operators import pages as Lp
from codetrail.operators import replace as G
from codetrail.sources.ids import assign_ids
from codetrail.streaming.hook import analyze_history

BUILD = "repo string, path string, content string"


def test_r9_three_states(spark):
    pom = "<project><dependencies><dependency><groupId>{}</groupId><artifactId>a</artifactId></dependency></dependencies></project>"
    gradle = 'dependencies {\n    implementation("commons-io", "commons-io", "2.11.0")\n}'
    files = spark.createDataFrame([
        ("kts", "app/build.gradle.kts", gradle), ("maven", "pom.xml", pom.format("commons-io")), ("maven", "build.gradle", gradle),
        ("other", "pom.xml", pom.format("x.y")), ("broken", "x/pom.xml", "<project><dep"), ("empty", "build.gradle", None),
        ("settings", "settings.gradle", gradle)], BUILD)
    repos = spark.createDataFrame([("none",), ("kts",)], "repo string")
    deps = R.project_dependencies(files, repos=repos)
    assert sorted((r.repo, r.build, r.state, r.group, r.artifact) for r in deps.collect()) == [
        ("broken", "maven", "empty", None, None), ("empty", "gradle", "empty", None, None),
        ("kts", "gradle", "known", "commons-io", "commons-io"), ("maven", "maven", "known", "commons-io", "a"),
        ("none", None, "unknown", None, None), ("other", "maven", "empty", None, None), ("settings", None, "unknown", None, None)]
    apis = spark.createDataFrame([(r, p) for r in ("kts", "maven", "other", "none", "unseen") for p in ("commons-io|commons-io|1", "commons-io|a")],
                                 "repo string, project string")
    kept = sorted((r.repo, r.project) for r in R.restrict_to_dependencies(apis, deps).collect())
    assert kept == [("kts", "commons-io|commons-io|1"), ("maven", "commons-io|a")]
    kept = [r.repo for r in R.restrict_to_dependencies(apis, deps, keep_unknown=True).collect()]
    assert sorted(kept) == ["kts", "maven", "none", "none", "unseen", "unseen"]


def test_r8_root_must_be_project(spark):
    body = "<dependencies><dependency><groupId>g</groupId></dependency></dependencies>"
    texts = {"plain": f"<project>{body}</project>", "not": f"<notproject>{body}</notproject>", "projects": f"<projects>{body}</projects>",
             "prolog": f"<?xml version='1.0'?>\n<!-- <x> --><!DOCTYPE project [<!ENTITY a 'b'>]>\n<project xmlns='u' a=\"b\">{body}</project>",
             "null": None, "none": ""}
    files = spark.createDataFrame([("r", k, v) for k, v in texts.items()], BUILD)
    assert sorted(r.path for r in R.pom_dependencies(files).collect()) == ["plain", "prolog"]


def test_r7_forms(spark):
    lines = ['f("a", "b", "c") g("d","e","f")', 'f(g("a.b-c" ,\t"_x","1"))', 'f("a", "b")', 'f("a","b","c","d")', "f('a','b','c')",
             "x 'g:a:v'", "a:b:c:d:e:f", "a:b::c:d:e", ":a:b:c:", "a:b:c:d", '("a","b","c")', 'f("a b","c","d") p:q:r', "1.0:x-y:_z"]
    text = "dependencies {\n" + "\n".join(lines) + "\n}\nout:of:block"
    got = {}
    for r in R.gradle_dependencies(spark.createDataFrame([("r", "p", text)], BUILD)).collect():
        got.setdefault(r.pos - 1, []).append((r.group, r.artifact))
    assert got == {0: [("a", "b"), ("d", "e")], 1: [("a.b-c", "_x")], 5: [("g", "a")], 6: [("a", "b"), ("d", "e")], 7: [("c", "d")],
                   8: [("a", "b")], 9: [("a", "b")], 11: [("p", "q")], 12: [("1.0", "x-y")]}


def test_r7_blocks_like_a_line_by_line_walk(spark):
    rng = random.Random(4)
    files = [[rng.choice(["dependencies {", "{", "}", "x", "a { b }", "} else {", "dependencies { y }"]) for _ in range(rng.randint(0, 400))]
             for _ in range(150)]

    def walk(lines):
        inside, level, out = False, 0, []
        for x in lines:
            out.append(inside)
            if not inside:
                inside, level = "dependencies {" in x, 0
            elif "{" in x:
                level += 1
            elif "}" in x:
                level -= 1
                inside = level >= 0
        return out

    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, lines array<string>")
    got = {r.id: r.b for r in df.select("id", R._in_block(F.col("lines")).alias("b")).collect()}
    assert all(got[i] == walk(f) for i, f in enumerate(files))


def _seconds(run):
    run()
    best = []
    for _ in range(2):
        start = time.time()
        run()
        best.append(time.time() - start)
    return min(best)


@pytest.mark.parametrize("what", ["blocks", "calls"])
def test_walks_are_linear(spark, what):
    """Eight times the input may take eight times the time, and some; a square would take 64 times."""
    def of(n):
        if what == "calls":
            x = spark.range(1).select(F.size(calls_from_text(F.repeat(F.lit("f(a, b);"), n))).alias("n"))
        else:
            block = F.array_repeat(F.lit("dependencies {"), n)
            lines = F.concat(block, F.array_repeat(F.lit("}"), n))
            x = spark.range(1).select(lines.alias("l")).select(F.size(R._in_block(F.col("l"))).alias("n"))
        return lambda: x.first()
    small, large = _seconds(of(1000)), _seconds(of(8000))
    assert large < 24 * small


def test_open_blocks_of_nothing(spark):
    row = spark.range(1).select(open_blocks(F.array().cast("array<int>"), F.array().cast("array<boolean>")).alias("a"),
                                open_blocks(F.array(F.lit(1)), F.array(F.lit(True))).alias("b")).first()
    assert row.a == [] and row.b == [NONE_OPEN]


def test_d2_d3_like_plain_patterns(spark):
    rng = random.Random(1)
    marks = ["[-", "-]", "{+", "+}", "a", "b", "[", "]", "{", "}", "-", "+", " ", "-]{+", "[-x-]{+y+}"]
    lines = sorted({"".join(rng.choice(marks) for _ in range(rng.randint(1, 14))) for _ in range(4000)})
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    removed, added = r"\[-((?:(?!\[-).)*?)-\]", r"\{\+((?:(?!\{\+).)*?)\+\}"
    got = {"pair": {}, "removed": {}, "added": {}}
    for r in D.paired_replacements(df).orderBy("id", "k").collect():
        got["pair"].setdefault(r.id, []).append((r.removed, r.added))
    for r in D.unpaired_changes(df).orderBy("id", "k").collect():
        got[r.side].setdefault(r.id, []).append(r.removed if r.side == "removed" else r.added)
    for i, line in enumerate(lines):
        assert got["pair"].get(i, []) == [(a.strip(" "), b.strip(" ")) for a, b in re.findall(removed + added, line)], line
        assert got["removed"].get(i, []) == [a.strip(" ") for a in re.findall(removed + r"(?!\{)", line)], line
        assert got["added"].get(i, []) == [a.strip(" ") for a in re.findall(r"(?<!\])" + added, line)], line


def test_x2_arguments(spark):
    texts = {"f()": [("f", 0)], "f(a, g(b, c), [x, y])": [("f", 3), ("g", 2)], "f(a": [("f", 1)], "f(,)": [("f", 2)], "": [], ") f(a)": [("f", 1)],
             "f(a) {g(b, {c, d})}": [("f", 1), ("g", 2)], "if (f(a, b)) return g(h());": [("f", 2), ("g", 1), ("h", 0)]}
    df = spark.createDataFrame([(k,) for k in [*texts, None]], "c string")
    got = {r.c: r.calls and [tuple(x) for x in r.calls] for r in df.select("c", calls_from_text(F.col("c")).alias("calls")).collect()}
    assert got.pop(None) is None
    assert {k: v or [] for k, v in got.items()} == texts


def test_r2_popular_class(spark):
    classes = spark.range(10_000).select(F.format_string("g:a:%s", "id").alias("library"), F.lit("p.C").alias("class")).unionByName(
        spark.createDataFrame([("h:b:1", "p.C"), ("h:b:1", "p.D")], "library string, class string"))
    deps = spark.createDataFrame([("one", "g", "a", "77"), ("two", "g", "a", "1"), ("two", "g", "a", "2"), ("both", "g", "a", "3"),
                                  ("both", "h", "b", "1"), ("none", "z", "z", "1")], "repo string, group string, artifact string, version string")
    calls = spark.createDataFrame([(f"{r}{c}", r, f"p.{c}", False, False) for r in ("one", "two", "both", "none") for c in "CD"],
                                  "inv_id string, repo string, cls string, is_local boolean, is_java boolean")
    out = R.resolve_external(calls, deps, classes, fallback=True)
    got = {r.inv_id: (r.status, r.library and ":".join(r.library)) for r in out.collect()}
    assert got == {"oneC": ("linked", "g:a:77"), "twoC": ("versions", None), "bothC": ("libraries", None), "noneC": ("fallback", "g:a:0"),
                   "oneD": ("fallback", "h:b:1"), "twoD": ("fallback", "h:b:1"), "bothD": ("linked", "h:b:1"), "noneD": ("fallback", "h:b:1")}


def test_r12_like_every_package_against_every_line(spark):
    rng = random.Random(2)
    packages = ["a", "a.b", "org.lib", "org.lib.x", "org.lib.xy", "org.other", "zz", "import", "org.none.at.all"]
    lines = [f"import {rng.choice(['org.lib.x', 'org.lib.xyz', 'static org.other.', 'a.b', 'q', 'org.li'])}{rng.choice(['', '.A', '.b.C'])};"
             for _ in range(300)]
    files = spark.createDataFrame([("r", i, "F", "\n".join(rng.sample(lines, 3))) for i in range(80)], "repo string, idx int, path string, content string")
    listed = sorted(packages, key=lambda p: (-len(p), p))
    want = {}
    for r in files.collect():
        named = {next((p for p in listed if p in line), None) for line in r.content.split("\n") if "import" in line} - {None}
        if named:
            want[r.idx] = sorted(named)
    pk = spark.createDataFrame([(p,) for p in packages], "package string")
    assert {r.idx: r.packages for r in R.imported_targets(files, pk).collect()} == want


def test_l1_as_a_parser_reads(spark):
    html = """<div class=im><a href="/artifact/g/outside">o</a></div><body><div id='maincontent'>
      <!-- <div class="im"><a href="/artifact/g/comment">c</a></div> --><script>"<div class='im'><a href='/artifact/g/script'>"</script>
      <div class="im big"><img src="a>b" alt='<a href="/artifact/g/attr">'><a href="/artifact/g/first?x=1&amp;y=&#x32;" title='&lt;t&gt;'>A &amp; <b>B</b>ig</a>
      <br><a href=/artifact/g/second>two</A><p><a href="/artifact/g/inner">i</a></div>
      <div class=im><h2><a href="/artifact/g/heading">h</a></h2></div>
      <ul><li class=im><a href="/artifact/g/li">l<li><a href="/artifact/g/plain">p</a></ul>
      <div class="imx"><a href="/artifact/g/class">c</a></div></span></div><div class=im><a href="/artifact/g/after">z</a></div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<"), (5, "<a href='x"), (6, "<div id=maincontent><div class=im><a href='/artifact/g/open'>u")],
                                  "page_id int, html string")
    rows = Lp.artifact_links(pages, group="g", listing=True).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.href, r.text, r.title) for r in rows] == [
        (1, 0, "/artifact/g/first?x=1&y=2", "A & Big", "<t>"), (1, 1, "/artifact/g/second", "two", ""), (1, 2, "/artifact/g/li", "l", ""),
        (6, 0, "/artifact/g/open", "u", "")]
    every = [r.artifact for r in Lp.artifact_links(pages.filter("page_id = 1"), group="g").orderBy("pos").collect()]
    assert every == ["outside", "first?x=1&y=2", "second", "inner", "heading", "li", "plain", "class", "after"]


def test_entities(spark):
    texts = {"a &amp; b": "a & b", "&#65;&#x42;&#x1F642;": "AB\U0001f642", "&nope; &": "&nope; &", "&lt;&gt;&quot;&apos;": "<>\"'", "&#0;&#xD800;&#9999999;": "���",
             "&amp;lt;": "&lt;", "x": "x"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.d for r in df.select("t", decoded(F.col("t")).alias("d")).collect()} == texts


MEMBERS = ("repo string, idx int, old_name string, old_n_args int, new_name string, new_n_args int, edit_rank int, path string, pos int, "
           "k int, old_path string, before int, after int, packages array<string>")


def test_g11_g12_a_commit_of_very_many_files(spark):
    n = 100_000
    members = spark.range(n).select(
        F.lit("r").alias("repo"), F.lit(1).alias("idx"), F.lit("o").alias("old_name"), F.lit(0).alias("old_n_args"), F.lit("n").alias("new_name"),
        F.lit(0).alias("new_n_args"), F.lit(1).alias("edit_rank"), F.format_string("f%06d", "id").alias("path"), F.lit(0).alias("pos"), F.lit(0).alias("k"),
        F.format_string("f%06d", "id").alias("old_path"), F.lit(1).alias("before"), F.lit(2).alias("after"), F.array(F.lit("p")).alias("packages"))
    members = G.group_members(members)
    assert G.group_replacements(members).select("gid", "count").first()[:] == (1, n)
    text = G.render_occurrences(G.group_occurrences(members)).first().replacement_paths
    files = text.split(", ")
    assert len(files) == n and files[0] == '("f000000"->"f000000"|[1,2])' and files == sorted(files)


def test_g13_a_hot_name(spark):
    """One (name, arity) has a third of the catalog: it's dealt out, and loses nothing."""
    apis = [(i, f"org.lib.c{i % 40}.C{i}", "get" if i % 3 == 0 else f"m{i}", 0, True) for i in range(3000)] + [(9000, "org.lib.c1.X", "get", 0, False)]
    catalog = spark.createDataFrame(apis, "id int, class string, name string, n_args int, is_public boolean")
    t = "struct<packages:array<string>>"
    groups = spark.createDataFrame([("r", i, "o", 0, name, 0, 1, ([f"org.lib.c{i % 5}.", "none"],)) for i, name in enumerate(["get"] * 20 + ["m1", "zz"])],
                                   f"repo string, idx int, old_name string, old_n_args int, new_name string, new_n_args int, gid int, rep {t}")
    want = sorted((i, a) for i, name in enumerate(["get"] * 20 + ["m1", "zz"]) for a, cls, nm, na, pub in apis
                  if pub and nm == name and f"org.lib.c{i % 5}." in cls)
    for at_once in (16, 100_000):
        assert sorted((r.idx, r.api_id) for r in G.candidate_apis(groups, catalog, at_once=at_once).collect()) == want


def test_u1_stretches_emit_the_rows_of_the_plain_walk(spark):
    commits = spark.createDataFrame([("big", i, i % 7) for i in range(500)] + [("small", 3, 1), ("small", 900, 2), (None, 1, 5)],
                                    "repo string, idx int, v int")

    def on_commit(state, row):
        state = {"n": state["n"] + 1, "sum": state["sum"] + row["v"]}
        return state, [{"repo": row["repo"], "idx": row["idx"], "total": state["sum"]}] if row["v"] == 1 else []

    def on_end(key, state):
        return [{"repo": key[0], "idx": -state["n"], "total": state["sum"]}]

    def merge(a, b):
        return {"n": a["n"] + b["n"], "sum": a["sum"] + b["sum"]}

    how = dict(schema="repo string, idx long, total long", init=lambda: {"n": 0, "sum": 0})
    plain = sorted((tuple(r) for r in analyze_history(commits.dropna(), on_commit, on_end, **how).collect()), key=str)
    for stretch in (10, 64, 100_000):
        out = analyze_history(commits.dropna(), on_commit, on_end, merge=merge, stretch=stretch, **how)
        assert sorted((tuple(r) for r in out.collect()), key=str) == plain
    assert ("big", -500, sum(i % 7 for i in range(500))) in plain
    assert analyze_history(commits.limit(0), on_commit, on_end, merge=merge, **how).collect() == []


def test_s13_ties_get_the_same_ids_however_rows_arrive(spark):
    rows = [(i % 5, f"t{i % 11}", None if i % 3 else {"a": i % 2}) for i in range(200)] + [(None, "x", None)] * 2
    seen = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, text string, m map<string,int>").repartition(3 + seed)
        got = sorted((r.id, r.k, r.text, str(r.m)) for r in assign_ids(df, ["k"], base=1).collect())
        assert [g[0] for g in got] == list(range(1, 203)) and [g[1] for g in got] == [None] * 2 + sorted(i % 5 for i in range(200))
        seen.append(got)
    assert seen[0] == seen[1]
