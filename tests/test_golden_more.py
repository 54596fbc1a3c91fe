"""More hand-derived rows for operators whose oracle checks use only the synthetic carriers."""

from pyspark.sql import functions as F

from codetrail.operators import deps as R
from codetrail.operators import facts as X
from codetrail.operators import history as H
from codetrail.operators import pages as Lp
from codetrail.operators import select as P
from codetrail.sources.ids import assign_ids
from codetrail.streaming.hook import analyze_history


def test_h2_chain_and_h8c(spark):
    log = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("s", "x", 5)],
                                "repo string, sha string, ts int")
    c = H.first_parent_chain(log, order=["ts"])
    got = sorted((r.repo, r.idx, r.sha, r.parent_sha, r.total) for r in c.collect())
    assert got == [("r", 1, "a", H.EMPTY_TREE_SHA, 3), ("r", 2, "b", "a", 3), ("r", 3, "c", "b", 3),
                   ("s", 1, "x", H.EMPTY_TREE_SHA, 1)]
    prev = spark.createDataFrame([("r", "c")], "repo_name string, cur_commit string")
    kept = sorted(r.sha for r in H.restrict_commits(c, prev).collect())
    assert kept == ["b", "c"]


def test_h10_running_totals(spark):
    iv = spark.createDataFrame([("r", "p", 1, 3), ("r", "q", 2, None)], "repo string, path string, valid_from int, valid_to int")
    facts = spark.createDataFrame([("r", "p", 1, "f"), ("r", "p", 1, "g"), ("r", "q", 2, "h")],
                                  "repo string, path string, idx int, name string")
    commits = spark.createDataFrame([("r", i) for i in range(1, 5)], "repo string, idx int")
    got = sorted((r.idx, r.n_total) for r in H.state_totals(facts, iv, commits, width=2).collect())
    assert got == [(1, 2), (2, 3), (3, 1), (4, 1)]


def test_l2_stop_at_first_empty_page(spark):
    pages = spark.createDataFrame([("g", i, i) for i in (1, 2, 3, 4)], "group string, page_no int, page_id int")
    links = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "page_id int, href string")
    assert sorted(r.page_no for r in Lp.pages_before_empty(pages, links).collect()) == [1, 2]


def test_l3_moves(spark):
    arts = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("g", "d")], "group string, artifact string")
    moves = spark.createDataFrame([("g", "a", "g", "a2"), ("g", "b", "h", "b2"), ("g", "c", "g", None)],
                                  "group string, artifact string, new_group string, new_artifact string")
    got = sorted((r.artifact, r.resolved_artifact) for r in Lp.resolve_moved(arts, moves).collect())
    assert got == [("a", "a2"), ("c", "c"), ("d", "d")]


def test_l4_release_and_listing_past_navigation(spark):
    html = ("<a href='/'>Home</a> <a class=\"vbtn\" href=\"/old\">0.9</a><p><a href='/no'>View All</a></p>"
            "<div class=\"x\" id='maincontent'><a title='r' class='big vbtn release'\n href='a/1.2'>1.2</a>"
            "<a class=\"vbtn release\" href=\"a/1.1\">1.1</a><table><tr><td><a href=\"/all\">View\n  <b>All</b></a></td></tr></table></div>")
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    latest = {r.page_id: r.latest_release for r in Lp.latest_release(pages).collect()}
    first, missing = Lp.download_listing(pages)
    assert latest == {1: "a/1.2", 2: None, 3: None}
    assert [r.download_listing for r in first.collect()] == ["/all"]
    assert sorted(r.page_id for r in missing.collect()) == [2, 3]


def test_l1_listing_entries_and_l2_unfiltered(spark):
    entry = '<div class="im"><a href="/artifact/{}/x"><img></a><h2><a href="/artifact/{}/x">x</a></h2></div>'
    pages = spark.createDataFrame([
        ("g", 1, 1, f'<a href="/artifact/g/nav">n</a><div id="maincontent">{entry.format("g", "g")}</div>'),
        ("g", 2, 2, f'<div id="maincontent">{entry.format("other", "other")}</div>'),
        ("g", 3, 3, '<a href="/artifact/g/nav">n</a><div id="maincontent"></div>'),
        ("g", 4, 4, f'<div id="maincontent">{entry.format("g", "g")}</div>')], "group string, page_no int, page_id int, html string")
    assert [(r.page_id, r.artifact) for r in Lp.artifact_links(pages, group="g", listing=True).orderBy("page_id").collect()] == [
        (1, "x"), (4, "x")]  # the link in the heading is no direct child
    kept = Lp.pages_before_empty(pages, Lp.page_links(pages, listing=True))
    assert sorted(r.page_no for r in kept.collect()) == [1, 2]


def test_l3_move_read_from_the_page(spark):
    def page(row):
        return f'<div id="maincontent"><div>This artifact was moved to:<table><tbody><tr>{row}</tr></tbody></table></div></div>'
    pages = spark.createDataFrame([
        ("g", "a", page('<td><a href="/artifact/g">g</a> » <a href="/artifact/g/a2">a2</a></td>')),
        ("g", "b", page('<td><a href="/artifact/h">h</a> » <a href="/artifact/h/b2">b2</a></td>')),
        ("g", "c", page("")), ("g", "d", '<div id="maincontent">fine</div>')], "group string, artifact string, html string")
    moves = Lp.moves_of_pages(pages)
    assert sorted((r.artifact, r.new_group, r.new_artifact) for r in moves.collect()) == [
        ("a", "g", "a2"), ("b", "h", "b2"), ("c", None, None)]
    got = sorted((r.artifact, r.resolved_artifact) for r in Lp.resolve_moved(pages.select("group", "artifact"), moves).collect())
    assert got == [("a", "a2"), ("c", "c"), ("d", "d")]


def test_l5_title_attribute(spark):
    html = '<a title="x-sources.jar" href="x-sources.jar">s</a><a href=\'t\' title=\'x-test-sources.jar\'>t</a><a href="j">-sources.jar</a>'
    links = Lp.page_links(spark.createDataFrame([(1, html)], "page_id int, html string")).withColumnRenamed("href", "url")
    assert [r.file_name for r in Lp.source_archives(links).collect()] == ["x-sources.jar"]


def test_p2_any_tagger_names_and_ties(spark):
    labels = spark.createDataFrame([(1, "alice", 1), (1, "bob", 1), (2, "alice", 1), (2, "bob", 0), (3, "zoe", 1),
                                    (4, "a", 0), (4, "b", 1), (4, "c", 0)], "artifact_id long, tagger string, is_valid int")
    v = {r.artifact_id: (r.n_taggers, r.is_valid, r.agreed) for r in P.adjudicate_labels(labels).collect()}
    assert v == {1: (2, True, True), 2: (2, None, False), 3: (1, True, None), 4: (3, False, False)}


def test_p1_p2_p3(spark):
    rep = spark.createDataFrame([(1, "getName(0)", 3), (2, "compute(1)", 3), (3, "main(1)", 5), (4, "parse(1)", 1)],
                                "id long, old_method string, count long")
    sel = P.select_replacements(rep, min_count=2)
    assert sorted(r.id for r in sel.collect()) == [2]
    labels = spark.createDataFrame([(2, "t1", 1), (2, "t2", 0), (2, "t3", 1), (9, "t1", 0), (9, "t2", 0)],
                                   "artifact_id long, tagger string, is_valid int")
    v = {r.artifact_id: (r.n_taggers, r.is_valid, r.agreed) for r in P.adjudicate_labels(labels).collect()}
    assert v == {2: (3, True, False), 9: (2, False, True)}
    f = {r.stage: r.n for r in P.funnel(rep, sel, P.adjudicate_labels(labels)).collect()}
    assert f == {"candidates": 4, "selected": 1, "valid": 1}


def test_r5_r9(spark):
    cat = spark.createDataFrame([("g", "a", "1.2"), ("g", "a", "1.10"), ("g", "a", "1.9")], "group string, artifact string, version string")
    deps = spark.createDataFrame([("r", "g", "a", "1.3"), ("r", "g", "a", "1.2"), ("r", "h", "b", "1")],
                                 "repo string, group string, artifact string, version string")
    got = sorted((r.artifact, r.version, r.upgraded) for r in R.upgrade_missing_versions(deps, cat).collect())
    assert got == [("a", "1.10", True), ("a", "1.2", False), ("b", "1", False)]
    pom = ("<project><dependencies><dependency><groupId>commons-io</groupId><artifactId>commons-io</artifactId>"
           "<version>2.11.0</version></dependency><dependency><groupId>x</groupId><artifactId>y</artifactId>"
           "<version>1</version></dependency></dependencies></project>")
    files = spark.createDataFrame([("r1", "pom.xml", pom), ("r1", "build.gradle", "dependencies {\n  a 'org.apache.commons:lang:1'\n}"),
                                   ("r2", "build.gradle", "dependencies {\n  a 'org.apache.commons:lang:1'\n}"),
                                   ("r3", "build.gradle", "nothing")], "repo string, path string, content string")
    got = sorted((r.repo, r.state, r.group, r.artifact) for r in R.project_dependencies(files).collect())
    assert got == [("r1", "known", "commons-io", "commons-io"), ("r2", "known", "org.apache.commons", "lang"),
                   ("r3", "empty", None, None)]


def test_x13_x14_x15(spark):
    t = "array<struct<kind:string,name:string,modifier:string>>"
    types = spark.createDataFrame([("p", "A.java", "Inner", [("class", "Outer", "public")], False, None, "class"),
                                   ("p", "B.java", "B", [], True, "x.y.B", "enum")],
                                  f"project string, path string, name string, ancestors {t}, resolved boolean, "
                                  "binding_name string, kind string")
    pk = spark.createDataFrame([("p", "A.java", "a.b")], "project string, path string, package string")
    q = {r.name: r.qualified_name for r in X.qualified_type_name(types, pk).collect()}
    assert q == {"Inner": "a.b.Outer.Inner", "B": "x.y.B"}
    codes = sorted((r.qualified_name, r.kind_code) for r in X.type_declarations(X.qualified_type_name(types, pk)).collect())
    assert codes == [("a.b.Outer.Inner", 0), ("x.y.B", 2)]
    pk2 = spark.createDataFrame([("p", "A.java", "a", "d"), ("p", "A.java", "b", "d"), ("p", "C.java", "a", "d")],
                                "project string, path string, package string, dir string")
    d, multi = X.package_declarations(pk2)
    assert d.count() == 2 and [r.path for r in multi.collect()] == ["A.java"]


def test_s13_ids_and_reuse(spark):
    df = spark.createDataFrame([(k,) for k in "dbca"], "k string")
    assert sorted((r.k, r.id) for r in assign_ids(df, ["k"], base=1).collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    reuse = spark.createDataFrame([("a", 7)], "k string, old int")
    assert assign_ids(reuse, ["k"], reuse_col="old").first().id == 7


def test_u1_hook_in_order(spark):
    commits = spark.createDataFrame([("r", 3, "c"), ("r", 1, "a"), ("r", 2, "b"), ("s", 1, "z")],
                                    "repo string, idx int, sha string")

    def on_commit(state, row):
        return state + [row["sha"]], []

    def on_end(key, state):
        return [{"repo": key[0], "shas": ",".join(state)}]

    out = analyze_history(commits, on_commit, on_end, "repo string, shas string", init=list)
    assert sorted(tuple(r) for r in out.collect()) == [("r", "a,b,c"), ("s", "z")]


def test_d5_hunks_all_real_hunks(spark):
    from codetrail.operators import diffs as D
    text = "diff --git a/f b/f\n@@ -1 +7 @@\n-a\n+b\n@@ -5,2 +9,3 @@\n c"
    df = spark.createDataFrame([("r", 1, "f", "f", text)], "repo string, idx int, old_path string, path string, line_diff string")
    got = [(r.hunk, r.start, r.end, r.text) for r in D.hunks(df).orderBy("hunk").collect()]
    assert got == [(1, 7, 7, "-a\n+b\n"), (2, 9, 11, " c\n")]


def test_h11_h12_s14(spark):
    from codetrail.sources.text import normalize_text
    ch = spark.createDataFrame([("r", 1, "M", "a.java", "a.java"), ("r", 1, "M", "b.txt", "b.txt"), ("r", 1, "A", None, "c.java")],
                               "repo string, idx int, kind string, old_path string, path string")
    assert [r.path for r in H.modified_files(ch).collect()] == ["a.java"]
    cp = spark.createDataFrame([("r", "s1", ["p"]), ("r", "s2", ["p", "q"]), ("r", "s0", [])], "repo string, sha string, parents array<string>")
    assert sorted(r.sha for r in H.all_non_merge_commits(cp).collect()) == ["s0", "s1"]
    t = spark.createDataFrame([("a\r\nb\r",)], "t string")
    assert normalize_text(t, ["t"]).first().t == "a\nb"


def test_l1_artifact_links_and_s2(spark, tmp_path):
    html = ('<a href="/artifact/org.apache.commons/commons-lang3">x</a> <a href="/artifact/other/y">y</a>'
            '<a href="/artifact/org.apache.commons/commons-io">z</a>')
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [r.artifact for r in Lp.artifact_links(pages, group="org.apache.commons").orderBy("pos").collect()]
    assert got == ["commons-lang3", "commons-io"]
    from codetrail.sources.readers import read_library_list
    f = tmp_path / "libs.txt"
    f.write_text("commons-io|commons-io|2.11.0\norg.apache.commons|commons-jcs3-*|*\n")
    rows = sorted(tuple(r) for r in read_library_list(spark, str(f)).collect())
    assert rows == [("commons-io", "commons-io", "2.11.0"), ("org.apache.commons", "commons-jcs3-*", "*")]


def test_r8_pairs_by_element_and_skips_broken_files(spark):
    from codetrail.operators import deps as R
    pom = ("<?xml version='1.0'?><project xmlns='http://maven.apache.org/POM/4.0.0'><dependencies>"
           "<dependency><artifactId>a1</artifactId></dependency>"
           "<dependency><groupId>g2</groupId><artifactId>a2</artifactId><version>2</version></dependency>"
           "<dependency><version>3</version><artifactId>a3</artifactId><groupId>g3</groupId></dependency></dependencies></project>")
    df = spark.createDataFrame([("r", "pom.xml", pom), ("s", "pom.xml", pom[:-20]), ("t", "pom.xml", None)],
                               "repo string, path string, content string")
    got = [(r.repo, r.group, r.artifact, r.version) for r in R.pom_dependencies(df).orderBy("k").collect()]
    assert got == [("r", None, "a1", None), ("r", "g2", "a2", "2"), ("r", "g3", "a3", "3")]
    assert sorted(r.repo for r in R.malformed_poms(df).collect()) == ["s", "t"]


def test_r10_is_per_repository(spark):
    from codetrail.operators import deps as R
    apis = spark.createDataFrame([("r", 1, "g|a|1"), ("s", 1, "g|a|1"), ("t", 1, "g|a|1")], "repo string, id int, project string")
    deps = spark.createDataFrame([("r", "g", "a"), ("s", "g", "b"), ("t", None, None)], "repo string, group string, artifact string")
    assert [r.repo for r in R.restrict_to_dependencies(apis, deps).collect()] == ["r"]


def test_r7_blocks_by_brace_balance(spark):
    from codetrail.operators import deps as R
    text = "\n".join(["a 'x:x:1'", "dependencies {", "  api 'g:a:1'", "  impl(\"g\", \"b\", \"2\") {", "    exclude 'g:c:3'", "  }",
                      "}", "t 'l:l:1'", "dependencies {", "  api 'g:d:4'", "} // 'g:e:5'", "z 'n:n:1'"])
    df = spark.createDataFrame([("r", "build.gradle", text)], "repo string, path string, content string")
    got = [(r.group, r.artifact) for r in R.gradle_dependencies(df).orderBy("pos").collect()]
    assert got == [("g", "a"), ("g", "b"), ("g", "c"), ("g", "d"), ("g", "e")]


def test_x1_x3_skip_and_count_broken_units(spark):
    from codetrail.operators import facts as X
    head = '<unit xmlns="x">\n'
    good = '<unit revision="1" item="1"><call><name>f</name><argument_list pos:start="3:1">(<argument>a</argument>)</argument_list></call></unit>'
    bad = '<unit revision="1" item="2"><call><name>cut</unit>'
    decl = ('<unit item="{}" scope="{}"><function pos:start="1:1" pos:end="2:1"><name>m{}</name><parameter_list>(<parameter>int... a'
            '</parameter>)</parameter_list></function></unit>')
    df = spark.createDataFrame([("r", 1, "p", head + good + "\n" + bad + "\n</unit>",
                                 head + decl.format(1, "class", 1) + "\n" + decl.format(2, "block", 2) + "\n" + bad + "\n</unit>")],
                               "repo string, idx int, path string, calls_xml string, decls_xml string")
    assert [(r.name, r.n_args, r.line) for r in X.calls_from_xml(df).collect()] == [("f", 1, 3)]
    assert [(r.name, r.n_args, r.varargs) for r in X.declarations_from_xml(df).orderBy("unit_pos").collect()] == [
        ("m1", 0, True), ("m2", 0, True)]
    assert [r.name for r in X.declarations_from_xml(df, scope="types").collect()] == ["m1"]
    assert [(r.n_units, r.n_malformed) for r in X.malformed_units(df, "decls_xml").collect()] == [(3, 1)]


def test_g11_groups_follow_package_sets(spark):
    rows = [("r", 1, "o", 0, "n", 0, 0, f"p{i}", 0, 0, f"p{i}", 1, 1, pk) for i, pk in enumerate(
        [["a", "b"], ["c"], ["b", "c"], ["c", "d"], ["d"], ["a", "b"], ["d"]])]
    df = spark.createDataFrame(rows, "repo string, idx int, old_name string, old_n_args int, new_name string, new_n_args int, "
                                     "edit_rank int, path string, pos int, k int, old_path string, before int, after int, "
                                     "packages array<string>")
    from codetrail.operators import replace as G
    got = {}
    for r in G.group_occurrences(G.group_members(df)).orderBy("path").collect():
        got.setdefault(r.gid, []).append(r.path)
    # p2 overlaps the first opener; p3 the second; p4 shares nothing with an opener and opens the third
    assert got == {1: ["p0", "p2", "p5"], 2: ["p1", "p3"], 3: ["p4", "p6"]}
