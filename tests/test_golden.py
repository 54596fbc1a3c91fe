"""Golden rows (FIXTURES.md section 2): literal inputs with hand-derived expected outputs."""

from pyspark.sql import functions as F

from codetrail.functions.calls import calls_from_text
from codetrail.operators import deps as R
from codetrail.operators import diffs as D
from codetrail.operators import facts as X
from codetrail.operators import history as H
from codetrail.operators import pages as Lp
from codetrail.operators import replace as G


def test_h1_commit_log(spark):
    df = spark.createDataFrame([("r", 0, "abc,fix a, b"), ("r", 1, "abc")], "repo string, pos int, line string")
    got = sorted((r.sha, r.subject) for r in H.parse_commit_log(df).collect())
    assert got == [("abc", ""), ("abc", "fix a")]


def test_h3_name_status(spark):
    lines = ["A\tx.java", "R100\ta.java\tb.java", "C75\ta.java\tc.java", "T\td.java",
             "warning: inexact rename detection was skipped due to too many files."]
    df = spark.createDataFrame([("r", 1, l) for l in lines], "repo string, idx int, line string")
    got = {(r.kind, r.old_path, r.path) for r in H.parse_name_status(df).collect()}
    assert got == {("A", None, "x.java"), ("R", "a.java", "b.java"), ("C", "a.java", "c.java"), ("other", None, "d.java")}
    s = H.commit_change_summary(H.parse_name_status(df)).collect()[0]
    assert s.total == 4 and s.n_added == 2 and s.n_renamed == 1 and s.n_other == 1


def test_h5_expand_changes(spark):
    df = spark.createDataFrame([("r", 1, "M", "x", "x"), ("r", 1, "R", "a", "b")],
                               "repo string, idx int, kind string, old_path string, path string")
    got = {(r.event, r.path, r.old_path, r.edit_rank) for r in H.expand_changes(df).collect()}
    assert got == {("delete", "x", None, None), ("add", "x", None, None), ("edit", "x", "x", 1),
                   ("delete", "a", None, None), ("add", "b", None, None), ("edit", "b", "a", 0)}


def test_h9_same_commit_delete_and_add(spark):
    ev = spark.createDataFrame([("r", "p", 1, "add"), ("r", "p", 3, "delete"), ("r", "p", 3, "add"),
                                ("r", "p", 5, "delete"), ("r", "q", 2, "add")],
                               "repo string, path string, idx int, event string")
    got = sorted(tuple(r) for r in H.file_intervals(ev, width=2).collect())
    assert got == [("r", "p", 1, 3), ("r", "p", 3, 5), ("r", "q", 2, None)]


def _diff(spark, text):
    return spark.createDataFrame([("r", 1, "f", "f", text)],
                                 "repo string, idx int, old_path string, path string, word_diff string")


def test_d1_line_numbers(spark):
    text = "\n".join(["diff --git a/f b/f", "--- a/f", "+++ b/f", "@@ -10,3 +20,3 @@",
                      "{+a+}", "[-b-]{+c+}", "", "[-d-]", "e"])
    got = [(r.before, r.after) for r in D.diff_lines(_diff(spark, text)).orderBy("pos").collect()]
    assert got == [(10, 20), (10, 21), (11, 22), (12, 23), (13, 23)]


def test_d2_word_diff_pair(spark):
    text = "@@ -1 +1 @@\nif[-(line.getWords().size()-]{+(line.words().size()+} > 0) {"
    got = [(r.removed, r.added) for r in D.paired_replacements(D.diff_lines(_diff(spark, text))).collect()]
    assert got == [("(line.getWords().size()", "(line.words().size()")]


def test_d3_unpaired(spark):
    text = "@@ -1 +1 @@\na [-x-] b {+y+} [-p-]{+q+}"
    got = {(r.side, r.removed, r.added) for r in D.unpaired_changes(D.diff_lines(_diff(spark, text))).collect()}
    assert got == {("removed", "x", None), ("added", None, "y")}


def test_d4_imports(spark):
    df = spark.createDataFrame([("r", 1, "f", "f", "+import a.B;\n-import c.D;")],
                               "repo string, idx int, old_path string, path string, line_diff string")
    r = D.import_changes(df).collect()[0]
    assert r.added == ["a.B;"] and r.removed == ["c.D;"]


def test_d6_ranges(spark):
    df = spark.createDataFrame([("r", 1, "f", "f", "@@ -1,5 +7,3 @@\nx\n@@ -1 +7 @@")],
                               "repo string, idx int, old_path string, path string, line_diff string")
    got = [(r.start, r.end) for r in D.modified_line_ranges(df).orderBy("pos").collect()]
    assert got == [(7, 9), (7, 7)]


def test_d7_size_flags_drop_nothing(spark):
    pairs = spark.createDataFrame([("r", 1, "a", "a", i) for i in range(5)] + [("r", 1, "b", "b", 0), ("r", 2, "a", "a", 0)],
                                  "repo string, idx int, old_path string, path string, k int")
    edited = spark.createDataFrame([("r", 1, f"f{i}") for i in range(21)] + [("r", 2, "a")], "repo string, idx int, path string")
    got = D.size_guard(pairs, edited, max_pairs=3, warn_pairs=0)
    assert got.count() == 7
    flags = {(r.idx, r.path): (r.n_edited, r.n_pairs, r.many_files, r.many_pairs, r.many_changes) for r in got.collect()}
    assert flags == {(1, "a"): (21, 5, True, True, True), (1, "b"): (21, 1, True, False, True), (2, "a"): (1, 1, False, False, True)}


def _calls(spark, *codes):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    rows = df.select("i", calls_from_text(F.col("c")).alias("k")).orderBy("i").collect()
    return [None if r.k is None else [(c.name, c.n_args) for c in r.k] for r in rows]


def test_x2_calls_from_text(spark):
    same = ["Function(12)", "Function<A>(12)", "BBB.CCC<ct>.Function<Generic.Type>(12)"]
    got = _calls(spark, *same, "obj.X().X().obj.Y().foo().Z()", "(line.getWords().size()")
    assert got[:3] == [[("Function", 1)]] * 3
    assert [n for n, _ in got[3]] == ["X", "X", "Y", "foo", "Z"]
    assert got[4] == [("getWords", 0), ("size", 0)]


def test_x2_comments_literals_declarations_annotations(spark):
    got = _calls(spark, "a(); // b()", "/* old(1) */ z()", "public void foo(int a) {", "@Anno(value=1) void m()",
                 'foo("a,b(", \'c\')', "if (a(b)) return c(d, e)", "Map<String, List<A>> m = f(x<y>(1), 2)",
                 "foo(a, (b, c), {1,2}, d[e(1,2)])", "open(a, b", 'String s = "unterminated (', "super(a); this()", "", None)
    assert got == [[("a", 0)], [("z", 0)], [], [], [("foo", 2)], [("a", 1), ("c", 2)], [("f", 2), ("x", 1)],
                   [("foo", 4), ("e", 2)], [("open", 2)], [], [("super", 1), ("this", 0)], [], None]


def test_d1_strips_unicode_white_space(spark):
    text = "@@ -1 +1 @@\n\u3000{+a+}\u2003\n\u2028b"
    got = [(r.line, r.before, r.after) for r in D.diff_lines(_diff(spark, text)).orderBy("pos").collect()]
    assert got == [("{+a+}", 1, 1), ("b", 1, 2)]


def test_d1_long_file_crosses_blocks(spark):
    """More lines than a block of the running sums, several hunks and a reset."""
    lines, want, b, a = [], [], 0, 0
    for h in range(4):
        b, a = 1000 * h + 5, 1000 * h + 9
        lines += ["diff --git a/f b/f", "ignored"] if h == 2 else []
        lines.append(f"@@ -{b},9 +{a},9 @@")
        for k in range(170):
            lines.append(["x", "{+n+}", "[-o-]", "[-o-]{+n+}"][k % 4])
            want.append((len(lines) - 1, h + 1, b, a))
            b, a = b + (k % 4 != 1), a + (k % 4 not in (2,))
    got = [(r.pos, r.hunk, r.before, r.after) for r in D.diff_lines(_diff(spark, "\n".join(lines))).orderBy("pos").collect()]
    # a replaced line starts with [- and ends with +}, so it counts on both sides
    assert got == want


def _xml(spark, col, body):
    return spark.createDataFrame([("r", 1, "f", body)], f"repo string, idx int, path string, {col} string")


def test_x1_calls_from_xml(spark):
    unit = ('<unit revision="1.0.0" item="1"><call><name><name>BBB</name><operator>.</operator><name><name>CCC</name>'
            '<argument_list type="generic">&lt;<argument><name>ct</name></argument>&gt;</argument_list></name>'
            '<operator>.</operator><name><name>Function</name><argument_list type="generic">&lt;<argument><name>'
            '<name>Generic</name><operator>.</operator><name>Type</name></name></argument>&gt;</argument_list>'
            '</name></name><argument_list pos:start="3:40">(<argument><expr><literal>12</literal></expr></argument>)'
            '</argument_list></call></unit>')
    got = X.calls_from_xml(_xml(spark, "calls_xml", '<unit xmlns="x">\n' + unit + "\n</unit>")).collect()
    assert [(r.name, r.n_args, r.line) for r in got] == [("Function", 1, 3)]
    one_line = X.calls_from_xml(_xml(spark, "calls_xml", "<unit/>")).count()
    failed = X.calls_from_xml(_xml(spark, "calls_xml", "srcML translator error\n" + unit)).count()
    assert one_line == 0 and failed == 0


def test_x3_varargs(spark):
    unit = ('<unit revision="1.0.0" item="1"><function pos:start="5:5" pos:end="9:5"><name>f</name><parameter_list>('
            '<parameter><decl><type><name>String</name></type> <name>a</name></decl></parameter>, <parameter><decl>'
            '<type><name>int</name>...</type> <name>b</name></decl></parameter>)</parameter_list></function></unit>')
    r = X.declarations_from_xml(_xml(spark, "decls_xml", "<unit>\n" + unit + "\n</unit>")).collect()[0]
    assert (r.name, r.n_args, r.varargs, r.line_start, r.line_end) == ("f", 1, True, 5, 9)


def test_x4_spans(spark):
    body = "\n".join(['<unit>', '<unit revision="1" item="1">start="18:5"</unit>', '<unit revision="1" item="2">end="65:5"</unit>',
                      '<unit revision="1" item="3">main</unit>', '<unit revision="1" item="4">start="71:5"</unit>',
                      '<unit revision="1" item="5">end="104:5"</unit>', '<unit revision="1" item="6">ReadListOfImpactedFiles</unit>',
                      '</unit>'])
    got = [(r.name, r.line_start, r.line_end) for r in X.declaration_spans_from_xml(_xml(spark, "spans_xml", body)).orderBy("k").collect()]
    assert got == [("main", 18, 65), ("ReadListOfImpactedFiles", 71, 104)]


def test_x5_types_skip_anonymous(spark):
    units = ['start="90:1"', 'end="3959:1"', "ActiveServices", 'start="156:46"', 'end="162:5"',
             'start="168:5"', 'end="182:5"', "ActiveForegroundApp"]
    body = "<unit>\n" + "\n".join(f'<unit revision="1" item="{i + 1}">{u}</unit>' for i, u in enumerate(units)) + "\n</unit>"
    got = [(r.name, r.line_start, r.line_end) for r in X.types_from_xml(_xml(spark, "types_xml", body)).orderBy("k").collect()]
    assert got == [("ActiveServices", 90, 3959), ("ActiveForegroundApp", 168, 182)]


def test_x11_visibility(spark):
    t = "struct<kind:string,name:string,modifier:string>"
    rows = [("a", "", [("interface", "I", "public")]), ("b", "", [("class", "C", "public")]),
            ("c", "public", [("class", "C", "")]), ("d", "public", [("anonymous", "", ""), ("class", "C", "public")]),
            ("e", "public", [("class", "In", "public"), ("class", "Out", "public")]), ("f", "private", [("class", "C", "public")])]
    df = spark.createDataFrame(rows, f"name string, modifier string, ancestors array<{t}>")
    got = {r.name: r.is_public for r in X.effective_visibility(df).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False}


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "removed string, added string")


def _first_change(spark, rows):
    from codetrail.functions.calls import calls_from_text
    p = _pairs(spark, rows).withColumn("removed_calls", calls_from_text(F.col("removed"))) \
        .withColumn("added_calls", calls_from_text(F.col("added")))
    c = G.drop_pure_add_remove(G.common_calls(G.comparable_pairs(p)))
    return {(r.removed, r.old_name, r.new_name) for r in G.first_changed_call(c).collect()}


def test_g4_golden(spark):
    rows = [("obj.X().X().obj.Y().foo().Z()", "lib.X().lib.Y().bar().Z()"),
            ("X().Y().foo().Z()", "X().Y().bar().Z()"),
            ("foo(a)", "bar(a)")]
    got = _first_change(spark, rows)
    assert got == {("obj.X().X().obj.Y().foo().Z()", "foo", "bar"), ("foo(a)", "foo", "bar")}


def test_g3_only_additions_dropped(spark):
    assert _first_change(spark, [("X()", "X().Y()")]) == set()


def test_g5_non_api_names(spark):
    df = spark.createDataFrame([("assertTrue",), ("super",), ("this",), ("get",)], "new_name string")
    assert [r.new_name for r in G.drop_non_api_names(df).collect()] == ["get"]


def test_g6_varargs_arity(spark):
    decls = spark.createDataFrame([("r", "p", "f", 1, True, 1, None)],
                                  "repo string, path string, name string, n_args int, varargs boolean, valid_from int, valid_to int")
    calls = spark.createDataFrame([("r", 2, "f", n) for n in (0, 1, 3)], "repo string, idx int, name string, n_args int")
    assert sorted(r.n_args for r in G.was_local_before(calls, decls).collect()) == [1, 3]


def test_g10_render(spark):
    from codetrail.functions.calls import render_call
    df = spark.createDataFrame([("f", 2, "a.b.C")], "name string, n_args int, cls string")
    call = F.struct("name", "n_args")
    r = df.select(render_call(call).alias("a"), render_call(call, True, F.col("cls")).alias("b")).collect()[0]
    assert (r.a, r.b) == ("f(2)", "[C] f(2)")


def test_g11_overlap_fold_not_transitive(spark):
    rows = [("r", 1, "o", 0, "n", 0, 1, "p1", i, 0, "p1", i, i, pk) for i, pk in enumerate([["p"], ["p", "q"], ["q"]])]
    df = spark.createDataFrame(rows, "repo string, idx int, old_name string, old_n_args int, new_name string, new_n_args int, "
                                     "edit_rank int, path string, pos int, k int, old_path string, before int, after int, "
                                     "packages array<string>")
    got = sorted((r["gid"], r["count"]) for r in G.group_replacements(G.group_members(df)).collect())
    assert got == [(1, 2), (2, 1)]


def test_g12_render_occurrences(spark):
    rows = [("g", 0, "a", "a", 9, 0, 5, 6), ("g", 0, "a", "a", 4, 0, 1, 2), ("g", 0, None, "b", 1, 0, 3, 4),
            ("g", 1, "0", "0", 0, 1, 7, 8), ("g", 1, "0", "0", 0, 0, 9, 9), ("h", 1, "x", "y", 20000, 0, 1, 1), ("h", 1, "x", "y", 3, 0, 2, 2)]
    occ = spark.createDataFrame(rows, "gid string, edit_rank int, old_path string, path string, pos int, k int, before int, after int")
    got = {r.gid: r.replacement_paths for r in G.render_occurrences(occ, ["gid"]).collect()}
    assert got == {"g": '("a"->"a"|[1,2][5,6]), ("null"->"b"|[3,4]), ("0"->"0"|[9,9][7,8])', "h": '("x"->"y"|[2,2][1,1])'}


def test_g16_g17_body(spark):
    content = "l1\nl2\nl3\nl4\nl5"
    snaps = spark.createDataFrame([("r", 1, "F.java", content)], "repo string, idx int, path string, content string")
    iv = spark.createDataFrame([("r", "F.java", 1, None)], "repo string, path string, valid_from int, valid_to int")
    t = "struct<path:string,line_start:int,line_end:int,is_constructor:boolean>"
    groups = spark.createDataFrame([("r", 2, "g", ("F.java", 2, 4, False)), ("r", 2, "h", ("F.java", 2, 5, False))],
                                   f"repo string, idx int, new_name string, old_decl {t}")
    got = {r.new_name: r.old_body for r in G.declaration_body(groups, snaps, iv).collect()}
    assert got == {"g": "l2\nl3\nl4", "h": None}
    bodies = spark.createDataFrame([("int f(){return new X().g();}", "g"), ("int f()", "g")], "old_body string, new_name string")
    assert [r.old_body for r in G.drop_already_using(bodies).collect()] == ["int f()"]


def test_r2_resolution(spark):
    inv = spark.createDataFrame([(i, "r", c, False, False) for i, c in enumerate(["A", "B", "C", "D"])],
                                "inv_id int, repo string, cls string, is_local boolean, is_java boolean")
    deps = spark.createDataFrame([("r", "g", "a", "1"), ("r", "g", "a", "2"), ("r", "h", "b", "1")],
                                 "repo string, group string, artifact string, version string")
    classes = spark.createDataFrame([("g:a:1", "A"), ("g:a:1", "B"), ("g:a:2", "B"), ("g:a:1", "C"), ("h:b:1", "C"),
                                     ("z:z:9", "D")], "library string, class string")
    got = {r.inv_id: r.status for r in R.resolve_external(inv, deps, classes).collect()}
    assert got == {0: "linked", 1: "versions", 2: "libraries", 3: "unlinked"}
    fb = {r.inv_id: r.status for r in R.resolve_external(inv, deps, classes, fallback=True).collect()}
    assert fb[3] == "fallback"


def test_r7_gradle(spark):
    text = "\n".join(["dependencies {", '    implementation("g", "a", "1")', "    testImplementation 'g2:a2:1'", "}",
                      "other {", "    x 'g3:a3:1'", "}"])
    df = spark.createDataFrame([("r", "build.gradle", text)], "repo string, path string, content string")
    assert [(r.group, r.artifact) for r in R.gradle_dependencies(df).orderBy("pos").collect()] == [("g", "a"), ("g2", "a2")]


def test_r11_base_package(spark):
    df = spark.createDataFrame([("p", "a.b.c"), ("p", "a.b"), ("p", "a.b.d")], "project string, package string")
    assert R.base_packages(df).first().package == "a.b"


def test_r12_import_section(spark):
    files = spark.createDataFrame([("r", 1, "F", "import a.b.X;\nclass Q {\nimport a.b.Y;")],
                                  "repo string, idx int, path string, content string")
    pk = spark.createDataFrame([("a.b",), ("zz",)], "package string")
    rows = R.imported_targets(files, pk).collect()
    assert [r.packages for r in rows] == [["a.b"]]


def test_r14_wildcards(spark):
    libs = spark.createDataFrame([("org.apache.commons", "commons-jcs3-*", "*")], "group string, artifact string, version string")
    arts = spark.createDataFrame([("org.apache.commons", "commons-jcs3-core", "3.0"), ("org.apache.commons", "commons-jcs-core", "2.0")],
                                 "group string, artifact string, version string")
    assert [r.artifact for r in R.match_library_patterns(libs, arts).collect()] == ["commons-jcs3-core"]


def test_l5_source_archives(spark):
    links = spark.createDataFrame([(t, "https://h/x/" + t) for t in ("x-sources.jar", "x-test-sources.jar", "x.jar")],
                                  "title string, url string")
    assert [r.file_name for r in Lp.source_archives(links).collect()] == ["x-sources.jar"]
