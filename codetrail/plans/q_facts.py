"""Registered queries: code facts from parser listings and fact rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.functions.lineage import materialize
from codetrail.operators import facts as X
from codetrail.plans.oracle_carriers import with_carriers
from codetrail.plans.registry import query
from codetrail.sources.carriers import Landed

KEYS = ["repo", "idx", "path"]
_FAILED = "(fno = 6 AND k = 1)"
_PATH = "'src/F' || CAST(fno AS VARCHAR) || '.java'"


@query("x1_calls_from_xml", with_carriers(["xml_units"], f"""
SELECT repo, idx, {_PATH} AS path, CAST(rl - 1 AS INTEGER) AS unit_pos, api AS name, n_args, line
FROM xml_units WHERE NOT {_FAILED}"""))
def q_x1(spark, sf):
    return X.calls_from_xml(Landed.get(spark, sf).listing("calls_xml"))


_X3 = f"""
SELECT repo, idx, {_PATH} AS path, CAST(rl - 1 AS INTEGER) AS unit_pos, name, n_args, varargs,
       false AS is_constructor, line AS line_start, line_end FROM xml_units
UNION ALL
SELECT repo, idx, path, CAST(k AS INTEGER), 'F' || CAST(fno AS VARCHAR), 0, false, true,
       CAST(k + 1 AS INTEGER), CAST(k + 1 AS INTEGER) FROM parsed_files WHERE k % 2 = 0"""


@query("x3_declarations_from_xml", with_carriers(["xml_units", "parsed_files"], _X3))
def q_x3(spark, sf):
    return X.declarations_from_xml(Landed.get(spark, sf).listing("decls_xml"))


@query("x3_malformed_units", with_carriers(["parsed_files"], """
SELECT repo, idx, path, CAST(k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + 1 AS BIGINT) AS n_units,
       CAST(1 AS BIGINT) AS n_malformed FROM parsed_files"""))
def q_x3_malformed(spark, sf):
    return X.malformed_units(Landed.get(spark, sf).listing("decls_xml"), "decls_xml")


@query("x4_declaration_spans_from_xml", with_carriers(["xml_units"], f"""
SELECT repo, idx, {_PATH} AS path, CAST(rl - 1 AS INTEGER) AS k, name, line AS line_start, line_end
FROM xml_units WHERE fno <> 0"""))
def q_x4(spark, sf):
    return X.declaration_spans_from_xml(Landed.get(spark, sf).listing("spans_xml"))


@query("x5_types_from_xml", with_carriers(["parsed_files"], """
SELECT repo, idx, path, 0 AS k, 'F' || CAST(fno AS VARCHAR) AS name, CAST(k + 1 AS INTEGER) AS line_start,
       CAST(2 * k + 2 AS INTEGER) AS line_end FROM parsed_files"""))
def q_x5(spark, sf):
    return X.types_from_xml(Landed.get(spark, sf).listing("types_xml"))


@query("x6_add_default_constructors", with_carriers(["xml_units", "parsed_files"], f"""
SELECT repo, idx, path, name, n_args, varargs, is_constructor, line_start, line_end FROM ({_X3}) d
UNION ALL
SELECT repo, idx, path, 'F' || CAST(fno AS VARCHAR), 0, false, true, CAST(k + 1 AS INTEGER), CAST(2 * k + 2 AS INTEGER)
FROM parsed_files WHERE k % 2 = 1"""))
def q_x6(spark, sf):
    L = Landed.get(spark, sf)
    return X.add_default_constructors(X.declarations_from_xml(L.listing("decls_xml")), X.types_from_xml(L.listing("types_xml")))


@query("x7_distinct_facts", with_carriers(["decls"], """
SELECT repo, idx, path, name, n_args, varargs, is_constructor, line_start, line_end FROM decls"""))
def q_x7(spark, sf):
    return Landed.get(spark, sf).decls


@query("x8_drop_failed_parses", with_carriers(["parsed_files"], f"""
SELECT repo, idx, path FROM parsed_files WHERE NOT {_FAILED}"""))
def q_x8(spark, sf):
    return X.drop_failed_parses(Landed.get(spark, sf).listing("calls_xml"), "calls_xml").select(*KEYS)


def _raw_calls(L: Landed):
    """Raw call facts as a compiler front end lands them: one row per call site (``call_facts``)."""
    c = L.call_facts
    cls = F.when(F.col("name").startswith("promo"), F.lit("java.lang.Promo")).otherwise(
        F.concat(F.lit("org.lib."), F.substring_index("name", "_", 1)))
    return c.select(F.col("repo").alias("project"), "idx", "path", cls.alias("cls"),
                    F.lit(None).cast("string").alias("return_type"), "name",
                    F.lit(None).cast("string").alias("arg_types"), "n_args", "line")


_RAW_CALLS = f"""
raw_calls AS (
  SELECT repo AS project, idx, {_PATH} AS path,
         CASE WHEN starts_with(api, 'promo') THEN 'java.lang.Promo' ELSE 'org.lib.' || split_part(api, '_', 1) END AS cls,
         api AS name, n_args, line
  FROM xml_units),
inv AS (
  SELECT project, idx, path, cls, name, n_args, list_sort(list(line)) AS lines, count(*) AS cnt
  FROM raw_calls GROUP BY ALL)"""


def _calls_sql(body: str) -> str:
    base = with_carriers(["xml_units"], "SELECT 1")
    return base[: -len("\nSELECT 1")] + "," + _RAW_CALLS + "\n" + body


@query("x9_invocations_per_file", _calls_sql("""
SELECT project, idx, path, cls, name, n_args, array_to_string(lines, ',') AS lines, CAST(cnt AS BIGINT) AS count,
       starts_with(cls, 'java.') AS is_java FROM inv"""))
def q_x9(spark, sf):
    i = X.invocations_per_file(_raw_calls(Landed.get(spark, sf)), keys=("project", "idx", "path"))
    return i.select("project", "idx", "path", "cls", "name", "n_args", F.array_join("lines", ",").alias("lines"),
                    F.col("count").cast("long").alias("count"), "is_java")


@query("x10_declared_members", with_carriers(["decls"], """
SELECT repo, idx, path, name,
       CASE n_args WHEN 0 THEN '' WHEN 1 THEN 'int' ELSE 'int, int' END AS args_types, n_args,
       line_start % 2 = 0 AS has_javadoc,
       CASE WHEN line_start % 2 = 0 THEN line_start - 1 ELSE -1 END AS javadoc_line_start,
       CASE WHEN line_start % 2 = 0 THEN line_start - 1 ELSE -1 END AS javadoc_line_end,
       NOT varargs AS has_body
FROM decls"""))
def q_x10(spark, sf):
    d = Landed.get(spark, sf).decls
    even = F.col("line_start") % 2 == 0
    x = d.select("repo", "idx", "path", "name", F.array_repeat(F.lit("int"), F.col("n_args")).alias("arg_type_list"),
                 F.when(even, F.lit("/** doc */")).alias("javadoc"),
                 F.when(even, F.col("line_start") - 1).alias("javadoc_line_start"),
                 F.when(even, F.col("line_start") - 1).alias("javadoc_line_end"),
                 F.when(~F.col("varargs"), F.lit("{}")).alias("body"))
    return X.declared_members(x).select("repo", "idx", "path", "name", "args_types", "n_args", "has_javadoc",
                                        "javadoc_line_start", "javadoc_line_end", "has_body")


def _members(L: Landed):
    li = L.live_items
    ln = F.col("l_linenumber")
    modifier = F.when(ln % 3 == 0, "public").when(ln % 3 == 1, "").otherwise("private")
    kind = (F.when(F.col("p_size") % 4 == 0, "class").when(F.col("p_size") % 4 == 1, "interface")
            .when(F.col("p_size") % 4 == 2, "enum").otherwise("annotation"))
    tmod = F.when(F.col("p_size") % 5 == 0, "").otherwise("public")
    owner = F.struct(kind.alias("kind"), F.concat(F.lit("F"), F.col("fno").cast("string")).alias("name"), tmod.alias("modifier"))
    anon = F.struct(F.lit("anonymous").alias("kind"), F.lit("").alias("name"), F.lit("").alias("modifier"))
    anc = F.when(ln == 7, F.array(anon, owner)).otherwise(F.array(owner))
    return li.select(F.col("repo").alias("project"), "idx", path_col(), "name", modifier.alias("modifier"),
                     anc.alias("ancestors"), F.concat(F.lit("org.app.F"), F.col("fno").cast("string")).alias("qualified_class"),
                     "l_linenumber", "l_partkey", "l_suppkey")


def path_col():
    return F.concat(F.lit("src/F"), F.col("fno").cast("string"), F.lit(".java")).alias("path")


_MEMBERS = f"""
members AS (
  SELECT repo AS project, idx, {_PATH} AS path, name, l_linenumber, l_partkey, l_suppkey, fno,
         CASE l_linenumber % 3 WHEN 0 THEN 'public' WHEN 1 THEN '' ELSE 'private' END AS modifier,
         CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'enum' ELSE 'annotation' END AS tkind,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE 'public' END AS tmod
  FROM live_items),
vis AS (
  SELECT *, CASE WHEN modifier = 'private' THEN false
                 WHEN l_linenumber = 7 THEN false
                 WHEN tmod = '' THEN false
                 WHEN modifier = 'public' THEN true
                 ELSE tkind IN ('interface', 'annotation') END AS is_public
  FROM members)"""


def _members_sql(body: str) -> str:
    base = with_carriers(["live_items"], "SELECT 1")
    return base[: -len("\nSELECT 1")] + "," + _MEMBERS + "\n" + body


@query("x11_effective_visibility", _members_sql("""
SELECT project, idx, path, name, l_linenumber, l_partkey, l_suppkey, is_public FROM vis"""))
def q_x11(spark, sf):
    m = X.effective_visibility(_members(Landed.get(spark, sf)))
    return m.select("project", "idx", "path", "name", "l_linenumber", "l_partkey", "l_suppkey", "is_public")


@query("x12_drop_local_types", _members_sql("""
SELECT project, idx, path, name, l_linenumber, l_partkey, l_suppkey FROM members WHERE l_linenumber <> 7"""))
def q_x12(spark, sf):
    m = X.drop_local_types(_members(Landed.get(spark, sf)))
    return m.select("project", "idx", "path", "name", "l_linenumber", "l_partkey", "l_suppkey")


def _types(L: Landed):
    f = L.live_files
    fno = F.col("fno").cast("string")
    anc = F.when(F.col("fno") % 2 == 1, F.array(F.struct(F.lit("class").alias("kind"),
                                                         F.concat(F.lit("Outer"), fno).alias("name"),
                                                         F.lit("public").alias("modifier")))) \
        .otherwise(F.array().cast("array<struct<kind:string,name:string,modifier:string>>"))
    kind = (F.when(F.col("fno") % 4 == 0, "class").when(F.col("fno") % 4 == 1, "interface")
            .when(F.col("fno") % 4 == 2, "enum").otherwise("annotation"))
    return f.select(F.col("repo").alias("project"), "idx", "path", F.concat(F.lit("F"), fno).alias("name"),
                    anc.alias("ancestors"), (F.col("k") % 2 == 0).alias("resolved"),
                    F.concat(F.lit("bound.F"), fno).alias("binding_name"), kind.alias("kind"), "fno", "k")


def _packages(L: Landed):
    f = L.live_files
    main = f.select(F.col("repo").alias("project"), "path",
                    F.concat(F.lit("org.app.p"), (F.col("fno") % 3).cast("string")).alias("package"), F.lit("src").alias("dir"))
    extra = f.filter(F.col("k") >= 3).select(F.col("repo").alias("project"), "path", F.lit("org.app.extra").alias("package"),
                                             F.lit("src").alias("dir"))
    return main.unionByName(extra)


_TYPES = f"""
tfiles AS (SELECT repo AS project, idx, {_PATH} AS path, fno, k FROM parsed_files),
pk AS (SELECT DISTINCT repo AS project, {_PATH} AS path, 'org.app.p' || CAST(fno % 3 AS VARCHAR) AS package, 'src' AS dir
       FROM parsed_files
       UNION ALL
       SELECT DISTINCT repo, {_PATH}, 'org.app.extra', 'src' FROM parsed_files WHERE k >= 3),
pk1 AS (SELECT project, path, min(package) AS package FROM pk GROUP BY ALL),
qt AS (
  SELECT t.project, t.idx, t.path, 'F' || CAST(t.fno AS VARCHAR) AS name,
         CASE WHEN t.k % 2 = 0 THEN 'bound.F' || CAST(t.fno AS VARCHAR)
              ELSE concat_ws('.', p.package, CASE WHEN t.fno % 2 = 1 THEN 'Outer' || CAST(t.fno AS VARCHAR) END,
                             'F' || CAST(t.fno AS VARCHAR)) END AS qualified_name,
         t.k % 2 = 0 AS resolved,
         CASE t.fno % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind_code
  FROM tfiles t LEFT JOIN pk1 p ON p.project = t.project AND p.path = t.path)"""


def _types_sql(body: str) -> str:
    base = with_carriers(["parsed_files"], "SELECT 1")
    return base[: -len("\nSELECT 1")] + "," + _TYPES + "\n" + body


def _qualified(L: Landed):
    """Package per file for unresolved types: the first (smallest) declared package."""
    pk = _packages(L).groupBy("project", "path").agg(F.min("package").alias("package"))
    return X.qualified_type_name(_types(L), pk, keys=("project", "path"))


@query("x13_qualified_type_name", _types_sql("SELECT project, idx, path, name, qualified_name FROM qt"))
def q_x13(spark, sf):
    return _qualified(Landed.get(spark, sf)).select("project", "idx", "path", "name", "qualified_name")


@query("x14_type_declarations", _types_sql("""
SELECT DISTINCT project, path, qualified_name, kind_code, resolved FROM qt"""))
def q_x14(spark, sf):
    return X.type_declarations(_qualified(Landed.get(spark, sf)))


@query("x15_package_declarations", _types_sql("SELECT DISTINCT project, package, dir FROM pk"))
def q_x15(spark, sf):
    return X.package_declarations(_packages(Landed.get(spark, sf)))[0]


@query("x15_multi_package_files", _types_sql("""
SELECT project, path, CAST(count(DISTINCT package) AS BIGINT) AS n_packages FROM pk GROUP BY ALL
HAVING count(DISTINCT package) > 1"""))
def q_x15b(spark, sf):
    return X.package_declarations(_packages(Landed.get(spark, sf)))[1]


@query("x16_public_members", (lambda b: b[: -len("\nSELECT 1")])(with_carriers(["xml_units", "live_items"], "SELECT 1"))
       + "," + _RAW_CALLS + "," + _MEMBERS + """
SELECT DISTINCT project, 'org.app.F' || CAST(fno AS VARCHAR) AS cls, name, 'method' AS kind FROM vis WHERE is_public
UNION ALL
SELECT DISTINCT repo, 'org.app.F' || CAST(fno AS VARCHAR), 'field_' || CAST(l_linenumber AS VARCHAR), 'field'
FROM live_items WHERE p_size % 2 = 0
UNION ALL
SELECT DISTINCT project, cls, name, 'call' FROM raw_calls""")
def q_x16(spark, sf):
    L = Landed.get(spark, sf)
    m = X.effective_visibility(_members(L)).select("project", F.col("qualified_class").alias("cls"), "name", "is_public")
    fields = L.live_items.select(
        F.col("repo").alias("project"), F.concat(F.lit("org.app.F"), F.col("fno").cast("string")).alias("cls"),
        F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("name"),
        (F.col("p_size") % 2 == 0).alias("is_public"))
    calls = _raw_calls(L).select("project", "cls", "name")
    pm = X.public_members(m.distinct(), fields.distinct(), calls)
    return pm


@query("x17_relevant_files", with_carriers(["snapshots", "parsed_files"], f"""
SELECT s.repo, s.idx, s.path, s.content, CAST(len(string_split(s.content, chr(10))) AS INTEGER) AS n_lines
FROM snapshots s JOIN parsed_files p ON p.repo = s.repo AND p.idx = s.idx AND p.path = s.path
WHERE NOT (p.fno = 6 AND p.k = 1)"""))
def q_x17(spark, sf):
    L = Landed.get(spark, sf)
    return X.relevant_files(L.snapshots, X.calls_from_xml(L.listing("calls_xml")))


@query("x19_merge_projects", with_carriers(["parsed_files"], """
SELECT DISTINCT repo, path, 'F' || CAST(fno AS VARCHAR) AS name FROM parsed_files"""))
def q_x19(spark, sf):
    L = Landed.get(spark, sf)
    types = materialize(X.types_from_xml(L.listing("types_xml")))
    t = types.select("repo", "path", "name")
    c = X.add_default_constructors(X.declarations_from_xml(L.listing("decls_xml")), types).filter(
        F.col("is_constructor")).select("repo", "path", "name")
    return X.merge_projects(t, None, c)


@query("x20_extraction_report", (lambda b: b[: -len("\nSELECT 1")])(with_carriers(["xml_units", "decls", "parsed_files"], "SELECT 1"))
       + "," + _RAW_CALLS + "," + _TYPES + """
SELECT (SELECT CAST(sum(cnt) AS BIGINT) FROM inv) AS n_calls, (SELECT CAST(count(*) AS BIGINT) FROM inv) AS n_unique_calls,
       (SELECT CAST(count(*) AS BIGINT) FROM decls) AS n_declarations,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT project, package, dir FROM pk)) AS n_packages,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT project, path, qualified_name, kind_code, resolved FROM qt))
         AS n_types""")
def q_x20(spark, sf):
    L = Landed.get(spark, sf)
    inv = X.invocations_per_file(_raw_calls(L), keys=("project", "idx", "path"))
    pk, _ = X.package_declarations(_packages(L))
    return X.extraction_report(inv, L.decls, pk, X.type_declarations(_qualified(L))).select(
        F.col("n_calls").cast("long").alias("n_calls"), F.col("n_unique_calls").cast("long").alias("n_unique_calls"),
        F.col("n_declarations").cast("long").alias("n_declarations"), F.col("n_packages").cast("long").alias("n_packages"),
        F.col("n_types").cast("long").alias("n_types"))
