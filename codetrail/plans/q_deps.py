"""Registered queries: dependencies and library knowledge.

Carriers: invocations of every live item (class by line number: a project type,
a ``java.`` class, a library class or a ``javax.`` class), dependencies of each
repository from the types it uses (plus a mirror library for some), library
class lists from ``part``, and Gradle / Maven build files per customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.operators import deps as R
from codetrail.plans.oracle_carriers import with_carriers
from codetrail.plans.q_sources import _library_list, _LIBS
from codetrail.plans.registry import query
from codetrail.sources.carriers import Landed


def _invocations(L: Landed):
    li = L.live_items
    ln = F.col("l_linenumber") % 4
    fno = F.col("fno").cast("string")
    cls = (F.when(ln == 0, F.concat(F.lit("bound.F"), fno)).when(ln == 1, F.lit("java.util.List"))
           .when(ln == 2, F.concat(F.lit("org.lib."), F.lower("p_type"), F.lit("."), F.regexp_replace("p_brand", "#", "")))
           .otherwise(F.concat(F.lit("javax.swing.X"), fno)))
    return li.select(F.concat_ws(":", "repo", "idx", "fno", "rl").alias("inv_id"), F.col("repo").alias("project"),
                     "repo", cls.alias("cls"), "name")


def _project_types(L: Landed):
    # every line declares a type, some of them the one that calls name
    package = F.when(F.col("k") % 2 == 0, F.lit("bound.F")).otherwise(F.lit("apart.F"))
    return L.live_items.select(F.col("repo").alias("project"),
                               F.concat(package, F.col("fno").cast("string")).alias("qualified_name")).distinct()


def _deps(L: Landed):
    li = L.live_items
    main = li.select("repo", F.lit("org.lib").alias("group"), F.lower("p_type").alias("artifact"),
                     F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string")).alias("version"))
    group = F.when((F.col("repo") % 3 == 0) & (F.col("p_size") % 11 == 0), F.lit("org.mirror")).otherwise(F.lit("org.spare"))
    mirror = li.select("repo", group.alias("group"), F.lower("p_type").alias("artifact"), F.lit("1.0").alias("version"))
    return main.unionByName(mirror).distinct()


def _classes(L: Landed):
    p = L.t("part")
    cls = F.concat(F.lit("org.lib."), F.lower("p_type"), F.lit("."), F.regexp_replace("p_brand", "#", ""))
    a = p.select(F.concat(F.lit("org.lib:"), F.lower("p_type"), F.lit(":1."), (F.col("p_size") % 3).cast("string"))
                 .alias("library"), cls.alias("class"))
    mirrored = F.col("p_size") % 11 == 0
    b = p.select(F.concat(F.when(mirrored, F.lit("org.mirror:")).otherwise(F.lit("org.spare:")), F.lower("p_type"), F.lit(":1.0"))
                 .alias("library"), F.when(mirrored, cls).otherwise(F.concat(F.lit("spare."), cls)).alias("class"))
    return a.union(b).distinct()


_R_CTES = """
inv_r AS (
  SELECT CAST(repo AS VARCHAR) || ':' || CAST(idx AS VARCHAR) || ':' || CAST(fno AS VARCHAR) || ':' || CAST(rl AS VARCHAR)
           AS inv_id, repo AS project, repo, name,
         CASE l_linenumber % 4 WHEN 0 THEN 'bound.F' || CAST(fno AS VARCHAR) WHEN 1 THEN 'java.util.List'
              WHEN 2 THEN 'org.lib.' || lower(p_type) || '.' || replace(p_brand, '#', '')
              ELSE 'javax.swing.X' || CAST(fno AS VARCHAR) END AS cls
  FROM live_items),
ptypes AS (SELECT DISTINCT repo AS project, CASE WHEN k % 2 = 0 THEN 'bound.F' ELSE 'apart.F' END || CAST(fno AS VARCHAR)
                  AS qualified_name FROM live_items),
deps AS (
  SELECT DISTINCT repo, 'org.lib' AS "group", lower(p_type) AS artifact, '1.' || CAST(p_size % 3 AS VARCHAR) AS version
  FROM live_items
  UNION
  SELECT DISTINCT repo, CASE WHEN repo % 3 = 0 AND p_size % 11 = 0 THEN 'org.mirror' ELSE 'org.spare' END, lower(p_type), '1.0'
  FROM live_items),
lib_classes AS (
  SELECT DISTINCT 'org.lib:' || lower(p_type) || ':1.' || CAST(p_size % 3 AS VARCHAR) AS library,
         'org.lib.' || lower(p_type) || '.' || replace(p_brand, '#', '') AS class FROM part
  UNION
  SELECT DISTINCT CASE WHEN p_size % 11 = 0 THEN 'org.mirror:' ELSE 'org.spare:' END || lower(p_type) || ':1.0',
         CASE WHEN p_size % 11 = 0 THEN '' ELSE 'spare.' END || 'org.lib.' || lower(p_type) || '.' || replace(p_brand, '#', '')
  FROM part),
local_flag AS (
  SELECT i.*, EXISTS (SELECT 1 FROM ptypes t WHERE t.project = i.project AND t.qualified_name = i.cls) AS is_local,
         starts_with(i.cls, 'java.') AS is_java
  FROM inv_r i),
hits AS (
  SELECT i.inv_id, d."group", d.artifact, d.version
  FROM local_flag i JOIN deps d ON d.repo = i.repo
  JOIN lib_classes c ON c.library = d."group" || ':' || d.artifact || ':' || d.version AND c.class = i.cls
  WHERE NOT i.is_local AND NOT i.is_java),
per AS (
  SELECT inv_id, count(DISTINCT ("group", artifact, version)) AS n_libs, count(DISTINCT ("group", artifact)) AS n_ga,
         min("group" || ':' || artifact || ':' || version) AS lib
  FROM hits GROUP BY inv_id),
fb AS (
  SELECT i.inv_id, min(c.library) AS fb
  FROM local_flag i JOIN lib_classes c ON c.class = i.cls
  WHERE NOT i.is_local AND NOT i.is_java AND i.inv_id NOT IN (SELECT inv_id FROM per)
  GROUP BY i.inv_id),
resolved AS (
  SELECT i.inv_id, i.cls,
         CASE WHEN i.is_local OR i.is_java THEN 'skipped' WHEN p.n_libs = 1 THEN 'linked'
              WHEN p.n_ga = 1 THEN 'versions' WHEN p.n_libs > 1 THEN 'libraries'
              WHEN f.fb IS NOT NULL THEN 'fallback' ELSE 'unlinked' END AS status,
         CASE WHEN i.is_local OR i.is_java THEN NULL WHEN p.n_libs = 1 THEN p.lib WHEN p.n_libs > 1 THEN NULL
              ELSE f.fb END AS library
  FROM local_flag i LEFT JOIN per p USING (inv_id) LEFT JOIN fb f USING (inv_id))"""


def _r_sql(body: str, extra=()) -> str:
    base = with_carriers(["live_items", *extra], "SELECT 1")
    return base[: -len("\nSELECT 1")] + "," + _R_CTES + "\n" + body


def _resolved(L: Landed, fallback: bool = True):
    inv = R.flag_platform_calls(R.resolve_local(_invocations(L), _project_types(L)))
    return R.resolve_external(inv, _deps(L), _classes(L), fallback=fallback)


@query("r1_resolve_local", _r_sql("SELECT inv_id, cls, is_local FROM local_flag"))
def q_r1(spark, sf):
    L = Landed.get(spark, sf)
    return R.resolve_local(_invocations(L), _project_types(L)).select("inv_id", "cls", "is_local")


@query("r4_flag_platform_calls", _r_sql("""
SELECT inv_id, cls, starts_with(cls, 'java.') AS is_java, starts_with(cls, 'javax.') OR starts_with(cls, 'sun.')
       AS is_javax_or_sun FROM inv_r"""))
def q_r4(spark, sf):
    return R.flag_platform_calls(_invocations(Landed.get(spark, sf))).select("inv_id", "cls", "is_java", "is_javax_or_sun")


@query("r2_resolve_external", _r_sql("SELECT inv_id, cls, status, library FROM resolved"))
def q_r2(spark, sf):
    r = _resolved(Landed.get(spark, sf))
    return r.select("inv_id", "cls", "status", F.when(F.col("library").isNotNull(), F.concat_ws(
        ":", "library.group", "library.artifact", "library.version")).alias("library"))


@query("r3_resolution_report", _r_sql("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status <> 'skipped') AS BIGINT) AS considered,
       CAST(count(*) FILTER (WHERE status = 'linked') AS BIGINT) AS linked,
       CAST(count(*) FILTER (WHERE status = 'unlinked') AS BIGINT) AS not_linked,
       CAST(count(*) FILTER (WHERE status = 'unlinked' AND (starts_with(cls, 'javax.') OR starts_with(cls, 'sun.')))
            AS BIGINT) AS not_linked_javax_sun,
       CAST(count(*) FILTER (WHERE status = 'versions') AS BIGINT) AS multi_version,
       CAST(count(*) FILTER (WHERE status = 'libraries') AS BIGINT) AS multi_library,
       CAST(count(*) FILTER (WHERE status = 'fallback') AS BIGINT) AS linked_by_fallback
FROM resolved"""))
def q_r3(spark, sf):
    r = R.resolution_report(_resolved(Landed.get(spark, sf)))
    return r.select(*[F.col(c).cast("long").alias(c) for c in r.columns])


def _catalog_versions(L: Landed):
    c = _classes(L)
    parts = F.split("library", ":")
    return c.select(F.get(parts, 0).alias("group"), F.get(parts, 1).alias("artifact"), F.get(parts, 2).alias("version")).distinct()


def _wanted_deps(L: Landed):
    li = L.live_items
    return li.select("repo", F.lit("org.lib").alias("group"), F.lower("p_type").alias("artifact"),
                     F.concat(F.lit("1."), (F.col("p_size") % 5).cast("string")).alias("version")).distinct()


_R5 = """
cat AS (SELECT DISTINCT split_part(library, ':', 1) AS "group", split_part(library, ':', 2) AS artifact,
               split_part(library, ':', 3) AS version FROM lib_classes),
wanted AS (SELECT DISTINCT repo, 'org.lib' AS "group", lower(p_type) AS artifact, '1.' || CAST(p_size % 5 AS VARCHAR) AS version
           FROM live_items),
latest AS (SELECT "group", artifact, arg_max(version, [CAST(split_part(version, '.', 1) AS INTEGER),
                                                       CAST(split_part(version, '.', 2) AS INTEGER)]) AS latest
           FROM cat GROUP BY ALL)"""


def _r5_sql(body: str) -> str:
    return _r_sql("SELECT 1")[: -len("\nSELECT 1")] + "," + _R5 + body


@query("r5_upgrade_missing_versions", _r5_sql("""
SELECT w.repo, w."group", w.artifact,
       CASE WHEN c.version IS NULL AND l.latest IS NOT NULL THEN l.latest ELSE w.version END AS version,
       c.version IS NULL AND l.latest IS NOT NULL AS upgraded
FROM wanted w LEFT JOIN cat c ON c."group" = w."group" AND c.artifact = w.artifact AND c.version = w.version
LEFT JOIN latest l ON l."group" = w."group" AND l.artifact = w.artifact"""))
def q_r5(spark, sf):
    L = Landed.get(spark, sf)
    return R.upgrade_missing_versions(_wanted_deps(L), _catalog_versions(L)).select(
        "repo", "group", "artifact", "version", "upgraded")


@query("r6_available_dependencies", _r5_sql("""
SELECT DISTINCT w."group", w.artifact, w.version FROM wanted w
WHERE EXISTS (SELECT 1 FROM cat c WHERE c."group" = w."group" AND c.artifact = w.artifact AND c.version = w.version)"""))
def q_r6(spark, sf):
    L = Landed.get(spark, sf)
    return R.available_dependencies(_wanted_deps(L), _catalog_versions(L))[0]


@query("r6_missing_dependencies", _r5_sql("""
SELECT DISTINCT w."group", w.artifact, w.version FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c."group" = w."group" AND c.artifact = w.artifact AND c.version = w.version)"""))
def q_r6b(spark, sf):
    L = Landed.get(spark, sf)
    return R.available_dependencies(_wanted_deps(L), _catalog_versions(L))[1]


# ---- build files: per repository, coordinates of the libraries it uses
def _build_coords(L: Landed):
    li = L.live_items
    t = F.lower("p_type")
    g = F.when(t == "small", F.lit("commons-io")).when(t == "large", F.lit("org.apache.commons")).otherwise(F.lit("org.lib"))
    return li.select("repo", g.alias("group"), F.concat(F.lit("lib-"), t).alias("artifact"),
                     F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string")).alias("version"),
                     (F.col("p_size") % 2 == 0).alias("call_form")).distinct()


def _build_files(L: Landed):
    c = _build_coords(L)
    line = F.when(F.col("call_form"), F.format_string('    implementation("%s", "%s", "%s")', "group", "artifact", "version")) \
        .otherwise(F.format_string("    testImplementation '%s:%s:%s'", "group", "artifact", "version"))
    # a dependency in call form leaves its version to the parent
    dep = F.when(F.col("call_form"), F.format_string("<dependency><groupId>%s</groupId><artifactId>%s</artifactId></dependency>",
                                                     "group", "artifact")).otherwise(
        F.format_string("<dependency><version>%s</version><groupId>%s</groupId><artifactId>%s</artifactId></dependency>",
                        "version", "group", "artifact"))
    g = c.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("group", "artifact", "version", "call_form",
                                                                   line.alias("gl"), dep.alias("pl")))).alias("_d"))
    gradle = g.select(
        "repo", F.lit("build.gradle").alias("path"),
        F.concat(F.lit("plugins {\n    id 'java'\n}\ndependencies {\n"), F.array_join(F.transform("_d", lambda x: x["gl"]), "\n"),
                 F.lit("\n}\ntask extra {\n    implementation 'late.group:late:1'\n}")).alias("content"))
    # and a Maven file; one in three breaks off, one has another root element
    kind = F.col("repo") % 3
    root = F.when(kind == 2, F.lit("notproject")).otherwise(F.lit("project"))
    pom = g.select(
        "repo", F.lit("pom.xml").alias("path"),
        F.concat(F.lit("<?xml version='1.0'?><!-- <other> --><"), root,
                 F.lit("><dependencies>\n<dependency><artifactId>no-group</artifactId></dependency>"),
                 F.array_join(F.transform("_d", lambda x: x["pl"]), "\n"),
                 F.when(kind == 1, F.lit("\n<dep")).otherwise(F.concat(F.lit("\n</dependencies></"), root, F.lit(">"))))
        .alias("content"))
    return gradle.unionByName(pom)


_BUILD = """
coords AS (
  SELECT DISTINCT repo,
         CASE lower(p_type) WHEN 'small' THEN 'commons-io' WHEN 'large' THEN 'org.apache.commons' ELSE 'org.lib' END AS "group",
         'lib-' || lower(p_type) AS artifact, '1.' || CAST(p_size % 3 AS VARCHAR) AS version
  FROM live_items),
coords_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "group", artifact, version, p_even) - 1 AS k FROM (
    SELECT DISTINCT repo,
           CASE lower(p_type) WHEN 'small' THEN 'commons-io' WHEN 'large' THEN 'org.apache.commons' ELSE 'org.lib' END
             AS "group", 'lib-' || lower(p_type) AS artifact, '1.' || CAST(p_size % 3 AS VARCHAR) AS version,
           p_size % 2 = 0 AS p_even
    FROM live_items) t)"""


def _build_sql(body: str) -> str:
    base = with_carriers(["live_items"], "SELECT 1")
    return base[: -len("\nSELECT 1")] + "," + _BUILD + "\n" + body


@query("r7_gradle_dependencies", _build_sql("""
SELECT repo, 'build.gradle' AS path, CAST(4 + k AS INTEGER) AS pos, "group", artifact FROM coords_ranked"""))
def q_r7(spark, sf):
    b = _build_files(Landed.get(spark, sf))
    return R.gradle_dependencies(b.filter(F.col("path") == "build.gradle"))


@query("r8_pom_dependencies", _build_sql("""
SELECT repo, 'pom.xml' AS path, CAST(k + 1 AS INTEGER) AS k, "group", artifact, CASE WHEN NOT p_even THEN version END AS version
FROM coords_ranked WHERE repo % 3 = 0
UNION ALL SELECT DISTINCT repo, 'pom.xml', 0, NULL, 'no-group', NULL FROM coords_ranked WHERE repo % 3 = 0"""))
def q_r8(spark, sf):
    b = _build_files(Landed.get(spark, sf))
    return R.pom_dependencies(b.filter(F.col("path") == "pom.xml"))


@query("r8_malformed_poms", _build_sql("SELECT DISTINCT repo, 'pom.xml' AS path FROM coords_ranked WHERE repo % 3 = 1"))
def q_r8_malformed(spark, sf):
    b = _build_files(Landed.get(spark, sf))
    return R.malformed_poms(b.filter(F.col("path") == "pom.xml"))


# the files' names say which of them count: Gradle files of either language, settings and backups among them
_R9 = """
, repo_build AS (
  SELECT DISTINCT repo, CASE WHEN repo % 6 < 3 THEN 'maven' WHEN repo % 4 <> 2 THEN 'gradle' END AS build FROM coords),
found AS (
  SELECT DISTINCT repo, "group", artifact FROM coords JOIN repo_build USING (repo)
  WHERE "group" IN ('org.apache.commons', 'commons-io', 'commons-daemon') AND (build = 'gradle' OR (build = 'maven' AND repo % 3 = 0)))"""


def _named_build_files(L: Landed):
    gradle = F.when(F.col("repo") % 4 == 1, F.lit("app/build.gradle.kts")).when(
        F.col("repo") % 4 == 2, F.lit("settings.gradle.kts")).otherwise(F.lit("build.gradle"))
    pom = F.when(F.col("repo") % 6 < 3, F.lit("pom.xml")).otherwise(F.lit("pom.xml.orig"))
    return _build_files(L).withColumn("path", F.when(F.col("path") == "pom.xml", pom).otherwise(gradle))


@query("r9_project_dependencies", _build_sql("SELECT 1")[:-len("\nSELECT 1")] + _R9 + """
SELECT b.repo, build, CASE WHEN build IS NULL THEN 'unknown' WHEN f.repo IS NULL THEN 'empty' ELSE 'known' END AS state,
       f."group", f.artifact
FROM repo_build b LEFT JOIN found f ON f.repo = b.repo""")
def q_r9(spark, sf):
    return R.project_dependencies(_named_build_files(Landed.get(spark, sf)))


@query("r10_restrict_by_state", with_carriers(["api_catalog", "live_items"], "SELECT 1")[:-len("\nSELECT 1")] + "," + _BUILD + _R9 + """,
apis AS (
  SELECT id, name, split_part(project, '|', 2) AS t FROM api_catalog),
asked AS (
  SELECT id AS repo, id, name, CASE t WHEN 'small' THEN 'commons-io' WHEN 'large' THEN 'org.apache.commons' ELSE 'org.lib' END
           AS "group", 'lib-' || t AS artifact
  FROM apis)
SELECT repo, id, name FROM asked a
WHERE EXISTS (SELECT 1 FROM found f WHERE f.repo = a.repo AND f."group" = a."group" AND f.artifact = a.artifact)
   OR NOT EXISTS (SELECT 1 FROM repo_build b WHERE b.repo = a.repo AND b.build IS NOT NULL)""")
def q_r10_state(spark, sf):
    L = Landed.get(spark, sf)
    t = F.get(F.split("project", r"\|"), F.lit(1))
    group = F.when(t == "small", F.lit("commons-io")).when(t == "large", F.lit("org.apache.commons")).otherwise(F.lit("org.lib"))
    apis = L.api_catalog.select(F.col("id").alias("repo"), "id", "name", F.concat(group, F.lit("|lib-"), t).alias("project"))
    return R.restrict_to_dependencies(apis, R.project_dependencies(_named_build_files(L)), keep_unknown=True).select("repo", "id", "name")


# every library API against the repository that has its part's number
@query("r10_restrict_to_dependencies", with_carriers(["api_catalog", "live_items"], """
SELECT a.id AS repo, a.id, a.project, a.class, a.name FROM api_catalog a
WHERE EXISTS (SELECT 1 FROM live_items d WHERE d.repo = a.id AND lower(d.p_type) = split_part(a.project, '|', 2))"""))
def q_r10(spark, sf):
    L = Landed.get(spark, sf)
    apis = L.api_catalog.withColumn("repo", F.col("id"))
    return R.restrict_to_dependencies(apis, _deps(L)).select("repo", "id", "project", "class", "name")


@query("r11_base_packages", with_carriers(["library_packages"], """
SELECT project, min_by(package, (length(package), package)) AS package FROM library_packages GROUP BY project"""))
def q_r11(spark, sf):
    return R.base_packages(Landed.get(spark, sf).library_packages)


@query("r12_imported_targets", with_carriers(["live_items"], """
SELECT repo, idx, 'src/F' || CAST(fno AS VARCHAR) || '.java' AS path,
       array_to_string(list_sort(list(DISTINCT 'org.lib.' || lower(p_type))), ',') AS packages
FROM live_items GROUP BY repo, idx, fno"""))
def q_r12(spark, sf):
    L = Landed.get(spark, sf)
    t = R.imported_targets(L.snapshots, R.base_packages(L.library_packages))
    return t.select("repo", "idx", "path", F.array_join("packages", ",").alias("packages"))


@query("r13_public_api_catalog", with_carriers(["api_catalog"], """
SELECT id, project, class, name, n_args FROM api_catalog WHERE is_public"""))
def q_r13(spark, sf):
    return R.public_api_catalog(Landed.get(spark, sf).api_catalog).select("id", "project", "class", "name", "n_args")


@query("r14_match_library_patterns", f"""
WITH libs AS ({_LIBS}),
arts AS (SELECT DISTINCT 'org.lib.' || lower(p_type) AS "group", 'lib-' || lower(p_type) || '-' || CAST(p_size % 5 AS VARCHAR)
                AS artifact, '1.' || CAST(p_size % 3 AS VARCHAR) AS version FROM part)
SELECT a."group", a.artifact, a.version, l.artifact AS artifact_pattern, l.version AS version_pattern
FROM arts a JOIN libs l ON l."group" = a."group"
WHERE regexp_full_match(a.artifact, replace(l.artifact, '*', '.*'))
  AND regexp_full_match(a.version, replace(replace(l.version, '.', '[.]'), '*', '.*'))""")
def q_r14(spark, sf):
    L = Landed.get(spark, sf)
    p = L.t("part")
    arts = p.select(F.concat(F.lit("org.lib."), F.lower("p_type")).alias("group"),
                    F.concat(F.lit("lib-"), F.lower("p_type"), F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("artifact"),
                    F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string")).alias("version")).distinct()
    return R.match_library_patterns(_library_list(L), arts)
