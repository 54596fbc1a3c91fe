"""Registered queries: call extraction and replacement detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.functions.arrays import with_once
from codetrail.functions.calls import calls_of_pair, render_call_list, render_declaration, render_signature
from codetrail.operators import diffs as D
from codetrail.operators import replace as G
from codetrail.plans import mining as M
from codetrail.plans.oracle_carriers import with_carriers
from codetrail.plans.registry import query
from codetrail.sources.carriers import Landed

PAIR_COLS = ["repo", "idx", "path", "pos", "k"]


def _pairs(L: Landed):
    p = D.paired_replacements(D.diff_lines(L.diffs))
    return (with_once(p, "_c", calls_of_pair(F.col("removed"), F.col("added")))
            .withColumn("removed_calls", F.col("_c.removed_calls")).withColumn("added_calls", F.col("_c.added_calls"))
            .drop("_c"))


def _first_changed(L: Landed):
    c = G.drop_pure_add_remove(G.common_calls(G.comparable_pairs(_pairs(L))))
    return G.drop_non_api_names(G.first_changed_call(c))


_RM = "CASE WHEN l_linenumber % 2 = 0 THEN 'size(0),' ELSE '' END || old_name || '(' || CAST(old_n_args AS VARCHAR) || ')'"
_AD = f"""CASE variant WHEN 1 THEN {_RM} WHEN 2 THEN {_RM} || ',then(0)'
  WHEN 3 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'size(0),' ELSE '' END || 'assertOf(' || CAST(new_n_args AS VARCHAR) || ')'
  ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'size(0),' ELSE '' END || new_name || '(' || CAST(new_n_args AS VARCHAR) || ')' END"""


@query("x2_calls_from_text", with_carriers(["pairs"], f"""
SELECT repo, idx, path, pos, k, {_RM} AS removed_methods, {_AD} AS added_methods,
       n_calls AS n_removed, n_calls + CASE WHEN variant = 2 THEN 1 ELSE 0 END AS n_added FROM pairs"""))
def q_x2(spark, sf):
    p = _pairs(Landed.get(spark, sf))
    return p.select(*PAIR_COLS, render_call_list(F.col("removed_calls")).alias("removed_methods"),
                    render_call_list(F.col("added_calls")).alias("added_methods"),
                    F.size("removed_calls").alias("n_removed"), F.size("added_calls").alias("n_added"))


# G1 rejects the pairs with the same calls, G3 those that only add one
@query("g1_g3_comparable_pairs", with_carriers(["pairs"], """
SELECT repo, idx, path, pos, k, CASE WHEN l_linenumber % 2 = 0 THEN 'size(0)' ELSE '' END AS common
FROM pairs WHERE variant NOT IN (1, 2)"""))
def q_g1_g3(spark, sf):
    c = G.drop_pure_add_remove(G.common_calls(G.comparable_pairs(_pairs(Landed.get(spark, sf)))))
    return c.select(*PAIR_COLS, render_call_list(F.col("common")).alias("common"))


# G4 skips the pairs with equal left texts, G5 rejects assertions
@query("g4_g5_first_changed_call", with_carriers(["pairs"], """
SELECT repo, idx, path, pos, k, old_name, old_n_args, new_name, new_n_args FROM pairs
WHERE variant IN (0, 4) AND new_name NOT IN ('super', 'this') AND NOT starts_with(new_name, 'assert')"""))
def q_g4(spark, sf):
    return _first_changed(Landed.get(spark, sf)).select(*PAIR_COLS, "old_name", "old_n_args", "new_name", "new_n_args")


@query("g6_g9_checked_pairs", with_carriers(["checked"], """
SELECT repo, idx, path, pos, k, old_name, old_n_args, new_name, new_n_args FROM checked"""))
def q_g6_g9(spark, sf):
    L = Landed.get(spark, sf)
    inp = L.mining
    return M.checked_pairs(inp, _first_changed(L)).select(*PAIR_COLS, "old_name", "old_n_args", "new_name", "new_n_args")


@query("g10_render_signatures", with_carriers(["call_facts"], """
SELECT repo, idx, path, line, '[org.lib.' || name || '] ' || name || ' (' ||
       CASE n_args WHEN 0 THEN '' WHEN 1 THEN 'int' ELSE 'int, int' END || ') -> null' AS rendered
FROM call_facts"""))
def q_g10_signatures(spark, sf):
    c, n = Landed.get(spark, sf).call_facts, F.col("n_args")
    types = F.when(n == 0, "").when(n == 1, "int").otherwise("int, int")
    return c.select("repo", "idx", "path", "line", render_signature(
        F.concat(F.lit("org.lib."), "name"), F.col("name"), types, F.lit(None).cast("string")).alias("rendered"))


@query("g10_render_declarations", with_carriers(["decl_versions"], """
SELECT repo, path, valid_from, name || '(' || CAST(n_args AS VARCHAR) || CASE WHEN varargs THEN '+' ELSE '' END || ')'
       AS rendered
FROM decl_versions"""))
def q_g10(spark, sf):
    d = Landed.get(spark, sf).decl_versions
    return d.select("repo", "path", "valid_from",
                    render_declaration(F.col("name"), F.col("n_args"), F.col("varargs"), F.lit(None).cast("string"))
                    .alias("rendered"))


# -- groups: in this carrier every member of an (old, new) key imports the new call's package,
#    so each key forms one group (gid 1); the fold itself is tested on golden rows.
_GROUPS = """
members AS (
  SELECT c.*, row_number() OVER (PARTITION BY repo, idx, old_name, old_n_args, new_name, new_n_args
                                 ORDER BY edit_rank, path, pos, k) AS m_rank
  FROM (SELECT c.*, CASE WHEN f.kind = 'R' THEN 0 ELSE 1 END AS edit_rank
        FROM checked c JOIN file_changes f ON c.repo = f.repo AND c.idx = f.idx AND c.path = f.path) c),
file_order AS (
  SELECT repo, idx, old_name, old_n_args, new_name, new_n_args, old_path, path, min(m_rank) AS f_rank,
         string_agg('[' || CAST(before AS VARCHAR) || ',' || CAST(after AS VARCHAR) || ']', '' ORDER BY m_rank) AS lines
  FROM members GROUP BY ALL),
occ AS (
  SELECT repo, idx, old_name, old_n_args, new_name, new_n_args,
         string_agg('("' || old_path || '"->"' || path || '"|' || lines || ')', ', ' ORDER BY f_rank) AS replacement_paths
  FROM file_order GROUP BY ALL),
groups AS (
  SELECT m.repo, m.idx, m.old_name, m.old_n_args, m.new_name, m.new_n_args, 1 AS gid, g.cnt AS count,
         m.removed, m.added, m.l_linenumber, m.n_calls, m.fno, o.replacement_paths
  FROM members m
  JOIN (SELECT repo, idx, old_name, old_n_args, new_name, new_n_args, count(*) AS cnt FROM members GROUP BY ALL) g
    USING (repo, idx, old_name, old_n_args, new_name, new_n_args)
  JOIN occ o USING (repo, idx, old_name, old_n_args, new_name, new_n_args)
  WHERE m.m_rank = 1),
file_pkgs AS (SELECT DISTINCT repo, idx, fno, 'org.lib.' || lower(p_type) AS pkg FROM live_items),
cand_ids AS (
  SELECT DISTINCT g.repo, g.idx, g.old_name, g.old_n_args, g.new_name, g.new_n_args, a.id
  FROM groups g JOIN api_catalog a ON a.is_public AND a.name = g.new_name AND a.n_args = g.new_n_args
  JOIN file_pkgs fp ON fp.repo = g.repo AND fp.idx = g.idx AND fp.fno = g.fno AND contains(a.class, fp.pkg)),
cand_agg AS (
  SELECT repo, idx, old_name, old_n_args, new_name, new_n_args, count(*) AS n_candidates FROM cand_ids GROUP BY ALL),
old_decl AS (
  SELECT * FROM (
    SELECT g.repo, g.idx, g.old_name, g.old_n_args, g.new_name, g.new_n_args, d.path AS decl_path,
           d.line_start, d.line_end, d.is_constructor,
           row_number() OVER (PARTITION BY g.repo, g.idx, g.old_name, g.old_n_args, g.new_name, g.new_n_args
                              ORDER BY d.path, d.line_start, d.line_end, d.is_constructor) AS rn
    FROM groups g JOIN decl_versions d ON d.repo = g.repo AND d.name = g.old_name
      AND CASE WHEN d.varargs THEN d.n_args <= g.old_n_args ELSE d.n_args = g.old_n_args END
      AND d.valid_from <= g.idx - 1 AND (d.valid_to IS NULL OR d.valid_to > g.idx - 1)) t WHERE rn = 1),
bodies AS (
  SELECT o.*, CASE WHEN o.is_constructor THEN '(((CONSTRUCTOR)))'
                   WHEN s.content IS NULL THEN NULL
                   WHEN len(string_split(s.content, chr(10))) <= o.line_end THEN NULL
                   ELSE array_to_string(list_slice(string_split(s.content, chr(10)), o.line_start, o.line_end), chr(10))
              END AS old_body
  FROM old_decl o
  LEFT JOIN intervals v ON v.repo = o.repo AND v.path = o.decl_path
       AND v.valid_from <= o.idx - 1 AND (v.valid_to IS NULL OR v.valid_to > o.idx - 1)
  LEFT JOIN snapshots s ON s.repo = v.repo AND s.path = v.path AND s.idx = v.valid_from),
result AS (
  SELECT g.*, coalesce(c.n_candidates, 0) AS n_candidates,
         b.decl_path, b.line_start, b.line_end, b.old_body
  FROM groups g
  LEFT JOIN cand_agg c USING (repo, idx, old_name, old_n_args, new_name, new_n_args)
  LEFT JOIN bodies b USING (repo, idx, old_name, old_n_args, new_name, new_n_args)
  WHERE b.old_body IS NOT NULL
    AND NOT (instr(b.old_body, '{') > 0 AND contains(substr(b.old_body, instr(b.old_body, '{')), g.new_name)))
"""

_G_DEPS = ["checked", "diff_items", "file_changes", "api_catalog", "live_items", "decl_versions", "intervals", "snapshots",
           "commits"]


def _groups_sql(body: str) -> str:
    base = with_carriers(_G_DEPS, "SELECT 1")
    return base[: -len("\nSELECT 1")] + ",\n" + _GROUPS + body


@query("g11_g12_group_replacements", _groups_sql("""
SELECT repo, idx, old_name, old_n_args, new_name, new_n_args, gid, CAST(count AS BIGINT) AS count, replacement_paths
FROM groups"""))
def q_g11(spark, sf):
    m = Landed.get(spark, sf).members
    g = G.group_replacements(m).join(G.render_occurrences(G.group_occurrences(m)), list(G.GROUP_KEY))
    return g.select(*G.GROUP_KEY, F.col("count").cast("long").alias("count"), "replacement_paths")


# the members of all commits by their numbers of arguments, with one of three packages by their place in the diff: a key has
# a group for each package, numbered by first appearance
@query("g11_split_groups", _groups_sql("""
SELECT old_n_args, new_n_args, CAST(gid AS INTEGER) AS gid, CAST(count(*) AS BIGINT) AS count,
       arg_min(path, (repo, idx, edit_rank, path, pos, k)) AS first_path
FROM (SELECT *, dense_rank() OVER (PARTITION BY old_n_args, new_n_args ORDER BY first_place) AS gid
      FROM (SELECT *, min((repo, idx, edit_rank, path, pos, k)) OVER (PARTITION BY old_n_args, new_n_args, pos % 3) AS first_place
            FROM members) f) n
GROUP BY old_n_args, new_n_args, gid"""))
def q_g11_split(spark, sf):
    m = Landed.get(spark, sf).members.drop("gid").withColumn(
        "packages", F.array(F.concat(F.lit("p.q"), (F.col("pos") % 3).cast("string"))))
    how = dict(key=("old_n_args", "new_n_args"), order=("repo", "idx", "edit_rank", "path", "pos", "k"))
    g = G.group_replacements(G.group_members(m, **how), **how)
    return g.select("old_n_args", "new_n_args", "gid", F.col("count").cast("long").alias("count"), F.col("rep.path").alias("first_path"))


def _groups(L: Landed):
    return G.group_replacements(L.members), L.mining


@query("g13_candidate_apis", _groups_sql("""
SELECT repo, idx, old_name, old_n_args, new_name, new_n_args, 1 AS gid, id AS api_id FROM cand_ids"""))
def q_g13(spark, sf):
    g, inp = _groups(Landed.get(spark, sf))
    return G.candidate_apis(g, inp.api_catalog)


@query("g14_candidate_count", _groups_sql("""
SELECT g.repo, g.idx, g.old_name, g.old_n_args, g.new_name, g.new_n_args, g.gid,
       CAST(coalesce(c.n_candidates, 0) AS BIGINT) AS n_candidates
FROM groups g LEFT JOIN cand_agg c USING (repo, idx, old_name, old_n_args, new_name, new_n_args)"""))
def q_g14(spark, sf):
    g, inp = _groups(Landed.get(spark, sf))
    c = G.with_candidate_count(g, G.candidate_apis(g, inp.api_catalog, lists=True))
    return c.select(*G.GROUP_KEY, F.col("n_candidates").cast("long").alias("n_candidates"))


@query("g15_g17_old_declaration_body", _groups_sql("""
SELECT repo, idx, old_name, old_n_args, new_name, new_n_args, gid, decl_path, line_start, line_end, old_body
FROM result"""))
def q_g15(spark, sf):
    g, inp = _groups(Landed.get(spark, sf))
    g = G.old_declaration(g, inp.decl_versions)
    g = G.drop_already_using(G.declaration_body(g, inp.snapshots, inp.intervals))
    return g.select(*G.REPLACEMENT_KEY, "gid", F.col("old_decl.path").alias("decl_path"),
                    F.col("old_decl.line_start").alias("line_start"), F.col("old_decl.line_end").alias("line_end"),
                    "old_body")


_FINAL = """
SELECT CAST(row_number() OVER (ORDER BY r.repo, r.idx, r.old_name, r.old_n_args, r.new_name, r.new_n_args, r.gid) AS BIGINT)
         AS id,
       cu.c_name AS repo_name, lower(cu.c_mktsegment) AS default_branch, cm.parent_sha AS prev_commit,
       cm.sha AS cur_commit, cm.subject AS commit_message,
       r.old_name || '(' || CAST(r.old_n_args AS VARCHAR) || ')' AS old_method,
       r.new_name || '(' || CAST(r.new_n_args AS VARCHAR) || ')' AS new_method,
       CAST(r.count AS BIGINT) AS count, r.replacement_paths,
       r.decl_path AS old_method_decl_path, r.line_start AS old_method_decl_line_start,
       r.line_end AS old_method_decl_line_end, r.old_body AS old_method_decl_body,
       r.removed AS "diffRemovedText", r.added AS "diffAddedText",
       CASE WHEN r.l_linenumber % 2 = 0 THEN 'size(0),' ELSE '' END || r.old_name || '(' || CAST(r.old_n_args AS VARCHAR) || ')'
         AS "removedMethods",
       CASE WHEN r.l_linenumber % 2 = 0 THEN 'size(0),' ELSE '' END || r.new_name || '(' || CAST(r.new_n_args AS VARCHAR) || ')'
         AS "addedMethods",
       CAST(r.n_calls AS INTEGER) AS "nRemovedMethods", CAST(r.n_calls AS INTEGER) AS "nAddedMethods",
       CAST(r.n_candidates AS BIGINT) AS "nCandidateAPIs"
FROM result r JOIN commits cm ON cm.repo = r.repo AND cm.idx = r.idx
LEFT JOIN customer cu ON cu.c_custkey = r.repo"""


@query("g20_mine_replacements", _groups_sql(_FINAL))
def q_g20(spark, sf):
    return Landed.get(spark, sf).mined.replacements


@query("g20_candidate_apis", _groups_sql("""
SELECT f.id AS replacement_id, c.id AS api_id FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY repo, idx, old_name, old_n_args, new_name, new_n_args, gid) AS BIGINT) AS id
  FROM result) f JOIN cand_ids c USING (repo, idx, old_name, old_n_args, new_name, new_n_args)"""))
def q_g20_candidates(spark, sf):
    return Landed.get(spark, sf).mined.candidates


@query("g18_s12_import_changes", _groups_sql("""
SELECT CAST(row_number() OVER (ORDER BY f.repo, f.idx, f.path) AS BIGINT) AS id,
       cu.c_name AS repo_name, lower(cu.c_mktsegment) AS default_branch, cm.parent_sha AS prev_commit,
       cm.sha AS cur_commit, f.path,
       coalesce((SELECT string_agg(cls || ';', chr(10) ORDER BY r) FROM diff_items di
                 WHERE di.repo = f.repo AND di.idx = f.idx AND di.path = f.path AND di.l_returnflag = 'A'), '') AS added,
       coalesce((SELECT string_agg('org.old.' || name || ';', chr(10) ORDER BY r) FROM diff_items di
                 WHERE di.repo = f.repo AND di.idx = f.idx AND di.path = f.path AND di.l_returnflag = 'R'), '') AS removed
FROM (SELECT DISTINCT m.repo, m.idx, m.path FROM members m JOIN result r
        USING (repo, idx, old_name, old_n_args, new_name, new_n_args)) f
JOIN commits cm ON cm.repo = f.repo AND cm.idx = f.idx
LEFT JOIN customer cu ON cu.c_custkey = f.repo"""))
def q_g18(spark, sf):
    return Landed.get(spark, sf).mined.import_changes


@query("s11_write_replacements", _groups_sql(_FINAL))
def q_s11(spark, sf):
    from codetrail.plans.q_sources import scratch
    from codetrail.sources.writers import write_replacements
    path = write_replacements(Landed.get(spark, sf).mined.replacements, scratch(spark, "replacements"))
    return spark.read.parquet(path).drop("repo_bucket")


@query("g19_restrict_imports", _groups_sql("""
SELECT DISTINCT d.repo, d.idx, d.path FROM diff_items d
WHERE EXISTS (SELECT 1 FROM members m JOIN result r USING (repo, idx, old_name, old_n_args, new_name, new_n_args)
              WHERE m.repo = d.repo AND m.idx = d.idx AND m.path = d.path)"""))
def q_g19(spark, sf):
    L = Landed.get(spark, sf)
    imp = D.import_changes(L.diffs)
    return G.restrict_imports(imp, G.occurrences_of(L.members, L.mined_groups)).select("repo", "idx", "path").distinct()
