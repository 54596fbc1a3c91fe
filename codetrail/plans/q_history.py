"""Registered queries: history preparation and project state (H*, G6, G7 flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.operators import history as H
from codetrail.operators import replace as G
from codetrail.plans.oracle_carriers import with_carriers
from codetrail.plans.registry import query
from codetrail.sources.carriers import Landed


def removed_local_calls(spark, sf):
    """Flagship: calls whose method was declared in the project before the commit and nowhere after it."""
    L = Landed.get(spark, sf)
    return G.removed_local_calls(L.calls, L.decl_versions).select("repo", "idx", "name", "n_args")


_MATCH = """dv.repo = c.repo AND dv.name = c.name
  AND CASE WHEN dv.varargs THEN dv.n_args <= c.n_args ELSE dv.n_args = c.n_args END"""

FLAGSHIP_SQL = with_carriers(["calls", "decl_versions"], f"""
SELECT c.repo, c.idx, c.name, c.n_args FROM calls c
WHERE EXISTS (SELECT 1 FROM decl_versions dv WHERE {_MATCH}
              AND dv.valid_from <= c.idx - 1 AND (dv.valid_to IS NULL OR dv.valid_to > c.idx - 1))
  AND NOT EXISTS (SELECT 1 FROM decl_versions dv WHERE {_MATCH}
              AND dv.valid_from <= c.idx AND (dv.valid_to IS NULL OR dv.valid_to > c.idx))""")

query("g6_g7_removed_local_calls", FLAGSHIP_SQL)(removed_local_calls)


@query("h2_first_parent_chain", with_carriers(["commits"], """
SELECT repo, sha, idx, parent_sha, subject, total FROM commits"""))
def q_h2(spark, sf):
    return Landed.get(spark, sf).commits.select("repo", "sha", "idx", "parent_sha", "subject", "total")


@query("h5_expand_changes", with_carriers(["file_changes"], """
SELECT repo, idx, 'delete' AS event, old_path AS path, CAST(NULL AS VARCHAR) AS old_path, CAST(NULL AS INTEGER) AS edit_rank
FROM file_changes WHERE kind IN ('M', 'R')
UNION ALL SELECT repo, idx, 'delete', path, NULL, NULL FROM file_changes WHERE kind = 'D'
UNION ALL SELECT repo, idx, 'add', path, NULL, NULL FROM file_changes WHERE kind IN ('A', 'C', 'M', 'R')
UNION ALL SELECT repo, idx, 'edit', path, old_path, CASE WHEN kind = 'R' THEN 0 ELSE 1 END
FROM file_changes WHERE kind IN ('M', 'R')"""))
def q_h5(spark, sf):
    ev = H.expand_changes(Landed.get(spark, sf).file_changes)
    return ev.select("repo", "idx", "event", "path", "old_path", "edit_rank")


@query("h9_file_intervals", with_carriers(["intervals"], "SELECT repo, path, valid_from, valid_to FROM intervals"))
def q_h9(spark, sf):
    return Landed.get(spark, sf).intervals


# ---------------------------------------------------------------- H1 (+ H2 from log positions)
def _log_lines(L: Landed):
    c = L.commits
    tail = F.col("okey") % 10
    line = (F.when(tail == 0, F.col("sha")).when(tail == 5, F.concat("sha", F.lit(",")))
            .otherwise(F.concat_ws(",", "sha", "subject", F.lit("extra"))))
    return c.select("repo", (F.col("total") - F.col("idx")).alias("pos"), line.alias("line"))


@query("h1_parse_commit_log", with_carriers(["commits"], """
SELECT repo, sha, CASE WHEN okey % 10 IN (0, 5) THEN '' ELSE subject END AS subject, idx, parent_sha, total
FROM commits"""))
def q_h1(spark, sf):
    parsed = H.parse_commit_log(_log_lines(Landed.get(spark, sf)))
    return H.first_parent_chain(parsed, pos_col="pos").select("repo", "sha", "subject", "idx", "parent_sha", "total")


# ---------------------------------------------------------------- H3 / H4
def _name_status_lines(L: Landed):
    fc = L.file_changes
    tab = F.lit("\t")
    main = fc.select("repo", "idx", F.when(F.col("kind") == "R", F.concat(
        F.lit("R"), (F.lit(50) + F.col("idx") % 50).cast("string"), tab, F.col("old_path"), tab, F.col("path")))
        .otherwise(F.concat(F.col("kind"), tab, F.col("path"))).alias("line"))
    c = L.commits.select("repo", "idx")
    i = F.col("idx").cast("string")
    extra = c.select("repo", "idx", F.explode(F.array(
        F.when(F.col("idx") % 5 == 0, F.concat(F.lit("C75\tsrc/F0.java\tsrc/copy/F"), i, F.lit(".java"))),
        F.when(F.col("idx") % 7 == 0, F.concat(F.lit("T\tsrc/link"), i)),
        F.when(F.col("idx") % 11 == 0, F.lit("warning: inexact rename detection was skipped due to too many files."))))
        .alias("line")).filter(F.col("line").isNotNull())
    return main.unionByName(extra)


_NS = """
ns AS (
  SELECT repo, idx, kind, CASE WHEN kind = 'A' THEN NULL ELSE old_path END AS old_path, path FROM file_changes
  UNION ALL SELECT repo, idx, 'C', 'src/F0.java', 'src/copy/F' || CAST(idx AS VARCHAR) || '.java' FROM commits WHERE idx % 5 = 0
  UNION ALL SELECT repo, idx, 'other', NULL, 'src/link' || CAST(idx AS VARCHAR) FROM commits WHERE idx % 7 = 0)"""


def _ns_sql(body: str) -> str:
    base = with_carriers(["file_changes", "commits"], "SELECT 1")
    return base[: -len("\nSELECT 1")] + "," + _NS + "\n" + body


@query("h3_parse_name_status", _ns_sql("SELECT repo, idx, kind, old_path, path FROM ns"))
def q_h3(spark, sf):
    return H.parse_name_status(_name_status_lines(Landed.get(spark, sf)))


@query("h4_commit_change_summary", _ns_sql("""
SELECT repo, idx, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE kind IN ('A', 'C')) AS BIGINT) AS n_added,
       CAST(count(*) FILTER (WHERE kind = 'D') AS BIGINT) AS n_deleted,
       CAST(count(*) FILTER (WHERE kind = 'M') AS BIGINT) AS n_modified,
       CAST(count(*) FILTER (WHERE kind = 'R') AS BIGINT) AS n_renamed,
       CAST(count(*) FILTER (WHERE kind = 'other') AS BIGINT) AS n_other
FROM ns GROUP BY repo, idx"""))
def q_h4(spark, sf):
    s = H.commit_change_summary(H.parse_name_status(_name_status_lines(Landed.get(spark, sf))))
    return s.select("repo", "idx", *[F.col(c).cast("long").alias(c) for c in
                                     ("total", "n_added", "n_deleted", "n_modified", "n_renamed", "n_other")])


# ---------------------------------------------------------------- H6 / H7
# Whole histories are answered as change sets with a full list every EVERY commits (the test histories are short);
# the delta form's texts are asked for at the last commit of each repository and year.
EVERY = 8

_YEAR_ENDS = "(SELECT repo, max(idx) AS idx FROM commits GROUP BY repo, year(ts))"


def _year_ends(L: Landed):
    return L.commits.groupBy("repo", F.year("ts").alias("y")).agg(F.max("idx").alias("idx")).select("repo", "idx")


_DELTAS = f"""
SELECT repo, CAST(valid_from AS BIGINT) AS idx, path, 'add' AS change, CAST(valid_from AS BIGINT) AS version FROM intervals
UNION ALL SELECT v.repo, CAST(v.valid_to AS BIGINT), v.path, 'gone', NULL FROM intervals v
WHERE v.valid_to IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM intervals w WHERE w.repo = v.repo AND w.path = v.path AND w.valid_from = v.valid_to)
UNION ALL SELECT c.repo, CAST(c.idx AS BIGINT), v.path, 'full', CAST(v.valid_from AS BIGINT) FROM commits c JOIN intervals v
  ON v.repo = c.repo AND v.valid_from <= c.idx AND (v.valid_to IS NULL OR v.valid_to > c.idx) WHERE c.idx % {EVERY} = 0"""


@query("h6_state_deltas", with_carriers(["commits", "intervals"], _DELTAS))
def q_h6_deltas(spark, sf):
    L = Landed.get(spark, sf)
    return H.state_deltas(L.intervals, L.commits, every=EVERY)


@query("h6_files_at_commit", with_carriers(["commits", "intervals"], """
SELECT c.repo, c.idx, v.path FROM commits c JOIN intervals v ON v.repo = c.repo
  AND v.valid_from <= c.idx AND (v.valid_to IS NULL OR v.valid_to > c.idx)
WHERE ends_with(v.path, '.java')"""))
def q_h6(spark, sf):
    L = Landed.get(spark, sf)
    return H.files_at_commit(L.intervals, L.commits, suffix=".java")


@query("h7_content_from_deltas", with_carriers(["commits", "intervals", "snapshots"], f"""
SELECT c.repo, CAST(c.idx AS BIGINT) AS idx, v.path, CAST(v.valid_from AS BIGINT) AS version, s.content
FROM {_YEAR_ENDS} c JOIN intervals v ON v.repo = c.repo AND v.valid_from <= c.idx AND (v.valid_to IS NULL OR v.valid_to > c.idx)
LEFT JOIN snapshots s ON s.repo = v.repo AND s.path = v.path AND s.idx = v.valid_from"""))
def q_h7_deltas(spark, sf):
    L = Landed.get(spark, sf)
    files = H.expand_deltas(H.state_deltas(L.intervals, L.commits, every=EVERY), _year_ends(L), every=EVERY)
    return H.content_of_versions(files, L.snapshots).select("repo", "idx", "path", "version", "content")


@query("h7_content_at_commit", with_carriers(["commits", "intervals", "snapshots"], """
SELECT r.repo, r.idx, r.path, s.content
FROM (SELECT repo, idx, 'src/F' || CAST(f AS VARCHAR) || '.java' AS path
      FROM commits, range(7) t(f)) r
LEFT JOIN intervals v ON v.repo = r.repo AND v.path = r.path AND v.valid_from <= r.idx
     AND (v.valid_to IS NULL OR v.valid_to > r.idx)
LEFT JOIN snapshots s ON s.repo = v.repo AND s.path = v.path AND s.idx = v.valid_from"""))
def q_h7(spark, sf):
    L = Landed.get(spark, sf)
    req = L.commits.select("repo", "idx", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("f")).select(
        "repo", "idx", F.concat(F.lit("src/F"), F.col("f").cast("string"), F.lit(".java")).alias("path"))
    return H.content_at_commit(L.snapshots, L.intervals, req).select("repo", "idx", "path", "content")


# ---------------------------------------------------------------- H8
def _previous_results(L: Landed):
    """An earlier run's results: (repo_name, cur_commit) of finished orders."""
    o = L.t("orders").filter(F.col("o_orderstatus") == "F")
    return o.join(L.repos, o["o_custkey"] == L.repos["repo"]).select(
        "repo_name", F.col("o_orderkey").cast("string").alias("cur_commit"))


_PREV = """
prev AS (SELECT cu.c_name AS repo_name, CAST(o.o_orderkey AS VARCHAR) AS cur_commit, o.o_custkey AS repo
         FROM orders o JOIN customer cu ON cu.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F')"""


def _prev_sql(deps, body: str) -> str:
    base = with_carriers(deps, "SELECT 1")
    if base.startswith("WITH "):
        return base[: -len("\nSELECT 1")] + "," + _PREV + "\n" + body
    return "WITH " + _PREV + "\n" + body


@query("h8a_interesting_commits", _prev_sql([], "SELECT DISTINCT repo_name, cur_commit FROM prev"))
def q_h8a(spark, sf):
    return H.interesting_commits(_previous_results(Landed.get(spark, sf)))


@query("h8b_restrict_repos", _prev_sql([], """
SELECT c_custkey AS repo, c_name AS repo_name, lower(c_mktsegment) AS default_branch FROM customer
WHERE c_name IN (SELECT repo_name FROM prev)"""))
def q_h8b(spark, sf):
    L = Landed.get(spark, sf)
    return H.restrict_repos(L.repos, H.interesting_commits(_previous_results(L)), repo="repo_name")


@query("h8c_restrict_commits", _prev_sql(["commits"], """
SELECT c.repo, c.idx, c.sha FROM commits c
WHERE EXISTS (SELECT 1 FROM prev p JOIN commits c2 ON c2.repo = p.repo AND c2.sha = p.cur_commit
              WHERE c2.repo = c.repo AND (c2.idx = c.idx OR c2.idx = c.idx + 1))"""))
def q_h8c(spark, sf):
    L = Landed.get(spark, sf)
    o = L.t("orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("repo_name"), F.col("o_orderkey").cast("string").alias("cur_commit"))
    return H.restrict_commits(L.commits, o).select("repo", "idx", "sha")


# ---------------------------------------------------------------- H10 / H11 / H12
@query("h10_state_totals", with_carriers(["commits", "decl_versions"], """
SELECT c.repo, c.idx, CAST(count(d.name) AS BIGINT) AS n_total
FROM commits c LEFT JOIN decl_versions d ON d.repo = c.repo AND d.valid_from <= c.idx
     AND (d.valid_to IS NULL OR d.valid_to > c.idx)
GROUP BY c.repo, c.idx"""))
def q_h10(spark, sf):
    L = Landed.get(spark, sf)
    t = H.state_totals(L.decls, L.intervals, L.commits)
    return t.select("repo", "idx", F.col("n_total").cast("long").alias("n_total"))


@query("h11_modified_files", with_carriers(["file_changes"], """
SELECT repo, idx, kind, old_path, path FROM file_changes WHERE kind = 'M' AND ends_with(path, '.java')"""))
def q_h11(spark, sf):
    return H.modified_files(Landed.get(spark, sf).file_changes)


@query("h12_all_non_merge_commits", with_carriers(["commits"], """
SELECT repo, sha FROM commits WHERE okey % 13 <> 0"""))
def q_h12(spark, sf):
    c = Landed.get(spark, sf).commits
    parents = F.when(F.col("okey") % 13 == 0, F.array("parent_sha", F.concat(F.lit("merge"), F.col("sha")))) \
        .otherwise(F.array("parent_sha"))
    return H.all_non_merge_commits(c.select("repo", "sha", parents.alias("parents")))
