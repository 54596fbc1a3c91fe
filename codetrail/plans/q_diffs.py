"""Registered queries: diff text operators.

The diff text is synthesized from line items (see ``Landed.diffs``); the
oracles read the generating columns directly (round trip).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.operators import diffs as D
from codetrail.plans.oracle_carriers import with_carriers
from codetrail.plans.registry import query
from codetrail.sources.carriers import Landed

def _word_sql(body: str) -> str:
    return with_carriers(["numbered", "file_changes"], body)


@query("d1_diff_lines", _word_sql("""
SELECT repo, idx, old_path, path, CAST(pos AS INTEGER) AS pos, CAST(hunk AS INTEGER) AS hunk, line, before, after
FROM numbered"""))
def q_d1(spark, sf):
    return D.diff_lines(Landed.get(spark, sf).diffs)


@query("d2_paired_replacements", _word_sql("""
SELECT repo, idx, old_path, path, CAST(pos AS INTEGER) AS pos, CAST(hunk AS INTEGER) AS hunk, before, after,
       0 AS k, trim(old_text) AS removed, trim(new_text) AS added
FROM numbered WHERE l_returnflag = 'N'"""))
def q_d2(spark, sf):
    return D.paired_replacements(D.diff_lines(Landed.get(spark, sf).diffs))


@query("d3_unpaired_changes", _word_sql("""
SELECT repo, idx, old_path, path, CAST(pos AS INTEGER) AS pos, CAST(hunk AS INTEGER) AS hunk, before, after, 0 AS k,
       CASE WHEN l_returnflag = 'R' THEN 'import org.old.' || name || ';' END AS removed,
       CASE WHEN l_returnflag = 'A' THEN 'import ' || cls || ';' END AS added,
       CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'added' END AS side
FROM numbered WHERE l_returnflag IN ('A', 'R')"""))
def q_d3(spark, sf):
    return D.unpaired_changes(D.diff_lines(Landed.get(spark, sf).diffs))


@query("d4_import_changes", with_carriers(["diff_items"], """
SELECT repo, idx, old_path, path,
       coalesce(string_agg(CASE WHEN l_returnflag = 'A' THEN cls || ';' END, chr(10) ORDER BY r), '') AS added_text,
       coalesce(string_agg(CASE WHEN l_returnflag = 'R' THEN 'org.old.' || name || ';' END, chr(10) ORDER BY r), '')
         AS removed_text,
       CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS BIGINT) AS n_added,
       CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS n_removed
FROM diff_items GROUP BY repo, idx, old_path, path"""))
def q_d4(spark, sf):
    x = D.import_changes(Landed.get(spark, sf).diffs)
    return x.select("repo", "idx", "old_path", "path", "added_text", "removed_text",
                    F.size("added").cast("long").alias("n_added"), F.size("removed").cast("long").alias("n_removed"))


@query("d5_hunks", with_carriers(["diff_items"], """
SELECT repo, idx, old_path, path, CAST(hunk AS INTEGER) AS hunk, CAST(head_a AS INTEGER) AS start,
       CAST(head_a + head_na - 1 AS INTEGER) AS "end", text
FROM (SELECT repo, idx, old_path, path, hunk,
             max(head_a) AS head_a, max(head_na) AS head_na,
             string_agg(unified_lines || CASE WHEN l_linenumber = 4 THEN chr(10) || ' ' ELSE '' END || chr(10), ''
                        ORDER BY r) AS text
      FROM (SELECT *, sum(CASE WHEN hunk_head IS NOT NULL THEN 1 ELSE 0 END)
                        OVER (PARTITION BY repo, idx, path ORDER BY r ROWS UNBOUNDED PRECEDING) AS hunk
            FROM diff_items) t
      GROUP BY repo, idx, old_path, path, hunk) g"""))
def q_d5(spark, sf):
    return D.hunks(Landed.get(spark, sf).diffs)


@query("d6_modified_line_ranges", with_carriers(["diff_items"], """
SELECT repo, idx, old_path, path, CAST(start_pos + CASE WHEN r = 1 THEN 3 ELSE 0 END AS INTEGER) AS pos,
       CAST(head_a AS INTEGER) AS start, CAST(head_a + head_na - 1 AS INTEGER) AS "end"
FROM (SELECT *, coalesce(sum(n_lines) OVER (PARTITION BY repo, idx, path ORDER BY r
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos
      FROM (SELECT *, (CASE WHEN r = 1 THEN 3 ELSE 0 END) + (CASE WHEN hunk_head IS NOT NULL THEN 1 ELSE 0 END)
                      + (CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END)
                      + (CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) AS n_lines
            FROM diff_items) a) b
WHERE hunk_head IS NOT NULL"""))
def q_d6(spark, sf):
    return D.modified_line_ranges(Landed.get(spark, sf).diffs)


@query("d7_size_guard", _word_sql("""
SELECT n.repo, n.idx, n.path, n.before, n.after, trim(n.old_text) AS removed, trim(n.new_text) AS added,
       CAST(e.n_edited AS BIGINT) AS n_edited, CAST(p.n_pairs AS BIGINT) AS n_pairs, e.n_edited > 2 AS many_files,
       p.n_pairs > 3 AS many_pairs, p.n_pairs > 1 AS many_changes
FROM numbered n
JOIN (SELECT repo, idx, count(*) AS n_edited FROM file_changes WHERE kind IN ('M', 'R') GROUP BY repo, idx) e
  ON n.repo = e.repo AND n.idx = e.idx
JOIN (SELECT repo, idx, path, count(*) AS n_pairs FROM numbered WHERE l_returnflag = 'N' GROUP BY repo, idx, path) p
  ON n.repo = p.repo AND n.idx = p.idx AND n.path = p.path
WHERE n.l_returnflag = 'N'"""))
def q_d7(spark, sf):
    L = Landed.get(spark, sf)
    pairs = D.paired_replacements(D.diff_lines(L.diffs))
    edited = L.file_changes.filter(F.col("kind").isin("M", "R"))
    # limits that this data crosses, so the flags take both values
    g = D.size_guard(pairs, edited, max_files=2, max_pairs=3, warn_pairs=1)
    return g.select("repo", "idx", "path", "before", "after", "removed", "added", "n_edited", "n_pairs", "many_files",
                    "many_pairs", "many_changes")
