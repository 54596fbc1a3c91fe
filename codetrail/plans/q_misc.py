"""Registered queries: library pages (L1-L5), selection and labels (P1-P3), the history hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrail.functions.windows import ordered_index
from codetrail.operators import pages as Lp
from codetrail.operators import select as P
from codetrail.plans.q_replace import _FINAL, _groups_sql
from codetrail.plans.registry import query
from codetrail.sources.carriers import Landed
from codetrail.streaming.hook import analyze_history

def _attr_sql(attributes: str, name: str) -> str:
    shape = r"(?:^|\s)" + name + r'''\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'''
    return "concat(" + ", ".join(f"regexp_extract({attributes}, '{shape}', {k}, 'is')" for k in (1, 2, 3)) + ")"


def _links_sql(table: str, name: str) -> str:
    anchor = r"'(?is)<a\b([^>]*)>(.*?)</a\s*>'"
    text = r"trim(regexp_replace(regexp_replace(t[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
    return f'''
{name} AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {_attr_sql('a[i]', 'href')} AS href, {text} AS text,
         {_attr_sql('a[i]', 'title')} AS title
  FROM (SELECT page_id, regexp_extract_all(html, {anchor}, 1) AS a, regexp_extract_all(html, {anchor}, 2) AS t
        FROM {table}) x, range(1, len(a) + 1) r(i))'''


_PAGES = f'''
WITH pg AS (
  SELECT page_id, url, html, regexp_extract(url, '//([^/]+)', 1) AS "group",
         CAST(row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY page_id) AS INTEGER) AS page_no
  FROM pages),{_links_sql("pages", "links")}
'''


def _pages(L: Landed):
    """Fetched pages grouped by host (listing) and numbered by page id; a host may hold most pages,
    so the numbering is range-partitioned rather than one window per host."""
    p = L.t("pages")
    host = F.regexp_extract("url", "//([^/]+)", 1)
    x = p.select("page_id", "url", "html", host.alias("group"))
    return ordered_index(x, ["group"], ["page_id"], out="page_no").withColumn("page_no", F.col("page_no").cast("int"))


@query("l1_artifact_links", _PAGES + """
SELECT page_id, pos, href, text, title, split_part(href, '/', -1) AS artifact FROM links WHERE starts_with(href, '/')""")
def q_l1(spark, sf):
    return Lp.artifact_links(_pages(Landed.get(spark, sf)), prefix="/")


def _repo_pages(L: Landed):
    """Repository pages made of the given ones: a navigation link, a listing entry, a move notice, a release link and a
    download row, each present or not by the page's own length."""
    n, page, group = F.length("html"), F.col("page_id").cast("string"), F.col("group")
    other = F.when(n % 2 == 0, group).otherwise(F.lit("other"))
    none = F.lit("")
    html = F.concat(
        F.lit('<a href="/">Home</a><a class="vbtn" href="/none">x</a><div id="maincontent">'),
        # an entry whose image comes first and whose second link is no child of it, one with two links, one over unclosed
        # list entries; and what only looks like one: in a comment, in a script, in an attribute
        F.lit('<!-- <div class="im"><a href="/artifact/c">c</a></div> --><script>w("<div class=im><a href=/artifact/s>")</script>'),
        F.lit('<img title=\'<div class="im"><a href="/artifact/t">\'>'),
        F.when(n % 7 != 0, F.concat(
            F.lit('<div class="x im"><img src=i><a href="/artifact/'), other, F.lit("/e"), page,
            F.lit('?a=1&amp;b=&#50;">e &lt;1&gt;</a><p><a href="/artifact/x/y">p</a></div>'),
            F.when(n % 2 == 0, F.concat(F.lit("<ul><li class='im'><a href='/artifact/f"), page, F.lit("'>f</a> <a href=/artifact/g"), page,
                                        F.lit(">g</a><li><a href='/artifact/no'>h</a></ul>"))).otherwise(none))).otherwise(none),
        F.when(n % 5 == 0, F.concat(
            F.lit("<div>This artifact was moved to:<table><tbody><tr>"),
            F.when(n % 3 == 0, none).otherwise(F.concat(
                F.lit('<td><a href="/artifact/'), other, F.lit('">g</a> <a href="/artifact/'), other, F.lit("/b"), page,
                F.lit('">b</a></td>'))), F.lit("</tr></tbody></table></div>"))).otherwise(none),
        F.when(n % 4 != 0, F.concat(F.lit("<a title='r' class='vbtn release' href='v"), page, F.lit("'>1.0</a>"))).otherwise(none),
        F.when(n % 3 != 1, F.concat(F.lit('<table><tr><td><a href="/files/'), page,
                                    F.lit('">View\n All</a></td></tr></table>')))
        .otherwise(F.lit('<p><a href="/no">View All</a></p>')), F.lit("</div>"))
    return _pages(L).select("page_id", "group", "page_no", F.concat(F.lit("a"), page).alias("artifact"), html.alias("html"))


# the same pages in SQL: what their parts say
_REPO = _PAGES + """,
rp AS (SELECT page_id, "group", page_no, 'a' || CAST(page_id AS VARCHAR) AS artifact, length(html) AS n FROM pg)"""


@query("l2_pages_before_empty", _REPO + """,
stop AS (SELECT "group", min(page_no) AS s FROM rp WHERE n % 7 = 0 GROUP BY ALL)
SELECT rp.page_id, rp."group", rp.page_no, CAST(CASE WHEN n % 7 = 0 THEN 0 WHEN n % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS n_links
FROM rp LEFT JOIN stop USING ("group") WHERE stop.s IS NULL OR rp.page_no < stop.s""")
def q_l2(spark, sf):
    pg = _repo_pages(Landed.get(spark, sf))
    return Lp.pages_before_empty(pg, Lp.page_links(pg, listing=True)).select("page_id", "group", "page_no", "n_links")


@query("l1_listing_links", _REPO + """
SELECT page_id, 0 AS pos, '/artifact/' || CASE WHEN n % 2 = 0 THEN "group" ELSE 'other' END || '/e' || CAST(page_id AS VARCHAR)
       || '?a=1&b=2' AS href, 'e <1>' AS text, '' AS title, 'e' || CAST(page_id AS VARCHAR) || '?a=1&b=2' AS artifact
FROM rp WHERE n % 7 <> 0
UNION ALL
SELECT page_id, k + 1, '/artifact/' || c || CAST(page_id AS VARCHAR), c, '', c || CAST(page_id AS VARCHAR)
FROM rp, (VALUES (0, 'f'), (1, 'g')) v(k, c) WHERE n % 7 <> 0 AND n % 2 = 0""")
def q_l1_listing(spark, sf):
    return Lp.artifact_links(_repo_pages(Landed.get(spark, sf)), prefix="/artifact/", listing=True)


@query("l3_resolve_moved", _REPO + """
SELECT "group", artifact, CASE WHEN n % 3 <> 0 THEN CASE WHEN n % 2 = 0 THEN "group" ELSE 'other' END END AS new_group,
       CASE WHEN n % 3 <> 0 THEN 'b' || CAST(page_id AS VARCHAR) END AS new_artifact FROM rp WHERE n % 5 = 0""")
def q_l3(spark, sf):
    return Lp.moves_of_pages(_repo_pages(Landed.get(spark, sf)))


@query("l3_resolved_artifacts", _REPO + """
SELECT "group", artifact, CASE WHEN n % 5 = 0 AND n % 3 <> 0 THEN 'b' || CAST(page_id AS VARCHAR) ELSE artifact END
         AS resolved_artifact, n % 5 = 0 AND n % 3 <> 0 AS moved
FROM rp WHERE NOT (n % 5 = 0 AND n % 3 <> 0 AND n % 2 <> 0)""")
def q_l3b(spark, sf):
    pg = _repo_pages(Landed.get(spark, sf))
    return Lp.resolve_moved(pg.select("group", "artifact"), Lp.moves_of_pages(pg)).select(
        "group", "artifact", "resolved_artifact", "moved")


@query("l4_latest_release", _REPO + """
SELECT page_id, CASE WHEN n % 4 <> 0 THEN 'v' || CAST(page_id AS VARCHAR) END AS latest_release FROM rp""")
def q_l4(spark, sf):
    return Lp.latest_release(_repo_pages(Landed.get(spark, sf)))


@query("l4_download_listing", _REPO + """
SELECT page_id, '/files/' || CAST(page_id AS VARCHAR) AS download_listing FROM rp WHERE n % 3 <> 1""")
def q_l4a(spark, sf):
    return Lp.download_listing(_repo_pages(Landed.get(spark, sf)))[0]


@query("l4_download_listing_missing", _REPO + " SELECT page_id FROM rp WHERE n % 3 = 1")
def q_l4b(spark, sf):
    return Lp.download_listing(_repo_pages(Landed.get(spark, sf)))[1]


def _archive_pages(L: Landed):
    """Download listings: each link of a page as a file, whose title attribute ends in one of three suffixes."""
    links = Lp.page_links(_pages(L))
    sfx = F.element_at(F.array(F.lit("-sources.jar"), F.lit("-test-sources.jar"), F.lit(".jar")),
                       (F.length("href") % 3 + 1).cast("int"))
    a = F.concat(F.lit('<a title="f'), F.col("pos").cast("string"), sfx, F.lit('" href="'), F.col("href"), sfx, F.lit('">f</a>'))
    return links.groupBy("page_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", a.alias("a")))), lambda x: x["a"]), "\n").alias("html"))


@query("l5_source_archives", _PAGES + """,
al AS (SELECT page_id, pos, href, (['-sources.jar', '-test-sources.jar', '.jar'])[CAST(length(href) % 3 + 1 AS INTEGER)] AS sfx
       FROM links),
x AS (SELECT page_id, pos, 'f' || CAST(pos AS VARCHAR) || sfx AS title, 'https://repo.example.org/files' || href || sfx AS url
      FROM al),
held AS (SELECT DISTINCT split_part(url, '/', -1) AS file_name FROM x WHERE length(url) % 4 = 0)
SELECT page_id, pos, title, url, split_part(url, '/', -1) AS file_name FROM x
WHERE ends_with(title, '-sources.jar') AND NOT ends_with(title, 'test-sources.jar')
  AND split_part(url, '/', -1) NOT IN (SELECT file_name FROM held)""")
def q_l5(spark, sf):
    links = Lp.page_links(_archive_pages(Landed.get(spark, sf)))
    x = links.select("page_id", "pos", "title", F.concat(F.lit("https://repo.example.org/files"), "href").alias("url"))
    held = x.filter(F.length("url") % 4 == 0).select(F.substring_index("url", "/", -1).alias("file_name"))
    return Lp.source_archives(x, held).select("page_id", "pos", "title", "url", "file_name")


# ---- selection and labels
def _label_rows(L: Landed):
    lb = L.t("labels")
    t3 = F.when(F.col("quality") != 1 - F.col("toxic"), F.array(F.struct(F.lit("t3").alias("tagger"),
                                                                          F.col("quality").alias("is_valid"))))
    votes = F.concat(F.array(F.struct(F.lit("t1").alias("tagger"), F.col("quality").alias("is_valid")),
                             F.struct(F.lit("t2").alias("tagger"), (1 - F.col("toxic")).alias("is_valid"))),
                     F.coalesce(t3, F.array().cast("array<struct<tagger:string,is_valid:int>>")))
    return lb.select(F.col("doc_id").alias("artifact_id"), F.explode(votes).alias("_v")).select(
        "artifact_id", "_v.tagger", F.col("_v.is_valid").cast("int").alias("is_valid"))


_LABELS = """
lbl AS (SELECT doc_id AS artifact_id, quality AS t1, 1 - toxic AS t2,
               CASE WHEN quality <> 1 - toxic THEN quality END AS t3 FROM labels),
verd AS (SELECT artifact_id, CAST(CASE WHEN t3 IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_taggers,
                CAST(t1 + t2 + coalesce(t3, 0) AS BIGINT) AS n_valid,
                CASE WHEN (t1 + t2 + coalesce(t3, 0)) * 2 <> (CASE WHEN t3 IS NULL THEN 2 ELSE 3 END)
                     THEN (t1 + t2 + coalesce(t3, 0)) * 2 > (CASE WHEN t3 IS NULL THEN 2 ELSE 3 END) END AS is_valid,
                t1 = t2 AS agreed FROM lbl)"""


@query("p2_adjudicate_labels", "WITH " + _LABELS + "\nSELECT * FROM verd")
def q_p2(spark, sf):
    v = P.adjudicate_labels(_label_rows(Landed.get(spark, sf)))
    return v.select("artifact_id", F.col("n_taggers").cast("long").alias("n_taggers"),
                    F.col("n_valid").cast("long").alias("n_valid"), "is_valid", "agreed")


_P1_SQL = _groups_sql(_FINAL)


@query("p1_select_replacements", f"""
SELECT id, CASE id % 4 WHEN 1 THEN 'getName(0)' WHEN 2 THEN 'main(1)' ELSE old_method END AS old_method, new_method, count
FROM (SELECT * REPLACE (1 + id % 3 AS count) FROM ({_P1_SQL}) q) r WHERE id % 4 NOT IN (1, 2) AND count >= 2""")
def q_p1(spark, sf):
    # the mined replacements with some methods renamed to a getter and to main, and counts from 1 to 3
    rep, four = Landed.get(spark, sf).mined.replacements, F.col("id") % 4
    rep = rep.withColumn("count", 1 + F.col("id") % 3).withColumn("old_method", F.when(
        four == 1, F.lit("getName(0)")).when(four == 2, F.lit("main(1)")).otherwise(F.col("old_method")))
    return P.select_replacements(rep, min_count=2).select("id", "old_method", "new_method", "count")


@query("p3_funnel", f"""
WITH r AS ({_P1_SQL}),
{_LABELS}
SELECT 'candidates' AS stage, CAST(count(*) AS BIGINT) AS n FROM r
UNION ALL SELECT 'selected', CAST(count(*) AS BIGINT) FROM r WHERE count >= 2
UNION ALL SELECT 'valid', CAST(count(*) AS BIGINT) FROM r WHERE count >= 2
  AND id IN (SELECT artifact_id FROM verd WHERE is_valid)""")
def q_p3(spark, sf):
    L = Landed.get(spark, sf)
    rep = L.mined.replacements
    sel = P.select_replacements(rep, min_count=2)
    out = P.funnel(rep, sel, P.adjudicate_labels(_label_rows(L)))
    return out.select("stage", F.col("n").cast("long").alias("n"))


# ---- U1: per-commit hook with a simple callback
def _count_changes(state, row):
    n, changes, prev, _ = state
    if prev is not None and row["subject"] != prev:
        changes += 1
    return (n + 1, changes, row["subject"], row["sha"]), []


def _close(key, state):
    n, changes, _, last = state
    return [{"repo": int(key[0]), "n_commits": n, "n_subject_changes": changes, "last_sha": last}]


@query("u1_analyze_history", """
WITH c AS (SELECT o_custkey AS repo, CAST(o_orderkey AS VARCHAR) AS sha, o_orderpriority AS subject,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS idx FROM orders),
d AS (SELECT *, lag(subject) OVER (PARTITION BY repo ORDER BY idx) AS prev FROM c)
SELECT repo, CAST(count(*) AS BIGINT) AS n_commits,
       CAST(count(*) FILTER (WHERE prev IS NOT NULL AND prev <> subject) AS BIGINT) AS n_subject_changes,
       arg_max(sha, idx) AS last_sha
FROM d GROUP BY repo""")
def q_u1(spark, sf):
    c = Landed.get(spark, sf).commits.select("repo", "idx", "sha", "subject")
    return analyze_history(c, _count_changes, _close,
                           "repo long, n_commits long, n_subject_changes long, last_sha string",
                           init=lambda: (0, 0, None, None))
