"""Library pages (L1-L5): a table of already fetched pages replaces the crawler.

Input rows are (group, page_no, url, html).  Pages are read as a parser reads them (``functions/html.py``): tokens, open
elements and entities, all in one pass over the page's row, so comments, scripts and unclosed elements are no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.functions.html import rows_after, with_links

# The sources-archive suffixes, the move notice, the id and class names of the pages' parts.
SOURCES_SUFFIX = "-sources.jar"
TEST_SOURCES_SUFFIX = "test-sources.jar"
MOVED_NOTICE = "This artifact was moved to"
MAIN_CONTENT = "maincontent"
LISTING_CLASS = "im"
RELEASE_CLASSES = ("vbtn", "release")


def _read(pages: DataFrame) -> DataFrame:
    return with_links(pages, MAIN_CONTENT, LISTING_CLASS)


def page_links(pages: DataFrame, keys: Sequence[str] = ("page_id",), listing: bool = False) -> DataFrame:
    """All links of each page in document order: (keys, pos, href, text, title, classes).

    ``listing``: only the links that are direct children of an element of class ``im`` in the main content, which is how a
    listing page names its entries; ``pos`` then counts those.
    """
    keys = list(keys)
    found = F.filter("_links", lambda a: a["child"]) if listing else F.col("_links")
    return (_read(pages).select(*keys, F.posexplode(found).alias("pos", "_a"))
            .select(*keys, "pos", "_a.href", "_a.text", "_a.title", "_a.classes"))


# ---------------------------------------------------------------- L1
def artifact_links(pages: DataFrame, group: str | None = None, prefix: str | None = None,
                   keys: Sequence[str] = ("page_id",), listing: bool = False) -> DataFrame:
    """L1: links whose href starts with ``/artifact/<group>/`` (or ``prefix``); artifact = last path segment.

    ``listing`` looks at the entries of listing pages only, else every link of a page counts.
    """
    pre = prefix if prefix is not None else f"/artifact/{group}/"
    links = page_links(pages, keys, listing)
    return (links.filter(F.col("href").startswith(pre)).drop("classes")
            .withColumn("artifact", F.substring_index("href", "/", -1)))


# ---------------------------------------------------------------- L2
def pages_before_empty(pages: DataFrame, links: DataFrame, listing: str = "group",
                       page_no: str = "page_no", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """L2: keep the pages of each listing before its first page without links.

    ``links`` are all entries of the pages, of whatever group: a page that names other groups only doesn't end a listing.
    """
    keys = list(keys)
    n = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_links"))
    p = pages.join(n, keys, "left").fillna(0, ["n_links"])
    stop = p.filter(F.col("n_links") == 0).groupBy(listing).agg(F.min(page_no).alias("_stop"))
    return (p.join(stop, listing, "left").filter(F.col("_stop").isNull() | (F.col(page_no) < F.col("_stop")))
            .drop("_stop"))


# ---------------------------------------------------------------- L3
def moves_of_pages(pages: DataFrame) -> DataFrame:
    """L3: (group, artifact, new_group, new_artifact) of the artifact pages (group, artifact, html) with a move notice.

    The first table row after the notice names the new group and artifact in its first two links; a notice without
    them gives nulls.
    """
    x = _read(pages)
    # the notice as one text; else the main content's texts one after the other, from the top
    said = F.filter("_main", lambda t: F.contains(t["text"], F.lit(MOVED_NOTICE)))
    together = F.array_join(F.transform("_main", lambda t: t["text"]), " ")
    at = F.when(F.size(said) > 0, F.get(said, F.lit(0))["at"]).when(F.contains(together, F.lit(MOVED_NOTICE)), F.lit(0))
    x = x.withColumn("_at", at).filter(F.col("_at").isNotNull()).withColumn("_row", rows_after("_states", F.col("_at")))
    x = x.withColumn("_a", F.filter("_links", lambda a: a["row"] == F.col("_row")))
    new_group = F.regexp_extract(F.get("_a", F.lit(0))["href"], "^/artifact/([^/]+)/?$", 1)
    new_artifact = F.regexp_extract(F.get("_a", F.lit(1))["href"], "^/artifact/[^/]+/([^/]+)/?$", 1)
    return x.select("group", "artifact", F.nullif(new_group, F.lit("")).alias("new_group"),
                    F.nullif(new_artifact, F.lit("")).alias("new_artifact"))


def resolve_moved(artifacts: DataFrame, moves: DataFrame) -> DataFrame:
    """L3: an artifact moved within its group takes the new name; one moved to another group is
    dropped; a move notice without target keeps the artifact as is."""
    m = moves.select(F.col("group").alias("_g"), F.col("artifact").alias("_a"), "new_group", "new_artifact")
    j = artifacts.join(m, (artifacts["group"] == m["_g"]) & (artifacts["artifact"] == m["_a"]), "left")
    other_group = F.coalesce(F.col("new_group") != F.col("group"), F.lit(False)) & F.col("new_artifact").isNotNull()
    return (j.filter(~other_group)
            .withColumn("resolved_artifact", F.coalesce("new_artifact", "artifact"))
            .withColumn("moved", F.col("new_artifact").isNotNull())
            .drop("_g", "_a", "new_group", "new_artifact"))


# ---------------------------------------------------------------- L4
def latest_release(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """L4: the first link of an artifact page that is marked as a release (classes ``vbtn`` and ``release``), else null."""
    marked = F.filter("_links", lambda a: F.array_contains(a["classes"], RELEASE_CLASSES[0])
                      & F.array_contains(a["classes"], RELEASE_CLASSES[1]))
    return _read(pages).select(*keys, F.get(marked, F.lit(0))["href"].alias("latest_release"))


def download_listing(pages: DataFrame, text: str = "View All", keys: Sequence[str] = ("page_id",)) -> tuple[DataFrame, DataFrame]:
    """L4: the first link in a table row of the main content whose text is ``View All``; and the pages without one."""
    found = F.filter("_links", lambda a: a["main"] & (a["row"] >= 0) & (a["text"] == text))
    x = _read(pages).select(*keys, F.get(found, F.lit(0))["href"].alias("download_listing"))
    return x.filter(F.col("download_listing").isNotNull()), x.filter(F.col("download_listing").isNull()).select(*keys)


# ---------------------------------------------------------------- L5
def source_archives(links: DataFrame, held: DataFrame | None = None, override: bool = False) -> DataFrame:
    """Links whose ``title`` attribute ends in ``-sources.jar`` but not in ``test-sources.jar``; file name = last URL
    segment; files already held are skipped unless ``override``.  ``links`` are those of ``page_links`` with a ``url``."""
    t = F.col("title")
    x = (links.filter(t.endswith(SOURCES_SUFFIX) & ~t.endswith(TEST_SOURCES_SUFFIX))
         .withColumn("file_name", F.substring_index("url", "/", -1)))
    if held is not None and not override:
        x = x.join(held.select("file_name").distinct(), "file_name", "left_anti")
    return x
