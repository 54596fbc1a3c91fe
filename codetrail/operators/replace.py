"""Replacement detection: a project's own method replaced by a library call.

For a diff pair (removed text, added text) of an edited file the first changed
call pair (old, new) is found (G1-G5), then checked against project state
(G6-G9): the old call was declared in the project at the parent commit and
nowhere at the commit, the new call is not declared in the project and is
really called.  Survivors are grouped per commit (G11), given candidate
library APIs (G13), the old method's body (G15-G17) and import changes (G18).

All project-state checks ask whether a matching declaration or call is alive
at a commit: the distinct (repo, name, arity, commit) points are joined with
the state table on bins of several widths (``functions.joins``), one plan at
every size, and the points found decide the semi and anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrail.functions.joins import binned_interval_join
from codetrail.functions.lineage import materialize
from codetrail.functions.text import java_trim


def _arity(d, n: Column) -> Column:
    """Varargs-aware arity match: a varargs declaration takes n_args or more arguments."""
    return F.when(d("varargs"), d("n_args") <= n).otherwise(d("n_args") == n)


# Column pairs (of the candidate, of the state table) that must agree besides name and arity.
Identity = Sequence[tuple[str, str]]
_POINT = ("_repo", "_name", "_n", "_at")


def _points(cands: DataFrame, name: str, n_args: str, offset: int, repo: str, idx: str, ident: Identity) -> DataFrame:
    """The candidates' distinct (repo, name, arity, commit + offset, identity columns)."""
    return cands.select(F.col(repo).alias("_repo"), F.col(name).alias("_name"), F.col(n_args).alias("_n"),
                        (F.col(idx) + offset).alias("_at"), *[F.col(c).alias(f"_i{k}") for k, (c, _) in enumerate(ident)]
                        ).distinct()


def declared_points(points: DataFrame, decl_versions: DataFrame, ident: Identity = ()) -> DataFrame:
    """The points (repo, name, arity, commit) at which a matching declaration is alive; one pass over the state table."""
    cols = ["repo", "name", "n_args", "varargs", "valid_from", "valid_to", *[d for _, d in ident]]
    v = decl_versions.select(*[F.col(c).alias("_d_" + c) for c in dict.fromkeys(cols)])
    hits = binned_interval_join(points, v, ["_repo", "_name"], ["_d_repo", "_d_name"], "_at", "_d_valid_from", "_d_valid_to")
    cond = _arity(lambda c: F.col("_d_" + c), F.col("_n"))
    for k, (_, d) in enumerate(ident):
        cond = cond & F.col(f"_i{k}").eqNullSafe(F.col("_d_" + d))
    return hits.filter(cond).select(*points.columns).distinct()


def called_points(points: DataFrame, call_versions: DataFrame) -> DataFrame:
    """The points at which a call of that name and exactly that arity is alive."""
    v = call_versions.select(*[F.col(c).alias("_d_" + c) for c in ("repo", "name", "n_args", "valid_from", "valid_to")])
    return (binned_interval_join(points, v, ["_repo", "_name", "_n"], ["_d_repo", "_d_name", "_d_n_args"], "_at",
                                 "_d_valid_from", "_d_valid_to").select(*points.columns).distinct())


def _restrict(cands: DataFrame, points: DataFrame, name: str, n_args: str, offset: int, repo: str, idx: str,
              ident: Identity, how: str) -> DataFrame:
    cond = ((F.col(repo) == F.col("_repo")) & (F.col(name) == F.col("_name")) & (F.col(n_args) == F.col("_n"))
            & (F.col(idx) + offset == F.col("_at")))
    for k, (c, _) in enumerate(ident):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_i{k}"))
    return cands.join(points, cond, how)


def _decl_exists(cands: DataFrame, decls: DataFrame, name: str, n_args: str, offset: int, how: str, ident: Identity,
                 repo: str, idx: str) -> DataFrame:
    hits = declared_points(_points(cands, name, n_args, offset, repo, idx, ident), decls, ident)
    return _restrict(cands, hits, name, n_args, offset, repo, idx, ident, how)


# ---------------------------------------------------------------- G6
def was_local_before(cands: DataFrame, decl_versions: DataFrame, name: str = "name", n_args: str = "n_args",
                     ident: Identity = (), repo: str = "repo", idx: str = "idx") -> DataFrame:
    """The call matches a declaration alive at the parent commit (idx - 1)."""
    return _decl_exists(cands, decl_versions, name, n_args, -1, "left_semi", ident, repo, idx)


# ---------------------------------------------------------------- G7
def gone_after(cands: DataFrame, decl_versions: DataFrame, name: str = "name", n_args: str = "n_args",
               ident: Identity = (), repo: str = "repo", idx: str = "idx") -> DataFrame:
    """The call matches no declaration alive at the commit, in any file."""
    return _decl_exists(cands, decl_versions, name, n_args, 0, "left_anti", ident, repo, idx)


# ---------------------------------------------------------------- G8
def new_not_local(cands: DataFrame, decl_versions: DataFrame, name: str = "new_name", n_args: str = "new_n_args",
                  ident: Identity = (), repo: str = "repo", idx: str = "idx") -> DataFrame:
    """The new call matches no declaration alive at the commit."""
    return _decl_exists(cands, decl_versions, name, n_args, 0, "left_anti", ident, repo, idx)


# ---------------------------------------------------------------- G9
def new_is_called(cands: DataFrame, call_versions: DataFrame, name: str = "new_name", n_args: str = "new_n_args",
                  repo: str = "repo", idx: str = "idx") -> DataFrame:
    """The new call occurs, with exactly its arity, among calls alive at the commit."""
    hits = called_points(_points(cands, name, n_args, 0, repo, idx, ()), call_versions)
    return _restrict(cands, hits, name, n_args, 0, repo, idx, (), "left_semi")


# ---------------------------------------------------------------- G6 and G7
def removed_local_calls(cands: DataFrame, decl_versions: DataFrame, name: str = "name", n_args: str = "n_args") -> DataFrame:
    """G6 and G7 together: the call local before the commit and gone after it; one lookup answers both."""
    asked = (_points(cands, name, n_args, -1, "repo", "idx", ()).unionByName(_points(cands, name, n_args, 0, "repo", "idx", ()))
             .distinct())
    hits = materialize(declared_points(asked, decl_versions))
    before = _restrict(cands, hits, name, n_args, -1, "repo", "idx", (), "left_semi")
    return _restrict(before, hits, name, n_args, 0, "repo", "idx", (), "left_anti")


# ---------------------------------------------------------------- G6-G9
def replaced_by_external(cands: DataFrame, decl_versions: DataFrame, call_versions: DataFrame | None = None) -> DataFrame:
    """G6 to G9 together: the old call local before and gone after, the new one not local and really called.

    The three questions about declarations are answered by one join: all their points, looked up once.  The candidates
    are read six times, so they are materialised first.
    """
    cands = materialize(cands)
    old = ("old_name", "old_n_args")
    new = ("new_name", "new_n_args")
    asked = (_points(cands, *old, -1, "repo", "idx", ()).unionByName(_points(cands, *old, 0, "repo", "idx", ()))
             .unionByName(_points(cands, *new, 0, "repo", "idx", ())).distinct())
    hits = materialize(declared_points(asked, decl_versions))
    c = _restrict(cands, hits, *old, -1, "repo", "idx", (), "left_semi")
    c = _restrict(c, hits, *old, 0, "repo", "idx", (), "left_anti")
    c = _restrict(c, hits, *new, 0, "repo", "idx", (), "left_anti")
    return c if call_versions is None else new_is_called(c, call_versions)


# ---------------------------------------------------------------- G1
def comparable_pairs(pairs: DataFrame, removed_calls: str = "removed_calls", added_calls: str = "added_calls") -> DataFrame:
    """G1: both texts present, both sides call something, and the call lists differ."""
    rc, ac = F.col(removed_calls), F.col(added_calls)
    return pairs.filter(F.col("removed").isNotNull() & F.col("added").isNotNull()
                        & (F.size(rc) > 0) & (F.size(ac) > 0) & (rc != ac))


# ---------------------------------------------------------------- G2
def common_calls(pairs: DataFrame) -> DataFrame:
    """The set of calls present on both sides (``common``)."""
    return pairs.withColumn("common", F.array_intersect("removed_calls", "added_calls"))


# ---------------------------------------------------------------- G3
def drop_pure_add_remove(pairs: DataFrame) -> DataFrame:
    """Drop pairs where every removed call, or every added call, is common."""
    return pairs.filter((F.size(F.array_except("removed_calls", "common")) > 0)
                        & (F.size(F.array_except("added_calls", "common")) > 0))


def _index_of(text: Column, needle: Column, cursor: Column) -> Column:
    """0-based position of ``needle`` at or after a 0-based cursor, -1 if there is none."""
    return F.call_function("locate", needle, text, cursor + 1) - 1


def _call_position(text: Column, name: Column, cursor: Column) -> Column:
    """Where ``name(``, else ``name<``, else ``name`` stands from the cursor on."""
    exact, generic = (_index_of(text, F.concat(name, F.lit(c)), cursor) for c in "(<")
    return F.when(exact >= 0, exact).when(generic >= 0, generic).otherwise(_index_of(text, name, cursor))


def _other_calls(text: Column, calls: Column, common: Column) -> Column:
    """The calls that aren't common, each with the cursor after all calls before it: one pass over the calls."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,n_args:int,cursor:int>>").alias("seen"))

    def step(acc, c):
        past = _index_of(text, c["name"], acc["at"]) + F.length(c["name"])
        here = F.array(F.struct(c["name"].alias("name"), c["n_args"].alias("n_args"), acc["at"].alias("cursor")))
        return F.struct(past.alias("at"), F.when(F.array_contains(common, c), acc["seen"])
                        .otherwise(F.concat(acc["seen"], here)).alias("seen"))
    return F.aggregate(calls, start, step, lambda acc: acc["seen"])


# ---------------------------------------------------------------- G4
def first_changed_call(pairs: DataFrame) -> DataFrame:
    """The first positional pair of non-common calls whose left-hand text differs.

    Equivalent to the reference's two-pointer walk: drop common calls from both
    lists, pair the rest by position, and skip a pair when the text left of both
    calls is equal and, trimmed, neither empty nor ``.``.  If a call name cannot
    be found from the side's cursor the walk stops with no result.  Keeps rows
    with a result and adds ``old_name, old_n_args, new_name, new_n_args``.
    """
    def sides(p):
        return F.struct(p["removed"].alias("removed"), p["added"].alias("added"), F.arrays_zip(
            _other_calls(p["removed"], p["removed_calls"], p["common"]).alias("old"),
            _other_calls(p["added"], p["added_calls"], p["common"]).alias("new")).alias("steps"))

    def located(p):
        both = F.filter(p["steps"], lambda s: s["old"].isNotNull() & s["new"].isNotNull())
        return F.struct(p["removed"].alias("removed"), p["added"].alias("added"), F.transform(both, lambda s: F.struct(
            s["old"].alias("old"), s["new"].alias("new"),
            _call_position(p["removed"], s["old"]["name"], s["old"]["cursor"]).alias("old_at"),
            _call_position(p["added"], s["new"]["name"], s["new"]["cursor"]).alias("new_at"))).alias("steps"))

    def first(p):
        def differs(s):
            left = F.substring(p["removed"], F.lit(1), s["old_at"])
            same = left == F.substring(p["added"], F.lit(1), s["new_at"])
            found = (s["old_at"] >= 0) & (s["new_at"] >= 0)
            return ~found | ~same | java_trim(left).isin("", ".")
        return F.get(F.filter(p["steps"], differs), F.lit(0))

    given = F.array(F.struct("removed", "added", "removed_calls", "added_calls", "common"))
    firsts = F.transform(F.transform(F.transform(given, sides), located), first)
    hits = F.filter(firsts, lambda s: s.isNotNull() & (s["old_at"] >= 0) & (s["new_at"] >= 0))
    # a generator emits the kept pairs, so the walk isn't copied into a filter
    x = pairs.withColumn("_hit", F.explode(hits))
    return (x.withColumn("old_name", F.col("_hit.old.name")).withColumn("old_n_args", F.col("_hit.old.n_args"))
            .withColumn("new_name", F.col("_hit.new.name")).withColumn("new_n_args", F.col("_hit.new.n_args")).drop("_hit"))


# ---------------------------------------------------------------- G5
def drop_non_api_names(df: DataFrame, name: str = "new_name") -> DataFrame:
    """Drop when the new call is ``super``, ``this`` or starts with ``assert``."""
    n = F.col(name)
    return df.filter(~n.isin("super", "this") & ~n.startswith("assert"))


# ---------------------------------------------------------------- G11
# Over a key's distinct package sets in order of first appearance: the number of the first group whose opener shares a
# package with the set; a set that shares none opens a group.
_GROUP_OF_SET = """aggregate(_sets,
  named_struct('openers', CAST(array() AS ARRAY<ARRAY<STRING>>), 'gids', CAST(array() AS ARRAY<INT>)),
  (acc, s) -> element_at(transform(array(
      CAST(array_position(transform(acc.openers, o -> arrays_overlap(o, s.packages)), true) AS INT)), at ->
    named_struct('openers', CASE WHEN at > 0 THEN acc.openers ELSE concat(acc.openers, array(s.packages)) END,
                 'gids', concat(acc.gids, array(CASE WHEN at > 0 THEN at ELSE size(acc.openers) + 1 END)))), 1)).gids"""

REPLACEMENT_KEY = ("repo", "idx", "old_name", "old_n_args", "new_name", "new_n_args")


def group_members(cands: DataFrame, order: Sequence[str] = ("edit_rank", "path", "pos", "k"),
                  key: Sequence[str] = REPLACEMENT_KEY) -> DataFrame:
    """The candidates with ``gid``, the number of their group among those of an equal (old, new) in a commit.

    In edited-file order (renames before modifications, then path, then position in the diff) a member joins the first
    group whose *first* member's packages overlap its own, else it opens a group (not transitive).  Which group that is
    depends on the member's package set alone, so only the distinct sets of a key are put in order; its members never
    meet in one row.
    """
    key, at = list(key), [F.col(c) for c in order]
    sets = cands.groupBy(*key, "packages").agg(F.min(F.struct(*at)).alias("_first"))
    sets = sets.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_first", "packages"))).alias("_sets"))
    numbered = sets.select(*key, F.explode(F.arrays_zip(F.col("_sets.packages").alias("packages"),
                                                        F.expr(_GROUP_OF_SET).alias("gid"))).alias("_s"))
    numbered = numbered.select(*key, F.col("_s.packages").alias("packages"), F.col("_s.gid").alias("gid"))
    return cands.join(numbered, [*key, "packages"])


def group_replacements(members: DataFrame, order: Sequence[str] = ("edit_rank", "path", "pos", "k"),
                       key: Sequence[str] = REPLACEMENT_KEY) -> DataFrame:
    """One row per group of ``group_members`` with ``count`` and the first member's fields (``rep``).

    Where a group occurs is a table of its own (``group_occurrences``): a group of any size is one small row here.
    """
    key, at = list(key), [F.col(c) for c in order]
    payload = [F.col(c) for c in members.columns if c not in (*key, "gid", *order)]
    return members.groupBy(*key, "gid").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*at, *payload)).alias("rep"))


def group_occurrences(members: DataFrame, key: Sequence[str] = REPLACEMENT_KEY) -> DataFrame:
    """The child table of the groups: a row per occurrence with its files and lines, no text."""
    return members.select(*key, "gid", "edit_rank", "old_path", "path", "pos", "k", "before", "after")


# ---------------------------------------------------------------- G12
GROUP_KEY = (*REPLACEMENT_KEY, "gid")

# Occurrences of a file that are put into text at once.
SEGMENT = 4096


def _in_order(df: DataFrame, keys: Sequence[str], first: Column, text: Column, separator: str) -> DataFrame:
    """(keys, first, text): the texts of a key one after the other."""
    at = F.struct(first.alias("f"), text.alias("t"))
    return df.groupBy(*keys).agg(F.min(first).alias("first"), F.array_join(
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x["t"]), separator).alias("text"))


def render_occurrences(occurrences: DataFrame, gkey: Sequence[str] = GROUP_KEY) -> DataFrame:
    """(group key, replacement_paths) with ``("old"->"new"|[b,a][b,a]), (...)`` per file in first-appearance order.

    The text grows in three steps, each a group of its own: the lines of a stretch of a file's diff, a file, a group.  Only
    texts meet in the last one, one for each file.
    """
    gkey, file = list(gkey), [*gkey, "old_path", "path"]
    place = F.struct("edit_rank", "path", "pos", "k")
    lines = F.format_string("[%d,%d]", "before", "after")
    stretches = _in_order(occurrences.withColumn("_part", F.floor(F.col("pos") / SEGMENT)), [*file, "_part"], place, lines, "")
    files = _in_order(stretches, file, F.col("first"), F.col("text"), "")
    shown = F.format_string('("%s"->"%s"|%s)', F.coalesce("old_path", F.lit("null")), F.col("path"), F.col("text"))
    return _in_order(files, gkey, F.struct("first", "old_path"), shown, ", ").select(*gkey, F.col("text").alias("replacement_paths"))


# ---------------------------------------------------------------- G13 / G14
# Classes of one (name, arity) that meet its package sets in one task.
CLASSES_AT_ONCE = 1024
# Candidate rows that the groups of one call and package set are cut into.
CANDIDATES_AT_ONCE = 1 << 20


def matching_classes(groups: DataFrame, catalog: DataFrame, at_once: int = CLASSES_AT_ONCE) -> DataFrame:
    """G13, per call and package set: (_nm, _na, _asked, _ids) with the ids of each public class that matches, a row per class.

    A class is tested once against each distinct package set that asks for its (name, arity), whatever the number of
    groups.  How many classes a (name, arity) has is counted first: one with more than ``at_once`` is dealt over as many
    salts as that takes, and the few sets that ask for it are repeated; all others stay as they are.
    """
    call = ["_nm", "_na"]
    classes = (catalog.filter(F.col("is_public")).groupBy(F.col("name").alias("_nm"), F.col("n_args").alias("_na"),
                                                          F.col("class").alias("_cls"))
               .agg(F.collect_list("id").alias("_ids")))
    sets = groups.select(F.col("new_name").alias("_nm"), F.col("new_n_args").alias("_na"), F.col("rep.packages").alias("_pk")).distinct()
    salts = (classes.groupBy(*call).agg(F.ceil(F.count(F.lit(1)) / at_once).cast("int").alias("_salts"))
             .join(sets.select(*call).distinct(), call, "left_semi"))
    dealt = (classes.join(salts, call).withColumn("_salt", F.pmod(F.hash("_cls"), F.col("_salts"))))
    asked = sets.join(salts, call).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return (asked.select(*call, "_pk", "_salt").join(dealt.select(*call, "_salt", "_cls", "_ids"), [*call, "_salt"])
            .filter(F.exists("_pk", lambda p: F.contains(F.col("_cls"), p)))
            .select(*call, F.col("_pk").alias("_asked"), "_ids"))


def candidate_apis(groups: DataFrame, catalog: DataFrame, gkey: Sequence[str] = GROUP_KEY, at_once: int = CLASSES_AT_ONCE,
                   matches: DataFrame | None = None, lists: bool = False, rows_at_once: int = CANDIDATES_AT_ONCE) -> DataFrame:
    """(group key, api_id): all public APIs with the new call's name and arity whose class contains one of the
    group's imported packages.

    ``matches`` are the ``matching_classes`` of a catalog, where several results read them.  With ``lists`` a row has the ids of
    one class (api_ids), for what only counts them.  There are as many rows as groups times APIs of a popular call, out of
    small tables: how many the groups of a call and package set give is worked out first, and they are dealt over as many
    salts as that takes, in a fixed number of tasks, so that no task is left with all of them.
    """
    gkey = list(gkey)
    if matches is None:
        matches = matching_classes(groups, catalog, at_once)
        matches = matches if lists else materialize(matches)  # read twice below
    g = groups.select(*gkey, *[F.col(c).alias(f"_g{i}") for i, c in enumerate(("new_name", "new_n_args", "rep.packages"))])
    asks = (F.col("_g0") == F.col("_nm")) & (F.col("_g1") == F.col("_na")) & (F.col("_g2") == F.col("_asked"))
    if lists:
        return g.join(matches, asks).select(*gkey, F.col("_ids").alias("api_ids"))
    spark = groups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    n_groups = g.groupBy("_g0", "_g1", "_g2").agg(F.count(F.lit(1)).alias("_n"))
    n_ids = matches.groupBy("_nm", "_na", "_asked").agg(F.sum(F.size("_ids")).alias("_m"))
    salts = F.least(F.ceil(F.col("_n") * F.col("_m") / rows_at_once), F.col("_n")).cast("int")
    parts = materialize(n_groups.join(n_ids, asks).select("_nm", "_na", "_asked", salts.alias("_salts")))
    call = ["_nm", "_na", "_asked"]
    dealt = (g.join(parts, asks).withColumn("_salt", F.pmod(F.xxhash64(*gkey), F.col("_salts")))
             .select(*gkey, *call, "_salt").repartition(tasks, *call, "_salt"))
    repeated = (matches.join(parts, call).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts").cast("long") - 1)))
                .select(*call, "_salt", "_ids").repartition(tasks, *call, "_salt"))  # whichever side is broadcast, the other one is dealt
    return dealt.join(repeated, [*call, "_salt"]).select(*gkey, F.explode("_ids").alias("api_id"))


def with_candidate_count(groups: DataFrame, candidates: DataFrame, gkey: Sequence[str] = GROUP_KEY) -> DataFrame:
    """The groups with ``n_candidates``; the ids stay rows (or lists, api_ids) of ``candidates``, however many there are."""
    gkey = list(gkey)
    found = F.sum(F.size("api_ids")) if "api_ids" in candidates.columns else F.count(F.lit(1))
    n = candidates.groupBy(*gkey).agg(found.alias("n_candidates"))
    return groups.join(n, gkey, "left").fillna(0, ["n_candidates"])


# ---------------------------------------------------------------- G15
def old_declaration(groups: DataFrame, decl_versions: DataFrame, gkey: Sequence[str] = GROUP_KEY) -> DataFrame:
    """The declaration that made G6 true, one per group: smallest (path, line_start)."""
    gkey = list(gkey)
    points = groups.select(*gkey, (F.col("idx") - 1).alias("_at"))
    v = decl_versions.select(*[F.col(c).alias("_d_" + c) for c in (
        "repo", "name", "n_args", "varargs", "path", "line_start", "line_end", "is_constructor", "valid_from", "valid_to")])
    m = binned_interval_join(points, v, ["repo", "old_name"], ["_d_repo", "_d_name"], "_at", "_d_valid_from", "_d_valid_to")
    m = m.filter(_arity(lambda c: F.col("_d_" + c), F.col("old_n_args")))
    best = m.groupBy(*gkey).agg(F.min(F.struct(*[F.col("_d_" + c).alias(c) for c in (
        "path", "line_start", "line_end", "is_constructor")])).alias("old_decl"))
    return groups.join(best, gkey, "left")


# ---------------------------------------------------------------- G16
def declaration_body(groups: DataFrame, snapshots: DataFrame, intervals: DataFrame,
                     relaxed_end: bool = False) -> DataFrame:
    """Text of lines start..end of the old declaration's file at the parent commit.

    A synthetic constructor gives ``(((CONSTRUCTOR)))``; a missing file gives
    null; so does ``line_count <= line_end`` (the reference's test, which also
    drops a method ending on the last line; ``relaxed_end`` uses ``<``).
    """
    from codetrail.functions.text import java_lines
    from codetrail.operators.history import content_at_commit
    req = (groups.filter(F.col("old_decl").isNotNull() & ~F.col("old_decl.is_constructor"))
           .select("repo", (F.col("idx") - 1).alias("idx"), F.col("old_decl.path").alias("path")).distinct())
    text = content_at_commit(snapshots, intervals, req).select(
        "repo", (F.col("idx") + 1).alias("idx"), F.col("path").alias("_dp"), "content")
    j = groups.join(text, (groups["repo"] == text["repo"]) & (groups["idx"] == text["idx"])
                    & (F.col("old_decl.path") == text["_dp"]), "left").drop(text["repo"]).drop(text["idx"])
    lines = java_lines(F.col("content"))
    s, e = F.col("old_decl.line_start"), F.col("old_decl.line_end")
    too_short = (F.size(lines) < e) if relaxed_end else (F.size(lines) <= e)
    body = (F.when(F.col("old_decl").isNull(), F.lit(None))
            .when(F.col("old_decl.is_constructor"), F.lit("(((CONSTRUCTOR)))"))
            .when(F.col("content").isNull(), F.lit(None))
            .when(too_short, F.lit(None))
            .otherwise(F.array_join(F.slice(lines, s, e - s + 1), "\n")))
    return j.withColumn("old_body", body).drop("_dp", "content")


# ---------------------------------------------------------------- G17
def drop_already_using(groups: DataFrame, body: str = "old_body", name: str = "new_name") -> DataFrame:
    """Drop null bodies, and bodies whose text from the first ``{`` contains the new call's name."""
    b = F.col(body)
    brace = F.instr(b, "{")
    uses = (brace > 0) & F.expr(f"substr({body}, instr({body}, '{{'))").contains(F.col(name))
    return groups.filter(b.isNotNull() & ~uses)


# ---------------------------------------------------------------- G18 / G19
def result_files(occurrences: DataFrame) -> DataFrame:
    """The files of a result, from the occurrences of its groups."""
    return occurrences.select("repo", "idx", "old_path", "path").distinct()


def occurrences_of(members: DataFrame, groups: DataFrame, gkey: Sequence[str] = GROUP_KEY) -> DataFrame:
    """The occurrences of the groups that are left."""
    return group_occurrences(members).join(groups.select(*gkey), list(gkey), "left_semi")


def imports_of_result_files(occurrences: DataFrame, import_changes: DataFrame) -> DataFrame:
    """Import changes of each file that holds a surviving replacement."""
    f = result_files(occurrences)
    return import_changes.join(f, [c for c in ("repo", "idx", "path") if c in import_changes.columns], "left_semi")


def restrict_imports(imports: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Keep import changes of the result's key files only (by new path)."""
    return imports.join(result_files(occurrences).select("repo", "idx", "path"), ["repo", "idx", "path"], "left_semi")
