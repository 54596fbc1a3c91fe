"""The end-to-end replacement mining plan and its result tables.

Order matters for cost: the cheap import-section test (R12) prunes edited
files before any diff text is exploded, file text is joined last and only for
surviving groups, and every project-state check is an interval join over bins.
Groups, their occurrences and their candidate APIs are tables of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from codetrail.functions.lineage import materialize

from codetrail.functions.arrays import with_once
from codetrail.functions.calls import calls_of_pair, render_call_list
from codetrail.operators import diffs as D
from codetrail.operators import replace as G
from codetrail.operators.deps import imported_targets
from codetrail.operators.history import expand_changes
from codetrail.sources.ids import assign_ids


@dataclass
class MiningInputs:
    commits: DataFrame          # repo, idx, sha, parent_sha, subject
    repos: DataFrame            # repo, repo_name, default_branch
    file_changes: DataFrame     # repo, idx, kind, old_path, path
    diffs: DataFrame            # repo, idx, old_path, path, word_diff, line_diff
    snapshots: DataFrame        # repo, idx, path, content
    intervals: DataFrame        # repo, path, valid_from, valid_to
    decl_versions: DataFrame    # repo, path, name, n_args, varargs, is_constructor, line_start, line_end, valid_from, valid_to
    call_versions: DataFrame    # repo, path, name, n_args, valid_from, valid_to
    api_catalog: DataFrame      # id, project, class, name, n_args, is_public
    base_packages: DataFrame    # project, package
    extension: str = ".java"    # changes of other files aren't edits of code


def materialized(inp: MiningInputs) -> MiningInputs:
    """The state tables that several joins of the plan read, written to the shared folder."""
    from dataclasses import replace
    return replace(inp, decl_versions=materialize(inp.decl_versions),
                   call_versions=materialize(inp.call_versions),
                   intervals=materialize(inp.intervals))


def edited_files(file_changes: DataFrame, extension: str = ".java") -> DataFrame:
    return (expand_changes(file_changes).filter((F.col("event") == "edit") & F.col("path").endswith(extension))
            .select("repo", "idx", "old_path", "path", "edit_rank"))


def candidate_pairs(inp: MiningInputs) -> DataFrame:
    """R12 -> D1/D2 -> X2 -> G1..G5: first changed call pairs of all edited files, however many a commit has."""
    # both are read three times below: materialise them once
    edited = materialize(edited_files(inp.file_changes, inp.extension))
    # an edited file was re-added at its commit, so its text is the snapshot stored at that commit
    content = inp.snapshots.join(edited.select("repo", "idx", "path").distinct(), ["repo", "idx", "path"], "left_semi")
    pk = materialize(imported_targets(content.filter(F.col("content").isNotNull()), inp.base_packages))
    diffs = inp.diffs.join(pk.select("repo", "idx", "path"), ["repo", "idx", "path"], "left_semi")
    pairs = D.paired_replacements(D.diff_lines(diffs))
    pairs = (with_once(pairs, "_c", calls_of_pair(F.col("removed"), F.col("added")))
             .withColumn("removed_calls", F.col("_c.removed_calls")).withColumn("added_calls", F.col("_c.added_calls"))
             .drop("_c"))
    c = G.drop_pure_add_remove(G.common_calls(G.comparable_pairs(pairs)))
    c = G.drop_non_api_names(G.first_changed_call(c))
    return c.join(pk, ["repo", "idx", "path"]).join(edited.select("repo", "idx", "path", "edit_rank"),
                                                    ["repo", "idx", "path"])


def checked_pairs(inp: MiningInputs, cands: DataFrame) -> DataFrame:
    """G6..G9: old call local before and gone after; new call not local and really called."""
    return G.replaced_by_external(cands, inp.decl_versions, inp.call_versions)


def members_of(checked: DataFrame) -> DataFrame:
    """The members of all groups, with the texts that the result shows."""
    return G.group_members(checked.select(
        *G.REPLACEMENT_KEY, "edit_rank", "path", "pos", "k", "old_path", "before", "after", "packages",
        "removed", "added", render_call_list(F.col("removed_calls")).alias("removed_methods"),
        render_call_list(F.col("added_calls")).alias("added_methods"),
        F.size("removed_calls").alias("n_removed"), F.size("added_calls").alias("n_added")))


def replacement_groups(inp: MiningInputs, members: DataFrame) -> DataFrame:
    """G11 -> G15 -> G16 -> G17."""
    g = G.old_declaration(G.group_replacements(members), inp.decl_versions)
    return G.drop_already_using(G.declaration_body(g, inp.snapshots, inp.intervals))


@dataclass
class Mined:
    """The result tables of a run: ``APIReplacements`` (S11), their candidate APIs and ``ImportsChanges``."""
    replacements: DataFrame
    candidates: DataFrame       # replacement_id, api_id
    import_changes: DataFrame


def mine_replacements(inp: MiningInputs, materialize_inputs: bool = True) -> Mined:
    """The result tables of all commits of all repositories.

    The state tables are read by several joins, so they are materialised once in the shared folder; so are the
    surviving groups, which feed all result tables.
    """
    if materialize_inputs:
        inp = materialized(inp)
    members = materialize(members_of(checked_pairs(inp, candidate_pairs(inp))))
    return results(materialize(replacement_groups(inp, members)), members, inp)


def results(groups: DataFrame, members: DataFrame, inp: MiningInputs) -> Mined:
    ids = materialize(assign_ids(groups.select(*G.GROUP_KEY), ["repo", "idx", "old_name", "old_n_args", "new_name",
                                                                "new_n_args", "gid"], base=1))
    # groups times APIs: matched once per call and package set, counted as lists, made into rows only where they are read
    matches = materialize(G.matching_classes(groups, inp.api_catalog))
    occurrences = G.occurrences_of(members, groups)
    found = G.candidate_apis(groups, inp.api_catalog, matches=matches, lists=True)
    counted = G.with_candidate_count(groups, found).join(G.render_occurrences(occurrences), list(G.GROUP_KEY))
    numbered = groups.join(ids, list(G.GROUP_KEY)).select("id", "new_name", "new_n_args", "rep")
    candidates = G.candidate_apis(numbered, inp.api_catalog, gkey=["id"], matches=matches)
    return Mined(write_replacements_frame(counted.join(ids, list(G.GROUP_KEY)), inp),
                 candidates.withColumnRenamed("id", "replacement_id"), import_changes_frame(occurrences, inp))


def write_replacements_frame(groups: DataFrame, inp: MiningInputs) -> DataFrame:
    """The result columns (ids dense from 1 in (repo, commit, old, new, group) order); the ids of the candidate APIs
    are a table of their own."""
    c = inp.commits.select("repo", "idx", "sha", "parent_sha", "subject")
    r = inp.repos.select("repo", "repo_name", "default_branch")
    x = groups.join(c, ["repo", "idx"]).join(r, "repo", "left")
    return x.select(
        "id", "repo_name", "default_branch", F.col("parent_sha").alias("prev_commit"),
        F.col("sha").alias("cur_commit"), F.col("subject").alias("commit_message"),
        F.format_string("%s(%d)", "old_name", "old_n_args").alias("old_method"),
        F.format_string("%s(%d)", "new_name", "new_n_args").alias("new_method"),
        F.col("count").cast("long").alias("count"),
        "replacement_paths",
        F.col("old_decl.path").alias("old_method_decl_path"),
        F.col("old_decl.line_start").alias("old_method_decl_line_start"),
        F.col("old_decl.line_end").alias("old_method_decl_line_end"),
        F.col("old_body").alias("old_method_decl_body"),
        F.col("rep.removed").alias("diffRemovedText"), F.col("rep.added").alias("diffAddedText"),
        F.col("rep.removed_methods").alias("removedMethods"), F.col("rep.added_methods").alias("addedMethods"),
        F.col("rep.n_removed").alias("nRemovedMethods"), F.col("rep.n_added").alias("nAddedMethods"),
        F.col("n_candidates").cast("long").alias("nCandidateAPIs"))


def import_changes_frame(occurrences: DataFrame, inp: MiningInputs) -> DataFrame:
    """Import changes of the result files (added / removed joined by newlines)."""
    files = G.result_files(occurrences)
    imp = D.import_changes(inp.diffs.join(files, ["repo", "idx", "old_path", "path"], "left_semi"))
    c = inp.commits.select("repo", "idx", "sha", "parent_sha")
    r = inp.repos.select("repo", "repo_name", "default_branch")
    x = imp.join(c, ["repo", "idx"]).join(r, "repo", "left")
    x = assign_ids(x, ["repo", "idx", "path"], base=1)
    return x.select("id", "repo_name", "default_branch", F.col("parent_sha").alias("prev_commit"),
                    F.col("sha").alias("cur_commit"), "path", F.col("added_text").alias("added"),
                    F.col("removed_text").alias("removed"))
