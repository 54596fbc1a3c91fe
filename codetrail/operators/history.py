"""History preparation (commit lists, file changes, per-commit project state).

The reference walks every repository commit by commit and copies its project
state for each step.  Here all commits of all repositories are handled at once:
a file's state is a set of validity intervals ``[valid_from, valid_to)`` in
commit-index space, so "what existed at commit c" is an interval join.

Commit indexes follow the first-parent chain, oldest first, 1-based; index 0 is
the implicit empty tree that the first real commit is diffed against.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codetrail.functions.joins import binned_interval_join
from codetrail.functions.windows import next_in_order, ordered_index, running_total

# Fixed value: git's well-known hash of the empty tree, the parent of the first commit.
EMPTY_TREE_SHA = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


# ---------------------------------------------------------------- H1
def parse_commit_log(lines: DataFrame, line_col: str = "line", full_subject: bool = False) -> DataFrame:
    """H1: ``sha,subject`` log lines -> (sha, subject).

    Like the reference, the subject is the text between the first and the
    second comma (``full_subject=True`` keeps everything after the first comma);
    a missing subject becomes ''.
    """
    parts = F.split(F.col(line_col), ",")
    if full_subject:
        rest = F.expr(f"substr(`{line_col}`, instr(`{line_col}`, ',') + 1)")
        subject = F.when(F.instr(F.col(line_col), ",") > 0, rest).otherwise(F.lit(""))
    else:
        subject = F.coalesce(F.get(parts, 1), F.lit(""))
    return lines.withColumn("sha", F.get(parts, 0)).withColumn("subject", subject).drop(line_col)


# ---------------------------------------------------------------- H2
def first_parent_chain(log: DataFrame, order: Sequence[str] | None = None, pos_col: str | None = None,
                       repo: str = "repo", sha: str = "sha") -> DataFrame:
    """H2: number a first-parent log oldest first (idx 1..total) and attach the parent sha.

    Give either ``order`` (columns ascending from oldest) or ``pos_col`` (0 = newest,
    as printed by ``git log``).  The parent is found with an equi-join on
    (repo, idx - 1) rather than a ``lag`` window, so a huge repository is not
    funnelled through one task; the first commit's parent is the empty tree.
    """
    totals = log.groupBy(repo).agg(F.count(F.lit(1)).cast("int").alias("total"))
    if pos_col is not None:
        numbered = log.join(totals, repo).withColumn("idx", (F.col("total") - F.col(pos_col)).cast("int"))
    else:
        numbered = ordered_index(log, [repo], list(order or []), out="idx").withColumn("idx", F.col("idx").cast("int"))
        numbered = numbered.join(totals, repo)
    parents = numbered.select(F.col(repo), (F.col("idx") + 1).alias("idx"), F.col(sha).alias("parent_sha"))
    return (numbered.join(parents, [repo, "idx"], "left")
            .withColumn("parent_sha", F.coalesce(F.col("parent_sha"), F.lit(EMPTY_TREE_SHA))))


# ---------------------------------------------------------------- H3
def parse_name_status(lines: DataFrame, line_col: str = "line", extension: str | None = None) -> DataFrame:
    """H3: ``git diff --name-status`` lines -> (kind, old_path, path).

    Kinds: A, D, M, R (prefix test, e.g. R100), C (copy = add of the third
    field), 'other' for every remaining status (counted in totals only).
    Lines starting with ``warning`` are skipped; with ``extension`` (such as ``.java``) only files that end in it count.
    """
    f = F.split(F.col(line_col), "\t")
    action = F.get(f, 0)
    kind = (F.when(action == "A", "A").when(action == "D", "D").when(action == "M", "M")
            .when(action.startswith("R"), "R").when(action.startswith("C"), "C").otherwise("other"))
    path = F.when(kind.isin("R", "C"), F.get(f, 2)).otherwise(F.get(f, 1))
    old_path = F.when(kind.isin("R", "C", "D", "M"), F.get(f, 1))
    wanted = ~action.startswith("warning")
    if extension is not None:
        wanted = wanted & path.endswith(extension)
    return (lines.filter(wanted)
            .withColumn("kind", kind).withColumn("old_path", old_path).withColumn("path", path)
            .drop(line_col))


# ---------------------------------------------------------------- H4
def commit_change_summary(changes: DataFrame, keys: Sequence[str] = ("repo", "idx")) -> DataFrame:
    """H4: per commit, the total and per-kind counts (partial aggregation).

    The reference also keeps per-kind path lists in memory; a single commit
    may touch millions of files, so the lists are not collected into one row:
    they are the change rows themselves (``changes.filter(kind == ...)``).
    """
    k = F.col("kind")
    return changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(k.isin("A", "C")).alias("n_added"),
        F.count_if(k == "D").alias("n_deleted"),
        F.count_if(k == "M").alias("n_modified"),
        F.count_if(k == "R").alias("n_renamed"),
        F.count_if(k == "other").alias("n_other"),
    )


# ---------------------------------------------------------------- H5
def expand_changes(changes: DataFrame) -> DataFrame:
    """H5: one file change -> delete / add / edit events.

    M = delete + add + edit, R = delete old + add new + edit (old -> new),
    A and C = add, D = delete.  ``edit_rank`` orders edits as the reference
    lists them: renames before modifications.
    """
    k = F.col("kind")
    ev = F.array(
        F.struct(F.lit("delete").alias("event"), F.when(k.isin("M", "R"), F.col("old_path"))
                 .when(k == "D", F.col("path")).alias("ev_path")),
        F.struct(F.lit("add").alias("event"), F.when(k.isin("A", "C", "M", "R"), F.col("path")).alias("ev_path")),
        F.struct(F.lit("edit").alias("event"), F.when(k.isin("M", "R"), F.col("path")).alias("ev_path")),
    )
    out = (changes.withColumn("_e", F.explode(ev)).filter(F.col("_e.ev_path").isNotNull())
           .withColumn("event", F.col("_e.event"))
           .withColumn("edit_rank", F.when(F.col("event") == "edit", F.when(k == "R", 0).otherwise(1)))
           .withColumn("old_path", F.when(F.col("event") == "edit", F.col("old_path")))
           .withColumn("path", F.col("_e.ev_path"))
           .drop("_e"))
    return out


# ---------------------------------------------------------------- H9
def file_intervals(events: DataFrame, repo: str = "repo", width: int = 4096) -> DataFrame:
    """H9: per (repo, path) validity intervals of file versions.

    Events of one commit are collapsed with ``max(is_add)`` (removals apply before
    additions), each add opens a version at its commit and the next event of the
    path closes it; ``valid_to`` is null while the version is still alive.
    """
    # dealt once by the stretches in which versions are closed; grouping and ordering stay there
    stretch = F.floor(F.col("idx") / F.lit(width))
    collapsed = (events.filter(F.col("event").isin("add", "delete")).select(
        repo, "path", "idx", stretch.alias("_b"), (F.col("event") == "add").cast("int").alias("is_add"))
                 .repartition(F.col(repo), F.col("path"), F.col("_b"))
                 .groupBy(repo, "path", "_b", "idx").agg(F.max("is_add").alias("is_add")))
    nxt = next_in_order(collapsed, [repo, "path"], "idx", "valid_to", width=width)
    return (nxt.filter(F.col("is_add") == 1)
            .select(repo, "path", F.col("idx").alias("valid_from"), "valid_to"))


# ---------------------------------------------------------------- H6
def files_at_commit(intervals: DataFrame, targets: DataFrame, suffix: str | None = None,
                    repo: str = "repo") -> DataFrame:
    """H6: files alive at each target commit (targets: repo, idx), optional suffix filter.

    A range join: (repo, index bin) equality plus the exact interval test, so a
    repository with very many commits and files is not compared pairwise.
    """
    iv = intervals if suffix is None else intervals.filter(F.col("path").endswith(suffix))
    t = targets.select(F.col(repo).alias("_t_repo"), F.col("idx").alias("_t_idx")).distinct()
    v = iv.select(F.col(repo).alias("_v_repo"), "path", "valid_from", "valid_to")
    j = binned_interval_join(t, v, ["_t_repo"], ["_v_repo"], "_t_idx")
    return j.select(F.col("_t_repo").alias(repo), F.col("_t_idx").alias("idx"), "path")


# ---------------------------------------------------------------- H7
def content_at_commit(snapshots: DataFrame, intervals: DataFrame, requests: DataFrame,
                      repo: str = "repo") -> DataFrame:
    """H7: text of (repo, idx, path) requests; absent or deleted files give null content.

    ``snapshots`` hold the text stored at the commit that added/modified a path;
    the version alive at the requested commit is found with a binned range join
    on (repo, path), and file text is joined last, only for the requests.
    """
    req = requests.select(F.col(repo).alias("_q_repo"), F.col("idx").alias("_q_idx"), F.col("path").alias("_q_path")).distinct()
    iv = intervals.select(F.col(repo).alias("_v_repo"), F.col("path").alias("_v_path"), "valid_from", "valid_to")
    hit = binned_interval_join(req, iv, ["_q_repo", "_q_path"], ["_v_repo", "_v_path"], "_q_idx")
    ver = hit.select("_q_repo", "_q_idx", "_q_path", F.col("valid_from").alias("_ver"))
    snaps = snapshots.select(F.col(repo).alias("_q_repo"), F.col("path").alias("_q_path"), F.col("idx").alias("_ver"), "content")
    located = ver.join(snaps, ["_q_repo", "_q_path", "_ver"])
    out = requests.join(located.select(F.col("_q_repo").alias(repo), F.col("_q_idx").alias("idx"),
                                       F.col("_q_path").alias("path"), "content"), [repo, "idx", "path"], "left")
    return out


# ---------------------------------------------------------------- H6 / H7, delta form
def state_deltas(intervals: DataFrame, commits: DataFrame, every: int = 4096, suffix: str | None = None,
                 repo: str = "repo") -> DataFrame:
    """H6 / H7 for whole histories: (repo, idx, path, change, version), the files of every commit as change sets.

    ``add`` rows are versions that begin at a commit, ``gone`` rows are paths that stop there; every ``every`` commits
    ``full`` rows list all files.  ``version`` is the commit whose snapshot has the text (null for ``gone``).  The size
    is that of the changes plus a list of files for each ``every`` commits, where the expanded form has a list for each
    commit.  ``commits`` (repo, idx) says where each history ends; the implicit empty tree (index 0) has no full rows.
    """
    iv = intervals if suffix is None else intervals.filter(F.col("path").endswith(suffix))
    iv = iv.select(repo, "path", "valid_from", "valid_to")
    add = iv.select(repo, F.col("valid_from").cast("long").alias("idx"), "path", F.lit("add").alias("change"),
                    F.col("valid_from").cast("long").alias("version"))
    ends = iv.filter("valid_to IS NOT NULL").select(repo, F.col("valid_to").cast("long").alias("idx"), "path")
    gone = ends.join(add.select(repo, "idx", "path"), [repo, "idx", "path"], "left_anti").select(
        repo, "idx", "path", F.lit("gone").alias("change"), F.lit(None).cast("long").alias("version"))
    last = commits.groupBy(F.col(repo).alias("_t_repo")).agg(F.max("idx").cast("long").alias("_n")).filter("_n >= 0")
    at = last.select("_t_repo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"), F.lit(every).cast("long"))).alias("_t_idx"))
    at = at.filter("_t_idx > 0")
    alive = binned_interval_join(at, iv.withColumnRenamed(repo, "_v_repo"), ["_t_repo"], ["_v_repo"], "_t_idx")
    full = alive.select(F.col("_t_repo").alias(repo), F.col("_t_idx").alias("idx"), "path", F.lit("full").alias("change"),
                        F.col("valid_from").cast("long").alias("version"))
    return add.unionByName(gone).unionByName(full)


def expand_deltas(deltas: DataFrame, targets: DataFrame, every: int = 4096, repo: str = "repo") -> DataFrame:
    """(repo, idx, path, version): the files alive at the commits of ``targets`` (repo, idx), from ``state_deltas`` made with
    the same ``every``.

    A commit reads the changes since the last multiple of ``every`` and the full rows there, which it meets on
    (repo, idx div every): its work doesn't grow with the length of the history.  Versions are found again by closing
    each one at the next change of its path in that stretch, so that many commits of one stretch stay an interval join.
    """
    stretch = F.floor(F.col("idx") / every)
    # a full row says the same as the add row of its commit
    state = deltas.groupBy(repo, stretch.alias("_s"), "path", "idx").agg(F.max("version").alias("version"))
    closed = state.withColumn("_end", F.lead("idx").over(Window.partitionBy(repo, "_s", "path").orderBy("idx")))
    # positions inside the stretch, so that none passes ``every``
    begin = F.col("_s") * every
    versions = closed.filter("version IS NOT NULL").select(
        F.col(repo).alias("_v_repo"), F.col("_s").alias("_v_s"), "path", "version", (F.col("idx") - begin).alias("valid_from"),
        F.coalesce(F.col("_end") - begin, F.lit(every)).alias("valid_to"))
    asked = targets.select(F.col(repo).alias("_t_repo"), F.col("idx").cast("long").alias("_t_idx"),
                           stretch.alias("_t_s")).distinct().withColumn("_t_at", F.col("_t_idx") - F.col("_t_s") * every)
    hit = binned_interval_join(asked, versions, ["_t_repo", "_t_s"], ["_v_repo", "_v_s"], "_t_at", top=F.lit(every))
    return hit.select(F.col("_t_repo").alias(repo), F.col("_t_idx").alias("idx"), "path", "version")


def content_of_versions(files: DataFrame, snapshots: DataFrame, repo: str = "repo") -> DataFrame:
    """``files`` (repo, path, version and others) with the text of each version, null where no snapshot was landed."""
    text = snapshots.select(F.col(repo), "path", F.col("idx").cast("long").alias("version"), "content")
    return files.join(text, [repo, "path", "version"], "left")


# ---------------------------------------------------------------- H8
def interesting_commits(prev_results: DataFrame, repo: str = "repo_name", commit: str = "cur_commit") -> DataFrame:
    """Distinct (repo, commit) pairs from an earlier run's results, ordered by repo."""
    return prev_results.select(repo, commit).distinct().orderBy(repo, commit)


def restrict_repos(repos: DataFrame, interesting: DataFrame, repo: str = "repo",
                   interesting_repo: str = "repo_name") -> DataFrame:
    """Keep repositories that appear in an earlier run."""
    keys = interesting.select(F.col(interesting_repo).alias("_ir")).distinct()
    return repos.join(keys, repos[repo] == keys["_ir"], "left_semi")


def restrict_commits(commits: DataFrame, interesting: DataFrame, repo: str = "repo",
                     interesting_repo: str = "repo_name", interesting_commit: str = "cur_commit") -> DataFrame:
    """Keep interesting commits and the commit just before each one.

    The reference also always keeps list entry 0, the implicit empty tree,
    which is not a row of ``commits``.  "Just before" is an equi-join on
    (repo, idx + 1), not a ``lead`` window.
    """
    hit = (commits.join(interesting.select(F.col(interesting_repo).alias(repo), F.col(interesting_commit).alias("sha")),
                        [repo, "sha"], "left_semi").select(repo, "idx"))
    wanted = hit.union(hit.select(repo, (F.col("idx") - 1).alias("idx"))).filter(F.col("idx") >= 1).distinct()
    return commits.join(wanted, [repo, "idx"], "left_semi")


# ---------------------------------------------------------------- H10
def state_totals(facts_per_version: DataFrame, intervals: DataFrame, commits: DataFrame,
                 repo: str = "repo", width: int = 4096) -> DataFrame:
    """Running number of facts (declarations or calls) in the project after each commit.

    Each version contributes +n at ``valid_from`` and -n at ``valid_to``; a
    bucketed running sum per repository gives the total after every commit.
    """
    n = facts_per_version.groupBy(repo, "path", F.col("idx").alias("valid_from")).agg(F.count(F.lit(1)).alias("n"))
    v = intervals.join(n, [repo, "path", "valid_from"])
    deltas = (v.select(repo, F.col("valid_from").alias("idx"), F.col("n").alias("d"))
              .union(v.filter(F.col("valid_to").isNotNull()).select(repo, F.col("valid_to").alias("idx"), (-F.col("n")).alias("d")))
              .groupBy(repo, "idx").agg(F.sum("d").alias("d")))
    per_commit = commits.select(repo, "idx").join(deltas, [repo, "idx"], "left").fillna(0, ["d"])
    return running_total(per_commit, [repo], "idx", "d", "n_total", width=width).drop("d")


# ---------------------------------------------------------------- H11
def modified_files(changes: DataFrame, ext: str = ".java") -> DataFrame:
    """Paths with status M and the given extension."""
    return changes.filter((F.col("kind") == "M") & F.col("path").endswith(ext))


# ---------------------------------------------------------------- H12
def all_non_merge_commits(commit_parents: DataFrame, repo: str = "repo") -> DataFrame:
    """Distinct commits over all branches that are not merges (at most one parent)."""
    return commit_parents.filter(F.size("parents") <= 1).select(repo, "sha").distinct()
