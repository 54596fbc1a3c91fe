"""Dependencies and library knowledge.

Every step is a join or an aggregate over landed tables: project type
declarations, dependency coordinates, library class lists, the library API
catalog and its packages, build files and file text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrail.functions.arrays import NONE_OPEN, bound, open_blocks, running_sum
from codetrail.functions.text import glob_to_regex, java_lines
from codetrail.functions.windows import ordered_index
from codetrail.functions.xml import parsed, root_name

# Library groups kept as targets when reading project dependencies.
TARGET_GROUPS = ("org.apache.commons", "commons-io", "commons-daemon")

# The names that build files end in.
MAVEN_FILE = "pom.xml"
GRADLE_FILES = ("build.gradle", "build.gradle.kts")

# R12 looks import lines up by substrings of a package name of this length.
GRAM = 6


# ---------------------------------------------------------------- R1
def resolve_local(invocations: DataFrame, types: DataFrame, project: str = "project",
                  cls: str = "cls", type_name: str = "qualified_name") -> DataFrame:
    """Flag calls whose class is declared in the same project (``is_local``)."""
    t = types.select(F.col(project).alias("_p"), F.col(type_name).alias("_t")).distinct()
    j = invocations.join(t, (invocations[project] == t["_p"]) & (invocations[cls] == t["_t"]), "left")
    return j.withColumn("is_local", F.col("_t").isNotNull()).drop("_p", "_t")


# ---------------------------------------------------------------- R4
def flag_platform_calls(df: DataFrame, cls: str = "cls") -> DataFrame:
    """``is_java`` for ``java.`` classes; ``is_javax_or_sun`` for the report."""
    return (df.withColumn("is_java", F.coalesce(F.col(cls).startswith("java."), F.lit(False)))
            .withColumn("is_javax_or_sun", F.coalesce(F.col(cls).startswith("javax.") | F.col(cls).startswith("sun."),
                                                      F.lit(False))))


# ---------------------------------------------------------------- R2
def resolve_external(invocations: DataFrame, deps: DataFrame, classes: DataFrame, fallback: bool = False,
                     key: str = "inv_id", repo: str = "repo", cls: str = "cls") -> DataFrame:
    """R2: link non-local, non-``java.`` calls to the one dependency holding their class.

    ``invocations`` need ``key``, ``repo``, ``cls``, ``is_local``, ``is_java``;
    ``deps`` (repo, group, artifact, version); ``classes`` (library ``g:a:v``, class).
    Outcome ``status``: linked, versions / libraries (several dependencies match:
    not linked, no fallback), fallback (linked to the smallest library id holding
    the class, when enabled), unlinked, or skipped (local / java).
    """
    # a class is resolved once per repository, not once per call
    asked = (invocations.filter(~F.col("is_local") & ~F.col("is_java") & F.col(cls).isNotNull())
             .select(F.col(repo).alias("_repo"), F.col(cls).alias("_cls")).distinct())
    d = deps.select(F.col(repo).alias("_d_repo"), "group", "artifact", "version",
                    F.concat_ws(":", "group", "artifact", "version").alias("_lib")).distinct()
    holds = classes.select(F.col("library").alias("_lib"), F.col("class").alias("_c")).distinct()
    # Libraries that somebody depends on are numbered in the order of their coordinates; what a class is in and what a
    # repository depends on are sets of numbers.  A popular class is one row with a long set, never a row per version.
    known = ordered_index(d.select("_lib", "group", "artifact", "version").distinct(), [],
                          ["group", "artifact", "version", "_lib"], out="_code").withColumn("_code", F.col("_code").cast("int"))
    numbers = known.select("_lib", "_code")
    of_class = holds.join(numbers, "_lib").groupBy("_c").agg(F.collect_set("_code").alias("_in"))
    of_repo = d.join(numbers, "_lib").groupBy("_d_repo").agg(F.collect_set("_code").alias("_on"))
    both = (asked.join(of_class, F.col("_cls") == F.col("_c")).join(of_repo, F.col("_repo") == F.col("_d_repo"))
            .select("_repo", "_cls", F.array_intersect("_on", "_in").alias("_hits")).filter(F.size("_hits") > 0)
            .select("_repo", "_cls", F.array_min("_hits").alias("_first"), F.array_max("_hits").alias("_last")))
    coordinates = F.struct("group", "artifact", "version")
    first = known.select(F.col("_code").alias("_first"), coordinates.alias("_lib"))
    last = known.select(F.col("_code").alias("_last"), coordinates.alias("_max"))
    # one library <=> smallest and largest matching coordinate agree (no distinct aggregation needed)
    per = both.join(first, "_first").join(last, "_last").select("_repo", "_cls", "_lib", "_max")
    if fallback:
        smallest = holds.groupBy("_c").agg(F.min("_lib").alias("_any"))
        parts = F.split("_any", ":")
        any_lib = asked.join(smallest, F.col("_cls") == F.col("_c")).select(
            "_repo", "_cls", F.struct(F.get(parts, 0).alias("group"), F.get(parts, 1).alias("artifact"),
                                      F.get(parts, 2).alias("version")).alias("_fb"))
        per = any_lib.join(per, ["_repo", "_cls"], "left")
    else:
        per = per.withColumn("_fb", F.lit(None).cast("struct<group:string,artifact:string,version:string>"))
    out = invocations.join(per, (F.col(repo) == F.col("_repo")) & (F.col(cls) == F.col("_cls"))
                           & ~F.col("is_local") & ~F.col("is_java"), "left")
    one_lib = F.col("_lib") == F.col("_max")
    one_ga = (F.col("_lib.group") == F.col("_max.group")) & (F.col("_lib.artifact") == F.col("_max.artifact"))
    status = (F.when(F.col("is_local") | F.col("is_java"), F.lit("skipped"))
              .when(F.col("_lib").isNull() & F.col("_fb").isNotNull(), F.lit("fallback"))
              .when(F.col("_lib").isNull(), F.lit("unlinked"))
              .when(one_lib, F.lit("linked"))
              .when(one_ga, F.lit("versions"))
              .otherwise(F.lit("libraries")))
    return (out.withColumn("status", status)
            .withColumn("library", F.when(F.col("status") == "linked", F.col("_lib"))
                        .when(F.col("status") == "fallback", F.col("_fb")))
            .drop("_repo", "_cls", "_lib", "_max", "_fb"))


# ---------------------------------------------------------------- R3
def resolution_report(resolved: DataFrame, cls: str = "cls") -> DataFrame:
    """Totals of the resolution outcome (one row)."""
    s = F.col("status")
    return resolved.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s != "skipped").alias("considered"),
        F.count_if(s == "linked").alias("linked"),
        F.count_if(s == "unlinked").alias("not_linked"),
        F.count_if((s == "unlinked") & (F.col(cls).startswith("javax.") | F.col(cls).startswith("sun."))).alias("not_linked_javax_sun"),
        F.count_if(s == "versions").alias("multi_version"),
        F.count_if(s == "libraries").alias("multi_library"),
        F.count_if(s == "fallback").alias("linked_by_fallback"))


def version_key(v):
    """Numeric-aware sort key of a version string: numeric parts as numbers, then text."""
    parts = F.split(v, r"[.\-]")
    return F.transform(parts, lambda p: F.struct(
        F.coalesce(p.try_cast("long"), F.lit(-1)).alias("n"), p.alias("s")))


# ---------------------------------------------------------------- R5
def upgrade_missing_versions(deps: DataFrame, catalog: DataFrame) -> DataFrame:
    """A dependency whose exact version is not in the catalog takes the latest catalog
    version of the same group/artifact (numeric-aware order); otherwise it is unchanged."""
    have = catalog.select("group", "artifact", F.col("version").alias("_v"), F.lit(True).alias("_present")).distinct()
    latest = (catalog.groupBy("group", "artifact")
              .agg(F.max_by("version", version_key(F.col("version"))).alias("_latest")))
    out = (deps.join(have, (deps["group"] == have["group"]) & (deps["artifact"] == have["artifact"])
                     & (deps["version"] == have["_v"]), "left")
           .drop(have["group"]).drop(have["artifact"]).drop("_v"))
    out = out.join(latest, ["group", "artifact"], "left")
    return (out.withColumn("version", F.when(F.col("_present").isNull() & F.col("_latest").isNotNull(), F.col("_latest"))
                           .otherwise(F.col("version")))
            .withColumn("upgraded", F.col("_present").isNull() & F.col("_latest").isNotNull())
            .drop("_present", "_latest"))


# ---------------------------------------------------------------- R6
def available_dependencies(deps: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("group", "artifact", "version")):
    """Distinct dependencies present in the catalog, and the missing ones (for counting)."""
    d = deps.select(*keys).distinct()
    c = catalog.select(*keys).distinct()
    return d.join(c, list(keys), "left_semi"), d.join(c, list(keys), "left_anti")


# ---------------------------------------------------------------- R7
# A coordinate is written as three quoted names in the brackets of a call, or as names with colons between them.
BLOCK_OPENS = "dependencies {"
NAME = r"[\w.-]+"
BRACKETS = r"\w\(([^()]*)\)"
NAMES_AND_COLONS = r"[\w.:-]+"


def _pairs(parts: Column) -> Column:
    """group and artifact of a list of three names."""
    return F.transform(parts, lambda t: F.struct(t[0].alias("group"), t[1].alias("artifact")))


def _in_brackets(line: Column) -> Column:
    """Bracketed lists of exactly three names in double quotes."""
    def unquoted(arg: Column) -> Column:
        return F.regexp_extract(arg, rf'^\s*"({NAME})"\s*$', 1)

    lists = F.transform(F.regexp_extract_all(line, F.lit(BRACKETS), 1), lambda x: F.transform(F.split(x, ","), unquoted))
    return _pairs(F.filter(lists, lambda x: (F.size(x) == 3) & ~F.array_contains(x, "")))


def _with_colons(line: Column) -> Column:
    """Each stretch of names with single colons between them, three names at a time."""
    stretches = F.flatten(F.transform(F.regexp_extract_all(line, F.lit(NAMES_AND_COLONS), 0), lambda x: F.split(x, "::+")))
    names = F.transform(stretches, lambda x: F.filter(F.split(x, ":"), lambda n: n != ""))
    threes = F.transform(F.filter(names, lambda x: F.size(x) >= 3), lambda x: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(x) / 3).cast("int") - 1), lambda i: F.slice(x, i * 3 + 1, F.lit(3))))
    return _pairs(F.flatten(threes))


def _in_block(lines: Column) -> Column:
    """Per line, whether it stands in a block: after a line that opens one, up to the first line after which the brace
    balance is lower than it was at the opening."""
    change = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("{")), 1).when(F.contains(x, F.lit("}")), -1).otherwise(0))
    opens = F.transform(lines, lambda x: F.contains(x, F.lit(BLOCK_OPENS)))
    return F.transform(open_blocks(running_sum(change), opens), lambda x: x != NONE_OPEN)


def gradle_dependencies(files: DataFrame, content: str = "content", keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """(group, artifact) of dependency coordinates inside a ``dependencies {`` block.

    A line that contains ``dependencies {`` opens a block and isn't scanned itself; a line with ``{`` raises the brace
    balance by one, otherwise one with ``}`` lowers it, and the block reaches up to the line that brings the balance
    below its opening's.  Per line the call form ``f("g", "a", "v")`` is used if there is one, else the ``g:a:v`` form.
    Balance and open blocks are running values inside the file's row, so a file takes one pass.
    """
    keys = list(keys)
    x = files.select(*keys, java_lines(F.col(content)).alias("_lines"))
    x = x.select(*keys, F.posexplode(F.arrays_zip(F.col("_lines").alias("line"), _in_block(F.col("_lines")).alias("scan")))
                 .alias("pos", "_z")).filter(F.col("_z.scan"))
    line = F.col("_z.line")
    pairs = bound(_in_brackets(line), lambda found: F.when(F.size(found) > 0, found).otherwise(_with_colons(line)))
    return (x.select(*keys, "pos", F.explode(pairs).alias("_d"))
            .select(*keys, "pos", F.col("_d.group").alias("group"), F.col("_d.artifact").alias("artifact")))


# ---------------------------------------------------------------- R8
_POM = "dependencies STRUCT<dependency: ARRAY<STRUCT<groupId: STRING, artifactId: STRING, version: STRING>>>"


def pom_dependencies(files: DataFrame, content: str = "content", keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """(group, artifact, version) of each ``/project/dependencies/dependency`` of a Maven file.

    Each element is read as one record, so what one lacks is null and doesn't shift the others; a file that isn't
    well-formed XML has no rows (``malformed_poms`` lists those), nor has one whose root isn't ``project``.
    """
    deps = parsed(F.col(content), _POM)["dependencies"]["dependency"]
    return (files.filter(root_name(F.col(content)) == "project").select(*keys, F.posexplode(deps).alias("k", "_d"))
            .select(*keys, "k", F.col("_d.groupId").alias("group"), F.col("_d.artifactId").alias("artifact"),
                    F.col("_d.version").alias("version")))


def malformed_poms(files: DataFrame, content: str = "content", keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """The Maven files that aren't well-formed XML."""
    from codetrail.functions.xml import well_formed
    return files.filter(~well_formed(F.col(content))).select(*keys)


# ---------------------------------------------------------------- R9
UNKNOWN, EMPTY, KNOWN = "unknown", "empty", "known"


def build_systems(build_files: DataFrame, repos: DataFrame | None = None, repo: str = "repo") -> DataFrame:
    """Which build files decide about each repository: (repo, build) with ``maven``, ``gradle`` or null.

    A repository with a Maven file is read by its Maven files alone, else by its Gradle files of either language.  Files
    of other names count for nothing; ``repos`` adds repositories that have no row in ``build_files``.
    """
    path = F.col("path")
    gradle = path.endswith(GRADLE_FILES[0])
    for name in GRADLE_FILES[1:]:
        gradle = gradle | path.endswith(name)
    names = build_files.select(repo, "path")
    if repos is not None:
        names = names.unionByName(repos.select(repo, F.lit(None).cast("string").alias("path")))
    return names.groupBy(repo).agg(F.when(F.max(path.endswith(MAVEN_FILE)), F.lit("maven"))
                                   .when(F.max(gradle), F.lit("gradle")).alias("build"))


def dependency_rows(build_files: DataFrame, builds: DataFrame, targets: Sequence[str] = TARGET_GROUPS,
                    repo: str = "repo") -> DataFrame:
    """The child table: distinct (repo, group, artifact) of the target groups, from the files that decide."""
    path = F.col("path")
    chosen = build_files.join(builds, repo)
    poms = chosen.filter((F.col("build") == "maven") & path.endswith(MAVEN_FILE))
    gradle = chosen.filter(F.col("build") == "gradle")
    either = path.endswith(GRADLE_FILES[0])
    for name in GRADLE_FILES[1:]:
        either = either | path.endswith(name)
    from_pom = pom_dependencies(poms, keys=(repo, "path")).select(repo, "group", "artifact")
    from_gradle = gradle_dependencies(gradle.filter(either), keys=(repo, "path")).select(repo, "group", "artifact")
    return from_pom.unionByName(from_gradle).filter(F.col("group").isin(*targets)).distinct()


def project_dependencies(build_files: DataFrame, targets: Sequence[str] = TARGET_GROUPS, repo: str = "repo",
                         repos: DataFrame | None = None) -> DataFrame:
    """(repo, build, state, group, artifact): what is known about the dependencies of each repository.

    ``state``: ``unknown`` (no build file: the question has no answer), ``empty`` (build files without a target
    dependency) or ``known``.  A repository of the first two kinds is one row without group and artifact.
    """
    builds = build_systems(build_files, repos, repo)
    found = dependency_rows(build_files, builds, targets, repo)
    state = (F.when(F.col("build").isNull(), F.lit(UNKNOWN)).when(F.col("group").isNull(), F.lit(EMPTY)).otherwise(F.lit(KNOWN)))
    return builds.join(found, repo, "left").select(repo, "build", state.alias("state"), "group", "artifact")


# ---------------------------------------------------------------- R10
def restrict_to_dependencies(apis: DataFrame, deps: DataFrame, project: str = "project", repo: str = "repo",
                             keep_unknown: bool = False) -> DataFrame:
    """Keep the (repository, API) rows whose library (``group|artifact|...``) the repository depends on.

    ``deps`` are plain (repo, group, artifact) rows or those of R9 with their ``state``.  A repository with no dependency
    keeps nothing; one of unknown dependencies has no answer, and keeps nothing either unless ``keep_unknown`` asks for
    all its rows.  A repository that ``deps`` doesn't name is unknown too.
    """
    parts = F.split(F.col(project), r"\|")
    held = deps.filter(F.col("group").isNotNull())
    d = held.select(F.col(repo).alias("_r"), F.col("group").alias("_g"), F.col("artifact").alias("_a")).distinct()
    kept = apis.join(d, (F.col(repo) == F.col("_r")) & (F.get(parts, F.lit(0)) == F.col("_g"))
                     & (F.get(parts, F.lit(1)) == F.col("_a")), "left_semi")
    if not keep_unknown:
        return kept
    answered = (deps.filter(F.col("state") != UNKNOWN) if "state" in deps.columns else held).select(repo).distinct()
    return kept.unionByName(apis.join(answered, repo, "left_anti").select(apis.columns))


# ---------------------------------------------------------------- R11
def base_packages(packages: DataFrame, project: str = "project", package: str = "package") -> DataFrame:
    """The shortest package of each library (ties: alphabetical)."""
    return packages.groupBy(project).agg(
        F.min(F.struct(F.length(package).alias("_l"), F.col(package).alias("_p")))["_p"].alias("package"))


# ---------------------------------------------------------------- R12
def imported_targets(files: DataFrame, packages: DataFrame, content: str = "content",
                     keys: Sequence[str] = ("repo", "idx", "path"), package: str = "package") -> DataFrame:
    """Target packages named in the import section of each file -> (keys, packages array).

    The section ends at the first line containing ``class `` or ``interface ``
    (located in the whole text; only the section's ``import`` lines are
    exploded); a line counts if it contains ``import``; it names at most one package, the
    first in list order (longest, then alphabetical) that it contains as plain
    text.  Import lines repeat across files and versions, so each distinct line is matched once: a package is looked up
    by that of its substrings of ``GRAM`` characters which the fewest lines hold (none does: no line names it), so that
    what all names share is nobody's key, and the pairs found are tested.
    """
    keys = list(keys)
    text = F.col(content)
    # The section ends at the first line that contains "class " or "interface ": find that
    # line in the whole text, then explode only the lines of the section that contain "import".
    hit = F.least(*[F.when(F.instr(text, w) > 0, F.instr(text, w)) for w in ("class ", "interface ")])
    before_hit = F.substring(text, F.lit(1), hit - 1)
    line_start = F.length(before_hit) - F.instr(F.reverse(before_hit), "\n") + 1
    section = F.when(hit.isNull(), text).otherwise(
        F.when(F.instr(before_hit, "\n") > 0, F.substring(text, F.lit(1), line_start - 1)).otherwise(F.lit("")))
    lines = F.split(section, "\n")
    imp = (files.select(*keys, F.posexplode(lines).alias("pos", "line"))
           .filter(F.col("line").contains("import")))
    pk = packages.select(F.col(package).alias("_pkg")).distinct().filter(F.col("_pkg") != "")
    # a name shorter than GRAM is looked up whole; the lengths in use are five at most
    short = sorted(r[0] for r in pk.filter(F.length("_pkg") < GRAM).select(F.length("_pkg")).distinct().collect())

    def substrings(of: str, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(of) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(of))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(of), i, F.lit(n))))

    distinct_lines = imp.select("line").distinct()
    grams = distinct_lines.select("line", F.explode(F.flatten(F.array(*[substrings("line", n) for n in [*short, GRAM]]))).alias("_gram"))
    possible = pk.select("_pkg", F.explode(F.when(F.length("_pkg") < GRAM, F.array("_pkg"))
                                           .otherwise(substrings("_pkg", GRAM))).alias("_gram"))
    in_lines = (grams.join(possible.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram")
                .agg(F.count(F.lit(1)).alias("_n")))
    # a package with a substring that no line holds can't be in one: it must find all its substrings
    keyed = (possible.join(in_lines, "_gram", "left").groupBy("_pkg")
             .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_k"))
             .filter(F.col("_k.n") > 0).select("_pkg", F.col("_k.g").alias("_gram")))
    first = (grams.join(keyed, "_gram").filter(F.contains(F.col("line"), F.col("_pkg")))
             .groupBy("line").agg(F.min(F.struct((-F.length("_pkg")).alias("_l"), F.col("_pkg").alias("_p")))["_p"].alias("_pkg")))
    return imp.join(first, "line").groupBy(*keys).agg(F.array_sort(F.collect_set("_pkg")).alias("packages"))


# ---------------------------------------------------------------- R13
def public_api_catalog(decls: DataFrame) -> DataFrame:
    """Library declarations that are public."""
    return decls.filter(F.col("is_public"))


# ---------------------------------------------------------------- R14
def match_library_patterns(libs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Expand ``*`` entries of the library list against known (group, artifact, version)s."""
    l = libs.select(F.col("group").alias("_g"), F.col("artifact").alias("_ap"), F.col("version").alias("_vp"))
    j = artifacts.join(l, artifacts["group"] == l["_g"])
    j = j.filter(F.regexp(F.col("artifact"), glob_to_regex(F.col("_ap")))
                 & F.regexp(F.col("version"), glob_to_regex(F.col("_vp"))))
    return j.select("group", "artifact", "version", F.col("_ap").alias("artifact_pattern"),
                    F.col("_vp").alias("version_pattern"))
