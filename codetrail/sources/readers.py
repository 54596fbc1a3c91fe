"""Readers of landed inputs.

Every reader returns a typed DataFrame; nothing is collected.  Ordered
positions (file order) come from ``assign_ids`` over (file name, row id), so
numbering stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.sources.ids import assign_ids


# ---------------------------------------------------------------- S1
def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Repository CSV (header skipped): column 0 = ``owner/name``, column 4 = default branch.

    Rows without a branch are dropped; ``idx`` is the 0-based position of the
    kept rows in file order; owner and name split at the last ``/``.
    """
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns
    df = raw.select(F.col(c[0]).alias("repo_name"), F.col(c[4]).alias("default_branch"))
    df = (df.filter(F.col("default_branch").isNotNull())
          .withColumn("_file", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id()))
    df = assign_ids(df, ["_file", "_row"], base=0, out="idx").drop("_file", "_row")
    return (df.withColumn("owner", F.regexp_extract("repo_name", r"^(.*)/[^/]*$", 1))
            .withColumn("name", F.substring_index("repo_name", "/", -1)))


# ---------------------------------------------------------------- S2
def read_library_list(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated ``group|artifact|version`` lines (``*`` allowed in artifact and version)."""
    return spark.read.schema("group STRING, artifact STRING, version STRING").option("sep", "|").csv(path)


# ---------------------------------------------------------------- S3
def read_method_declarations(src: DataFrame) -> DataFrame:
    """S3: typed declarations: 0/1 columns become booleans (``isPublic`` -1 becomes null), an
    empty return type becomes ``void``."""
    b = lambda c: F.when(F.col(c) == 1, True).when(F.col(c) == 0, False)
    return (src.withColumn("isPublic", b("isPublic")).withColumn("isConstructor", b("isConstructor"))
            .withColumn("is_deprecated", b("is_deprecated")).withColumn("has_body", b("has_body"))
            .withColumn("has_javaDoc", b("has_javaDoc"))
            .withColumn("return_type", F.when(F.col("return_type") == "", "void").otherwise(F.col("return_type"))))


# ---------------------------------------------------------------- S4
def read_method_invocations(src: DataFrame, with_source: bool = True,
                            skip_cols: Sequence[str] = ()) -> DataFrame:
    """Typed invocations; ``library`` struct only when group, artifact or version is set;
    optional source columns and skipped legacy columns."""
    lib = F.when(F.coalesce("library_groupId", "library_artifactId", "library_version").isNotNull(),
                 F.struct(F.col("library_groupId").alias("group"), F.col("library_artifactId").alias("artifact"),
                          F.col("library_version").alias("version")))
    out = (src.withColumn("library", lib)
           .withColumn("is_local_invoc", F.col("is_local_invoc") == 1)
           .withColumn("is_java_invoc", F.col("is_java_invoc") == 1)
           .withColumn("return_type", F.when(F.col("return_type") == "", "void").otherwise(F.col("return_type")))
           .drop("library_groupId", "library_artifactId", "library_version", *skip_cols))
    if not with_source:
        out = out.drop("project_name", "commit_sha", "path")
    return out


# ---------------------------------------------------------------- S5
def read_packages(src: DataFrame) -> DataFrame:
    """Package declarations set-deduplicated per project."""
    return src.dropDuplicates(["project_name", "package", "dir_path"])


# ---------------------------------------------------------------- S6
def read_source_files(src: DataFrame) -> DataFrame:
    """One source file per (project, path); the row with the larger id wins (ids are unique)."""
    key = ["project_name", "relative_path", "java_file_id"]
    # the keys are aggregated without the text, which then moves once
    latest = src.groupBy(*key[:2]).agg(F.max("java_file_id").alias("java_file_id"))
    return src.join(latest, key, "left_semi")


# ---------------------------------------------------------------- S7
def group_by_project(df: DataFrame, project: str = "project_name") -> DataFrame:
    """Co-locate each project's rows (hash partitioning + sort), instead of one list per project."""
    return df.repartition(project).sortWithinPartitions(project)


def project_sizes(df: DataFrame, project: str = "project_name") -> DataFrame:
    """S7 summary: rows per project (partial aggregation)."""
    return df.groupBy(project).agg(F.count(F.lit(1)).alias("n_rows"))
