"""Selection and labels (P1-P3), described in prose by the reference.

The getter / setter name patterns and the minimum count are parameters (the
prose gives no values); the label majority rule follows the described process:
two taggers per item, a third one when they disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (our choice, the prose names none): accessor and entry-point names excluded from selection.
GETTER_SETTER = r"^(get|set|is)[A-Z_].*"
ENTRY_POINT = "main"


# ---------------------------------------------------------------- P1
def select_replacements(df: DataFrame, min_count: int, method_col: str = "old_method") -> DataFrame:
    """Drop replacements of getters, setters or ``main`` and those seen fewer than ``min_count`` times."""
    name = F.regexp_extract(F.col(method_col), r"^(?:\[[^\]]*\]\s+)?([^(]*)\(", 1)
    return df.filter(~name.rlike(GETTER_SETTER) & (name != ENTRY_POINT) & (F.col("count") >= min_count))


# ---------------------------------------------------------------- P2
def adjudicate_labels(labels: DataFrame, item: str = "artifact_id", tagger: str = "tagger") -> DataFrame:
    """Per item, number of taggers, valid votes, majority verdict and whether the first two taggers agreed.

    The first two votes are those of the two taggers that come first by name (a third one only settles a conflict);
    ``agreed`` is null with fewer than two.  The verdict is null where votes tie.
    """
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col(tagger).alias("t"), F.col("is_valid").alias("v")))), 1, 2)
    votes = labels.groupBy(item).agg(F.count(F.lit(1)).alias("n_taggers"), F.sum("is_valid").alias("n_valid"),
                                     first.alias("_first"))
    tie = F.col("n_valid") * 2 == F.col("n_taggers")
    return (votes.withColumn("is_valid", F.when(~tie, F.col("n_valid") * 2 > F.col("n_taggers")))
            .withColumn("agreed", F.when(F.size("_first") == 2, F.col("_first")[0]["v"] == F.col("_first")[1]["v"]))
            .drop("_first"))


# ---------------------------------------------------------------- P3
def funnel(candidates: DataFrame, selected: DataFrame, verdicts: DataFrame, item: str = "id") -> DataFrame:
    """Counts candidates -> selected -> labelled valid (one row per stage)."""
    valid = selected.join(verdicts.filter(F.col("is_valid")).select(F.col("artifact_id").alias(item)), item, "left_semi")
    return (candidates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("candidates").alias("stage"), "n")
            .unionByName(selected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("selected").alias("stage"), "n"))
            .unionByName(valid.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("stage"), "n")))
