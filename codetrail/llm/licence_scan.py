"""Operator 7: licence scan by canonical digest lookup (DataFrame functions only).

A text's canonical form is in lower case, without copyright lines and lines that only reserve all rights, with every run
of characters other than letters and digits as one blank, and with equivalent spellings made one.  SHA-256 digests of
canonical forms are hash-joined with those of the known licence texts, a fixed list of ``KNOWN`` texts (so the
broadcast side doesn't grow with the data).  The units looked up are each whole document and each of its lines (a line
as an entire notice).  A unit is digested only if a known text has its canonical length, which loses no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.llm.licence_texts import KNOWN

#: Words after canonical punctuation, and what they become, in this order.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencee", "licensee"),
             ("sub licence", "sublicense"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
             ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("organisation", "organization"),
             ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"),
             ("non infringement", "noninfringement"), ("per cent", "percent"), ("https", "http"),
             ("copyright holders", "copyright owners"), ("copyright holder", "copyright owner"))
_COPYRIGHT = (r"^\W*(copyright\b\W*(\(c\)|©|\d{4}|\[yyyy\]|<year>|\[year\])|©|\(c\)\s*\d{4}).*$|^\W*all rights reserved\W*$")
_ANY_SPELLING = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def canonical_line(line: Column) -> Column:
    """A line (without line ends) before spellings."""
    low = F.lower(line)
    kept = F.when(low.rlike("(?d)" + _COPYRIGHT), F.lit("")).otherwise(F.replace(low, F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " "))


def one_spelling(text: Column) -> Column:
    out = text
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.when(text.rlike(_ANY_SPELLING), out).otherwise(text)


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), canonical_line)


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_licences(spark: SparkSession) -> DataFrame:
    """license, digest, n (canonical length) of the known texts; of equal ones the first licence by name."""
    listed = F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in KNOWN])
    texts = spark.range(1).select(F.explode(listed).alias("k")).select("k.license", "k.text")
    canon = texts.select("license", one_spelling(whole(canonical_lines(F.col("text")))).alias("c"))
    return canon.groupBy(F.sha2(F.col("c").cast("binary"), 256).alias("digest")).agg(
        F.min("license").alias("license"), F.first(F.length("c")).alias("n"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, license (of the whole text, else null), notices (licences that
    single lines are, sorted, each once) and n_notices (such lines).

    Null and empty texts have neither; repeated rows give repeated rows; an empty table gives none; other columns aren't
    read.  A document that is one line counts in both ways.
    """
    spark = docs.sparkSession
    fixed = known_licences(spark).collect()  # some dozens of digests: the texts stay out of the plan below
    lengths = sorted({r["n"] for r in fixed})
    listed = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(r["digest"]).alias("digest")) for r in fixed])
    known = spark.range(1).select(F.explode(listed).alias("k")).select("k.license", "k.digest")
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text")).alias("lines"))
    units = own.select("doc_id", "row", F.posexplode(F.concat(F.array(whole(F.col("lines"))), F.col("lines")))
                       .alias("unit", "c")).select("doc_id", "row", "unit", one_spelling(F.col("c")).alias("c"))
    units = units.where((F.col("unit") == 0) | F.length("c").isin(lengths))
    looked = units.select("doc_id", "row", "unit", F.when(F.length("c").isin(lengths), F.sha2(F.col("c").cast("binary"), 256))
                          .alias("digest")).join(F.broadcast(known.select("digest", "license")), "digest", "left")
    line = F.when(F.col("unit") > 0, F.col("license"))
    return looked.groupBy("row", "doc_id").agg(
        F.min(F.when(F.col("unit") == 0, F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(line)).alias("notices"), F.count(line).alias("n_notices")).drop("row")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_spellings(column: str) -> str:
    for a, b in SPELLINGS:
        column = f"regexp_replace({column}, '\\b{a}\\b', '{b}', 'g')"
    return column


def _sql_line(column: str) -> str:
    return (f"trim(regexp_replace(CASE WHEN regexp_matches(lower({column}), {_literal(_COPYRIGHT)}) THEN '' "
            f"ELSE replace(lower({column}), '&', ' and ') END, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")


def _sql_lines(column: str) -> str:
    split = f"string_split(regexp_replace(coalesce({column}, ''), '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"list_transform({split}, lambda l: {_sql_line('l')})"


ORACLE_SQL = f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in KNOWN)}) AS v(license, text)),
kc AS (SELECT min(license) AS license, sha256({_sql_spellings("c")}) AS digest FROM
       (SELECT license, array_to_string(list_filter({_sql_lines("text")}, lambda x: x <> ''), ' ') AS c FROM k) AS t
       GROUP BY 2),
d AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
u AS (SELECT doc_id, 0 AS unit, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS c FROM d
      UNION ALL SELECT doc_id, 1, unnest(lines) FROM d),
m AS (SELECT doc_id, unit, license FROM (SELECT doc_id, unit, sha256({_sql_spellings("c")}) AS digest FROM u) AS s
      LEFT JOIN kc USING (digest))
SELECT doc_id, min(license) FILTER (WHERE unit = 0) AS license,
       coalesce(list_sort(list_distinct(list(license) FILTER (WHERE unit = 1))), []) AS notices,
       count(license) FILTER (WHERE unit = 1) AS n_notices FROM m GROUP BY doc_id
"""
