"""Column-level text helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_trim(c: Column) -> Column:
    """``String.trim()``: drop leading/trailing characters <= U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def java_strip(c: Column) -> Column:
    """``String.strip()``: drop leading/trailing whitespace, as Unicode and Java see it."""
    return F.regexp_replace(c, r"^\p{javaWhitespace}+|\p{javaWhitespace}+$", "")


def java_lines(c: Column) -> Column:
    """``text.split("\\n")``: like ``split`` but trailing empty strings are dropped."""
    return F.split(F.regexp_replace(c, r"\n+$", ""), "\n")


def glob_to_regex(c: Column) -> Column:
    """Turn a ``*`` wildcard pattern into an anchored regex (other characters literal)."""
    quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(c, r"\*", r"\\E.*\\Q"), F.lit(r"\E"))
    return F.concat(F.lit("^"), quoted, F.lit("$"))
