"""Diff text -> rows (word-diff pairs, line numbers, hunks, import changes).

Diff text is a landed column (one row per edited file).  Lines are numbered
with running sums over arrays inside that row and exploded last, so no diff
text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrail.functions.arrays import bound, running
from codetrail.functions.lineage import materialize
from codetrail.functions.text import java_strip, java_trim

# The marks of a word diff, [-removed-] and {+added+}; and where a removed text meets the added one.
RM_OPENS, RM_CLOSES, ADD_OPENS, ADD_CLOSES = "[-", "-]", "{+", "+}"
MEETING = RM_CLOSES + ADD_OPENS
# A hunk header: line before, line after, and how many lines after.
HEADER = r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,(\d+))? @@"

# Kinds of lines of a word diff: the first two end a stretch of code, a passive line is none and changes no counter.
_HEADER, _RESET, _PASSIVE, _ONLY_ADDED, _ONLY_REMOVED, _BOTH = range(6)
# Both counters of a line are one number: that of lines before, times this, and that of lines after.
_SIDE = 1 << 32

FILE_KEYS = ("repo", "idx", "old_path", "path")


# ---------------------------------------------------------------- D1
def diff_lines(diffs: DataFrame, text_col: str = "word_diff", keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """Code lines of a word diff with hunk number and before/after line numbers.

    Lines are stripped.  ``diff --git``, ``---`` and ``+++`` lines leave the
    hunk; a ``@@ -b[,n] +a[,m] @@`` header starts one at (b, a).  A blank line
    advances both counters, a line that is entirely ``{+..+}`` only the
    after-counter, one that is entirely ``[-..-]`` only the before-counter, any
    other line both.  A line's numbers are the counters before it advances them.
    """
    keys = list(keys)

    def kind(line):
        """What a line is to the counters."""
        return (F.when(line.startswith("@@"), F.when(line.rlike(HEADER), _HEADER).otherwise(_PASSIVE))
                .when(line.startswith("diff --git") | line.startswith("---") | line.startswith("+++"), _RESET)
                .when(line.startswith("{+") & line.endswith("+}"), _ONLY_ADDED)
                .when(line.startswith("[-") & line.endswith("-]"), _ONLY_REMOVED).otherwise(_BOTH))

    x = diffs.select(*keys, F.transform(F.split(F.col(text_col), "\n"), java_strip).alias("_l"))
    x = x.withColumn("_k", F.transform("_l", kind))
    # the lines that end a stretch of code, and the stretches of the hunks: from a header to the next such line or to the end
    x = x.withColumn("_c", F.filter(F.transform("_k", lambda k, i: F.when(k.isin(_HEADER, _RESET), i)), lambda i: i.isNotNull()))

    def stretch(at, k):
        def counter(n):
            return F.regexp_extract(F.get("_l", at), HEADER, n).try_cast("int")

        return F.when(F.get("_k", at) == _HEADER, F.struct(
            at.alias("at"), F.coalesce(F.get("_c", k + 1), F.size("_l")).alias("stop"), counter(1).alias("b"), counter(2).alias("a")))

    x = x.withColumn("_h", F.filter(F.transform("_c", stretch), lambda h: h.isNotNull()))

    def steps(k):
        """What a line adds to the counter before, times ``_SIDE``, and to the counter after."""
        return (F.when(k == _BOTH, _SIDE + 1).when(k == _ONLY_ADDED, 1).when(k == _ONLY_REMOVED, _SIDE).otherwise(0)).cast("long")

    def numbered(h, n):
        first, size = h["at"] + 2, h["stop"] - h["at"] - 1

        def rows(known):
            """known: the steps of the lines, and their sums up to and with each."""
            def row(line, i):
                past = F.get(known["sums"], i) - F.get(known["steps"], i)
                return F.when(F.get(known["steps"], i) > 0, F.struct(
                    (h["at"] + 1 + i).alias("pos"), (n + 1).alias("hunk"), line.alias("line"),
                    (h["b"] + F.shiftright(past, 32)).cast("int").alias("before"),
                    (h["a"] + F.pmod(past, F.lit(_SIDE))).cast("int").alias("after")))
            return F.transform(F.slice("_l", first, size), row)

        inside = F.transform(F.slice("_k", first, size), steps)
        # a header whose first number is no int starts no code
        return F.when(h["b"].isNotNull() & (size > 0), bound(inside, lambda s: bound(
            F.struct(s.alias("steps"), running(s, lambda v, w: v + w, F.lit(0).cast("long")).alias("sums")), rows)))

    found = F.filter(F.transform("_h", numbered), lambda r: r.isNotNull())
    kept = F.filter(F.flatten(found), lambda r: r.isNotNull())
    return x.select(*keys, F.explode(kept).alias("_r")).select(*keys, "_r.*")


_PAIRS = "array<struct<removed:string,added:string>>"


def _pieces(line: Column, mark: str) -> Column:
    return F.split(line, "\\Q" + mark + "\\E")


def _met(line: Column) -> Column:
    """The (removed, added) pairs of a line, read from the places where one meets the other.

    ``left`` is what stands before such a place, from the end of the last pair on.  What follows is an added text if it
    closes before another one opens, and what stands before is a removed text from its last opening on; else the place was
    part of a text, and joins what is left of the next one.
    """
    def step(acc: Column, after: Column) -> Column:
        closes, opens = F.instr(after, ADD_CLOSES), F.instr(after, ADD_OPENS)
        pair = ((closes > 0) & ((opens == 0) | (opens > closes)) & F.contains(acc["left"], F.lit(RM_OPENS))
                & ~acc["left"].endswith(RM_OPENS[0]))  # there the place's first character is part of an opening
        found = F.struct(F.substring_index(acc["left"], RM_OPENS, -1).alias("removed"),
                         F.substring(after, F.lit(1), closes - 1).alias("added"))
        return F.struct(F.when(pair, F.substring(after, closes + 2, F.length(after))).otherwise(
            F.concat(acc["left"], F.lit(MEETING), after)).alias("left"),
            F.when(pair, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def walked(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.struct(parts[0].alias("left"), F.array().cast(_PAIRS).alias("out")),
                           step, lambda acc: acc["out"])

    return bound(_pieces(line, MEETING), walked)


def _lone_removed(line: Column) -> Column:
    """Texts that open, hold no other opening, and close at the first close that no ``{`` follows."""
    bodies = bound(_pieces(line, RM_OPENS), lambda x: F.slice(x, F.lit(2), F.size(x)))

    def body(text: Column) -> Column:
        ends = bound(_pieces(text, RM_CLOSES), lambda x: F.filter(F.transform(x, lambda _, i: F.when(
            (i + 1 < F.size(x)) & ~F.get(x, i + 1).startswith("{"), F.array_join(F.slice(x, F.lit(1), i + 1), RM_CLOSES))),
            lambda t: t.isNotNull()))
        return F.struct(F.get(ends, F.lit(0)).alias("removed"), F.lit(None).cast("string").alias("added"))

    return F.filter(F.transform(bodies, body), lambda p: p["removed"].isNotNull())


def _lone_added(line: Column) -> Column:
    """Texts whose opening doesn't stand after a ``]``, up to their first close; they hold no other opening."""
    def texts(x: Column) -> Column:
        return F.transform(x, lambda text, i: F.when(
            (i > 0) & F.contains(text, F.lit(ADD_CLOSES)) & ~F.get(x, i - 1).endswith("]"),
            F.struct(F.lit(None).cast("string").alias("removed"), F.substring_index(text, ADD_CLOSES, 1).alias("added"))))

    return F.filter(bound(_pieces(line, ADD_OPENS), texts), lambda p: p.isNotNull())


def _as_rows(lines: DataFrame, found: Column) -> DataFrame:
    cols = [c for c in lines.columns if c != "line"]
    return (lines.filter(F.col("line") != "").select(*cols, F.posexplode(found).alias("k", "_p"))
            .select(*cols, "k", java_trim(F.col("_p.removed")).alias("removed"), java_trim(F.col("_p.added")).alias("added")))


# ---------------------------------------------------------------- D2
def paired_replacements(lines: DataFrame) -> DataFrame:
    """Every ``[-X-]{+Y+}`` of a code line -> (trim X, trim Y) with the line's before/after numbers."""
    return _as_rows(lines, _met(F.col("line")))


# ---------------------------------------------------------------- D3
def unpaired_changes(lines: DataFrame) -> DataFrame:
    """D3: lone removals (``[-X-]`` not followed by ``{``) and lone additions (``{+Y+}`` not after ``]``).

    The other side is null (null-safe, unlike the reference's unused branch).
    """
    r = _as_rows(lines, _lone_removed(F.col("line"))).withColumn("side", F.lit("removed"))
    a = _as_rows(lines, _lone_added(F.col("line"))).withColumn("side", F.lit("added"))
    return r.unionByName(a)


# ---------------------------------------------------------------- D4
def import_changes(diffs: DataFrame, text_col: str = "line_diff", keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """Text after ``+import `` / ``-import `` anywhere in a line, in order, also rendered with newlines."""
    added = F.regexp_extract_all(F.col(text_col), F.lit(r"\+import (.*)"), 1)
    removed = F.regexp_extract_all(F.col(text_col), F.lit(r"-import (.*)"), 1)
    return (diffs.select(*keys, added.alias("added"), removed.alias("removed"))
            .withColumn("added_text", F.array_join("added", "\n"))
            .withColumn("removed_text", F.array_join("removed", "\n")))


# ---------------------------------------------------------------- D5
def hunks(diffs: DataFrame, text_col: str = "line_diff", keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """Hunk text (lines after a ``@@`` header, each ending in a newline) with the new-file range.

    Text before the first header is not a hunk; every real hunk, including the
    last one, is emitted (the reference drops its last hunk).
    """
    keys = list(keys)
    x = diffs.select(*keys, F.split(F.col(text_col), "\n").alias("_l"))
    x = x.withColumn("_at", F.filter(F.transform("_l", lambda t, i: F.when(t.startswith("@@"), i)), lambda i: i.isNotNull()))

    def hunk(at, k):
        # lines after the header up to the next one, or to the end
        stop = F.coalesce(F.get("_at", k + 1), F.size("_l"))
        range_ = F.split(F.get(F.split(F.element_at("_l", at + 1), " "), F.lit(2)), ",")
        start, n = F.get(range_, F.lit(0)).try_cast("int"), F.coalesce(F.get(range_, F.lit(1)).try_cast("int"), F.lit(1))
        body = F.transform(F.slice("_l", at + 2, stop - at - 1), lambda t: F.concat(t, F.lit("\n")))
        return F.struct((k + 1).alias("hunk"), start.alias("start"),
                        F.when(F.size(range_) > 1, start + n - 1).otherwise(start).alias("end"),
                        F.array_join(body, "").alias("text"))

    return x.select(*keys, F.explode(F.transform("_at", hunk)).alias("_h")).select(*keys, "_h.*")


# ---------------------------------------------------------------- D6
def modified_line_ranges(diffs: DataFrame, text_col: str = "line_diff", keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """New-file ``[start, start + n - 1]`` of each ``@@`` header; n defaults to 1."""
    x = diffs.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    x = x.filter(F.col("line").startswith("@@") & F.col("line").rlike(HEADER))
    start = F.regexp_extract("line", HEADER, 2).cast("int")
    n = F.coalesce(F.regexp_extract("line", HEADER, 3).try_cast("int"), F.lit(1))
    return x.select(*keys, "pos", start.alias("start"), (start + n - 1).alias("end"))


# ---------------------------------------------------------------- D7
def size_guard(pairs: DataFrame, edited_files: DataFrame, max_files: int = 20, max_pairs: int = 1000,
               warn_pairs: int = 250, commit_keys: Sequence[str] = ("repo", "idx"),
               file_keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """Size flags; no pair is dropped.

    ``n_edited`` files of the commit, ``n_pairs`` of the file, ``many_files`` (more than ``max_files``), ``many_pairs``
    (more than ``max_pairs``) and ``many_changes`` (more than ``warn_pairs``).  The pairs come out of a parse, so they are
    written once and counted from their keys; both counts meet in a row per file, which the pairs (their texts) are joined with.
    """
    file_keys, commit_keys = list(file_keys), list(commit_keys)
    pairs = materialize(pairs)
    n_files = edited_files.groupBy(*commit_keys).agg(F.count(F.lit(1)).alias("n_edited"))
    n_pairs = pairs.groupBy(*file_keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    if set(commit_keys) <= set(file_keys):
        sized = pairs.join(n_pairs.join(n_files, commit_keys), file_keys)
    else:
        sized = pairs.join(n_pairs, file_keys).join(n_files, commit_keys)
    return (sized.withColumn("many_files", F.col("n_edited") > max_files)
            .withColumn("many_pairs", F.col("n_pairs") > max_pairs)
            .withColumn("many_changes", F.col("n_pairs") > warn_pairs))
