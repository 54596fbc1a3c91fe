"""Points in intervals: equi-joins on bins of several widths.

An equi-join of points with intervals on their keys compares every point of a key with every interval of it, which is
quadratic for a hot key.  Here an interval is cut into as few aligned bins as possible: bins of ``WIDTH`` positions at its
ends and bins of ``FAN`` times that, ``FAN`` squared, ... in between, so one that stays open through a million
commits is a few dozen rows and a short one is one or two.  A point looks its bin up once per width that the history's
length has room for.  The same plan serves every size; the bins also deal a hot key out over many partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
FAN = 8
#: Widths: 64, 512, ... positions; the widest bins hold 64 * 8 ** 7 positions.
LEVELS = 8

# The bins of each level that an interval of lowest-level bins _first.._last is cut into: what lies left of the next
# level's first whole bin and right of its last one; at the widest level all that is left.
_SPANS = f"""transform(sequence(0, {LEVELS - 1}), l -> named_struct('level', l,
  'a', (_first + shiftleft(1L, 3 * l) - 1) div shiftleft(1L, 3 * l), 'b', (_last + 1) div shiftleft(1L, 3 * l)))"""
_CUTS = f"""transform({_SPANS}, s -> named_struct('level', s.level, 'a', s.a, 'b', s.b,
  'cut', CASE WHEN s.level = {LEVELS - 1} THEN s.b ELSE least((s.a + {FAN - 1}) div {FAN} * {FAN}, s.b) END))"""
_BINS = f"""flatten(transform(filter({_CUTS}, s -> s.a < s.b), s -> transform(concat(
  CASE WHEN s.cut > s.a THEN sequence(s.a, s.cut - 1) ELSE array() END,
  CASE WHEN s.b > greatest(s.b div {FAN} * {FAN}, s.cut) THEN sequence(greatest(s.b div {FAN} * {FAN}, s.cut), s.b - 1)
       ELSE array() END), x -> named_struct('level', s.level, 'bin', x))))"""
# Fewer than FAN bins in a row hold no whole aligned bin of the next level: they are their own cut.
_FEWEST = f"""CASE WHEN _last - _first < {FAN - 1}
  THEN transform(sequence(_first, _last), x -> named_struct('level', 0, 'bin', x)) ELSE {_BINS} END"""


def interval_bins(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """A row per (level, bin) of the fewest aligned bins that cover the bins ``first`` to ``last`` of the lowest level."""
    return (df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")})
            .withColumn(out, F.explode(F.expr(_FEWEST))).drop("_first", "_last"))


def point_bins(at: Column, levels: Column | None = None) -> Column:
    """(level, bin) that a point is in, for each of the ``levels`` (an array of numbers; all where none is given)."""
    every = F.sequence(F.lit(0), F.lit(LEVELS - 1)) if levels is None else levels
    return F.transform(every, lambda l: F.struct(
        l.alias("level"), F.floor(at / (F.lit(WIDTH) * F.pow(F.lit(FAN), l))).alias("bin")))


def levels_up_to(top: Column) -> Column:
    """The levels that intervals of positions up to ``top`` can have whole bins on."""
    return F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)),
                    lambda l: F.pow(F.lit(FAN), l) <= F.floor(top / F.lit(WIDTH)) + 1)


def binned_interval_join(points: DataFrame, intervals: DataFrame, point_keys: Sequence[str],
                         interval_keys: Sequence[str], at: str, valid_from: str = "valid_from",
                         valid_to: str = "valid_to", top: Column | None = None) -> DataFrame:
    """Inner join of points ``at`` with intervals ``[valid_from, valid_to)`` on equal keys.

    Positions are 0 or more; a null ``valid_to`` is an open end.  Columns of the two sides must not clash; the result has
    all of them.  ``top`` is a position that no interval starts or ends behind, by default the last start or end there is:
    from it on the same intervals are open, so points behind it are looked up there, open intervals reach up to it, and
    points need only the widths that fit below it (one while histories are short).
    """
    if top is None:
        top = intervals.agg(F.max(F.greatest(valid_from, valid_to)).cast("long").alias("_top")).scalar()
    p = points.filter(F.col(at) >= 0).withColumn("_top", F.coalesce(top, F.lit(0)))
    p = p.withColumn("_p", F.explode(point_bins(F.least(F.col(at), F.col("_top")), levels_up_to(F.col("_top"))))).drop("_top")
    iv = intervals.withColumn("_last", F.coalesce(F.col(valid_to) - 1, top)).filter(F.col("_last") >= F.col(valid_from))
    iv = interval_bins(iv, F.floor(F.col(valid_from) / WIDTH), F.floor(F.col("_last") / WIDTH), "_i")
    on = [p[a] == iv[b] for a, b in zip(point_keys, interval_keys, strict=True)]
    on += [p["_p.level"] == iv["_i.level"], p["_p.bin"] == iv["_i.bin"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inside = (F.col(valid_from) <= F.col(at)) & (F.col(valid_to).isNull() | (F.col(valid_to) > F.col(at)))
    return p.join(iv, cond).filter(inside).drop("_p", "_i")
