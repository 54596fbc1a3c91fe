"""Running values inside one row: folds over an array that is cut into blocks.

A fold that appends to its result copies the result at every step.  Here only blocks of ``BLOCK`` elements and the list
of block totals are folded that way, so the cost stays close to the array's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is worked out once per row: it comes out of a generator, so the optimizer
    can't copy an expensive expression into the filters and projections above."""
    return df.withColumn(name, F.explode(F.array(value)))


def _fold(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """start, step(start, v1), step(step(start, v1), v2), ...: one element more than ``values``."""
    return F.aggregate(values, F.array(start), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))


def _blocks(values: Column) -> Column:
    """``values`` (a name or a lambda's variable: it is looked at for each block) cut into blocks."""
    n_blocks = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))), lambda b: b < n_blocks),
                       lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, step: Callable[[Column, Column], Column], zero: int | Column) -> Column:
    """The running value of an associative ``step`` up to and with each element (no nulls): of ints, or of any values of
    the type of ``zero``, the neutral element."""
    start = zero if isinstance(zero, Column) else F.lit(zero)

    def joined(parts: Column) -> Column:
        before = _fold(F.transform(parts, lambda p: F.element_at(p, -1)), step, start)
        return bound(before, lambda offsets: F.flatten(F.transform(parts, lambda p, i: F.transform(
            F.slice(p, F.lit(2), F.size(p) - 1), lambda v: step(F.element_at(offsets, i + 1), v)))))

    # what is one block at most needs no joining
    return bound(values, lambda known: F.when(F.size(known) <= BLOCK, F.slice(_fold(known, step, start), F.lit(2), F.size(known)))
                 .otherwise(bound(F.transform(_blocks(known), lambda b: _fold(b, step, start)), joined)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


#: No block is open.
NONE_OPEN = 2**31 - 1


def open_blocks(balance: Column, opens: Column) -> Column:
    """The lowest balance at which a block that is still open was opened, before each element; ``NONE_OPEN`` where none is.

    ``balance`` (ints) and ``opens`` (booleans) have one value per element; a block ends with the first element whose balance
    is below that of its opening.  A stretch of elements does one of two things to what was open before it: its lowest
    balance ends it, and only what the stretch itself leaves open remains, or it stays open, below everything newer.  Two
    stretches make one of the same kind, so this is a running value: one pass, whatever the number of blocks.
    """
    def stretch(low: Column, left: Column) -> Column:
        return F.struct(low.cast("int").alias("low"), left.cast("int").alias("left"))

    def both(a: Column, b: Column) -> Column:
        return stretch(F.least(a["low"], b["low"]),
                       F.when(b["low"] < a["left"], b["left"]).otherwise(F.least(a["left"], b["left"])))

    none = F.lit(NONE_OPEN)

    def walked(each: Column) -> Column:
        after = F.transform(running(each, both, stretch(none, none)), lambda x: x["left"])
        return F.slice(F.concat(F.array(none), after), F.lit(1), F.size(each))

    return bound(F.transform(F.arrays_zip(balance.alias("b"), opens.alias("o")),
                             lambda x: stretch(x["b"], F.when(x["o"], x["b"]).otherwise(none))), walked)


def scan(values: Column, step: Callable[[Column, Column], Column], start: Column,
         emit: Callable[[Column], Column], empty: Column) -> Column:
    """``emit(state)`` after each element, where a state follows from the one before it and the element; the step needn't be
    associative.  ``empty`` is an empty array of the type of the result.  Blocks are walked one after the other, and only
    what ``emit`` keeps of their states is put together, so the cost stays close to the array's length.
    """
    def walk(acc: Column, block: Column) -> Column:
        return bound(_fold(block, step, acc["state"]), lambda states: F.struct(
            F.element_at(states, -1).alias("state"),
            F.concat(acc["out"], F.array(F.transform(F.slice(states, F.lit(2), F.size(block)), emit))).alias("out")))

    return bound(values, lambda known: F.aggregate(_blocks(known), F.struct(start.alias("state"), F.slice(F.array(empty), F.lit(1), F.lit(0)).alias("out")), walk,
                       lambda acc: F.flatten(acc["out"])))
