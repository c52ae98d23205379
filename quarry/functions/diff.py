"""The one splice that turns a text into another, by bisection over slices.

No array of characters is made: a common prefix is found in as many comparisons of slices as its
length has binary digits, so a text of a megabyte costs some forty copies of itself. Offsets are
code points, so no character is cut in two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(most: Column) -> Column:
    """Powers of two, largest first, that add up to any length up to ``most``."""
    return F.transform(F.sequence(F.length(F.bin(most.cast("long"))) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def _longest(most: Column, equal) -> Column:
    grow = lambda have, step: F.when((have + step <= most) & equal(have, step), have + step).otherwise(have)
    return F.aggregate(_steps(most), F.lit(0), grow)


def common_prefix(a: Column, b: Column) -> Column:
    """Code points that both texts begin with."""
    most = F.least(F.length(a), F.length(b))
    return _longest(most, lambda have, step: F.substr(a, have + 1, step) == F.substr(b, have + 1, step))


def common_suffix(a: Column, b: Column, most: Column) -> Column:
    """Code points that both texts end with, ``most`` at most."""
    piece = lambda t, have, step: F.substr(t, F.length(t) - have - step + 1, step)
    return _longest(most, lambda have, step: piece(a, have, step) == piece(b, have, step))


def splice(before: Column, after: Column, caret: Column | None = None) -> Column:
    """(start, end, inserted): replace before[start:end] by inserted to get after. Null for equal or null texts.

    The smallest splice, its start as far right as the texts allow. Where repeated letters leave a
    choice, ``caret``, the place after the edit, decides: what follows it was there before.
    """
    head = common_prefix(before, after)
    tail = common_suffix(before, after, F.least(F.length(before), F.length(after)) - head)
    made = lambda start, end, stop: F.struct(start.alias("start"), end.alias("end"), F.substr(after, start + 1, stop - start).alias("inserted"))
    least = made(head, F.length(before) - tail, F.length(after) - tail)
    if caret is not None:
        end = F.length(before) - (F.length(after) - caret)
        # lengths first: a slice from before the text's start is no slice of it
        fits = (caret >= 0) & (caret <= F.length(after)) & (end >= 0)
        kept = F.substr(before, F.greatest(end, F.lit(0)) + 1, F.length(after)) == F.substr(after, F.greatest(caret, F.lit(0)) + 1, F.length(after))
        least = F.when(fits & kept, made(F.least(caret, end, head), end, caret)).otherwise(least)
    return F.when(before != after, least)
