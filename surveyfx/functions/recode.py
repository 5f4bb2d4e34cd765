"""Recodes as Column expressions.

Everything here is a plain projection, so Catalyst can fold, push and generate code for it. Null rules are
explicit: a comparison with null stays null, a membership test with null is false.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def member(c: str | Column, values: Iterable) -> Column:
    """True when the value is listed; false for null."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def flag(cond: Column) -> Column:
    """1 / 0, null when the condition is null."""
    return F.when(cond, F.lit(1)).when(~cond, F.lit(0))


def flag_in(c: str | Column, values: Iterable) -> Column:
    """1 when listed, 0 otherwise, never null."""
    return F.when(member(c, values), F.lit(1)).otherwise(F.lit(0))


def indicator(c: str | Column, code) -> Column:
    """0.0 / 1.0 for equality with one code; null stays null."""
    return (col(c) == F.lit(code)).cast("double")


def cases(branches: Iterable[tuple[Column, object]], default=None) -> Column:
    """First branch whose condition holds; null (or `default`) when none does."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def recode(c: str | Column, groups: Mapping[object, Iterable], default=None) -> Column:
    """Map sets of old codes to new values: ``{"Dem": (1, 2, 3), "Rep": (5, 6, 7)}``. Unlisted codes give null."""
    return cases(((col(c).isin(*old), new) for new, old in groups.items()), default)


def collapse(c: str | Column, groups: Mapping[object, Iterable]) -> Column:
    """Merge levels; unlisted levels keep their own value."""
    return recode(c, groups, default=col(c))


def lookup(c: str | Column, labels: Mapping, default=None) -> Column:
    """Label of a code from a small fixed dictionary held in the plan."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(labels.items())))
    found = table[col(c)]
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def relabel(c: str | Column, labels: Mapping[str, str]) -> Column:
    """Rename some levels, keep the others."""
    return lookup(c, labels, default=col(c))


def level_rank(c: str | Column, levels: Iterable) -> Column:
    """1-based position in an ordered level list; null when the value is not listed."""
    return F.nullif(F.array_position(F.array(*(F.lit(x) for x in levels)), col(c)), F.lit(0)).cast("int")


def known_level(c: str | Column, levels: Iterable) -> Column:
    """The value itself when listed, else null."""
    return F.when(col(c).isin(*levels), col(c))


def swap_codes(question: str | Column, response: str | Column, reversed_questions: Iterable[str], swap: Mapping) -> Column:
    """Reverse-code the answers of some questions so that every question points the same way."""
    flipped = recode(response, {new: (old,) for old, new in swap.items()})
    return F.when(member(question, reversed_questions), flipped).otherwise(col(response))


def strip_suffix(c: str | Column, text: str) -> Column:
    """Remove the first occurrence of a literal text."""
    return F.regexp_replace(col(c), rf"^(.*?)\Q{text}\E", "$1")


def stars(p: str | Column) -> Column:
    """Significance marks for a p-value."""
    return cases([(col(p) < 0.001, "***"), (col(p) < 0.01, "**"), (col(p) < 0.05, "*"), (col(p) < 0.1, "†")], "")


def ratio(num: Column, den: Column) -> Column:
    """Floating division, null on an empty denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def weighted_mean(x: Column, w: Column, lost: Column | None = None) -> Column:
    """Aggregate: mean of x weighted by w over rows where x is known.

    A missing weight on a row that counts makes the mean unknown, as no value could be assumed for it. `lost` counts
    such rows when the input is not one row each.
    """
    used = F.when(x.isNotNull(), w)
    lost = F.count_if(x.isNotNull() & w.isNull()) if lost is None else lost
    return F.when(lost == 0, ratio(F.sum(x.cast("double") * used.cast("double")), F.sum(used)))
