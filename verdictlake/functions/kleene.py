"""Three-valued logic on nullable booleans. SQL's AND, OR and NOT are Kleene's; aggregates are not, hence these."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(*trits: Column) -> Column:
    """AND of columns; true if there are none."""
    return reduce(lambda a, b: a & b, trits, F.lit(True))


def either(*trits: Column) -> Column:
    """OR of columns; false if there are none."""
    return reduce(lambda a, b: a | b, trits, F.lit(False))


def all_of(trits: Column) -> Column:
    """AND over an array; true if it is empty or null."""
    return F.forall(F.coalesce(trits, F.array().cast("array<boolean>")), lambda t: t)


def any_of(trits: Column) -> Column:
    """OR over an array; false if it is empty or null."""
    return F.exists(F.coalesce(trits, F.array().cast("array<boolean>")), lambda t: t)


def from_counts(kind: str, true: Column, false: Column, unknown: Column) -> Column:
    """AND ("and") or OR ("or") of a group, from how many of its trits are true, false and unknown."""
    if kind == "and":
        return F.when(false > 0, False).when(unknown > 0, None).otherwise(True)
    return F.when(true > 0, True).when(unknown > 0, None).otherwise(False)


def count_range(op: str, low: Column, high: Column, count: int) -> Column:
    """Whether a count between low and high compares with count: definite only if it does for all or for none."""
    if op == "<=":
        return F.when(high <= count, True).when(low > count, False)
    if op == "<":
        return F.when(high < count, True).when(low >= count, False)
    if op == ">=":
        return F.when(low >= count, True).when(high < count, False)
    if op == ">":
        return F.when(low > count, True).when(high <= count, False)
    return F.when((low == count) & (high == count), True).when((low > count) | (high < count), False)
