"""Aggregates that depend on an explicit order, since rows have none of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_by(value: Column | str, order: Column | str) -> Column:
    """The value of the row with the smallest ``order``; partial aggregates combine it."""
    return F.min_by(value, order)


def ordered_set(value: Column | str, order: Column | str) -> Column:
    """Distinct non-null values by first appearance. For groups that stay small (an entity's models)."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))
