"""Editing of clauses: offsets, focus and moving the border of the focused clause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges(clauses: Column) -> Column:
    """array<struct<start, end>> of clauses (array<string>), in code points."""
    start = F.transform(clauses, lambda c, i: F.aggregate(F.slice(clauses, 1, i), F.lit(0), lambda a, x: a + F.length(x)))
    return F.zip_with(start, clauses, lambda s, c: F.struct(s.alias("start"), (s + F.length(c)).alias("end")))


def _replaced(clauses: Column, at: Column, values: Column, count: int) -> Column:
    """`count` clauses from `at` (0-based) replaced by `values`, empty ones dropped."""
    new = F.concat(F.slice(clauses, 1, at), values, F.slice(clauses, at + 1 + count, F.greatest(F.size(clauses) - at - count, F.lit(0))))
    return F.filter(new, lambda c: c != "")


def extend_right(clauses: Column, focus: Column) -> Column:
    """The focused clause takes the first character of the next one; the last clause stays."""
    cur, nxt = F.get(clauses, focus), F.get(clauses, focus + 1)
    moved = F.array(F.concat(cur, F.left(nxt, F.lit(1))), F.substring(nxt, F.lit(2), F.length(nxt)))
    return F.when(focus + 1 < F.size(clauses), _replaced(clauses, focus, moved, 2)).otherwise(clauses)


def extend_left(clauses: Column, focus: Column) -> Column:
    """A single clause gives its last character to a new one; the first gives it to the next; others take it from the one before."""
    cur, nxt, prev = F.get(clauses, focus), F.get(clauses, focus + 1), F.get(clauses, focus - 1)
    body = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    last = lambda c: F.right(c, F.lit(1))
    single = F.when(F.length(cur) > 1, F.array(body(cur), last(cur))).otherwise(clauses)
    first = F.when(F.length(cur) > 1, _replaced(clauses, focus, F.array(body(cur), F.concat(last(cur), nxt)), 2)).otherwise(clauses)
    taken = _replaced(clauses, focus - 1, F.array(body(prev), F.concat(last(prev), cur)), 2)
    return F.when(F.size(clauses) == 0, clauses).when(F.size(clauses) == 1, single).when(focus == 0, first).otherwise(taken)


def moved_focus(focus: Column, count: Column, step: int) -> Column:
    """The focus one clause on, round both ends; 0 without clauses."""
    return F.when(count == 0, 0).otherwise(F.pmod(focus + step, count)).cast("int")


def built_string(clauses: Column, selected: Column) -> Column:
    """The selected candidates (0-based; missing: 0) of clauses (array<array<string>>), joined."""
    return F.array_join(F.transform(clauses, lambda c, i: F.get(c, F.coalesce(F.get(selected, i), F.lit(0)))), "")
