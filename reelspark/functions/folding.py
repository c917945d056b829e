"""Folding the rows of a group in order, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def fold_runs(rows: Column, joins: Callable[[Column, Column], Column], merged: Callable[[Column, Column], Column]) -> Column:
    """The array with each element merged into the one before it wherever joins(running, element) holds.

    The running element is carried beside those that are done, so a merge copies nothing that is done.
    """
    state = lambda done, running: F.struct(done.alias("done"), running.alias("running"))

    def add(s: Column, x: Column) -> Column:
        done, running = s["done"], s["running"]
        return F.when(joins(running, x), state(done, merged(running, x))).otherwise(state(F.concat(done, F.array(running)), x))

    first = state(F.slice(rows, 1, 0), F.element_at(rows, 1))
    folded = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), first, add, lambda s: F.concat(s["done"], F.array(s["running"])))
    return F.when(F.size(rows) > 0, folded).otherwise(rows)


def far_apart(rows: Column, place: str, gap: float) -> Column:
    """Of an array with the best element first, those that stay when each element nearer than `gap` to one that stays is dropped.
    The latest is looked at first: where better and better elements follow each other, it is the near one."""
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k[place] - x[place]) < gap)
    return F.aggregate(rows, F.slice(rows, 1, 0), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.concat(F.array(x), kept)))
