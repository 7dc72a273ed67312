"""Left folds over an array column that keep every intermediate state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], state: str) -> Column:
    """States after each item of `items`, an array as long as `items`.

    `items` must be a column of the frame, not an expression: it is sliced once per block. Appending to one long
    array copies it every time, so states are gathered in short blocks, of sqrt(n) at most, and flattened at the end.
    """
    n = F.size(items)
    block = F.greatest(F.lit(8), F.ceil(F.sqrt(n))).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), block)

    def within(states: Column, item: Column) -> Column:
        return F.array_append(states, step(F.element_at(states, -1), item))

    def across(blocks: Column, start: Column) -> Column:
        # Each block starts with the state the one before it ended in.
        carried = F.array(F.element_at(F.element_at(blocks, -1), -1))
        return F.array_append(blocks, F.aggregate(F.slice(items, start, block), carried, within))

    blocks = F.aggregate(starts, F.array(F.array(zero.cast(state))), across)
    states = F.flatten(F.transform(blocks, lambda states: F.slice(states, F.lit(2), F.size(states))))
    return F.when(items.isNotNull(), states)
