"""A fold over an array that gives one item for each element, in time that grows with the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items appended to one block before the next is begun: appending copies an array, so blocks are kept short.
BLOCK = 256


def fold(rows: Column | str, start: dict[str, Column], item_type: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """Array of the items of step(state, row) -> (new state, item), row by row; null where rows are null.

    The state is a struct of the fields of start, whose types the new state must keep.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    zero = F.struct(none(f"array<{item_type}>").alias("done"), none(item_type).alias("now"), *(v.alias(k) for k, v in start.items()))

    def merge(acc: Column, row: Column) -> Column:
        state, item = step(acc, row)
        full = F.size(acc["now"]) >= BLOCK
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(full, F.array(item)).otherwise(F.concat(acc["now"], F.array(item)))
        return F.struct(done.alias("done"), now.alias("now"), *(state[k].alias(k) for k in start))

    return F.aggregate(rows, zero, merge, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
