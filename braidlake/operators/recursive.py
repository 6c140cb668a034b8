"""WITH RECURSIVE as a fixed point over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from braidlake.errors import TOO_MUCH, SqlError
from braidlake.storage import cut

#: Divergence guard: rounds, and rows of one round in strict mode.
ROUNDS, ROWS = 200, 1000


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, rounds: int = ROUNDS, rows: int | None = None) -> DataFrame:
    """anchor, then step of the rows that were new, until none are. distinct: UNION, otherwise UNION ALL.

    Each round's new rows are cut from their lineage by a reliable checkpoint, so the plan does not grow. More than `rounds` rounds, or
    `rows` rows in all where that is given, is an error; nothing is cut off.
    """
    fresh = cut(anchor.distinct() if distinct else anchor)
    found = fresh
    for _ in range(rounds):
        if rows is not None and found.limit(rows + 1).count() > rows:
            raise SqlError(TOO_MUCH, f"the recursion gave more than {rows} rows")
        if fresh.isEmpty():
            return found
        after = step(fresh)
        after = after.toDF(*anchor.columns)
        fresh = cut(after.distinct().subtract(found) if distinct else after)
        found = found.union(fresh)
    raise SqlError(TOO_MUCH, f"the recursion did not end within {rounds} rounds")
