"""Joins in which a few keys hold much of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one in HOT of all rows is joined by broadcast; there are less than HOT of them.
HOT = 2000


def hot(n: str, total: int):
    """Whether a key with so many of all rows is hot."""
    return F.col(n) * HOT > F.lit(total)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """An inner join with a table of distinct keys in which `n` says how many rows each has on the left.

    Hot keys, fewer than HOT whatever the data, are broadcast, so none of them gathers its rows
    in one task; the others are shuffled. Both sides are read twice: give written tables.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    often = F.broadcast(right.where(hot(n, total)))
    rare = right.where(~hot(n, total))
    return left.join(often, keys).unionByName(left.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rare, keys))
