"""Running values and numbers along an order, for groups of any size.

A window over a group sorts the group in one task. Here rows are dealt out by ranges of
group and order first; a window runs inside each range, and groups that lie across ranges
get what the ranges before hold of them. That is at most two rows for each range, so it is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PART = "_part"


def _ranged(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows dealt out by ranges of group and order, with the number of the range, written to the shared folder."""
    return cut(rows.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn(PART, F.spark_partition_id()))


def _across(rows: DataFrame, keys: list[str], held: list[Column]) -> DataFrame:
    """(part, keys, held) of the groups that lie in several ranges; of all ranges if there are no keys."""
    each = rows.groupBy(PART, *keys).agg(*held)
    if not keys:
        return each
    wide = each.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return each.join(F.broadcast(wide), keys)


def carried(dealt: DataFrame, part: str, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows with the last non-null value, up to and with each row, of columns along the parts of a group and the order inside a part.

    Args:
        dealt: rows of groups that are cut into parts of bounded size; the parts of a group follow each other by `part`.
        order: columns that order the rows of a part.
    """
    rows = dealt.withColumns({f"_{n}": c for n, c in values.items()})
    along = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({n: F.last(f"_{n}", ignorenulls=True).over(along) for n in values})
    held = rows.groupBy(part, *keys).agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(f"_before_{n}") for n in values))
    # a row for each part of a group: what the parts before hold
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    border = held.select(part, *keys, *(F.last(f"_before_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in values))
    met = seen.join(border.where(F.greatest(*(F.col(f"_before_{n}").isNotNull() for n in values), F.lit(False))), [part, *keys], "left")
    return met.withColumns({n: F.coalesce(n, f"_before_{n}") for n in values}).select(*dealt.columns, *values)


def running_last(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows with the last non-null value, up to and with each row, of columns along an order inside a group.

    Args:
        order: columns that order the rows of a group; rows that are equal in all of them stay
            together, so add one that tells them apart if there may be many.
        values: for each new column what is carried along.
    """
    dealt = _ranged(rows, keys, [F.col(c) for c in order])
    return carried(dealt, PART, keys, order, values).drop(PART)


def _offsets(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """(part, keys, rows of the group in the ranges before, rows in this one)."""
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return _across(dealt, keys, [F.count("*").alias("_n")]).select(PART, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with their place in the order of their group (of all rows without keys), from 0; `order` must tell all rows of a group apart."""
    dealt = _ranged(rows, keys, order)
    own = (F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)) - 1).cast("long")
    met = dealt.withColumn(name, own).join(F.broadcast(_offsets(dealt, keys).drop("_n")), [PART, *keys], "left")
    return met.select(*rows.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))


def numbered_in(dealt: DataFrame, part: str, first: Column, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with their place in their group, from 0, where rows lie in parts already and a row tells in which part its group begins.

    Groups that go on in a later part are at most one for each part that another follows, so what parts hold of them is broadcast.
    """
    own = (F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order)) - 1).cast("long")
    late = dealt.where(first != F.col(part)).select(*keys).distinct()
    held = dealt.join(F.broadcast(late), keys, "left_semi").groupBy(part, *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    border = held.select(part, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = dealt.withColumn(name, own).join(F.broadcast(border), [part, *keys], "left")
    return met.select(*dealt.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))


def page(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """The rows at places start to start + size - 1 of an order that tells all rows apart, sorted.

    Counts of ranges say which of them hold the page; only those are sorted, however deep it lies.
    """
    dealt = _ranged(rows, [], order)
    asked = _offsets(dealt, []).where((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
    few = dealt.join(F.broadcast(asked.drop("_n")), PART)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    return few.withColumn("_place", place).where((F.col("_place") >= start) & (F.col("_place") < start + size)).orderBy("_place").select(*rows.columns)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): exact quantiles of a column by group, between two values on the line from one to the other; nulls are left out.

    Values are numbered along ranges, so no task holds all values of a group; two of them are picked for each share.
    """
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_id"))
    placed = numbered(held, keys, [F.col("_v"), F.col("_id")], "_place")
    total = placed.groupBy(*keys).agg(F.count("*").alias("_rows"))
    met = placed.join(total, keys)
    picks = []
    for name, share in shares.items():
        at = (F.col("_rows") - 1) * F.lit(float(share))
        near = 1 - F.abs(F.col("_place") - at)
        picks.append(F.sum(F.when(near > 0, F.col("_v") * near)).alias(name))
    return met.groupBy(*keys).agg(*picks)
