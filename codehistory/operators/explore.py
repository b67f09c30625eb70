"""The table of all files of all repositories: filter, sort, page, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import ordered

#: Rows up to which a page is cut from the first rows of all.
SHALLOW = 10_000


def narrow(files: DataFrame, text: str = "", repos: tuple[str, ...] = (), kinds: tuple[str, ...] = (), live: bool = False, born: bool = False, min_rework: int = 0, min_lines: int = 0) -> DataFrame:
    """Files whose path holds a text in any case, of some repositories and kinds, live or born in the window, with least rework and lines."""
    if text:
        files = files.where(F.lower("path").contains(text.lower()))
    if repos:
        files = files.where(F.col("repo").isin(*repos))
    if kinds:
        files = files.where(F.col("kind").isin(*kinds))
    if live:
        files = files.where("lines is not null")
    if born:
        files = files.where("born is not null")
    if min_rework:
        files = files.where(F.col("rework") >= min_rework)
    return files.where(F.col("lines") >= min_lines) if min_lines else files


def page(files: DataFrame, by: str = "rework", descending: bool = True, number: int = 0, size: int = 50, shallow: int = SHALLOW) -> DataFrame:
    """A page of the files in the order of a column, rows without it last either way; equal values go by repository and path.

    Pages that end within `shallow` rows are picked without a sort of the rest; for later ones only the ranges that hold them are sorted.
    """
    order = [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), F.col("repo"), F.col("path")]
    if (number + 1) * size <= shallow:
        return files.orderBy(*order).limit((number + 1) * size).offset(number * size)
    return ordered.page(files, order, number * size, size)


def summary(files: DataFrame) -> DataFrame:
    """Files, repositories, rework, rework over churn, and rework per line of live files."""
    live = F.col("lines").isNotNull()
    per = files.groupBy("repo").agg(F.count("*").alias("n"), F.sum("rework").alias("r"), F.sum("churn").alias("c"), F.sum(F.when(live, F.col("rework"))).alias("live"), F.sum("lines").alias("lines"))
    return per.agg(F.sum("n").alias("files"), F.count("*").alias("repos"), F.sum("r").alias("rework"), C.ratio(F.sum("r"), F.sum("c")).alias("of_churn"), C.ratio(F.sum("live"), F.sum("lines")).alias("per_line"))
