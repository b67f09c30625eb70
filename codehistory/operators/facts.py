"""Clean facts, identities and tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import Params
from .identity import people
from .lineage import cut


def clean(commits: DataFrame, params: Params | None = None) -> DataFrame:
    """Commit-file rows without automation, generated files and binary changes, with churn, day and month."""
    p = params or Params()
    kept = commits.where(~C.is_bot(F.col("author"), p.ignore_authors) & ~C.excluded(F.col("path"), p.exclude)).where("added is not null and deleted is not null")
    return kept.withColumns({"churn": F.col("added") + F.col("deleted"), "day": C.day(F.col("date")), "month": C.month(F.col("date"))})


def with_people(commits: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Rows with `person`, the one name of an author inside a scope (the repository, or () for all)."""
    # a row for each author name: far fewer than commits; written, it has a size by which Spark can send it to them
    names = cut(people(commits, scope))
    return commits.join(names, [*scope, "author"], "left")


def person_days(commits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct (person, day) of each key, as `dev_days`; a null person counts as one."""
    rows = commits.select(*keys, F.coalesce("person", F.lit("")).alias("who"), "day").distinct()
    return rows.groupBy(*keys).agg(F.count("*").alias("dev_days"))


def people_days(commits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of each key `dev_days`, as person_days has them, `devs`, the people without the null one, and `most_days`, the most of one person: all from one grouping of days."""
    days = commits.groupBy(*keys, F.coalesce("person", F.lit("")).alias("who"), "day").agg(F.max(F.col("person").isNotNull()).alias("known"))
    each = days.groupBy(*keys, "who").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    return each.groupBy(*keys).agg(F.sum("n").alias("dev_days"), F.count_if("known").alias("devs"), F.max("n").alias("most_days"))


def file_table(commits: DataFrame, lines: DataFrame | None = None, births: DataFrame | None = None, membership: DataFrame | None = None) -> DataFrame:
    """A row for each (repo, path): sums, distinct commits and person-days, size and birth, rework, debt, cluster and kind.

    Distinct counts go through one row per file and commit first, so no row is multiplied.
    """
    # maxima of texts sort their rows: commits come first in the keys, as they differ in their first letters
    per_commit = commits.groupBy("sha", "path", "repo").agg(
        F.sum("churn").alias("churn"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum(C.rework(F.col("added"), F.col("deleted"))).alias("rework"), F.max("month").alias("month"), F.max("date").alias("date")
    )
    files = per_commit.groupBy("repo", "path").agg(
        F.sum("churn").alias("churn"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum("rework").alias("rework"), F.count("*").alias("commits"), F.max("month").alias("last_month"), F.max("date").alias("last_date")
    )
    key = ["repo", "path"]
    if "person" in commits.columns:
        files = files.join(people_days(commits, ("repo", "path")).drop("most_days"), key, "left")
    files = files.join(lines, key, "left") if lines is not None else files.withColumn("lines", F.lit(None).cast("long"))
    files = files.join(births, key, "left") if births is not None else files.withColumn("born", F.lit(None).cast("string"))
    files = files.join(membership, key, "left") if membership is not None else files.withColumn("cluster_id", F.lit(None).cast("long"))
    c = F.col
    return files.withColumns(
        {
            "cluster_id": F.coalesce("cluster_id", F.lit(-1)).cast("long"),
            "module": C.module(c("path")),
            "kind": C.work_kind(c("path")),
            "density": C.ratio(c("churn"), c("lines"), 1),
            "debt": C.debt(c("rework"), c("lines"), c("commits")),
            "rework_per_line": C.ratio(c("rework"), c("lines")),
            "per_commit": C.ratio(c("churn"), c("commits"), 1),
            "growth": C.ratio(c("added") - c("deleted"), c("churn")),
        }
    )


def with_age(files: DataFrame) -> DataFrame:
    """Files with `alive`, the days from birth to the repository's last commit, floored."""
    last = files.groupBy("repo").agg(F.max(F.to_timestamp("last_date")).alias("last_commit"))
    return files.join(last, "repo").withColumn("alive", F.floor((F.unix_timestamp("last_commit") - F.unix_timestamp(F.to_timestamp("born"))) / 86400)).drop("last_commit")


def monthly(commits: DataFrame) -> DataFrame:
    """Lines added and deleted in each month of each file."""
    return commits.groupBy("repo", "path", "month").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def history(commits: DataFrame, repo: str, path: str) -> DataFrame:
    """Commits of one file, newest first."""
    rows = commits.where((F.col("repo") == repo) & (F.col("path") == path))
    return rows.select(F.substring("sha", 1, 8).alias("sha8"), "day", "person", "subject", "added", "deleted", "date").orderBy(F.desc("date"), "sha8")


def gone(files: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """How many files of each key are no longer there, and their share."""
    out = files.groupBy(*keys).agg(F.count_if(F.col("lines").isNull()).alias("gone"), F.count("*").alias("files"))
    return out.withColumn("share", C.ratio(F.col("gone"), F.col("files")))


def top_files(files: DataFrame, by: str, n: int, min_lines: int = 0) -> DataFrame:
    """The live files with the largest value in each repository; equal values go by path."""
    live = files.where((F.col("lines") >= min_lines) & F.col(by).isNotNull())
    return live.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc(by), "path"))).where(F.col("rank") <= n)
