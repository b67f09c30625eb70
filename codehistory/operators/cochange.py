"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import Params
from .lineage import cut
from .ordered import numbered


def pairs(rows: DataFrame, keys: tuple[str, ...], unit: str, item: str, most: int) -> DataFrame:
    """(keys, a, b, weight): pairs a < b of items in one unit, and in how many units; units of more than `most` items count for none.

    Sizes are counted before items are gathered, so a unit beyond the limit never forms a group.
    """
    distinct = rows.select(*keys, unit, item).distinct()
    sized = distinct.groupBy(*keys, unit).agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).drop("n")
    groups = distinct.join(sized, [*keys, unit]).groupBy(*keys, unit).agg(F.sort_array(F.collect_list(item)).alias("items"))
    both = groups.select(*keys, F.posexplode("items").alias("i", "a"), "items").select(*keys, "a", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return both.groupBy(*keys, "a", "b").agg(F.count("*").alias("weight"))


def dictionary(commits: DataFrame) -> DataFrame:
    """(repo, path, id) of all files: numbers without gaps in the order of repositories and paths, given along ranges."""
    return cut(numbered(commits.select("repo", "path").distinct(), [], [F.col("repo"), F.col("path")], "id"))


def coupled(commits: DataFrame, unit: str, most: int, gathered: bool = False) -> DataFrame:
    """(repo, a, b, weight): files a < b of one unit of a repository (a commit, a month), and in how many units; units of more than `most` files count for none.

    Pairs are formed and counted as two numbers; paths come back once for each distinct pair.
    Where units are many and each is small, as commits are, rows can be gathered by unit at once:
    one shuffle then serves their distinct files, their sizes and their groups.
    """
    names = dictionary(commits)
    coded = commits.select("repo", unit, "path").join(names, ["repo", "path"]).select(F.struct("repo", unit).alias("unit"), "id")
    if gathered:
        coded = coded.repartition("unit")
    found = pairs(coded, (), "unit", "id", most)
    a, b = names.select(F.col("id").alias("a"), "repo", F.col("path").alias("first")), names.select(F.col("id").alias("b"), F.col("path").alias("second"))
    return found.join(a, "a").join(b, "b").select("repo", F.col("first").alias("a"), F.col("second").alias("b"), "weight")


def edges(commits: DataFrame, params: Params | None = None) -> DataFrame:
    """The co-change graph: (repo, a, b, weight) with a < b."""
    return coupled(commits, "sha", (params or Params()).max_files, gathered=True)


def both_ways(edges_: DataFrame) -> DataFrame:
    return edges_.unionByName(edges_.select("repo", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def partners(edges_: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """The n files that each file changes with most, and in which share of its commits."""
    own = files.select("repo", F.col("path").alias("a"), "commits")
    other = files.select("repo", F.col("path").alias("b"), F.col("module").alias("partner_module"))
    rows = both_ways(edges_).withColumn("rank", F.row_number().over(Window.partitionBy("repo", "a").orderBy(F.desc("weight"), "b"))).where(F.col("rank") <= n)
    return rows.join(own, ["repo", "a"]).join(other, ["repo", "b"]).withColumn("of_commits", C.ratio(F.col("weight"), F.col("commits")))


def outside(edges_: DataFrame, membership: DataFrame) -> DataFrame:
    """For each file the share of its weight that leaves its cluster, and its strongest partner."""
    m = membership.select("repo", "path", "cluster_id")
    rows = both_ways(edges_).join(m.withColumnsRenamed({"path": "a", "cluster_id": "ca"}), ["repo", "a"]).join(m.withColumnsRenamed({"path": "b", "cluster_id": "cb"}), ["repo", "b"])
    return rows.groupBy("repo", F.col("a").alias("path")).agg(
        C.ratio(F.sum(F.when(F.col("ca") != F.col("cb"), F.col("weight")).otherwise(0)), F.sum("weight")).alias("outside"),
        F.min_by(F.format_string("%s  x%d", "b", "weight"), F.struct((-F.col("weight")).alias("w"), "b")).alias("partner"),
    )


def cohesion(edges_: DataFrame, membership: DataFrame) -> DataFrame:
    """Weight inside each cluster over all weight that touches it; clusters without edges have no row."""
    m = membership.select("repo", "path", "cluster_id")
    rows = edges_.join(m.withColumnsRenamed({"path": "a", "cluster_id": "ca"}), ["repo", "a"]).join(m.withColumnsRenamed({"path": "b", "cluster_id": "cb"}), ["repo", "b"])
    touched = rows.withColumn("cluster_id", F.explode(F.array_distinct(F.array("ca", "cb"))))
    return touched.groupBy("repo", "cluster_id").agg(C.ratio(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)), F.sum("weight")).alias("cohesion"))
