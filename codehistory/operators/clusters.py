"""Tables of clusters and of the files in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import cochange
from .facts import people_days, person_days
from .ordered import quantiles


def cluster_table(files: DataFrame, commits: DataFrame) -> DataFrame:
    """A row for each (repo, cluster_id): churn, files, modules, the module of most files, distinct commits, and a label."""
    key = ["repo", "cluster_id"]
    modules = files.groupBy(*key, "module").agg(F.count("*").alias("n"), F.sum("churn").alias("churn"))
    base = modules.groupBy(*key).agg(
        F.sum("churn").alias("total_churn"), F.sum("n").alias("num_files"), F.count("*").alias("num_modules"), F.min_by("module", F.struct((-F.col("n")).alias("n"), "module")).alias("dominant_module")
    )
    placed = commits.join(files.select("repo", "path", "cluster_id"), ["repo", "path"])
    total = placed.select(*key, "sha").distinct().groupBy(*key).agg(F.count("*").alias("total_commits"))
    label = F.when(F.col("cluster_id") == -1, F.format_string("unclustered (%d files)", "num_files")).otherwise(F.format_string("#%d %s (%d files)", "cluster_id", "dominant_module", "num_files"))
    return base.join(total, key, "left").withColumn("label", label)


def cluster_stats(files: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """A row for each cluster: leading modules, share of churn, hotspot, cohesion, per-line ratios of live files, people and days."""
    key = ["repo", "cluster_id"]
    live = lambda c: F.sum(F.when(F.col("lines").isNotNull(), F.col(c)))
    base = files.groupBy(*key).agg(
        F.sum("churn").alias("churn"), F.count("*").alias("files"), F.max("churn").alias("top"), F.min_by("path", F.struct((-F.col("churn")).alias("c"), "path")).alias("hotspot"), F.max("last_month").alias("last"),
        C.ratio(live("churn"), F.sum("lines")).alias("churn_per_line"), C.ratio(live("rework"), F.sum("lines")).alias("rework_per_line"), F.count_if(F.col("lines").isNull()).alias("gone"),
    )
    modules = files.groupBy(*key, "module").agg(F.sum("churn").alias("c"))
    ranked = modules.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "module")))
    lead = ranked.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "module")))).alias("m"), F.count("*").alias("n"))
    names = F.concat(F.array_join(F.transform("m", lambda x: x["module"]), ", "), F.when(F.col("n") > 3, F.format_string(" +%d", F.col("n") - 3)).otherwise(""))
    placed = commits.join(files.select("repo", "path", "cluster_id"), ["repo", "path"])
    days = people_days(placed, ("repo", "cluster_id")).withColumn("devs", F.nullif("devs", F.lit(0))).drop("most_days")
    total = placed.select(*key, "sha").distinct().groupBy(*key).agg(F.count("*").alias("commits"))
    out = base.join(lead.select(*key, names.alias("modules")), key).join(cochange.cohesion(edges, files), key, "left").join(days, key, "left").join(total, key, "left")
    repo = Window.partitionBy("repo")
    return out.select(
        *key, "modules", "files", "churn", C.ratio(F.col("churn"), F.sum("churn").over(repo), 3).alias("share"), "churn_per_line", "rework_per_line", C.ratio(F.col("top"), F.col("churn")).alias("in_hotspot"), "hotspot",
        "cohesion", "dev_days", "devs", C.ratio(F.col("dev_days"), F.sum("dev_days").over(repo), 3).alias("effort"), "commits", "last", "gone",
    )


def file_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each file in its cluster: shares of churn and effort, ratios, coupling beyond the cluster, top partner, day of birth."""
    # sums come from a grouping, as files without a cluster can be most of a repository
    own = files.groupBy("repo", "cluster_id").agg(F.sum("churn").alias("all_churn"), F.sum("dev_days").alias("all_days"))
    out = files.join(cochange.outside(edges, files), ["repo", "path"], "left").join(own, ["repo", "cluster_id"])
    return out.select(
        "repo", "cluster_id", "path", "churn", C.ratio(F.col("churn"), F.col("all_churn"), 3).alias("share"), "rework", "rework_per_line", "debt", "per_commit", "devs", "dev_days",
        C.ratio(F.col("dev_days"), F.col("all_days"), 3).alias("effort"), "growth", F.coalesce("outside", F.lit(0.0)).alias("outside"), F.coalesce("partner", F.lit("")).alias("partner"), F.substring("born", 1, 10).alias("born"),
    )


def hot(files: DataFrame, metric: str, percent: float = 10.0) -> DataFrame:
    """Files with a metric, whether it is in the top percent of its cluster (by the linear quantile), and how many of the cluster have none."""
    key = ["repo", "cluster_id"]
    none = files.groupBy(*key).agg(F.count_if(F.col(metric).isNull()).alias("dropped"))
    # files without a cluster can be most of a repository: no task takes all values of one
    rows = files.join(quantiles(files, key, metric, {"cut": 1 - percent / 100}), key).join(none, key)
    return rows.where(F.col(metric).isNotNull()).select("repo", "cluster_id", "path", F.col(metric).cast("double").alias("value"), (F.col(metric) >= F.col("cut") - 1e-9).alias("hot"), "dropped")


def screen_card(files: DataFrame, commits: DataFrame) -> DataFrame:
    """A row for each repository: churn, commits, person-days, author names, clusters, clusters of several modules, unclustered percent (cut off), biggest file and its share."""
    base = files.groupBy("repo").agg(
        F.sum("churn").alias("churn"), F.floor(100 * F.count_if(F.col("cluster_id") == -1) / F.count("*")).alias("unclustered"), F.min_by("path", F.struct((-F.col("churn")).alias("c"), "path")).alias("biggest"), C.ratio(F.max("churn"), F.sum("churn")).alias("biggest_share")
    )
    per = files.where("cluster_id <> -1").select("repo", "cluster_id", "module").distinct().groupBy("repo", "cluster_id").agg(F.count("*").alias("m"))
    found = per.groupBy("repo").agg(F.count("*").alias("clusters"), F.count_if(F.col("m") > 1).alias("cross_module"))
    total = commits.select("repo", "sha").distinct().groupBy("repo").agg(F.count("*").alias("commits"))
    authors = commits.select("repo", "author").distinct().groupBy("repo").agg(F.count("*").alias("authors"))
    return base.join(found, "repo", "left").fillna(0, ["clusters", "cross_module"]).join(total, "repo").join(authors, "repo").join(person_days(commits, ("repo",)), "repo")


def worst_coupling(clusters: DataFrame, n: int = 5) -> DataFrame:
    """The clusters of each repository that span most modules."""
    real = clusters.where("cluster_id <> -1")
    return real.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("num_modules"), F.desc("total_churn"), "cluster_id"))).where(F.col("rank") <= n)
