"""One row for each repository, and the ranked lists over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import KINDS, PRODUCT
from ..params import Params
from . import cochange, communities, effort, identity
from .clusters import cluster_table
from .facts import file_table, with_age
from .lineage import cut


def summarise(files: DataFrame, clusters: DataFrame, commits: DataFrame, params: Params | None = None) -> DataFrame:
    """The summary row of each repository, from its files, clusters and commits.

    Ties of every pick go to the smallest name. Per-line ratios take live files on both sides.
    """
    p = params or Params()
    live, c = F.col("lines").isNotNull(), F.col
    aged = with_age(files)
    product = live & (c("kind") == PRODUCT) & (c("lines") >= p.min_lines)
    fresh = live & c("born").isNotNull()
    young = fresh & product & (c("alive") >= p.young_days) & (c("rework") > 0)
    pick = lambda what, by, on: F.min_by(what, F.when(on, F.struct((-F.col(by)).alias("v"), "path")))
    base = aged.groupBy("repo").agg(
        F.sum("churn").alias("total_churn"), F.count("*").alias("num_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_now"),
        C.ratio(F.sum(F.when(live, c("churn"))), F.sum("lines")).alias("density"), F.coalesce(F.sum(F.when(live, c("rework"))), F.lit(0)).alias("rework"),
        C.ratio(F.sum(F.when(live, c("rework"))), F.sum("lines")).alias("rework_density"),
        F.min_by("path", F.struct((-c("dev_days")).alias("v"), "path")).alias("top_effort_file"), F.max("dev_days").alias("top_effort_days"), F.min_by("devs", F.struct((-c("dev_days")).alias("v"), "path")).alias("top_effort_devs"),
        pick("path", "debt", product & c("debt").isNotNull()).alias("top_debt_file"), F.max(F.when(product, c("debt"))).alias("top_debt"),
        F.count_if(fresh).alias("new_files"), F.coalesce(F.sum(F.when(fresh, c("rework"))), F.lit(0)).alias("new_rework"),
        pick("path", "rework", young).alias("top_new_file"), pick("rework", "rework", young).alias("top_new_rework"), F.substring(pick("born", "rework", young), 1, 10).alias("top_new_born"), pick("alive", "rework", young).alias("top_new_days"),
    )
    real = clusters.where("cluster_id <> -1")
    found = real.groupBy("repo").agg(F.count("*").alias("num_clusters"), F.count_if(c("num_modules") > 1).alias("cross_module"))
    modules = real.groupBy("repo", "dominant_module").agg(F.sum("total_churn").alias("t")).groupBy("repo").agg(F.min_by("dominant_module", F.struct((-c("t")).alias("t"), "dominant_module")).alias("top_module"))
    total = commits.select("repo", "sha").distinct().groupBy("repo").agg(F.count("*").alias("total_commits"))
    # people, their days, the days of the busiest and the kinds of work come from the same rows by person and day
    each = effort.shared_days(effort.touched(commits), ("repo", "who"))
    kinds = each.groupBy("repo").agg(
        F.nullif(F.count_if("known"), F.lit(0)).alias("devs"), F.sum("days").alias("dev_days"), C.ratio(F.max("days"), F.sum("days")).alias("solo_share"), *(C.rint(C.rint(F.sum(k), 9), 1).alias(k) for k in KINDS.values())
    )
    out = base.join(found, "repo", "left").fillna(0, ["num_clusters", "cross_module"])
    for part in (modules, total, kinds):
        out = out.join(part, "repo", "left")
    return out


def _shares(rows: DataFrame) -> DataFrame:
    """Summary rows with the exact shares of infrastructure and tests in their days, null without days."""
    total = F.nullif(sum((F.col(c) for c in list(KINDS.values())[1:]), F.col("days_build")), F.lit(0.0))
    return rows.withColumns({"infra": (F.col("days_build") + F.col("days_config")) / total, "tests": F.col("days_tests") / total})


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: C.rint(F.col(c), 3) for c in ("infra", "tests")})


def shares(rows: DataFrame) -> DataFrame:
    """Summary rows with the shares of infrastructure and tests in their days, rounded, null without days."""
    return _rounded(_shares(rows))


def totals(rows: DataFrame) -> DataFrame:
    """Person-days by kind over all repositories, shares of infrastructure and tests, rework over churn, memberships, share of rework in new files."""
    days = {c: F.sum(c) for c in KINDS.values()}
    total = sum(list(days.values())[1:], days["days_build"])
    return rows.agg(
        *(C.rint(v, 1).alias(k) for k, v in days.items()), C.ratio(days["days_build"] + days["days_config"], total).alias("infra"), C.ratio(days["days_tests"], total, 3).alias("tests"),
        C.ratio(F.sum("rework"), F.sum("total_churn")).alias("rework"), F.sum("devs").alias("memberships"), C.ratio(F.sum(F.when(F.col("new_rework").isNotNull(), F.col("new_rework"))), F.greatest(F.lit(1), F.sum(F.when(F.col("new_rework").isNotNull(), F.col("rework"))))).alias("new_share"),
    )


def _top(rows: DataFrame, by: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(by), "repo").limit(n)


def effort_sinks(rows: DataFrame, n: int = 6) -> DataFrame:
    return _top(rows.where("top_effort_file is not null"), "top_effort_days", n).select("repo", "top_effort_file", "top_effort_days", "top_effort_devs")


def infra_heavy(rows: DataFrame, n: int = 6, share: float = 0.25, days: int = 20) -> DataFrame:
    """Repositories with more than a share of infrastructure. Shares are compared and ordered as they are, and rounded for display."""
    return _rounded(_top(_shares(rows).where((F.col("infra") > share) & (F.col("dev_days") >= days)), "infra", n)).select("repo", "dev_days", "infra")


def redesign_candidates(rows: DataFrame, n: int = 6) -> DataFrame:
    return _top(rows.where("top_debt_file is not null"), "top_debt", n).select("repo", "top_debt_file", "top_debt")


def thin_on_tests(rows: DataFrame, n: int = 6, share: float = 0.01, days: int = 50) -> DataFrame:
    """Busy repositories with less than a share of tests, compared as it is and rounded for display."""
    return _rounded(_top(_shares(rows).where((F.col("tests") < share) & (F.col("dev_days") >= days)), "dev_days", n)).select("repo", "dev_days", "tests", "solo_share")


def new_and_rewritten(rows: DataFrame, n: int = 6) -> DataFrame:
    out = _top(rows.where("top_new_file is not null"), "top_new_rework", n)
    return out.select("repo", "top_new_file", "top_new_born", "top_new_days", "top_new_rework", "new_files", C.ratio(F.col("new_files"), F.col("num_files")).alias("of_repo"))


def ranking(rows: DataFrame, by: str = "dev_days") -> DataFrame:
    """All repositories in the order of a column, those without it last."""
    return rows.orderBy(F.desc_nulls_last(by), "repo")


def analyze(commits: DataFrame, lines: DataFrame, births: DataFrame, params: Params | None = None) -> DataFrame:
    """The whole job: the summary row of each repository of clean commit-file facts.

    Args:
        commits: (repo, sha, date, author, email, subject, path, added, deleted, churn, day, month) without automation.
        lines, births: (repo, path, lines) and (repo, path, born).

    Identities are merged, files counted, the co-change graph is built and clustered, and
    everything is summed up by repository. A repository without commits has no row.
    """
    return analyze_and_loose(commits, lines, births, params)[0]


def analyze_and_loose(commits: DataFrame, lines: DataFrame, births: DataFrame, params: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """What `analyze` gives, and (repo, reason) of the repositories whose identities or clusters had not settled when the rounds were over."""
    commits = cut(commits)
    names, strangers = identity.people_and_loose(commits)
    facts = commits.join(cut(names), ["repo", "author"], "left")
    edges = cut(cochange.edges(facts, params))
    loose = cut(file_table(facts, lines, births))
    found, open_ = communities.clusters_and_loose(edges, loose)
    placed = cut(found)
    files = cut(loose.drop("cluster_id").join(placed, ["repo", "path"]))
    why = strangers.select("repo", F.lit("identities did not settle").alias("reason")).unionByName(open_.select("repo", F.lit("clusters did not settle").alias("reason")))
    return summarise(files, cluster_table(files, facts), facts, params), why
