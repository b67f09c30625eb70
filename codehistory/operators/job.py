"""The whole job in one call: log text in, stored summaries and review lists out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import Params
from ..sources import logs, summaries
from ..sources.store import Store
from . import portfolio
from .facts import clean
from .lineage import cut


@dataclass
class Done:
    """rows: a summary or an error for each requested repository; faults: what could not be read; version: of the store, if there is one."""

    rows: DataFrame
    faults: DataFrame
    version: int | None

    def panels(self, params: Params | None = None) -> dict[str, DataFrame]:
        """The review lists over the rows that have a summary."""
        n = (params or Params()).top
        rows = self.rows.where("total_churn is not null").withColumn("repo", F.col("path"))
        return {
            "totals": portfolio.totals(rows), "effort_sinks": portfolio.effort_sinks(rows, n), "infra_heavy": portfolio.infra_heavy(rows, n), "redesign_candidates": portfolio.redesign_candidates(rows, n),
            "thin_on_tests": portfolio.thin_on_tests(rows, n), "new_and_rewritten": portfolio.new_and_rewritten(rows, n), "ranking": portfolio.ranking(rows),
        }


def failures(status: DataFrame | None, faults: DataFrame, loose: DataFrame) -> DataFrame:
    """(path, failure): why a row is missing or not whole. What the collector says comes first, then what did not settle, then faults, each with how often."""
    said = lambda rows, n, rank: rows.select("repo", F.concat(n, "reason").alias("text"), F.lit(rank).alias("rank"))
    counted = faults.groupBy("repo", "reason").agg(F.count("*").alias("n"))
    parts = said(loose.distinct(), F.lit(""), 1).unionByName(said(counted, F.concat(F.col("n").cast("string"), F.lit(" x ")), 2))
    if status is not None:
        parts = parts.unionByName(status.where("failure is not null").select(F.col("path").alias("repo"), F.col("failure").alias("text"), F.lit(0).alias("rank")))
    listed = parts.groupBy("repo").agg(F.sort_array(F.collect_set(F.struct("rank", "text"))).alias("all"))
    return listed.select(F.col("repo").alias("path"), F.array_join(F.transform("all", lambda x: x["text"]), "; ").alias("failure"))


def run(records: DataFrame, lines: DataFrame, births: DataFrame, requested: DataFrame, as_of: str, params: Params | None = None, store: Store | None = None, status: DataFrame | None = None) -> Done:
    """Analyse the logs of many repositories over a window and keep a row for each that was asked for.

    Args:
        records: (repo, value) log records, as `logs.read_records` gives them.
        lines, births: (repo, path, lines) and (repo, path, born).
        requested: (path) of the repositories wanted; the others are left out.
        as_of: the moment at which the window of `params.months` ends, also kept as `analyzed_at`.
        store: where rows are saved; rows of other repositories stay in it.
        status: (path, failure) of the collector, null where it went well.

    A repository with faulty lines is summed up from the others and says in `error` what was
    faulty; one without commits in the window has a row that says so; one that does not settle
    has its summary and says that. None of them stops the others.
    """
    p = params or Params()
    wanted = requested.select("path").where("path is not null").distinct()
    own = records.join(wanted.withColumnRenamed("path", "repo"), "repo", "left_semi")
    faults = cut(logs.malformed(own))
    facts = logs.in_window(clean(logs.parse_numstat(own, p).drop("churn"), p), as_of, p.months)
    summary, loose = portfolio.analyze_and_loose(facts, lines, births, p)
    named = summary.withColumnRenamed("repo", "path").withColumns({"max_files": F.lit(p.max_files).cast("long")})
    rows = summaries.with_errors(wanted, failures(status, faults, loose), named)
    rows = cut(summaries.conform(rows.withColumns({"name": C.repo_name(F.col("path")), "analyzed_at": F.lit(as_of), "since_months": F.lit(p.months).cast("long")})))
    return Done(rows, faults, store.save(rows) if store else None)
