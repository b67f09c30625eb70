"""One summary row for each repository: kept, replaced and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# The columns of a summary and their types, in order.
COLUMNS = {
    "path": "string", "name": "string", "analyzed_at": "string", "since_months": "long", "max_files": "long", "total_churn": "long", "total_commits": "long",
    "num_files": "long", "num_clusters": "long", "cross_module": "long", "lines_now": "long", "density": "double", "rework": "long", "rework_density": "double",
    "dev_days": "long", "devs": "long", "days_build": "double", "days_config": "double", "days_tests": "double", "days_docs": "double", "days_product": "double",
    "top_effort_file": "string", "top_effort_days": "long", "top_effort_devs": "long", "top_debt_file": "string", "top_debt": "double", "new_files": "long",
    "new_rework": "long", "top_new_file": "string", "top_new_rework": "long", "top_new_born": "string", "top_new_days": "long", "solo_share": "double",
    "top_module": "string", "error": "string",
}


def conform(rows: DataFrame) -> DataFrame:
    """All summary columns with their types; a column that older rows lack is null, text that is no number too."""
    return rows.select(*((F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()))


def latest(rows: DataFrame) -> DataFrame:
    """One row for each path: the one analysed last, of those the greatest by all columns. Rows without a path go."""
    whole = F.struct(*COLUMNS)
    picked = conform(rows).where("path is not null").groupBy(F.col("path").alias("of")).agg(F.max_by(whole, F.struct(F.coalesce("analyzed_at", F.lit("")), whole)).alias("row"))
    return picked.select("row.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored rows with those of the same path replaced; of several new rows of a path the latest. `store.Store.save` writes them."""
    new = latest(new)
    return conform(stored).join(new.select("path").distinct(), "path", "left_anti").select(*COLUMNS).unionByName(new)


def load(stored: DataFrame, requested: DataFrame) -> DataFrame:
    """A row for each requested (position, path), in order by position; paths never analysed have nulls and a name from their end."""
    rows = requested.join(conform(stored), "path", "left")
    return rows.withColumn("name", F.coalesce("name", C.repo_name(F.col("path")))).select("position", *COLUMNS).orderBy("position")


def with_errors(requested: DataFrame, status: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each requested path: its summary, or why there is none (status: path, failure)."""
    rows = requested.join(status, "path", "left").join(conform(summary).drop("error"), "path", "left")
    return rows.withColumn("error", F.coalesce("failure", F.when(F.col("total_churn").isNull(), "no commits in window"))).drop("failure")


def stale(stored: DataFrame, months: int) -> DataFrame:
    """Summaries made over another window."""
    return conform(stored).where(F.col("since_months") != months)
