"""Inside a file: named regions, those that change together, and tracker projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import Params
from . import cochange
from .lineage import cut

KEY = ("repo", "path")


def symbols(hunks: DataFrame) -> DataFrame:
    """Hunks with the symbol of their region and their rework. A heading meets the patterns of symbols once, not with each hunk."""
    named = cut(hunks.select("region").distinct().withColumn("symbol", C.region_symbol(F.col("region"))))
    # a hunk without a heading meets none, and is unnamed
    return hunks.join(named, "region", "left").withColumn("symbol", F.coalesce("symbol", F.lit(C.UNNAMED))).withColumn("rework", C.rework(F.col("added"), F.col("removed")))


def region_stats(hunks: DataFrame, top: int = 30) -> DataFrame:
    """The regions of each file with most rework, then churn: edits, commits, authors, owner and share, growth, longest signature."""
    rows = symbols(hunks)
    key = [*KEY, "symbol"]
    # sums by commit are numbers, and of texts a region has few headings and months: neither sorts hunks for a maximum of texts
    sums = rows.groupBy("sha", *key).agg(F.sum("churn").alias("churn"), F.sum("rework").alias("rework"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("edits"))
    sums = sums.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("churn", "rework", "added", "removed", "edits")), F.count("sha").alias("commits"))
    said = rows.select(*key, "region", C.month(F.col("date")).alias("month")).distinct()
    said = said.groupBy(*key).agg(F.max("month").alias("last"), F.min_by("region", F.struct((-F.length("region")).alias("n"), "region")).alias("signature"))
    base = sums.join(said, key).select(*key, "churn", "rework", "added", "removed", "edits", "last", "commits", "signature")
    people = rows.groupBy(*key, "person").agg(F.count("*").alias("n"))
    owner = people.groupBy(*key).agg(F.count("person").alias("authors"), F.min_by("person", F.struct((-F.col("n")).alias("n"), "person")).alias("owner"), C.ratio(F.max("n"), F.sum("n")).alias("owner_share"))
    out = base.join(owner, key)
    file = Window.partitionBy(*KEY)
    out = out.withColumns({"share": C.ratio(F.col("churn"), F.sum("churn").over(file), 3), "growth": C.ratio(F.col("added") - F.col("removed"), F.col("churn")), "signature": F.when(F.col("signature") == "", F.col("symbol")).otherwise(F.col("signature"))})
    ranked = out.withColumn("rank", F.row_number().over(file.orderBy(F.desc("rework"), F.desc("churn"), "symbol"))).where(F.col("rank") <= top)
    return ranked.drop("added", "removed").withColumnRenamed("symbol", "region")


def unnamed_share(hunks: DataFrame) -> DataFrame:
    """Share of each file's churn in unnamed regions."""
    return symbols(hunks).groupBy(*KEY).agg(C.ratio(F.sum(F.when(F.col("symbol") == C.UNNAMED, F.col("churn")).otherwise(0)), F.sum("churn")).alias("unnamed"))


def region_cochange(hunks: DataFrame, params: Params | None = None, head: int = 15) -> DataFrame:
    """Pairs of regions of a file in one commit, and the share of the rarer one's commits; the unnamed region counts for the limit only."""
    rows = symbols(hunks).select(*KEY, "sha", "symbol")
    found = cochange.pairs(rows, KEY, "sha", "symbol", (params or Params()).max_regions).where((F.col("a") != C.UNNAMED) & (F.col("b") != C.UNNAMED))
    n = rows.distinct().groupBy(*KEY, "symbol").agg(F.count("*").alias("n"))
    both = found.join(n.withColumnsRenamed({"symbol": "a", "n": "na"}), [*KEY, "a"]).join(n.withColumnsRenamed({"symbol": "b", "n": "nb"}), [*KEY, "b"])
    out = both.select(*KEY, F.col("a").alias("region"), F.col("b").alias("partner"), F.col("weight").alias("together"), C.ratio(F.col("weight"), F.least("na", "nb")).alias("of_the_rarer"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("of_the_rarer"), F.desc("together"), "region", "partner"))).where(F.col("rank") <= head)


def held_by_one(regions: DataFrame, owner_share: float = 0.9, share: float = 0.05) -> DataFrame:
    return regions.where((F.col("owner_share") >= owner_share) & (F.col("share") >= share))


def ticket_projects(commits: DataFrame) -> DataFrame:
    """Commits of each file by tracker project in their subject."""
    rows = commits.select(*KEY, "sha", "subject").distinct()
    return rows.select(*KEY, F.explode(C.tickets(F.col("subject"))).alias("project")).groupBy(*KEY, "project").agg(F.count("*").alias("subjects"))
