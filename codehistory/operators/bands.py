"""Inside a file, whatever its language: bands of lines and the commits that touch them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

KEY = ["repo", "path"]


def grid(lines: DataFrame, bands: int = 48, span: int = 8, least: int = 2) -> DataFrame:
    """Bands of equal width over each file of (repo, path, lines), the last one short; files of fewer than `least` lines have none."""
    n = F.greatest(F.lit(1), F.least(F.lit(bands), F.floor(F.col("lines") / span)))
    sized = lines.where(F.col("lines") >= max(2, least)).withColumn("size", F.ceil(F.col("lines") / n).cast("long"))
    starts = sized.select(*KEY, "lines", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lines").cast("long"), F.col("size"))).alias("start"))
    return starts.select(*KEY, "start", F.least(F.col("start") + F.col("size") - 1, F.col("lines")).alias("end"))


def touched(bands: DataFrame, touches: DataFrame, step: int = 64) -> DataFrame:
    """Distinct commits and the last month of each band. Bands and ranges meet in cells of `step` lines, so the join is on equal keys.

    A range that ends before it begins lies between those lines (all of its own are gone) and touches what holds both.
    """
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor((F.least("start", "end") - 1) / step), F.floor((F.col("end") - 1) / step))))
    # a band stands for its file and lines by a number; written, bands have a size by which Spark can send them to the touches, which then are not shuffled
    known = cut(bands.select(*KEY, "start", "end").distinct().withColumn("band", F.monotonically_increasing_id()))
    t = cells(touches.where("start is not null and end is not null").select(*KEY, "start", "end", "sha", F.substring("date", 1, 7).alias("month"))).withColumnsRenamed({"start": "from", "end": "to"})
    hits = t.join(cells(known), [*KEY, "cell"]).where((F.col("from") <= F.col("end")) & (F.col("to") >= F.col("start"))).select("sha", "band", "month")
    # a maximum of texts sorts its rows: commits come first in the keys, as they differ in their first letters
    per = hits.groupBy("sha", "band").agg(F.max("month").alias("month")).groupBy("band").agg(F.count("*").alias("commits"), F.max("month").alias("last"))
    counted = known.join(per, "band").drop("band")
    return bands.join(counted, [*KEY, "start", "end"], "left").select(*KEY, "start", "end", F.coalesce("commits", F.lit(0)).cast("long").alias("commits"), F.coalesce("last", F.lit("")).alias("last"))


def refine(found: DataFrame, touches: DataFrame, top: int = 6, into: int = 16, widest: int = 40) -> DataFrame:
    """The hottest bands of each file with a wide band, cut finer and counted again; the other bands stay."""
    file = Window.partitionBy(*KEY)
    ranked = found.withColumn("wide", F.max(F.col("end") - F.col("start") + 1).over(file) > widest).withColumn("rank", F.row_number().over(file.orderBy(F.desc("commits"), "start")))
    hot = ranked.where((F.col("rank") <= top) & (F.col("commits") > 0) & F.col("wide"))
    size = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start") + 1) / into)).cast("long")
    finer = hot.withColumn("size", size).select(*KEY, F.explode(F.sequence("start", "end", "size")).alias("from"), "end", "size").select(*KEY, F.col("from").alias("start"), F.least(F.col("from") + F.col("size") - 1, F.col("end")).alias("end"))
    kept = found.join(hot.select(*KEY, "start"), [*KEY, "start"], "left_anti").select(*found.columns)
    return kept.unionByName(touched(finer, touches))


def merge(found: DataFrame, into: int = 20) -> DataFrame:
    """Bands folded into at most `into` of each file; commits are summed."""
    file = Window.partitionBy(*KEY)
    placed = found.withColumn("n", F.count("*").over(file)).withColumn("i", F.row_number().over(file.orderBy("start")) - 1)
    group = F.when(F.col("n") <= into, F.col("i")).otherwise(F.floor(F.col("i") / F.ceil(F.col("n") / into)))
    return placed.groupBy(*KEY, group.cast("long").alias("band")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("commits").alias("commits"), F.max("last").alias("last"))


def heat(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Commits of each line of each file: those of its band."""
    rows = found.join(lines, KEY).where(F.col("start") <= F.col("lines"))
    return rows.select(*KEY, F.explode(F.sequence("start", F.least("end", "lines"))).alias("line"), F.col("commits").alias("heat"))


def quiet(found: DataFrame) -> DataFrame:
    """Bands and lines of each file that no commit touched."""
    none = F.col("commits") == 0
    return found.groupBy(*KEY).agg(F.count_if(none).alias("bands"), F.sum(F.when(none, F.col("end") - F.col("start") + 1).otherwise(0)).alias("lines"))
