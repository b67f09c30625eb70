"""Person-days: what kind of work they went to, who owns what, who works with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import KINDS, PRODUCT
from ..params import Params
from .lineage import cut
from .ordered import quantiles


def touched(commits: DataFrame) -> DataFrame:
    """Distinct (who, day, repo, path) with the kind of each path, and whether `who` is a known person: the base of every table here. Cache it to make several."""
    rows = commits.groupBy(F.coalesce("person", F.lit("")).alias("who"), "day", "repo", "path").agg(F.max(F.col("person").isNotNull()).alias("known"))
    # a path meets the patterns of kinds once, not on each day
    kinds = cut(commits.select("path").distinct().withColumn("kind", C.work_kind(F.col("path"))))
    return rows.join(kinds, "path", "left").withColumn("kind", F.coalesce("kind", F.lit(PRODUCT))).select("who", "day", "repo", "path", "known", "kind")


def shared_days(base: DataFrame, keys: tuple[str, ...], within: tuple[str, ...] | None = None) -> DataFrame:
    """Days of each key by kind, not rounded: a person's day is shared over kinds by the files touched that day (in `within`).

    With `days`, the person-days that the key has a part in, and `known`, whether a known person is among them.
    """
    unit = tuple(dict.fromkeys((*(within if within is not None else keys), "who", "day")))
    per = base.groupBy(*dict.fromkeys((*keys, *unit))).agg(*(F.count_if(F.col("kind") == k).alias(c) for k, c in KINDS.items()), F.count("*").alias("n"), F.max("known").alias("known"))
    # a row is a whole unit already, unless a key divides units
    whole = F.col("n") if set(keys) <= set(unit) else F.sum("n").over(Window.partitionBy(*unit))
    sums = [F.sum(F.col(c) / F.col("whole")).alias(c) for c in KINDS.values()]
    return per.withColumn("whole", whole).groupBy(*keys).agg(F.count("*").alias("days"), F.max("known").alias("known"), *sums)


def split(base: DataFrame, keys: tuple[str, ...], within: tuple[str, ...] | None = None) -> DataFrame:
    """Days of each key as shared_days has them, with nine digits, so that the order of a float sum does not decide a rounding later."""
    return shared_days(base, keys, within).withColumns({c: C.rint(F.col(c), 9) for c in KINDS.values()})


def repo_effort(base: DataFrame, digits: int = 1) -> DataFrame:
    """Days of each repository by kind."""
    out = split(base, ("repo",))
    return out.select("repo", *(C.rint(F.col(c), digits).alias(c) for c in KINDS.values()))


def people_effort(base: DataFrame) -> DataFrame:
    """A row for each person over all repositories: days, repos, the repository most worked in, and the kinds' shares of the days."""
    kinds = split(base, ("who",), ())
    repos = base.groupBy("who", "repo").agg(F.count("*").alias("n")).groupBy("who").agg(F.count("*").alias("repos"), F.min_by("repo", F.struct((-F.col("n")).alias("n"), "repo")).alias("top_repo"))
    out = kinds.join(repos, "who")
    return out.select(F.col("who").alias("person"), "days", "repos", "top_repo", *(C.ratio(F.col(c), F.col("days"), 3).alias(c) for c in KINDS.values()))


def person_repos(base: DataFrame, commits: DataFrame) -> DataFrame:
    """A row for each person and repository: days, commits, churn, shares of kinds."""
    key = ["who", "repo"]
    work = commits.groupBy(F.coalesce("person", F.lit("")).alias("who"), "repo", "sha").agg(F.sum("churn").alias("churn")).groupBy(*key).agg(F.count("*").alias("commits"), F.sum("churn").alias("churn"))
    out = split(base, ("who", "repo")).join(work, key)
    return out.select(F.col("who").alias("person"), "repo", "days", "commits", "churn", *(C.ratio(F.col(c), F.col("days"), 3).alias(c) for c in KINDS.values()))


def ownership(base: DataFrame, params: Params | None = None) -> DataFrame:
    """Files that one person holds: their share of the file's person-days, rounded before it is compared, and how many others touched it."""
    p = params or Params()
    days = base.groupBy("who", "repo", "path").agg(F.count("*").alias("days"))
    file = Window.partitionBy("repo", "path")
    out = days.withColumn("share", C.ratio(F.col("days"), F.sum("days").over(file))).withColumn("others", F.count("*").over(file) - 1)
    return out.where((F.col("share") >= p.ownership_floor) & (F.col("days") >= p.ownership_days)).withColumnRenamed("who", "person")


#: People beyond whom a file is not expanded into pairs of them.
HEAVY = 500


def peers(base: DataFrame, top: int = 12, most: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """For each person those who touch the same files: shared files and repositories, the top ones. Files of more than `most` people may be left out.

    Files of at most `heavy` people give pairs of people. For the others, people with the same
    heavy files are one class, and classes are paired: of whoever shares no light file with a
    person only the `top` of most shared heavy files, then least name, can be among its top.
    """
    who = base.select("repo", "path", "who").distinct()
    size = who.groupBy("repo", "path").agg(F.count("*").alias("n"))
    if most is not None:
        size = size.where(F.col("n") <= most)
    sized = cut(who.join(size, ["repo", "path"]))
    light, busy = sized.where(F.col("n") <= heavy).drop("n"), sized.where(F.col("n") > heavy).drop("n")
    pairs = light.join(light.withColumnRenamed("who", "peer"), ["repo", "path"]).where("who <> peer").groupBy("who", "peer", "repo").agg(F.count("*").alias("files"))
    if not busy.isEmpty():
        pairs = _with_heavy(cut(pairs), busy, top)
    out = pairs.groupBy("who", "peer").agg(F.sum("files").alias("files"), F.count("*").alias("repos"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("files"), "peer")))
    return ranked.where(F.col("rank") <= top).withColumnRenamed("who", "person")


def _with_heavy(pairs: DataFrame, busy: DataFrame, top: int) -> DataFrame:
    """Pairs (who, peer, repo, files) with heavy files counted in, and those that only heavy files link, as far as they can be among the top."""
    sets = busy.groupBy("who").agg(F.sort_array(F.collect_set(F.struct("repo", "path"))).alias("held"))
    # a class is named by its least member, so different sets never share a name
    name = sets.groupBy("held").agg(F.min("who").alias("class"))
    member = cut(sets.join(name, "held").select("who", "class"))
    files = name.select("class", F.explode("held").alias("f")).select("class", "f.*")
    shared = cut(files.join(files.withColumnRenamed("class", "other"), ["repo", "path"]).groupBy("class", "other", "repo").agg(F.count("*").alias("files")))
    # one more than the top of each class, as a person is no peer of their own
    first = member.withColumn("nr", F.row_number().over(Window.partitionBy("class").orderBy("who"))).where(F.col("nr") <= top + 1).select(F.col("class").alias("other"), F.col("who").alias("peer"))
    total = shared.groupBy("class", "other").agg(F.sum("files").alias("files")).join(first, "other")
    best = total.withColumn("nr", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("files"), "peer"))).where(F.col("nr") <= top + 1).select("class", "other", "peer")
    linked = pairs.select("who", "peer").distinct().join(member, "who").join(member.select(F.col("who").alias("peer"), F.col("class").alias("other")), "peer")
    asked = linked.select("who", "peer", "class", "other").union(member.join(best, "class").where("who <> peer").select("who", "peer", "class", "other")).distinct()
    both = pairs.unionByName(asked.join(shared, ["class", "other"]).select("who", "peer", "repo", "files"))
    return both.groupBy("who", "peer", "repo").agg(F.sum("files").alias("files"))


def active_days(commits: DataFrame) -> DataFrame:
    """By person and month: distinct days, and distinct commit times."""
    rows = commits.select("person", "month", "day", "date").distinct()
    per_day = rows.groupBy("person", "month", "day").agg(F.count("*").alias("stamps"))
    return per_day.groupBy("person", "month").agg(F.count("*").alias("days"), F.sum("stamps").alias("stamps"))


def cards(commits: DataFrame) -> DataFrame:
    """A row for each person: active days, repositories, commits, churn, files, first and last month, and the names committed under."""
    # days, commits and files are three groupings; the other figures go along with one of them
    days = commits.groupBy("person", "day").agg(F.min("month").alias("low"), F.max("month").alias("high"), F.collect_set("author").alias("names"))
    days = days.groupBy("person").agg(F.count("*").alias("days"), F.min("low").alias("first_month"), F.max("high").alias("last_month"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))), ", ").alias("aliases"))
    work = commits.groupBy("person", "repo", "sha").agg(F.sum("churn").alias("churn")).groupBy("person").agg(F.sum("churn").alias("churn"), F.count("*").alias("commits"))
    held = commits.select("person", "repo", "path").distinct().groupBy("person").agg(F.count("*").alias("files"), F.size(F.collect_set("repo")).cast("long").alias("repos"))
    return days.join(work, "person").join(held, "person")


def people_summary(effort: DataFrame) -> DataFrame:
    """Head count, total days, median and largest repositories and days."""
    base = effort.agg(F.count("*").alias("people"), F.sum("days").alias("days"), F.max("repos").alias("max_repos"), F.max("days").alias("max_days"))
    one = F.lit(1).alias("all")
    for name in ("repos", "days"):
        middle = quantiles(effort.select(one, name), ["all"], name, {f"median_{name}": 0.5})
        base = base.withColumn("all", F.lit(1)).join(middle, "all", "left").drop("all")
    return base.select("people", "days", "median_repos", "max_repos", "median_days", "max_days")


def named_like(effort: DataFrame, pattern: str) -> DataFrame:
    """People whose name matches a regex in any case."""
    return effort.where(F.col("person").rlike(f"(?i){pattern}"))


def alone(owned: DataFrame) -> DataFrame:
    """Owned files that nobody else touched."""
    return owned.where("others = 0")
