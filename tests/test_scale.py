"""What large inputs need: steps that leave out, or do once, what small inputs do not notice."""

from pyspark.sql import functions as F

from codehistory.functions import columns as C
from codehistory.operators import bands, cochange, effort, facts, regions
from codehistory.params import Params
from codehistory.plans import catalog
from codehistory.sources import adapters

SMALL = "/root/testdata/sf0.001"


def test_bands_need_no_facts(spark, monkeypatch):
    """Bands come from sizes and touches of files: no fact of a commit is made for them."""

    def none(*_):
        raise AssertionError("facts of commits are made")

    monkeypatch.setattr(adapters, "raw_commits", none)
    t = catalog.Tables(spark, SMALL)
    assert bands.quiet(t.bands).count() > 0


def test_seen_paths(spark):
    """The files of the tables are those of their facts, each once."""
    got = [tuple(r) for r in adapters.seen_paths(spark, SMALL).collect()]
    want = {tuple(r) for r in adapters.raw_commits(spark, SMALL).select("repo", "path").distinct().collect()}
    assert len(got) == len(want) and set(got) == want


def test_bands_that_begin_alike(spark):
    """Each band counts for itself, also where another one begins with it."""
    grid = spark.createDataFrame([("r", "f", 1, 10), ("r", "f", 1, 50)], "repo string, path string, start long, end long")
    touches = spark.createDataFrame([("r", "f", 20, 30, "a", "2025-02-01"), ("r", "f", 25, 30, "a", "2025-03-01"), ("r", "f", 20, 20, "b", None)], "repo string, path string, start long, end long, sha string, date string")
    assert {r.end: (r.commits, r["last"]) for r in bands.touched(grid, touches).collect()} == {10: (0, ""), 50: (2, "2025-03")}


def test_globs_without_a_regex(spark):
    """Globs with stars at their ends give what their regex gives, and none of them becomes one."""
    globs = ("*.lock", "dist/*", "*/build/*", "root", "*", "**", "", "a*b", "x?", "[!q]z*")
    texts = ["a.lock", ".lock", "a.lock.py", "dist/x", "sub/dist/x", "/build/", "build/x", "root", "roots", "a\nb.lock", "", "axxb", "ab", "xy", "qz1", "rz1", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    for glob in globs:
        got = rows.select(C.like_globs(F.col("text"), (glob,)).alias("x"), F.col("text").rlike(C.glob_regex((glob,))).alias("y")).collect()
        assert [r.x for r in got] == [r.y for r in got], glob
    p = Params()
    plan = facts.clean(spark.createDataFrame([("r", "a", "2025-01-01", "m", "x.py", 1, 1)], "repo string, sha string, date string, author string, path string, added long, deleted long"), p)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_facts_are_cleaned_once(spark):
    """What queries read of commits has met its patterns before it was written, and names are sent to it."""
    t = catalog.Tables(spark, SMALL)
    plan = t.commits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "contains(" not in plan.lower().replace(" ", "")
    assert t.commits.count() == t.kept.count()


def test_commits_are_gathered_once(spark):
    """Files of a commit are made distinct, counted and gathered after one shuffle of them."""
    rows = spark.createDataFrame([("r", "c1", "a"), ("r", "c1", "b"), ("r", "c1", "b"), ("r", "c2", "a"), ("r", "c2", "b"), ("s", "c2", "a"), ("r", None, "a"), ("r", None, "b")], "repo string, sha string, path string")
    once, apart = (cochange.coupled(rows, "sha", 30, gathered=g) for g in (True, False))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, apart.collect()))
    shuffles = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert shuffles(cochange.edges(rows)) > shuffles(apart)


def test_kinds_of_paths(spark):
    """Kinds come from paths, each once; a path that is none is a product."""
    rows = spark.createDataFrame([("Mina", "2025-01-01", "r", "tests/a.py"), (None, "2025-01-01", "r", None), ("Mina", "2025-01-02", "r", "tests/a.py")], "person string, day string, repo string, path string")
    base = effort.touched(rows)
    assert sorted((r.who, r.day, r.kind, r.known) for r in base.collect()) == [("", "2025-01-01", "product code", False), ("Mina", "2025-01-01", "tests", True), ("Mina", "2025-01-02", "tests", True)]
    assert "RLIKE" not in base._jdf.queryExecution().optimizedPlan().toString().upper()


def test_regions_meet_patterns_once(spark):
    """Symbols come from headings, each once; hunks without one are unnamed. Commits, months and headings of a region are counted for themselves."""
    rows = [("r", "f", "a", "2025-01-05", "Mina", "def save(self)", 3, 1), ("r", "f", "a", "2025-01-05", "Mina", "def save(self, x)", 1, 1), ("r", "f", "b", "2025-03-01", "Tor", "def save(self)", 0, 2), ("r", "f", "b", None, "Tor", None, 1, 0), ("r", "f", None, "2025-02-01", None, "", 1, 0)]
    hunks = spark.createDataFrame(rows, "repo string, path string, sha string, date string, person string, region string, added long, removed long").withColumn("churn", F.col("added") + F.col("removed"))
    assert "REGEXP" not in regions.symbols(hunks)._jdf.queryExecution().optimizedPlan().toString().upper()
    got = {r.region: (r.churn, r.rework, r.edits, r.commits, r["last"]) for r in regions.region_stats(hunks).collect()}
    assert got == {"save": (8, 4, 3, 2, "2025-03"), C.UNNAMED: (2, 0, 2, 1, "2025-02")}
