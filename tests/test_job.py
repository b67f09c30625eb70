"""The whole job: faulty logs, windows, repositories that do not settle, and what is stored."""

import pytest
from pyspark.sql import functions as F

from codehistory import Params
from codehistory.operators import communities, identity, job
from codehistory.sources import logs
from codehistory.sources.store import Store

GOOD = "a\t2025-03-03T09:15:00+02:00\tMina\tm@x\tnew\n12\t4\tcore/parser.rs\n6\t0\tcore/lexer.rs\n-\t-\tlogo.png"
OLD = "b\t2020-03-03T09:15:00+02:00\tMina\tm@x\told\n1\t1\tcore/parser.rs"


@pytest.fixture(scope="module")
def logged(spark):
    rows = [
        ("good", GOOD), ("good", OLD), ("past", OLD), ("faulty", GOOD), ("faulty", "c\tno day\tTor\tt@x\ts\n3\t3\tx.rs"), ("faulty", "\t\t\t\t\n5\t5\ty.rs"),
        ("faulty", "d\t2025-03-04T00:00:00+00:00\tTor\tt@x\ts\n5\tfive\tz.rs\nwords\n\n2\t1\tcore/parser.rs"), ("broken", "nothing here"), ("unasked", GOOD),
    ]
    return spark.createDataFrame(rows, "repo string, value string").cache()


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([("good", "core/parser.rs", 80)], "repo string, path string, lines long"), spark.createDataFrame([], "repo string, path string, born string")


def asked(spark):
    return spark.createDataFrame([(p,) for p in ("good", "past", "faulty", "broken", "absent", "refused", "good")], "path string")


def test_malformed(logged):
    got = sorted((r.repo, r.sha, r.reason, r.line) for r in logs.malformed(logged).collect())
    assert got == [
        ("broken", "nothing here", "date is no time", "nothing here"), ("faulty", "", "no commit id", "\t\t\t\t"), ("faulty", "c", "date is no time", "c\tno day\tTor\tt@x\ts"),
        ("faulty", "d", "count is no number", "5\tfive\tz.rs"), ("faulty", "d", "not a line of counts", "words"),
    ]


def test_job(spark, logged, sizes, tmp_path):
    store = Store(spark, str(tmp_path / "table"))
    status = spark.createDataFrame([("refused", "permission denied"), ("good", None)], "path string, failure string")
    done = job.run(logged, *sizes, asked(spark), "2025-06-01T00:00:00+00:00", Params(months=12), store, status)
    rows = {r.path: r for r in store.read().collect()}
    assert done.version == 1 and {p: r.error for p, r in rows.items()} == {
        "good": None, "past": "no commits in window", "absent": "no commits in window", "refused": "permission denied", "broken": "1 x date is no time",
        "faulty": "1 x count is no number; 1 x date is no time; 1 x no commit id; 1 x not a line of counts",
    }
    assert (rows["good"].total_churn, rows["good"].total_commits, rows["good"].since_months, rows["good"].max_files) == (22, 1, 12, 30)
    assert rows["faulty"].total_churn == 25 and rows["past"].total_churn is None and rows["past"].name == "past"
    lists = done.panels()
    assert [r.repo for r in lists["ranking"].collect()] == ["faulty", "good"] and {r.repo for r in lists["effort_sinks"].collect()} == {"good", "faulty"}
    assert job.run(logged, *sizes, asked(spark), "2026-06-01T00:00:00+00:00", Params(months=120), store).version == 2
    assert {r.path: r.total_churn for r in store.read().where("path in ('good', 'past')").collect()} == {"good": 24, "past": 2}


def test_what_does_not_settle_says_so(spark, logged, sizes, monkeypatch):
    """Rounds that end too early are named in the row, and every repository has its row."""
    monkeypatch.setattr(communities, "MOST_ROUNDS", 1)
    monkeypatch.setattr(communities, "_parts", lambda inside, paths: paths.select("repo", "path", F.col("comm").alias("label")))
    monkeypatch.setattr(identity, "MOST_ROUNDS", 1)
    twice = logged.unionByName(spark.createDataFrame([("good", f"e{k}\t2025-03-05T00:00:00+00:00\t{name}\t{mail}@x\ts\n1\t1\tq.rs") for k, (name, mail) in enumerate((("Mina", "z"), ("Ana", "z"), ("Ana", "y"), ("Zoe", "y"), ("Zoe", "m2")))], "repo string, value string"))
    rows = {r.path: r for r in job.run(twice, *sizes, asked(spark), "2025-06-01T00:00:00+00:00").rows.collect()}
    assert rows["good"].error == "clusters did not settle; identities did not settle" and rows["good"].total_churn == 32
    assert rows["faulty"].error.startswith("clusters did not settle; 1 x count") and rows["faulty"].total_churn == 25 and len(rows) == 6


def test_clusters_of_one_do_not_wait_for_others(spark):
    """A repository's clusters are the same alone and beside another that takes many rounds."""
    ring = lambda repo, n: [(repo, f"f{i:03d}", f"f{(i + 1) % n:03d}", 1) for i in range(n - 1)]
    small = [("small", "a", "b", 5), ("small", "b", "c", 5), ("small", "c", "d", 1), ("small", "d", "e", 5)]
    schema = "repo string, a string, b string, weight long"
    group = lambda df: sorted(sorted(r.path for r in df.collect() if r.comm == c) for c in {r.comm for r in df.collect()})
    alone = communities.louvain(spark.createDataFrame(small, schema))
    both = communities.louvain(spark.createDataFrame(small + ring("long", 7), schema)).cache()
    assert group(alone) == group(both.where("repo = 'small'")) and both.count() == 12
