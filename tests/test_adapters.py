"""The tables as facts: the same rows as the SQL, and no text through the shuffles."""

import contextlib
import io
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from codehistory.sources import adapters as A
from codehistory.sources import logs


def tables(spark, folder):
    """Two orders of one key, segments without text or in odd case, keys of automation, items without part or number."""
    day = lambda d: datetime(1996, 3, d, 5)
    orders = [(50, 1, day(1)), (50, 9, day(1)), (50, 2, day(1)), (7, 1, day(2)), (7, 9, day(2)), (11, 4, day(3)), (3, 4, None), (2, 3, day(4)), (9, 5, day(5)), (9, 6, day(5)), (9, 13, day(5))]
    customers = [(1, 0, "BUILDING"), (9, 0, "BUILDing"), (2, 0, "BUILDERS"), (4, 1, "MACHINERY"), (3, 1, None), (5, 1, None), (6, 1, None), (13, 1, "AUTO")]
    items = [(k, p, n, q) for k in (50, 7, 11, 3, 2, 9) for p, n, q in ((40, 1, 3.0), (41, 1, 4.0), (80, 2, 5.0), (56, 1, 6.0), (41, 5, 1.0), (191, 5, 2.0), (None, 2, 9.0), (57, None, 7.0), (57, 3, None))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "Peru"), (1, "CHINA")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(*r[:3], r[1] or 1, r[3]) for r in items], "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_the_rows_of_the_sql(spark, tmp_path):
    d = tables(spark, tmp_path)
    for made, sql in ((A.raw_commits(spark, d), A.COMMIT_SQL), (A.raw_hunks(spark, d), A.HUNK_SQL), (A.raw_touches(spark, d), A.TOUCH_SQL)):
        asked = A._view(spark, d, sql)
        assert Counter(map(tuple, made.collect())) == Counter(map(tuple, asked.collect())) and made.count() > 40
        assert [f.dataType for f in made.schema] == [f.dataType for f in asked.schema]


def test_items_are_summed_up_where_they_met_their_order(spark, tmp_path):
    d, key = tables(spark, tmp_path), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            A.raw_commits(spark, d).explain()
    finally:
        spark.conf.unset(key)
    shuffles = [line for line in plan.getvalue().splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 6 and not any("path" in line or "subject" in line for line in shuffles)


def test_records_are_gathered_where_items_met_their_order(spark, tmp_path):
    """Records say what the rows of the SQL say, and hold no shuffle beyond those of the rows."""
    d, key = tables(spark, tmp_path), "spark.sql.autoBroadcastJoinThreshold"
    raw = A.raw_commits(spark, d)
    head, line = F.concat_ws("\t", "sha", "date", "author", "email", "subject"), F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), "path")
    said = Counter(tuple(r) for r in raw.select("repo", head, line).collect())
    found = A.raw_records(spark, d).select("repo", F.substring_index("value", "\n", 1), F.explode(logs._lines(F.col("value"))))
    assert Counter(r for r in map(tuple, found.collect()) if r[2] != "-\t-\tart/logo.png") == said
    assert {r.repo for r in A.repos(spark, d).collect()} == {r.repo for r in raw.collect()}
    spark.conf.set(key, "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            A.raw_records(spark, d).explain()
        with contextlib.redirect_stdout(io.StringIO()) as once:
            logs.malformed(A.raw_records(spark, d)).explain()
    finally:
        spark.conf.unset(key)
    assert plan.getvalue().count("Exchange hashpartitioning") == once.getvalue().count("Exchange hashpartitioning") == 6
    assert "Union" not in once.getvalue()


def test_faults_of_records_without_text(spark):
    rows = [("r", None), ("r", ""), ("r", "a\t2025-01-01T00:00:00+00:00"), ("r", "b\tnever\n\n1\t2\tx\n\nx\n")]
    found = logs.malformed(spark.createDataFrame(rows, "repo string, value string")).collect()
    assert sorted(((r.sha, r.reason, r.line) for r in found), key=str) == sorted([("", "no commit id", None), ("", "no commit id", ""), ("b", "date is no time", "b\tnever"), ("b", "not a line of counts", "x")], key=str)
