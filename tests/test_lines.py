"""Logs read by lines, in blocks that are smaller than their commits."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from codehistory import Params
from codehistory.operators import lifting, ordered
from codehistory.plans import catalog
from codehistory.sources import logs


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def facts(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_counts_of_lines(spark, tmp_path, small_blocks):
    """A mass commit over many blocks, one of automation, empty ones, renames, and a second log in a folder of its own."""
    mass = "\n".join(f"{i}\t{i % 7}\tsrc/{{a => b}}/f{i}.py" for i in range(300))
    text = f"__C__a\t2025-01-02T00:00:00+00:00\tMina\tm@x\tmass\tchange\n{mass}\n-\t-\tx.png\n\n__C__b\t2025-01-01T00:00:00+00:00\tmergebot\tb@x\ts\n1\t1\ty.py\n__C__c\n__C__d\t2024-12-01T00:00:00+00:00\tTor\tt@x\ts\n3\tmany\tz.py\n2\t2\tz.py"
    (tmp_path / "logs" / "repo=lab%2Ftool").mkdir(parents=True)
    (tmp_path / "logs" / "repo=other").mkdir()
    (tmp_path / "logs" / "repo=lab%2Ftool" / "a.log").write_text(text)
    (tmp_path / "logs" / "repo=other" / "b.log").write_text("__C__q\t2025-01-01T00:00:00+00:00\tAna\ta@x\ts\n9\t9\tq.py\n")
    lines = logs.read_lines(spark, str(tmp_path / "logs"))
    assert lines.select("block").distinct().count() > 12, "the commit lies over many blocks"
    got = logs.numstat_of_lines(lines)
    assert facts(got) == facts(logs.parse_numstat(logs.read_records(spark, str(tmp_path / "logs"))).select(*got.columns)) and got.count() == 302
    assert {r.repo for r in got.collect()} == {"lab/tool", "other"}


def test_hunks_of_lines(spark, tmp_path, small_blocks):
    """Patches of many files and hunks; lines of hunks that look like headers of files; deleted and quoted paths; a commit without a patch."""
    rng = random.Random(5)
    out = []
    for k in range(25):
        out.append(f"__C__s{k}\t2025-01-{28 - k % 28:02d}T00:00:00+00:00\t{'mergebot' if k % 6 == 5 else 'Mina'}\tm@x\tsubject {k}")
        for f in range(rng.randrange(0, 5)):
            name = rng.choice([f"src/f{f}.py", f"src/ü{f}.py"])
            side = (lambda x, name=name: f'"{x}/' + name.replace("ü", r"\303\274") + '"') if "ü" in name else (lambda x, name=name: f"{x}/{name}")
            gone = rng.random() < 0.2
            out += [f"diff --git {side('a')} {side('b')}", "index 1..2 100644", f"--- {side('a')}", "+++ /dev/null" if gone else f"+++ {side('b')}"]
            for _ in range(rng.randrange(1, 12)):
                out += [f"@@ -{rng.randrange(90)},{rng.randrange(3)} +{rng.randrange(90)} @@ def f{k}():", "--- a/not/a/file", "+++ b/not/a/file", "-words", "+words"]
    (tmp_path / "lab~tool.log").write_text("\n".join(out) + "\n")
    every = Params(ignore_authors=())
    for p in (None, every):
        got = logs.hunks_of_lines(logs.read_lines(spark, str(tmp_path)), p)
        want = logs.parse_hunks(logs.read_records(spark, str(tmp_path)), p)
        assert facts(got.drop("position")) == facts(want.drop("position").select(*got.drop("position").columns)) and got.count() > 100
    order = [r.sha for r in got.select("sha", "position").distinct().orderBy("position").collect()]
    assert order == sorted(order, key=lambda s: int(s[1:])), "positions are in the order of the log"
    assert lifting.lift(got).count() > 0


def test_blocks_of_written_logs_do_not_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(catalog, "LEAST_BLOCK", 1000, raising=False)
    monkeypatch.setattr(catalog, "MOST_BLOCKS", 8, raising=False)
    records = spark.range(3000).select(F.lit("lab").alias("repo"), F.format_string("c%d\tday\tname\tmail\tsubject\n1\t2\tfile%d.py", "id", "id").alias("value"))
    lines = catalog._as_lines(SimpleNamespace(spark=spark), records)
    assert lines.count() == 6000 and 4 <= lines.select("file", "block").distinct().count() <= 8 + lines.select("file").distinct().count()
    facts = logs.numstat_of_lines(lines)
    assert facts.count() == 3000 and facts.where("path <> concat('file', substr(sha, 2), '.py')").count() == 0


def test_numbers_over_parts(spark):
    """Groups within a part, over two and over three parts."""
    rows = [(part, part * 10 + i, key, begin) for key, begin, sizes in (("a", 0, {0: 3}), ("b", 0, {0: 2, 1: 3, 3: 1}), ("c", 3, {3: 4})) for part, n in sizes.items() for i in range(n)]
    found = ordered.numbered_in(spark.createDataFrame(rows, "block long, row long, key string, first long"), "block", F.col("first"), ["key"], [F.col("row")], "no")
    assert {k: [r.no for r in sorted(found.where(F.col("key") == k).collect())] for k in "abc"} == {"a": [0, 1, 2], "b": [0, 1, 2, 3, 4, 5], "c": [0, 1, 2, 3]}


def test_counts_where_lines_are_read(spark, tmp_path, small_blocks):
    """Headers reach the lines of their commit in later blocks and batches, and no line is shuffled."""
    mass = "\n".join(f"{i}\t{i % 7}\tsrc/{{a => b}}/f{i}.py" for i in range(300))
    small = "\n".join(f"__C__s{k}\t2025-01-02T00:00:00+00:00\tMina\tm@x\ts\n{k}\t1\tf{k}.py\n" for k in range(40))
    for name, text in (("lab%2Ftool", f"__C__a\t2025-01-02T00:00:00+00:00\tMina\tm@x\tmass\tchange\n{mass}\n-\t-\tx.png\n\n__C__c\n{small}"), ("other", f"1\t1\tof no commit\n{small}__C__q\t2025-01-01T00:00:00+00:00\tAna\ta@x\ts\n9\t9\tq.py\n"), ("none", "\n1\t2\tx.py\n")):
        (tmp_path / "logs" / f"repo={name}").mkdir(parents=True)
        (tmp_path / "logs" / f"repo={name}" / "a.log").write_text(text)
    path = str(tmp_path / "logs")
    want = facts(logs.numstat_of_lines(logs.read_lines(spark, path)))
    assert len(want) == 381
    for rows in ("10000", "3", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = logs.numstat_of_files(spark, path)
        assert facts(got) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.index("MapInArrow _heads_in_blocks") < plan.index("Window"), "only headers of blocks are put in order"


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_hunks_where_lines_are_read(spark, tmp_path, small_blocks, batch):
    """Commits, sections and names that lie over blocks and batches, two logs, commits without a patch, paths with tabs, and automation; no line is shuffled."""
    rng = random.Random(11)
    for name, n in (("lab~tool", 9), ("other", 4)):
        out = []
        for k in range(n):
            out.append(f"__C__{name}{k}\t2025-01-{28 - k % 28:02d}T00:00:00+00:00\t{'mergebot' if k % 6 == 5 else 'Mina'}\tm@x\tsubject {k}")
            for f in range(rng.randrange(0, 4)):
                path = rng.choice([f"src/f{f}.py", f"src/ü{f}.py", f"a b{f}.py\t"])
                side = (lambda x, path=path: f'"{x}/' + path.replace("ü", r"\303\274") + '"') if "ü" in path else (lambda x, path=path: f"{x}/{path}")
                gone = rng.random() < 0.2
                out += [f"diff --git {side('a')} {side('b')}", *(["index 1..2 100644"] * rng.randrange(20)), f"--- {side('a')}", "+++ /dev/null" if gone else f"+++ {side('b')}"]
                for _ in range(rng.randrange(1, 7)):
                    out += [rng.choice([f"@@ -{rng.randrange(90)},{rng.randrange(3)} +{rng.randrange(90)} @@ def f{k}():", "@@ no header", "@@ -1 +2 @@"]), "--- a/not/a/file", "+++ b/not/a/file", "-words", *(["+words"] * rng.randrange(9))]
        (tmp_path / f"{name}.log").write_text("\n".join(out) + "\n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for p in (None, Params(ignore_authors=())):
            got = logs.hunks_of_files(spark, str(tmp_path), p).cache()
            want = logs.parse_hunks(logs.read_records(spark, str(tmp_path)), p)
            columns = [c for c in got.columns if c != "position"]
            assert facts(got.select(columns)) == facts(want.select(columns)) and got.count() > 30
        order = [r.sha for r in got.where("repo = 'other'").select("sha", "position").distinct().orderBy("position").collect()]
        assert order == sorted(order, key=lambda s: int(s[5:])), "positions are in the order of the log"
        assert got.select("repo").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_logs_are_written_in_rounds_and_go(spark, monkeypatch):
    """The text of all logs is never there at once, and none of it is left; hunks are the same."""
    monkeypatch.setattr(catalog, "ROUND", 2000, raising=False)
    written, block = [], catalog._block_size
    monkeypatch.setattr(catalog, "_block_size", lambda records, path: written.append(path.removeprefix("file:")) or block(records, path))
    t = catalog.Tables(spark, "/root/testdata/sf0.001")
    got = catalog.QUERIES["s4_from_lines"](spark, t.dir)
    want = logs.parse_hunks(catalog._patches(t)).select(*got.columns)
    assert facts(got) == facts(want) and len(written) == 3
    assert not any(os.path.exists(path) for path in written)
