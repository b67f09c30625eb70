"""Hunks in the line numbers of today, and running values over ranges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from codehistory import Params
from codehistory.operators import bands, lifting, ordered
from codehistory.sources import logs


def edited(rng, n):
    """Hunks (old, removed, new, added) of a random commit to a file of n lines, without context, and its length after."""
    out, old, shift = [], 1, 0
    for _ in range(rng.randrange(1, 4)):
        old += rng.randrange(1, 8)
        removed, added = rng.choice([(0, 2), (3, 0), (1, 1), (2, 5), (6, 2), (0, 1)])
        if old + removed > n + 1:
            break
        out.append((old, removed, old + shift, added))
        shift += added - removed
        old += removed + 1
    return out, n + shift


def moved(hunks, line, last):
    """Where one commit puts the first or the last line of a range."""
    shift = 0
    for old, removed, new, added in hunks:
        if old <= line < old + removed:
            return new + added - 1 if last else new
        if line >= old + removed:
            shift = new + added - old - removed
    return line + shift


def histories(rng, files, most):
    """Commits of files, oldest first, each a list of hunks."""
    out = {}
    for k in range(files):
        n = rng.randrange(0, 60)
        commits = [[(1, 0, 1, n)]] if n else [[(1, 0, 1, 30)]]
        n = n or 30
        for _ in range(rng.randrange(0, most)):
            hunks, n = edited(rng, n)
            commits.append(hunks or [(1, 0, 1, 1)])
            n += not hunks
        out[f"src/f{k}.py"] = (commits, n)
    return out


def as_rows(made):
    rows = []
    for path, (commits, _) in made.items():
        for at, hunks in enumerate(commits):
            for old, removed, new, added in hunks:
                rows.append(("r", path, f"{path}-{at}", f"2025-01-{at % 28 + 1:02d}", len(commits) - at, old - (removed == 0), removed, new - (added == 0), added))
    return rows


ROWS = "repo string, path string, sha string, date string, position long, old_start long, removed long, new_start long, added long"


def expected(made):
    out = []
    for path, (commits, _) in made.items():
        for at, hunks in enumerate(commits):
            for _, _, new, added in hunks:
                low, high = new, new + added - 1
                for later in commits[at + 1 :]:
                    low, high = moved(later, low, False), moved(later, high, True)
                out.append((path, f"{path}-{at}", low, high))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_lift(spark, parts):
    """Random edits; one file with most of all commits lies over several ranges."""
    rng = random.Random(parts)
    made = histories(rng, 12, 9) | {"src/big.py": histories(rng, 1, 2)["src/f0.py"]}
    commits, n = made["src/big.py"]
    for _ in range(70):
        hunks, n = edited(rng, n)
        commits.append(hunks or [(1, 0, 1, 1)])
        n += not hunks
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = as_rows(made)
        got = lifting.lift(spark.createDataFrame([*rows, rows[0]], ROWS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.path, r.sha, r.start, r.end) for r in got) == expected(made)


@pytest.mark.parametrize("block", [0, 2, 8])
def test_lift_by_blocks(spark, monkeypatch, block):
    """Blocks of one, four and 256 commits give the same; a file of no more commits than a block takes no ordered pass."""
    passes = []
    monkeypatch.setattr(lifting, "BLOCK", block, raising=False)
    monkeypatch.setattr(lifting, "running_last", lambda *a: passes.append(1) or ordered.running_last(*a))
    made = histories(random.Random(block), 4, 14)
    most = max(len(commits) for commits, _ in made.values())
    got = lifting.lift(spark.createDataFrame(as_rows(made), ROWS)).collect()
    assert sorted((r.path, r.sha, r.start, r.end) for r in got) == expected(made)
    assert len(passes) == ((most - 1) >> block).bit_length()


def test_lift_without_hunks(spark):
    assert lifting.lift(spark.createDataFrame([], ROWS)).count() == 0


def test_bands_from_a_patch_log(spark, tmp_path):
    """A log, newest first: lines put in above, a line changed, a stretch taken out, and automation that shifts too."""
    (tmp_path / "lab~tool.log").write_text(
        "__C__d\t2025-05-04T00:00:00+00:00\tTor\tt@l\tcut\ndiff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -31,2 +30,0 @@ fn\n"
        "__C__c\t2025-04-03T00:00:00+00:00\tmergebot\tb@l\tlicense\ndiff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -0,0 +1,10 @@\n"
        "__C__b\t2025-03-02T00:00:00+00:00\tMina\tm@l\tfix\ndiff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -21 +21 @@ fn\n"
        "__C__a\t2025-02-01T00:00:00+00:00\tMina\tm@l\tnew\ndiff --git a/x.rs b/x.rs\n--- /dev/null\n+++ b/x.rs\n@@ -0,0 +1,40 @@\n"
    )
    hunks = logs.parse_hunks(logs.read_records(spark, str(tmp_path)), Params(ignore_authors=()))
    touches = lifting.lift(hunks)
    # the two lines taken out were lines 21 and 22 of the second version: the fix is gone with them
    assert {(r.sha, r.start, r.end) for r in touches.collect()} == {("d", 31, 30), ("c", 1, 10), ("b", 31, 30), ("a", 11, 48)}
    grid = bands.grid(spark.createDataFrame([("lab/tool", "x.rs", 48)], "repo string, path string, lines long"), bands=2)
    assert {(r.start, r.end): (r.commits, r.last) for r in bands.touched(grid, touches).collect()} == {(1, 24): (2, "2025-04"), (25, 48): (3, "2025-05")}


@pytest.mark.parametrize("parts", [1, 9])
def test_running_values(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), rng.randrange(50), i, rng.randrange(9) if rng.random() < 0.2 else None) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, o long, i long, v long")
        got = {r.i: (r.last, r.n) for r in ordered.numbered(ordered.running_last(df, ["k"], ["o", "i"], {"last": F.col("v")}), ["k"], [F.desc("o"), F.col("i")], "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in "ab":
        last, own = None, sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for r in own:
            last = r[3] if r[3] is not None else last
            assert got[r[2]][0] == last
        assert [got[r[2]][1] for r in sorted(own, key=lambda r: (-r[1], r[2]))] == list(range(len(own)))


@pytest.mark.parametrize("parts", [1, 9])
def test_pages_and_quantiles(spark, parts):
    """Deep pages against slices, quantiles of groups of any size against numpy."""
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), i, rng.choice([None, rng.random(), 0.5])) for i in range(700)] + [("one", 700, 2.0), ("none", 701, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.desc_nulls_last("v"), F.col("i")]
        want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        for start, size in ((0, 5), (350, 40), (690, 40), (900, 5)):
            assert [tuple(r) for r in ordered.page(df, order, start, size).collect()] == want[start : start + size]
        got = {r.k: (r.low, r.mid, r.top) for r in ordered.quantiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "top": 0.93}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {"a", "b", "one"}
    for k in got:
        assert np.allclose(got[k], np.quantile([r[2] for r in rows if r[0] == k and r[2] is not None], [0, 0.5, 0.93]))


@pytest.mark.parametrize("rows", ["1", "3", "100"])
def test_lift_in_batches_and_ranges(spark, monkeypatch, rows):
    """Commits, blocks and files that lie over batches of a task, and files over ranges."""
    monkeypatch.setattr(lifting, "BLOCK", 3)
    monkeypatch.setattr(lifting, "RANGE", 60, raising=False)
    made = histories(random.Random(int(rows)), 9, 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = lifting.lift(spark.createDataFrame(as_rows(made), ROWS)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.path, r.sha, r.start, r.end) for r in got) == expected(made)


def test_lift_reads_its_hunks_once(spark, monkeypatch):
    """What hunks come from may be a log to be parsed; and a file in one range takes no ordered pass."""
    passes, read = [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr(lifting, "running_last", lambda *a: passes.append(1) or ordered.running_last(*a))
    made = histories(random.Random(4), 1, 2)
    commits, n = made["src/f0.py"]
    for _ in range(600):
        hunks, n = edited(random.Random(len(commits)), n)
        commits.append(hunks or [(1, 0, 1, 1)])
        n += not hunks
    rows = as_rows(made)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = lifting.lift(spark.createDataFrame(rows, ROWS).mapInArrow(counted, ROWS)).collect()
    assert sorted((r.path, r.sha, r.start, r.end) for r in got) == expected(made)
    assert read.value == len(rows) and not passes


def test_lift_of_a_commit_at_two_places(spark):
    """A commit that two logs give stands where the newer one has it, with each hunk once; numbers of lines may be of any size."""
    far = 1 << 58
    rows = [
        ("r", "x", "a", "2025-01-01", 9, 0, 0, 1, 5), ("r", "x", "b", "2025-01-02", 5, 2, 1, 2, 3), ("r", "x", "b", "2025-01-02", 7, 2, 1, 2, 3), ("r", "x", "b", "2025-01-02", 7, far, 0, far + 3, 2),
        ("r", "x", "c", "2025-01-03", 6, 1, 1, 1, 1), ("r", "x", "d", "2025-01-04", 1, 0, 0, 1, 4),
    ]
    got = {(r.sha, r.start, r.end) for r in lifting.lift(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {("a", 5, 11), ("c", 5, 5), ("b", 6, 8), ("b", far + 7, far + 8), ("d", 1, 4)}
