"""People who touch the same files: files of many people by classes, against brute force."""

import random
from collections import Counter

import pytest

from codehistory.operators import effort


def brute(rows, top):
    held = {}
    for repo, path, who in rows:
        held.setdefault((repo, path), set()).add(who)
    files, repos = Counter(), {}
    for (repo, _), people in held.items():
        for a in people:
            for b in people - {a}:
                files[a, b] += 1
                repos.setdefault((a, b), set()).add(repo)
    out = set()
    for a in {a for a, _ in files}:
        best = sorted((b for x, b in files if x == a), key=lambda b: (-files[a, b], b))[:top]
        out |= {(a, b, files[a, b], len(repos[a, b]), i + 1) for i, b in enumerate(best)}
    return out


@pytest.mark.parametrize("heavy", [0, 2, 6, 1000])
def test_peers_by_classes(spark, heavy):
    """Any border between light and heavy files gives the same: ties, repeated rows, one's own name among the first, several repositories."""
    rng = random.Random(heavy)
    rows = [(f"r{i % 3}", f"f{i}", f"p{k:02}") for i in range(14) for k in rng.sample(range(25), rng.choice([1, 2, 4, 9, 22]))]
    rows += rows[:20] + [("r9", "only", f"q{k}") for k in range(9)]
    got = effort.peers(spark.createDataFrame(rows, "repo string, path string, who string"), top=3, heavy=heavy)
    assert {(r.person, r.peer, r.files, r.repos, r["rank"]) for r in got.collect()} == brute(rows, 3)


def test_peers_of_a_crowd(spark):
    """A file of 3,000 people gives each of them their top without pairs of all."""
    people = spark.range(3000).selectExpr("'r' as repo", "'crowd' as path", "format_string('p%04d', id) as who")
    got = effort.peers(people.union(spark.createDataFrame([("r", "two", "p2000"), ("r", "two", "p2999")], people.schema)), top=2, heavy=100)
    rows = {(r.person, r["rank"]): (r.peer, r.files, r.repos) for r in got.collect()}
    assert len(rows) == 6000
    assert rows["p0000", 1] == ("p0001", 1, 1) and rows["p0500", 2] == ("p0001", 1, 1)
    assert rows["p2000", 1] == ("p2999", 2, 1) and rows["p2000", 2] == ("p0000", 1, 1)


def test_peers_of_nothing(spark):
    none = spark.createDataFrame([], "repo string, path string, who string")
    assert effort.peers(none).count() == 0
