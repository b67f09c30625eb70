"""Identities with hubs: keys that many names and mails share."""

import random

import pytest

from codehistory.operators import identity, skew


def _brute(rows):
    """Sets of authors that share letters of a name or a mail name, transitively."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for author, email in rows:
        name = "".join(c for c in author.lower() if "a" <= c <= "z")
        mail = "".join(c for c in email.lower().split("@")[0].split("+")[0] if c.isascii() and c.isalnum())
        up[root(("n", name))] = root(("m", mail))
        up[root(("a", author))] = root(("n", name))
    sets: dict = {}
    for author, _ in rows:
        sets.setdefault(root(("a", author)), set()).add(author)
    return {frozenset(s) for s in sets.values()}


@pytest.mark.parametrize("most", [2000, 4, 1])
def test_hubs(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "HOT", most)
    dice = random.Random(most)
    letters = "abcdefghij"
    # a third has no letters in the name, a chain of mails links some, and one mail is everywhere
    rows = [(f"{k} {k}", f"u{k % 40}@x") for k in range(60)] + [("".join(dice.choices(letters, k=2)), f"m{dice.randrange(90)}+z@y") for _ in range(90)]
    rows += [(f"{letters[k % 10] * 4}{letters[k // 10] * 3}", "info@z") for k in range(30)]
    got = identity.people(spark.createDataFrame([("r", *x) for x in rows] + [("s", *x) for x in rows[:70]], "repo string, author string, email string"))
    for repo, part in (("r", rows), ("s", rows[:70])):
        found: dict = {}
        here = [r for r in got.collect() if r.repo == repo]
        for r in here:
            found.setdefault(r.person, set()).add(r.author)
        assert {frozenset(s) for s in found.values()} == _brute(part)
        assert len(here) == len({a for a, _ in part})


def test_keyed_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 3)
    left = spark.createDataFrame([(k % 5 if k > 20 else 0, k) for k in range(40)], "k int, v int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    got = sorted(tuple(r) for r in skew.keyed_join(left, right, ["k"]).select("k", "v", "n").collect())
    assert got == sorted((r.k, r.v, r.n) for r in left.join(right, "k").collect())
