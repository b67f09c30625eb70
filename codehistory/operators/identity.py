"""One name for each human, from many git identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .skew import hot, keyed_join


def name_key(author: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(author, F.lit(""))), "[^a-z]", "")


def mail_key(email: Column) -> Column:
    local = F.substring_index(F.substring_index(F.lower(F.coalesce(email, F.lit(""))), "@", 1), "+", 1)
    return F.regexp_replace(local, "[^a-z0-9]", "")


#: Rounds after which identities are left as they are and their scope is reported.
MOST_ROUNDS = 50


def _along(edges: DataFrame, labels: DataFrame, end: str, scope: tuple[str, ...]) -> DataFrame:
    """Edges with the label of one end. An end that holds much of all edges is a hub: there are few, and their labels are broadcast."""
    key, hub = [*scope, end], F.col(f"{end}_hub")
    few = edges.where(hub).join(F.broadcast(labels.where(hub).drop(f"{end}_hub")), key)
    return edges.where(~hub).join(labels.where(~hub).drop(f"{end}_hub"), key).unionByName(few)


def _spread(edges: DataFrame, scope: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(scope, name, label): the least name that mails lead to from each; and the scopes in which that had not settled when the rounds were over.

    Edges tell in name_hub and mail_hub which of their ends are hubs. Minima are summed up
    before they are shuffled, and no join gathers the edges of a hub or the names of a label
    that many have.
    """
    label = edges.groupBy(*scope, "name", "name_hub").agg(F.min("name").alias("label"))
    before = None
    for _ in range(MOST_ROUNDS):
        old = label
        mails = _along(edges, label, "name", scope).groupBy(*scope, "mail", "mail_hub").agg(F.min("label").alias("label"))
        near = cut(_along(edges, mails, "mail", scope).groupBy(*scope, "name", "name_hub").agg(F.min("label").alias("label")))
        # a label is a name too, and has come ahead itself
        held = near.groupBy(*scope, "label").agg(F.count("*").alias("n"))
        ahead = cut(near.select(*scope, F.col("name").alias("label"), F.col("label").alias("next")).join(held, [*scope, "label"]))
        label = cut(keyed_join(near, ahead, [*scope, "label"]).select(*scope, "name", "name_hub", F.col("next").alias("label")))
        now = label.agg(F.coalesce(F.sum(F.xxhash64(*scope, "name", "label").cast("decimal(38,0)")), F.lit(0))).first()[0]
        if now == before:
            return label.drop("name_hub"), label.select(*scope).limit(0)
        before = now
    changed = label.join(old.select(*scope, "name", F.col("label").alias("old")), [*scope, "name"]).where("label <> old")
    return label.drop("name_hub"), changed.select(*scope).distinct()


def people_and_loose(commits: DataFrame, scope: tuple[str, ...] = ("repo",)) -> tuple[DataFrame, DataFrame]:
    """(scope, author, person), and the scopes that had not settled when the rounds were over.

    Identities with the same letters in their name or the same mail name are one person, transitively.

    Name and mail keys are a bipartite graph; the least label spreads along it and jumps
    ahead through the label's own label, until a round changes nothing. The displayed name is
    spaced before not, with capitals before without, then longer, then greater.
    """
    pairs = commits.select(*scope, "author", "email").distinct().select(*scope, "author", name_key(F.col("author")).alias("name"), mail_key(F.col("email")).alias("mail"))
    # letters leave an empty key of many names, and mails like "info" are everywhere: such hubs hold much of all edges
    edges = cut(pairs.select(*scope, "name", "mail").distinct())
    mails = cut(edges.groupBy(*scope, "name").agg(F.count("*").alias("mails")))
    names = cut(edges.groupBy(*scope, "mail").agg(F.count("*").alias("names")))
    total = edges.count()
    edges = keyed_join(keyed_join(edges, mails, [*scope, "name"], "mails"), names, [*scope, "mail"], "names")
    edges = cut(edges.withColumns({"name_hub": hot("mails", total), "mail_hub": hot("names", total)}))
    # a name and a mail that know only each other are settled; the loop is for the others
    alone = (F.col("mails") == 1) & (F.col("names") == 1)
    spread, loose = _spread(edges.where(~alone).drop("mails", "names"), scope)
    label = edges.where(alone).select(*scope, "name", F.col("name").alias("label")).union(spread)
    named = cut(pairs.select(*scope, "author", "name").distinct())
    authors = named.groupBy(*scope, "name").agg(F.count("*").alias("n"))
    named = cut(keyed_join(named, cut(label.join(authors, [*scope, "name"])), [*scope, "name"]).drop("n"))
    rank = F.struct(F.col("author").contains(" ").alias("spaced"), (F.col("author") != F.lower("author")).alias("capital"), F.length("author").alias("n"), "author")
    best = cut(named.groupBy(*scope, "label").agg(F.max_by("author", rank).alias("person"), F.count("*").alias("n")))
    return keyed_join(named, best, [*scope, "label"]).select(*scope, "author", "person"), loose


def people(commits: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """(scope, author, person): the one name of each identity."""
    return people_and_loose(commits, scope)[0]
