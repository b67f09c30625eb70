"""Clusters of the co-change graph by synchronous modularity moves, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Moves and levels of a repository end when it gains less modularity than this.
LEAST_GAIN = 1e-6
#: Rounds of moves, and levels, after which a repository is left as it is and reported.
MOST_ROUNDS = 200
MOST_LEVELS = 50


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _moves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, node, comm) after moves of single nodes, and (repo, gain, settled): the modularity gained. Edges are both ways; a loop (a = b) holds twice its weight.

    In each round one half of the nodes, by a hash, may move to the neighbouring community
    with the best gain of modularity, so that two nodes do not swap places for ever; a lone
    node joins another lone one only towards the smaller name. A repository is done when
    two rounds gain it nothing and takes no part from then on; one that is not done after
    MOST_ROUNDS keeps what it has and is not settled.
    """
    degree = edges.groupBy("repo", F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    total = degree.groupBy("repo").agg(F.sum("k").alias("m2"))
    state = cut(degree.join(total, "repo").select("repo", "node", F.col("node").alias("comm"), "k", "m2"))
    placed: list[DataFrame] = []
    gains: list[DataFrame] = []
    scores, open_ = None, None
    # every node alone; loops stay inside whatever moves, so they are left out here and below
    first = state.groupBy("repo").agg((-F.sum((F.col("k") / F.col("m2")) ** 2)).alias("start"))
    for turn in range(MOST_ROUNDS):
        size = state.groupBy("repo", "comm").agg(F.sum("k").alias("tot"), F.count("*").alias("n"), F.first("m2").alias("m2"))
        near = state.select("repo", F.col("node").alias("b"), F.col("comm").alias("to"))
        # the join with the nodes that are left leaves the edges of finished repositories behind
        links = edges.join(near, ["repo", "b"]).groupBy("repo", F.col("a").alias("node"), "to").agg(F.sum(F.when(F.col("a") != F.col("b"), F.col("weight")).otherwise(0)).alias("w"))
        options = links.join(state.join(size.drop("m2"), ["repo", "comm"]), ["repo", "node"]).join(size.select("repo", F.col("comm").alias("to"), F.col("tot").alias("to_tot"), F.col("n").alias("to_n")), ["repo", "to"])
        here = F.col("to") == F.col("comm")
        gain = F.round(F.col("w") - F.col("k") * (F.col("to_tot") - F.when(here, F.col("k")).otherwise(0)) / F.col("m2"), 9)
        allowed = ~here & ~((F.col("n") == 1) & (F.col("to_n") == 1) & (F.col("to") > F.col("comm")))
        stay = -F.first("k") * (F.first("tot") - F.first("k")) / F.first("m2")
        best = options.groupBy("repo", "node").agg(
            F.first("comm").alias("comm"), F.first("k").alias("k"), F.first("m2").alias("m2"), F.coalesce(F.max(F.when(here, F.col("w"))), F.lit(0)).alias("w_own"), stay.alias("stay"),
            F.min(F.when(allowed, F.struct((-gain).alias("loss"), "to"))).alias("best"),
        )
        go = (-F.col("best.loss") > F.col("w_own") + F.col("stay") + 1e-6) & (F.pmod(F.xxhash64("repo", "node"), F.lit(2)) == turn % 2)
        after = cut(best.select("repo", "node", "comm", F.when(F.coalesce(go, F.lit(False)), F.col("best.to")).otherwise(F.col("comm")).alias("next"), "k", "m2", (F.col("w_own") / F.col("m2")).alias("inside")))
        stays = after.select("repo", "node", F.col("next").alias("comm"), "k", "m2")
        if turn % 2 == 0:
            state = stays
            continue
        # once both halves have had their turn: modularity before the moves of this round, what lies inside communities less what chance puts there
        expected = size.groupBy("repo").agg(F.sum((F.col("tot") / F.col("m2")) ** 2).alias("expected"))
        now = after.groupBy("repo").agg(F.sum("inside").alias("inside")).join(expected, "repo").select("repo", (F.col("inside") - F.col("expected")).alias("value"))
        now = now.join(first, "repo").withColumn("before", F.lit(None).cast("double")) if scores is None else now.join(scores.select("repo", F.col("value").alias("before"), "start"), "repo")
        scores = cut(now.withColumn("done", F.coalesce(F.col("value") - F.col("before") < LEAST_GAIN, F.lit(False))))
        ended, open_ = scores.where("done"), scores.where("not done")
        some = {r["done"] for r in scores.select("done").distinct().collect()}
        if True in some or not some:
            placed.append(after.join(ended.select("repo"), "repo").select("repo", "node", "comm"))
            gains.append(ended.select("repo", (F.col("value") - F.col("start")).alias("gain"), F.lit(True).alias("settled")))
        if False not in some:
            break
        state = stays.join(open_.select("repo"), "repo", "left_semi") if True in some else stays
    else:
        placed.append(state.select("repo", "node", "comm"))
        late = (first.withColumn("value", F.col("start")) if open_ is None else open_).select("repo", (F.col("value") - F.col("start")).alias("gain"), F.lit(False).alias("settled"))
        gains.append(late)
    return _union(placed), _union(gains)


def _louvain(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, path, comm) of every linked file of a co-change graph, and (repo) of the repositories that did not settle."""
    now = cut(edges.select("repo", "a", "b", F.col("weight").cast("double")).unionByName(edges.select("repo", F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").cast("double"))))
    placed, done, loose = None, [], []
    for level in range(MOST_LEVELS):
        moved, gains = _moves(now)
        moved = cut(moved)
        placed = cut(moved.select("repo", F.col("node").alias("path"), "comm") if placed is None else placed.join(moved.select("repo", F.col("node").alias("comm"), F.col("comm").alias("next")), ["repo", "comm"]).select("repo", "path", F.col("next").alias("comm")))
        loose.append(gains.where("not settled").select("repo"))
        go_on = gains.where(F.col("settled") & (F.col("gain") >= LEAST_GAIN)).select("repo")
        done.append(placed.join(go_on, "repo", "left_anti"))
        if not go_on.head(1):
            break
        if level == MOST_LEVELS - 1:
            done.append(placed.join(go_on, "repo", "left_semi"))
            loose.append(go_on)
            break
        placed, moved = placed.join(go_on, "repo", "left_semi"), moved.join(go_on, "repo", "left_semi")
        a, b = (moved.withColumnsRenamed({"node": x, "comm": f"c{x}"}) for x in "ab")
        now = cut(now.join(a, ["repo", "a"]).join(b, ["repo", "b"]).groupBy("repo", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")))
    return _union(done), _union(loose).distinct()


def louvain(edges: DataFrame) -> DataFrame:
    """(repo, path, comm) of every linked file of a co-change graph (repo, a, b, weight), comm being a name in it.

    Levels of moves and contraction follow Blondel et al. 2008; each repository goes on until
    a level gains it nothing, whatever the others do.
    """
    return _louvain(edges)[0]


def _parts(inside: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, path, label): the smallest file that edges (repo, a, b) lead to from each."""
    both = cut(inside.union(inside.select("repo", "b", "a")))
    label = cut(paths.select("repo", "path", F.col("path").alias("label")))
    for _ in range(MOST_ROUNDS):
        near = both.join(label.withColumnRenamed("path", "b"), ["repo", "b"]).groupBy("repo", F.col("a").alias("path")).agg(F.min("label").alias("near"))
        step = label.join(near, ["repo", "path"], "left").select("repo", "path", F.least("label", F.coalesce("near", "label")).alias("to"), "label")
        ahead = step.select("repo", F.col("path").alias("to"), F.col("to").alias("next"))
        nxt = cut(step.join(ahead, ["repo", "to"], "left").select("repo", "path", F.coalesce("next", "to").alias("new"), "label"))
        if not nxt.where("new <> label").head(1):
            return label
        label = nxt.select("repo", "path", F.col("new").alias("label"))
    raise RuntimeError(f"parts did not settle in {MOST_ROUNDS} rounds")


def connected(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities cut into their connected parts, each named by its smallest file."""
    p = placed.select("repo", F.col("path").alias("a"), F.col("comm").alias("ca"))
    q = placed.select("repo", F.col("path").alias("b"), F.col("comm").alias("cb"))
    inside = edges.join(p, ["repo", "a"]).join(q, ["repo", "b"]).where("ca = cb").select("repo", "a", "b")
    return _parts(inside, placed)


def clusters_and_loose(edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, path, cluster_id) of every file, and (repo) of the repositories whose clusters had not settled when the rounds were over.

    Ids go by falling churn, then smallest path, from 0; files without edges have -1.
    """
    placed, loose = _louvain(edges)
    label = connected(placed, edges)
    size = files.select("repo", "path", "churn").join(label, ["repo", "path"]).groupBy("repo", "label").agg(F.sum("churn").alias("churn"), F.min("path").alias("first"))
    ids = size.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("churn"), "first")) - 1).cast("long"))
    found = label.join(ids.select("repo", "label", "cluster_id"), ["repo", "label"]).select("repo", "path", "cluster_id")
    return files.select("repo", "path").join(found, ["repo", "path"], "left").fillna(-1, ["cluster_id"]), loose


def clusters(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, cluster_id) of every file."""
    return clusters_and_loose(edges, files)[0]


def modularity(edges: DataFrame, placed: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Modularity of a partition, by repository."""
    a, b = (placed.select("repo", F.col("path").alias(x), F.col(label).alias(f"c{x}")) for x in "ab")
    rows = edges.join(a, ["repo", "a"]).join(b, ["repo", "b"])
    m = rows.groupBy("repo").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    tot = rows.select("repo", F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("repo", "c").agg(F.sum("weight").alias("tot"))
    square = tot.join(m, "repo").groupBy("repo").agg(F.sum((F.col("tot") / (2 * F.col("m"))) ** 2).alias("expected"))
    return m.join(square, "repo").select("repo", (F.col("inside") / F.col("m") - F.col("expected")).alias("modularity"))


def checks(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """A row for each repository that says whether clusters (repo, path, cluster_id) of a graph keep what they must.

    linked: files with an edge; placed, loose: files with and without a cluster; misplaced:
    files of which only one of both holds; broken: clusters that are not connected; crossing:
    clusters in several components; as_good: whether their modularity reaches that of the
    components.
    """
    ends = edges.select("repo", F.explode(F.array("a", "b")).alias("path")).distinct().withColumn("linked", F.lit(True))
    rows = placed.join(ends, ["repo", "path"], "left").withColumn("in", F.col("cluster_id") >= 0)
    base = rows.groupBy("repo").agg(
        F.count_if("linked").alias("linked"), F.count_if("in").alias("placed"), F.count_if(~F.col("in")).alias("loose"), F.count_if(F.coalesce("linked", F.lit(False)) != F.col("in")).alias("misplaced")
    )
    own = placed.where("cluster_id >= 0")
    whole = cut(_parts(edges.select("repo", "a", "b"), own))
    split = connected(own.select("repo", "path", F.col("cluster_id").cast("string").alias("comm")), edges)
    count = lambda labels, name: own.join(labels, ["repo", "path"]).select("repo", "cluster_id", "label").distinct().groupBy("repo", "cluster_id").agg(F.count("*").alias("n")).groupBy("repo").agg(F.count_if(F.col("n") > 1).alias(name))
    better = modularity(edges, own).join(modularity(edges, whole, "label").withColumnRenamed("modularity", "whole"), "repo").select("repo", (F.col("modularity") >= F.col("whole") - 1e-9).alias("as_good"))
    return base.join(count(split, "broken"), "repo", "left").join(count(whole, "crossing"), "repo", "left").join(better, "repo", "left").fillna(0, ["broken", "crossing"])
