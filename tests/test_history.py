"""Small logs worked out by hand, and invariants of the tables."""

import random

import pytest
from pyspark.sql import functions as F

from codehistory import Params
from codehistory.functions import columns as C
from codehistory.operators import bands, clusters, cochange, communities, effort, explore, facts, identity, portfolio, regions
from codehistory.sources import logs, summaries

LOG = """__C__s1\t2025-03-03T09:15:00+02:00\tMina\tmina@lab.test\tTASK-7 start
12\t4\tcore/parser.rs
6\t0\tcore/lexer.rs
-\t-\timg/icon.ico
8\t8\tdeps.lock
__C__s2\t2025-04-10T18:00:00+02:00\tTor\ttor@lab.test
3\t1\tcore/{scan => lexer}.rs
2\t2\tcore/parser.rs
__C__s3\t2025-04-11T08:00:00+00:00\tMina\tmina@lab.test\tTASK-9 and OPS-2 TASK-11
20\t0\tui/view.ts
__C__s4\t2025-05-01T00:00:00+00:00\tmergebot\tmb@lab.test\tbump
500\t500\tcore/parser.rs
"""


@pytest.fixture(scope="module")
def commits(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "lab~tool.log").write_text(LOG)
    return facts.with_people(facts.clean(logs.parse_numstat(logs.read_records(spark, str(folder))).drop("churn"))).cache()


@pytest.fixture(scope="module")
def sizes(spark):
    lines = spark.createDataFrame([("lab/tool", "core/parser.rs", 80), ("lab/tool", "core/lexer.rs", 60)], "repo string, path string, lines long")
    births = spark.createDataFrame([("lab/tool", "core/lexer.rs", "2025-03-03T09:15:00+02:00")], "repo string, path string, born string")
    return lines, births


@pytest.fixture(scope="module")
def files(spark, commits, sizes):
    members = spark.createDataFrame([("lab/tool", "core/parser.rs", 0), ("lab/tool", "core/lexer.rs", 0)], "repo string, path string, cluster_id long")
    return facts.file_table(commits, *sizes, members).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_log(commits):
    total = commits.agg(F.sum("churn"), F.sum("added"), F.sum("deleted"), F.count_distinct("path")).first()
    assert tuple(total) == (50, 43, 7, 3)
    assert {r.repo for r in commits.collect()} == {"lab/tool"}


def test_log_keeps_what_is_asked(spark, tmp_path):
    (tmp_path / "r.log").write_text(LOG)
    all_rows = logs.parse_numstat(logs.read_records(spark, str(tmp_path)), Params(ignore_authors=()))
    assert all_rows.agg(F.sum("churn")).first()[0] == 50 + 1000 and logs.parse_numstat(logs.read_records(spark, str(tmp_path)), Params(exclude=())).where("path = 'deps.lock'").count() == 1


def test_bots(spark):
    names = ["ROOT", "Release Agent 7", "ci-pipelines", "mergebot", "releng-7", "no-noreply-x", "Robin Root", "Mina Jen", None]
    got = spark.createDataFrame([(n,) for n in names], "a string").select(C.is_bot(F.col("a"), Params().ignore_authors)).collect()
    assert [r[0] for r in got] == [True] * 6 + [False] * 3


@pytest.mark.parametrize(("path", "want"), [("k/{old => new}/z", "k/new/z"), ("one => two", "two"), ("k/{ => in}/z", "k/in/z"), ("k/{in => }/z", "k//z"), ("same", "same")])
def test_renames(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(C.resolve_rename(F.col("p"))).first()[0] == want


@pytest.mark.parametrize(("path", "want"), [("e2e/build.gradle", "build/CI"), ("web/webpacked.js", "build/CI"), ("conf/site.py", "deploy/config"), ("core/spec/lex.rb", "tests"), ("NOTES.rst", "docs"), ("core/lex.rs", C.PRODUCT)])
def test_kinds(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(C.work_kind(F.col("p"))).first()[0] == want


def test_globs(spark):
    got = lambda p, g: spark.createDataFrame([(p,)], "p string").select(C.excluded(F.col("p"), (g,))).first()[0]
    assert got("k/m/n.lock", "*.lock") and not got("n.locks", "*.lock") and got("xz", "[!z]z") and not got("zz", "[!z]z") and got("x+z", "x+?")


@pytest.mark.parametrize(
    ("heading", "want"),
    [("private rowCount(String a) {", "rowCount"), ("export class Lamp extends Base", "Lamp"), ("const ratio = useMemo(() => 1)", "ratio"), ("", C.UNNAMED), ("public Frame openFram", "openFram"), ("###", "###")],
)
def test_region_names(spark, heading, want):
    assert spark.createDataFrame([(heading,)], "h string").select(C.region_symbol(F.col("h"))).first()[0] == want


def test_births_and_lines(spark, tmp_path):
    (tmp_path / "r.log").write_text("__C__2025-09-09\nk.c\nx.lock\n__C__2024-02-02\nk.c\nm.c\n")
    got = by(logs.parse_births(logs.read_records(spark, str(tmp_path))), "path")
    assert {k: v.born for k, v in got.items()} == {"k.c": "2024-02-02", "m.c": "2024-02-02"}
    lines = logs.parse_line_counts(spark.createDataFrame([("r", "HEAD:k:m.c:31"), ("r", "noise")], "repo string, value string")).collect()
    assert [(r.path, r.lines) for r in lines] == [("k:m.c", 31)]


def test_file_table(files):
    got = by(files, "path")
    assert (got["core/parser.rs"].churn, got["core/parser.rs"].rework, got["core/parser.rs"].commits, got["core/parser.rs"].dev_days) == (20, 12, 2, 2)
    assert got["ui/view.ts"].lines is None and got["ui/view.ts"].debt is None and got["ui/view.ts"].cluster_id == -1
    assert by(facts.with_age(files), "path")["core/lexer.rs"].alive == 39


def test_graph(commits):
    assert [tuple(r) for r in cochange.edges(commits).collect()] == [("lab/tool", "core/lexer.rs", "core/parser.rs", 2)]
    assert cochange.edges(commits, Params(max_files=1)).count() == 0


def test_clusters(files, commits):
    edges = cochange.edges(commits)
    found = by(communities.clusters(edges, files), "path")
    assert found["core/parser.rs"].cluster_id == found["core/lexer.rs"].cluster_id == 0 and found["ui/view.ts"].cluster_id == -1
    stats = by(clusters.cluster_stats(files, edges, commits), "cluster_id")
    core = stats[0]
    assert (core.files, core.churn, core.share, core.churn_per_line, core.rework_per_line, core.hotspot, core.in_hotspot, core.cohesion, core.dev_days, core.devs, core.effort) == (2, 30, 0.6, 0.21, 0.1, "core/parser.rs", 0.67, 1.0, 2, 2, 0.667)
    assert stats[-1].cohesion is None
    one = by(clusters.file_stats(files, edges), "path")["core/parser.rs"]
    assert (one.rework_per_line, one.share, one.growth, one.outside, one.partner) == (0.15, 0.667, 0.4, 0.0, "core/lexer.rs  x2")


def test_screen_card(files, commits):
    card = clusters.screen_card(files, commits).first()
    assert (card.repo, card.churn, card.unclustered, card.biggest, card.clusters, card.commits, card.dev_days) == ("lab/tool", 50, 33, "core/parser.rs", 1, 3, 3)


def test_summary(files, commits):
    row = portfolio.summarise(files, clusters.cluster_table(files, commits), commits).first()
    assert (row.total_commits, row.total_churn, row.lines_now, row.density, row.rework, row.rework_density, row.dev_days, row.devs) == (3, 50, 140, 0.21, 14, 0.1, 3, 2)
    assert (row.days_product, row.solo_share, row.top_debt_file, row.top_debt, row.new_files, row.new_rework, row.top_new_file, row.top_new_days) == (3.0, 0.67, "core/parser.rs", 0.24, 1, 2, "core/lexer.rs", 39)


def test_the_whole_job(spark, commits, sizes, files):
    """From facts to the stored row, with clusters of its own: here they are those of the fixture."""
    plain = commits.drop("person")
    row = portfolio.analyze(plain, *sizes).collect()
    assert [r.asDict() for r in row] == [r.asDict() for r in portfolio.summarise(files, clusters.cluster_table(files, commits), commits).collect()]
    stored = summaries.upsert(spark.createDataFrame([("lab/tool", 1), ("other", 2)], "path string, total_churn long"), portfolio.analyze(plain, *sizes).withColumnRenamed("repo", "path"))
    assert {r.path: (r.total_churn, r.num_clusters, r.top_module) for r in stored.collect()} == {"lab/tool": (50, 1, "core"), "other": (2, None, None)}


def test_shares_are_compared_before_they_are_rounded(spark):
    kinds = "days_build double, days_config double, days_tests double, days_docs double, days_product double"
    rows = [("just over", 100, 25.03, 0.0, 10.0, 0.0, 64.97), ("just under", 100, 24.97, 0.0, 0.96, 0.0, 74.07), ("none", 100, 0.0, 0.0, 0.0, 0.0, 0.0), ("more", 100, 25.04, 0.0, 1.04, 0.0, 73.92)]
    table = spark.createDataFrame([(*r, 0.5) for r in rows], f"repo string, dev_days long, {kinds}, solo_share double")
    assert [(r.repo, r.infra) for r in portfolio.infra_heavy(table).collect()] == [("more", 0.25), ("just over", 0.25)]
    assert [(r.repo, r.tests) for r in portfolio.thin_on_tests(table).collect()] == [("just under", 0.01)]
    assert {r.repo: r.infra for r in portfolio.shares(table).collect()} == {"just over": 0.25, "just under": 0.25, "none": None, "more": 0.25}


def test_effort(spark):
    rows = [("r", "Mina", "2025-01-01", p) for p in ("build.gradle", "core/a.rs", "core/b.rs", "core/c.rs", "core/d.rs")] + [("q", "Tor", "2025-01-02", "core/a.rs")]
    base = effort.touched(spark.createDataFrame(rows, "repo string, person string, day string, path string"))
    got = by(effort.repo_effort(base), "repo")
    assert (got["r"].days_build, got["r"].days_product, got["q"].days_product) == (0.2, 0.8, 1.0)
    people = by(effort.people_effort(base), "person")
    assert (people["Mina"].days, people["Mina"].repos, people["Tor"].days_product) == (1, 1, 1.0)


def test_people(spark):
    rows = [
        ("Petra Quill", "pq@a.test"), ("petraquill", "petra@home.test"), ("Sam Odell", "so-99@a.test"), ("so-99", "so-99+work@b.test"),
        ("I Banu", "ilke@a.test"), ("ibanu", "x1@b.test"), ("x1 tester", "x1@c.test"), ("Zoe", "zoe@a.test"),
    ]
    got = {r.author: r.person for r in identity.people(spark.createDataFrame([("r", *x) for x in rows], "repo string, author string, email string"), ()).collect()}
    assert got == {"Petra Quill": "Petra Quill", "petraquill": "Petra Quill", "Sam Odell": "Sam Odell", "so-99": "Sam Odell", "I Banu": "I Banu", "ibanu": "I Banu", "x1 tester": "I Banu", "Zoe": "Zoe"}


HUNKS = """__C__h1\t2025-01-05\tMina\tm@x\ts
diff --git a/box.go b/box.go
--- a/box.go
+++ b/box.go
@@ -3,2 +3,6 @@ func pack(items []int) {
+x
@@ -20 +24 @@ func seal(b Box) {
__C__h2\t2025-02-05\tTor\tt@x\ts
diff --git a/box.go b/box.go
+++ b/box.go
@@ -5,1 +5,4 @@ func pack(items []int, most int) {
@@ -0,0 +1,3 @@
"""


def test_regions(spark, tmp_path):
    (tmp_path / "r.log").write_text(HUNKS)
    hunks = facts.with_people(logs.parse_hunks(logs.read_records(spark, str(tmp_path))), ("repo", "path"))
    assert hunks.count() == 4 and hunks.agg(F.sum("churn")).first()[0] == 8 + 2 + 5 + 3
    pack = by(regions.region_stats(hunks), "region")["pack"]
    assert (pack.churn, pack.edits, pack.commits, pack.share, pack.growth, pack.authors, pack.owner_share, pack.signature) == (13, 2, 2, 0.722, 0.54, 2, 0.5, "func pack(items []int, most int) {")
    pair = regions.region_cochange(hunks).collect()
    assert [(r.region, r.partner, r.together, r.of_the_rarer) for r in pair] == [("pack", "seal", 1, 1.0)]


def test_hunks_of_odd_paths(spark):
    """Deleted and new files, paths in quotes with escaped bytes, and a tab after a path with blanks."""
    patch = "\n".join(
        [
            "h\t2025-01-05\tMina\tm@x\ts",
            "diff --git a/gone.go b/gone.go", "deleted file mode 100644", "--- a/gone.go", "+++ /dev/null", "@@ -1,4 +0,0 @@",
            "diff --git a/fresh.go b/fresh.go", "--- /dev/null", "+++ b/fresh.go", "@@ -0,0 +1,2 @@", "+++ b/no path",
            r'diff --git "a/na\303\257ve \"x\"\\\t.go" "b/na\303\257ve \"x\"\\\t.go"', r'--- "a/na\303\257ve \"x\"\\\t.go"', r'+++ "b/na\303\257ve \"x\"\\\t.go"', "@@ -1 +1 @@",
            r'diff --git "a/\344\270\255.go" "b/\344\270\255.go"', r'--- "a/\344\270\255.go"', "+++ /dev/null", "@@ -1,3 +0,0 @@",
            "diff --git a/two words b/two words", "--- a/two words\t", "+++ b/two words\t", "@@ -1,2 +1 @@",
        ]
    )
    got = logs.parse_hunks(spark.createDataFrame([("r", patch)], "repo string, value string")).collect()
    assert [(r.path, r.removed, r.added) for r in got] == [("gone.go", 4, 0), ("fresh.go", 0, 2), ('naïve "x"\\\t.go', 1, 1), ("中.go", 3, 0), ("two words", 2, 1)]


def test_tickets(commits):
    got = by(regions.ticket_projects(commits.where("path = 'ui/view.ts'")), "project")
    assert {k: v.subjects for k, v in got.items()} == {"TASK": 1, "OPS": 1}


def test_bands(spark):
    lines = spark.createDataFrame([("r", "f", 80)], "repo string, path string, lines long")
    touches = spark.createDataFrame([("r", "f", 5, 30, "a", "2025-01-01"), ("r", "f", 28, 45, "b", "2025-02-01"), ("r", "f", 45, 70, "c", "2025-03-01")], "repo string, path string, start long, end long, sha string, date string")
    found = bands.touched(bands.grid(lines, bands=4), touches)
    assert [(r.start, r.end, r.commits) for r in found.orderBy("start").collect()] == [(1, 20, 1), (21, 40, 2), (41, 60, 2), (61, 80, 1)]
    whole = bands.touched(bands.grid(lines, bands=1), touches)
    finer = bands.refine(whole, touches, into=4).orderBy("start").collect()
    assert [(r.start, r.end, r.commits) for r in finer] == [(1, 20, 1), (21, 40, 2), (41, 60, 2), (61, 80, 1)]
    merged = bands.merge(found, into=2).orderBy("start").collect()
    assert [(r.start, r.end, r.commits) for r in merged] == [(1, 40, 3), (41, 80, 3)]
    assert bands.heat(found, lines).count() == 80 and bands.quiet(found).first().lines == 0
    assert bands.grid(spark.createDataFrame([("r", "f", 1)], "repo string, path string, lines long")).count() == 0


def test_summaries(spark):
    old = spark.createDataFrame([("m", "1"), ("n", "x")], "path string, total_churn string")
    new = spark.createDataFrame([("n", 7)], "path string, total_churn long")
    merged = summaries.upsert(old, new)
    assert {r.path: r.total_churn for r in merged.collect()} == {"m": 1, "n": 7}
    asked = spark.createDataFrame([(0, "n"), (1, "u/v/w"), (2, "m")], "position int, path string")
    loaded = summaries.load(merged, asked).collect()
    assert [(r.path, r.name, r.total_churn) for r in loaded] == [("n", "n", 7), ("u/v/w", "v/w", None), ("m", "m", 1)]


def test_pages(spark):
    """Rows without a value come last either way; equal values go by repository and path."""
    rows = spark.createDataFrame([("r", "a", 2.0), ("r", "b", None), ("r", "c", 5.0), ("q", "d", 2.0)], "repo string, path string, debt double")
    pages = lambda down: [r.path for n in range(3) for r in explore.page(rows, "debt", down, n, 2).collect()]
    assert pages(True) == ["c", "d", "a", "b"] and pages(False) == ["d", "a", "c", "b"]


def graph(spark, rows, more=()):
    edges = spark.createDataFrame(rows, "repo string, a string, b string, weight long")
    paths = sorted({(r[0], p) for r in rows for p in r[1:3]}) + list(more)
    return edges, spark.createDataFrame([(r, p, 10) for r, p in paths], "repo string, path string, churn long")


def test_communities_on_planted_topics(spark):
    """Three dense topics with weak links between: the parts are found, each connected, with no less modularity than whole components."""
    rows = []
    for t in range(3):
        names = [f"t{t}/f{i}" for i in range(6)]
        rows += [("r", a, b, 5) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows += [("r", "t0/f0", "t1/f0", 1), ("r", "t1/f1", "t2/f1", 1), ("s", "x", "y", 2)]
    edges, files = graph(spark, rows, [("s", "lonely"), ("u", "alone")])
    found = communities.clusters(edges, files).cache()
    got = by(found, "repo", "path")
    assert got["s", "lonely"].cluster_id == -1 and got["s", "x"].cluster_id == got["s", "y"].cluster_id == 0
    assert len({got["r", f"t{t}/f{i}"].cluster_id for t in range(3) for i in range(6)}) == 3
    assert all(len({got["r", f"t{t}/f{i}"].cluster_id for i in range(6)}) == 1 for t in range(3))
    assert by(communities.modularity(edges, found), "repo")["r"].modularity > 0.5
    checks = by(communities.checks(edges, found), "repo")
    assert tuple(checks["r"])[1:] == (18, 18, 0, 0, 0, 0, True) and tuple(checks["s"])[1:] == (2, 2, 1, 0, 0, 0, True) and tuple(checks["u"])[1:] == (0, 0, 1, 0, 0, 0, None)
    # a cluster torn apart, one over two components, and a linked file without one are seen
    wrong = found.withColumn("cluster_id", F.when(F.col("path") == "y", -1).when(F.col("repo") == "r", 0).otherwise(F.col("cluster_id")))
    assert by(communities.checks(edges, wrong), "repo")["s"].misplaced == 1
    torn = found.withColumn("cluster_id", F.when(F.col("path").isin("t0/f1", "t2/f2"), 9).otherwise(F.col("cluster_id")))
    assert by(communities.checks(edges, torn), "repo")["r"].broken == 1
    two = communities.checks(*[graph(spark, [("r", "a", "b", 1), ("r", "c", "d", 1)])[0], spark.createDataFrame([("r", p, 0) for p in "abcd"], "repo string, path string, cluster_id long")])
    assert (two.first().broken, two.first().crossing, two.first().as_good) == (1, 1, False)


def sequential(edges):
    """Louvain node by node, in plain Python: the modularity it reaches."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    m2 = sum(sum(x.values()) for x in near.values())
    group = {v: v for v in near}
    while True:
        k = {v: sum(x.values()) for v, x in near.items()}
        comm, total, moved = {v: v for v in near}, dict(k), False
        while True:
            moves = 0
            for v in sorted(near):
                total[comm[v]] -= k[v]
                w = {}
                for u, x in near[v].items():
                    if u != v:
                        w[comm[u]] = w.get(comm[u], 0) + x
                w.setdefault(comm[v], 0)
                best = max(sorted(w), key=lambda c: w[c] - k[v] * total[c] / m2)
                if w[best] - k[v] * total[best] / m2 <= w[comm[v]] - k[v] * total[comm[v]] / m2 + 1e-12:
                    best = comm[v]
                moves += best != comm[v]
                comm[v] = best
                total[best] += k[v]
            if not moves:
                break
            moved = True
        if not moved:
            inside = sum(x for v, n in near.items() for u, x in n.items() if u == v)
            return inside / m2 - sum((x / m2) ** 2 for x in k.values()), group
        group = {v: comm[c] for v, c in group.items()}
        joined = {}
        for v, n in near.items():
            for u, x in n.items():
                joined.setdefault(comm[v], {})[comm[u]] = joined.setdefault(comm[v], {}).get(comm[u], 0) + x
        near = joined


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_against_sequential_moves(spark, seed):
    """Random graphs with soft groups: modularity within 5 percent of moves one by one; the same input gives the same output."""
    rng = random.Random(seed)
    weights = {}
    for _ in range(900):
        a = rng.randrange(90)
        b = rng.choice([x for x in range(90) if x % 7 == a % 7 or rng.random() < 0.12])
        if a != b:
            pair = (f"f{min(a, b):02}", f"f{max(a, b):02}")
            weights[pair] = weights.get(pair, 0) + rng.randrange(1, 4)
    rows = [("r", a, b, w) for (a, b), w in sorted(weights.items())]
    edges, files = graph(spark, rows)
    found = communities.clusters(edges, files).cache()
    own = communities.modularity(edges, found).first().modularity
    assert own >= 0.95 * sequential([r[1:] for r in rows])[0]
    again = communities.clusters(edges.repartition(3, "b"), files.repartition(2))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in found.collect()}
    assert communities.checks(edges, found).where("misplaced + broken + crossing > 0 or not as_good").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "repo string, sha string, date string, author string, email string, subject string, path string, added long, deleted long")
    commits = facts.with_people(facts.clean(none))
    files = facts.file_table(commits)
    assert files.count() == 0 and cochange.edges(commits).count() == 0 and effort.repo_effort(effort.touched(commits)).count() == 0
    assert portfolio.summarise(files, clusters.cluster_table(files, commits), commits).count() == 0
    sizes = [spark.createDataFrame([], f"repo string, path string, {c}") for c in ("lines long", "born string")]
    assert portfolio.analyze(facts.clean(none), *sizes).count() == 0
