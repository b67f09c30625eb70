"""Every operator as a query over the given tables, with the SQL it is checked against.

A query reads the tables of a folder as commit facts (sources.adapters). Where clusters are
needed, a fixed membership stands for them, so that the tables of clusters can be checked
row by row; the clusters themselves have their own query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bands, clusters, cochange, communities, effort, explore, facts, identity, job, lifting, portfolio, regions
from ..operators.lineage import cut, drop, folder, writing
from ..params import Params
from ..sources import adapters as A
from ..sources import logs, summaries
from ..sources.store import Store


class Tables:
    """The frames that queries start from, for one folder of tables.

    Facts, files and edges are read many times, so they are made once and kept in the
    shared folder; that also keeps the plans above them small.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return cut(A.raw_commits(self.spark, self.dir))

    @cached_property
    def kept(self) -> DataFrame:
        # written, so that names and paths meet their patterns once
        return cut(facts.clean(self.raw))

    @cached_property
    def commits(self) -> DataFrame:
        return facts.with_people(self.kept)

    @cached_property
    def org(self) -> DataFrame:
        """Commits with identities merged over all repositories."""
        return facts.with_people(self.kept, ())

    @cached_property
    def seen(self) -> DataFrame:
        """(repo, path, date): every file of raw with its first date, all that sizes, births and membership ask of raw."""
        return cut(self.raw.groupBy("repo", "path").agg(F.min("date").alias("date")))

    @cached_property
    def lines(self) -> DataFrame:
        return A.line_counts(self.seen)

    @cached_property
    def births(self) -> DataFrame:
        return A.births(self.seen)

    @cached_property
    def members(self) -> DataFrame:
        return A.membership(self.seen)

    @cached_property
    def files(self) -> DataFrame:
        return cut(facts.file_table(self.commits, self.lines, self.births, self.members))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(cochange.edges(self.kept))

    @cached_property
    def clusters(self) -> DataFrame:
        return clusters.cluster_table(self.files, self.commits)

    @cached_property
    def summary(self) -> DataFrame:
        return portfolio.summarise(self.files, self.clusters, self.commits)

    @cached_property
    def hunks(self) -> DataFrame:
        h = A.raw_hunks(self.spark, self.dir)
        h = h.where(~C.is_bot(F.col("author"), Params().ignore_authors)).withColumn("churn", F.col("added") + F.col("removed"))
        return facts.with_people(cut(h), ("repo", "path"))

    @cached_property
    def sizes(self) -> DataFrame:
        """The same as lines, for queries that need no facts of commits."""
        return cut(A.line_counts(cut(A.seen_paths(self.spark, self.dir))))

    @cached_property
    def touches(self) -> DataFrame:
        t = A.raw_touches(self.spark, self.dir).join(self.sizes, ["repo", "path"])
        return t.select("repo", "path", "start", F.least("end", "lines").alias("end"), "sha", "date").where("start <= end")

    @cached_property
    def bands(self) -> DataFrame:
        return bands.touched(bands.grid(self.sizes, least=50), self.touches)

    @cached_property
    def base(self) -> DataFrame:
        return effort.touched(self.org)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return make

    return add


# --- SQL that many checks share -------------------------------------------------------

_KIND = "case " + " ".join(f"when regexp_matches(path, '{p}', 'i') then '{k}'" for k, p in C.WORK_KINDS) + f" else '{C.PRODUCT}' end"
_DAYS = {"build/CI": "days_build", "deploy/config": "days_config", "tests": "days_tests", "docs": "days_docs", C.PRODUCT: "days_product"}


def _r(x: str, digits: int = 2) -> str:
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


def _ratio(a: str, b: str, digits: int = 2) -> str:
    return _r(f"cast({a} as double) / nullif({b}, 0)", digits)


def _people(name: str, source: str, scope: tuple[str, ...]) -> str:
    """Tables that name a person for each author of a source, in a scope."""
    s = "".join(f"{k}, " for k in scope)
    on = lambda a, b: "".join(f"{a}.{k} = {b}.{k} and " for k in scope)
    of = lambda a: "".join(f"{a}.{k}, " for k in scope)
    return f"""{name}_ids as materialized (select distinct {s}author, regexp_replace(lower(author), '[^a-z]', '', 'g') as nk, regexp_replace(split_part(split_part(lower(email), '@', 1), '+', 1), '[^a-z0-9]', '', 'g') as mk from {source}),
{name}_near as materialized (select distinct {of('a')}a.nk, b.nk as other from {name}_ids a join {name}_ids b on {on('a', 'b')}a.mk = b.mk),
{name}_reach as (select distinct {s}nk, nk as other from {name}_ids union select {of('r')}r.nk, n.other from {name}_reach r join {name}_near n on {on('r', 'n')}r.other = n.nk),
{name}_label as (select {s}nk, min(other) as label from {name}_reach group by {s}nk),
{name}_ranked as (select {of('i')}i.author, l.label, first_value(i.author) over (partition by {of('i')}l.label order by (i.author like '% %') desc, (i.author <> lower(i.author)) desc, length(i.author) desc, i.author desc) as person
  from (select distinct {s}author, nk from {name}_ids) i join {name}_label l on {on('i', 'l')}i.nk = l.nk)"""


_RAW = f"with recursive raw as materialized ({A.COMMIT_SQL}),\nkept as materialized (select *, added + deleted as churn, 2 * least(added, deleted) as rework, substr(date, 1, 10) as day, substr(date, 1, 7) as month, {_KIND} as kind from raw where lower(author) not like '%bot%' and path not like '%.lock')"
_COMMITS = f"{_RAW},\n{_people('own', 'kept', ('repo',))},\nc as materialized (select k.*, p.person from kept k join own_ranked p on p.repo = k.repo and p.author = k.author)"
_ORG = f"{_RAW},\n{_people('org', 'kept', ())},\nc as materialized (select k.*, p.person from kept k join org_ranked p on p.author = k.author),\nb as materialized (select distinct person, day, repo, path, kind from c)"
_FILES = f"""{_COMMITS},
lines as ({A.LINES_SQL}), births as ({A.BIRTHS_SQL}), members as ({A.MEMBERS_SQL}),
files as materialized (select f.*, l.lines, b.born, coalesce(m.cluster_id, -1) as cluster_id, split_part(f.path, '/', 1) as module, {_KIND.replace('path', 'f.path')} as kind,
  {_ratio('f.churn', 'l.lines', 1)} as density, {_r('cast(f.rework as double) / nullif(l.lines, 0) * log2(1 + f.commits)')} as debt, {_ratio('f.rework', 'l.lines')} as rework_per_line, {_ratio('f.churn', 'f.commits', 1)} as per_commit, {_ratio('f.added - f.deleted', 'f.churn')} as growth
  from (select repo, path, cast(sum(churn) as bigint) as churn, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted, cast(sum(rework) as bigint) as rework, count(distinct sha) as commits, max(month) as last_month, max(date) as last_date,
    count(distinct (person, day)) as dev_days, count(distinct person) as devs from c group by repo, path) f
  left join lines l on l.repo = f.repo and l.path = f.path left join births b on b.repo = f.repo and b.path = f.path left join members m on m.repo = f.repo and m.path = f.path)"""
_EDGE = "{n}sets as (select repo, sha, list(distinct path) as items from kept group by repo, sha having count(distinct path) between 2 and {cap}), {n}edges as materialized (select repo, a, b, count(*) as weight from (select x.repo, x.sha, x.p as a, y.p as b from (select repo, sha, unnest(items) as p from {n}sets) x join (select repo, sha, unnest(items) as p from {n}sets) y on x.repo = y.repo and x.sha = y.sha and x.p < y.p) group by repo, a, b)"
_EDGES = _EDGE.format(n="", cap=30)
_BOTH = "both_ways as (select repo, a, b, weight from edges union all select repo, b, a, weight from edges)"
_SPLIT = lambda keys, within, source="b": f"select {keys}, " + ", ".join(f"{_r(f'coalesce(sum(case when kind = {chr(39)}{k}{chr(39)} then share end), 0)', 9)} as {c}" for k, c in _DAYS.items()) + f" from (select *, cast(n as double) / sum(n) over (partition by {within}) as share from (select {keys}, {within}, kind, count(*) as n from {source} group by all) q) q group by {keys}"


# --- sources ---------------------------------------------------------------------------


def _printed(t: Tables) -> DataFrame:
    """The commits of the tables as log records."""
    return A.raw_records(t.spark, t.dir)


@query("s1_commit_log", f"{_RAW} select repo, sha, date, author, email, subject, path, added, deleted, churn from kept")
def _(t: Tables) -> DataFrame:
    """Log text of all repositories to commit facts."""
    return logs.parse_numstat(_printed(t))


@query("s2_births", f"with raw as ({A.COMMIT_SQL}) select repo, path, min(date) as born from raw where path <> 'poetry.lock' group by repo, path")
def _(t: Tables) -> DataFrame:
    """Births log, newest first; the last entry of a path in log order wins."""
    order = F.struct(F.translate("date", "0123456789", "9876543210").alias("row"))
    return logs.parse_births(t.raw.groupBy("repo", "date").agg(F.concat_ws("\n", F.collect_set("path")).alias("body")).select("repo", order.alias("position"), F.concat("date", F.lit("\n"), "body").alias("value")))


@query("s3_line_counts", f"with raw as ({A.COMMIT_SQL}) {A.LINES_SQL}")
def _(t: Tables) -> DataFrame:
    """S3: HEAD:path:count lines."""
    return logs.parse_line_counts(t.lines.select("repo", F.concat(F.lit("HEAD:"), "path", F.lit(":"), F.col("lines").cast("string")).alias("value")))


@query("s4_hunk_log", f"select repo, path, sha, date, author, hunk_no, trim(region) as region, added, removed, added + removed as churn from ({A.HUNK_SQL}) h where lower(author) not like '%bot%'")
def _(t: Tables) -> DataFrame:
    """Patch text to one row for each hunk, with deleted files and quoted paths."""
    h = A.raw_hunks(t.spark, t.dir)
    head = F.concat_ws("\t", "sha", "date", "author", "email", "subject")
    # every third hunk is printed as one of a deleted file, every third with quoted paths
    kind = F.pmod("hunk_no", F.lit(3))
    side = lambda x: F.when(kind == 1, F.concat(F.lit(f'"{x}/'), F.regexp_replace("path", "e", r"\\145"), F.lit('"'))).otherwise(F.concat(F.lit(f"{x}/"), "path"))
    value = F.format_string("%s\ndiff --git %s %s\n--- %s\n+++ %s\n@@ -%d,%d +%d,%d @@ %s", head, side("a"), side("b"), side("a"), F.when(kind == 2, "/dev/null").otherwise(side("b")), F.lit(1), "removed", F.lit(1), "added", "region")
    found = logs.parse_hunks(h.select(F.concat_ws("|", "repo", F.col("hunk_no").cast("string")).alias("repo"), value.alias("value")))
    return found.select(F.split("repo", "[|]")[0].alias("repo"), "path", "sha", "date", "author", F.split("repo", "[|]")[1].cast("long").alias("hunk_no"), "region", "added", "removed", "churn")


# one hunk of each commit to a file: taken out and put in by the tables' numbers, at a line that some file has
_PATCH = f"select repo, path, sha, date, min(1 + hash_ % 97) as old, cast(sum(deleted) % 4 as bigint) as removed, cast(sum(added) % 7 as bigint) as added from (select *, cast(substr(sha, 2) as bigint) * 31 as hash_ from ({A.COMMIT_SQL}) h) x group by repo, path, sha, date"
_PATCH_BY = _PATCH.replace("sha, date,", "sha, date, min(author) as author,", 1)


def _patches(t: Tables, numbers: DataFrame | None = None) -> DataFrame:
    """A patch log of the tables, or of some of their patches: the commits of a file in the order of their dates, newest first, each with one hunk."""
    c = A.printed(A.patch_numbers(t.spark, t.dir) if numbers is None else numbers).select("repo", "path", "sha", "date", "author", (1 + (F.substring("sha", 2, 20).cast("long") * 31) % 97).alias("old"), (F.col("deleted") % 4).alias("removed"), (F.col("added") % 7).alias("added")).where("added + removed > 0")
    side = lambda n: F.concat((F.col("old") - F.when(F.col(n) == 0, 1).otherwise(0)).cast("string"), F.lit(","), F.col(n).cast("string"))
    line = F.concat(F.lit("@@ -"), side("removed"), F.lit(" +"), side("added"), F.lit(" @@"))
    value = F.concat_ws("\n", F.concat_ws("\t", "sha", "date", "author", F.lit("x@y"), F.lit("s")), F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"), F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), line)
    # newest first, as a log has it: the greater the date, the smaller the position
    return c.select("repo", F.struct(F.translate(F.concat("date", "sha"), "0123456789", "9876543210").alias("row")).alias("position"), value.alias("value"))


#: Blocks in which written logs are read: small ones, so that commits lie across them, and no more of them than MOST_BLOCKS.
LEAST_BLOCK, MOST_BLOCKS = 1 << 16, 512


def _block_size(records: DataFrame, path: str) -> int:
    """Bytes of a block of the logs in a folder, by what its files hold in all."""
    folder_ = records.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = folder_.getFileSystem(records.sparkSession._jsc.hadoopConfiguration()).getContentSummary(folder_).getLength()
    return max(LEAST_BLOCK, -(-size // MOST_BLOCKS))


def _by_blocks(t: Tables, records: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What is read of log records, once they are written as files, a folder for each repository, in blocks of at least 64 kB, so that commits lie across blocks."""
    path = f"{folder(t.spark)}/logs-{uuid.uuid4().hex}"
    # a large repository is written by several tasks
    records.select("repo", F.concat(F.lit(logs.MARK), "value").alias("value")).hint("rebalance", "repo").write.partitionBy("repo").text(path)
    key, usual = "spark.sql.files.maxPartitionBytes", t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    t.spark.conf.set(key, str(_block_size(records, path)))
    try:
        return cut(read(t.spark, path))
    finally:
        t.spark.conf.set(key, usual)


#: Patches that are written as logs at once.
ROUND = 20_000_000


def _hunks_in_rounds(t: Tables) -> DataFrame:
    """Hunks of the patches of the tables, once they are written as logs, a folder for each repository, and read by blocks.

    Of large tables some logs at a time are written and read, as the text of all of them would take many times the place of the
    tables. Rounds are of whole orders. Logs are dealt out to tasks as numbers, before they are text, so that a large repository
    is written by several.
    """
    numbers = cut(A.patch_numbers(t.spark, t.dir))
    rounds, done = max(1, -(-numbers.count() // ROUND)), []
    key, usual = "spark.sql.files.maxPartitionBytes", t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i in range(rounds):
        path = f"{folder(t.spark)}/logs-{uuid.uuid4().hex}"
        own = numbers.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(rounds)) == i).hint("rebalance", "n_name")
        with writing(t.spark):
            _patches(t, own).select("repo", F.concat(F.lit(logs.MARK), "value").alias("value")).write.partitionBy("repo").text(path)
        t.spark.conf.set(key, str(_block_size(numbers, path)))
        try:
            done.append(logs.hunks_of_files(t.spark, path))
        finally:
            t.spark.conf.set(key, usual)
        drop(t.spark, path)
    return reduce(DataFrame.unionByName, done)


def _as_lines(t: Tables, records: DataFrame) -> DataFrame:
    """The lines of log records that are written and read in blocks."""
    return _by_blocks(t, records, logs.read_lines)


@query("s1_from_lines", f"{_RAW} select repo, sha, date, author, email, subject, path, added, deleted, churn from kept")
def _(t: Tables) -> DataFrame:
    """S1 by lines: commits that lie across the blocks of a file, with the same facts."""
    return _by_blocks(t, _printed(t), logs.numstat_of_files).select("repo", "sha", "date", "author", "email", "subject", "path", "added", "deleted", "churn")


@query("s4_from_lines", f"select repo, path, sha, date, author, removed, added from ({_PATCH_BY}) q where added + removed > 0 and lower(author) not like '%bot%'")
def _(t: Tables) -> DataFrame:
    """S4 by lines: patches that lie across the blocks of a file, with the same hunks."""
    return _hunks_in_rounds(t).select("repo", "path", "sha", "date", "author", "removed", "added")


@query("s5_range_touches", f"select repo, path, start_ as start, sha, date from ({A.TOUCH_SQL}) t")
def _(t: Tables) -> DataFrame:
    """Range log records to touches."""
    raw = A.raw_touches(t.spark, t.dir)
    return logs.parse_touches(raw.select("repo", "path", "start", "end", F.concat_ws("\t", "sha", "date").alias("value"))).drop("end")


def _stored(t: Tables) -> DataFrame:
    """Older summaries, of half of the repositories and without the columns of today."""
    old = t.kept.groupBy("repo").agg(F.sum("churn").alias("total_churn"), F.count_distinct("sha").alias("total_commits"))
    return old.where("repo like '%1%'").select(F.col("repo").alias("path"), F.lit("old").alias("name"), (F.col("total_churn") - 1).cast("string").alias("total_churn"), "total_commits", F.lit(6).alias("since_months"))


def _new(t: Tables) -> DataFrame:
    new = t.kept.groupBy("repo").agg(F.sum("churn").alias("total_churn"), F.count_distinct("path").alias("num_files"))
    return new.where("repo like '%2%'").select(F.col("repo").alias("path"), F.lit("new").alias("name"), "total_churn", "num_files", F.lit(12).alias("since_months"))


_STORE = f"""{_RAW}, old as (select repo as path, 'old' as name, cast(sum(churn) as bigint) - 1 as total_churn, count(distinct sha) as total_commits, cast(null as bigint) as num_files, cast(6 as bigint) as since_months from kept where repo like '%1%' group by repo),
new as (select repo as path, 'new' as name, cast(sum(churn) as bigint) as total_churn, cast(null as bigint) as total_commits, count(distinct path) as num_files, cast(12 as bigint) as since_months from kept where repo like '%2%' group by repo),
merged as (select * from new union all select * from old where path not in (select path from new))"""
_BRIEF = ("path", "name", "total_churn", "total_commits", "num_files", "since_months")


@query("s6_upsert_summaries", f"{_STORE} select * from merged")
def _(t: Tables) -> DataFrame:
    """Rows of the same path are replaced; columns that older rows lack are null."""
    return summaries.upsert(_stored(t), _new(t)).select(*_BRIEF)


def _requested(t: Tables) -> DataFrame:
    known = t.kept.select(F.col("repo").alias("path")).distinct()
    paths = known.unionByName(known.limit(1).select(F.lit("/srv/git/never/seen").alias("path")))
    return paths.select(F.length("path").cast("long").alias("position"), "path")


@query("s7_load_summaries", f"{_STORE}, asked as (select distinct repo as path from kept union all select '/srv/git/never/seen') select cast(length(a.path) as bigint) as position, a.path, coalesce(m.name, case when a.path like '/srv%' then 'never/seen' else a.path end) as name, m.total_churn, m.since_months from asked a left join merged m on m.path = a.path")
def _(t: Tables) -> DataFrame:
    """A row for each requested path, in order, names from the path where none is stored."""
    return summaries.load(summaries.upsert(_stored(t), _new(t)), _requested(t)).select("position", "path", "name", "total_churn", "since_months")


@query("s9_errors_stay", f"{_STORE}, asked as (select distinct repo as path from kept union all select '/srv/git/never/seen') select a.path, m.total_churn, case when length(a.path) % 13 = 0 then 'git failed' when m.total_churn is null then 'no commits in window' end as error from asked a left join merged m on m.path = a.path")
def _(t: Tables) -> DataFrame:
    """Failing and empty repositories keep a row that says why."""
    asked = _requested(t)
    status = asked.where("length(path) % 13 = 0").select("path", F.lit("git failed").alias("failure"))
    return summaries.with_errors(asked, status, summaries.upsert(_stored(t), _new(t))).select("path", "total_churn", "error")


@query("p19_stale_summaries", f"{_STORE} select path, since_months from merged where since_months <> 12")
def _(t: Tables) -> DataFrame:
    """Summaries of another window."""
    return summaries.stale(summaries.upsert(_stored(t), _new(t)), 12).select("path", "since_months")


# --- columns ---------------------------------------------------------------------------


@query("p5_window", f"{_RAW} select repo, sha, path, date from kept where cast(date as timestamptz) >= timestamptz '1997-02-01 00:00:00+00'")
def _(t: Tables) -> DataFrame:
    """P5: the last 18 months before a moment, by instant."""
    return logs.in_window(t.kept, "1998-08-01T00:00:00+00:00", 18).select("repo", "sha", "path", "date")


@query(
    "p6_row_columns",
    f"{_RAW} select repo, sha, path, split_part(path, '/', 1) as module, kind, churn, rework, day, month from kept",
)
def _(t: Tables) -> DataFrame:
    """Module, kind of work, churn, rework, day and month of each row."""
    return t.kept.select("repo", "sha", "path", C.module(F.col("path")).alias("module"), C.work_kind(F.col("path")).alias("kind"), "churn", C.rework(F.col("added"), F.col("deleted")).alias("rework"), "day", "month")


@query(
    "p3_renames",
    f"{_RAW} select distinct repo, path, split_part(path, '/', 1) || '/new' || substr(path, length(split_part(path, '/', 1)) + 1) as braced, path || '.new' as full_ from kept",
)
def _(t: Tables) -> DataFrame:
    """Rename notation, with braces and without."""
    p = F.col("path")
    rest = F.expr("substr(path, length(split_part(path, '/', 1)) + 1)")
    braced = F.concat(C.module(p), F.lit("/{old => new}"), rest)
    return t.kept.select("repo", "path").distinct().select("repo", "path", C.resolve_rename(braced).alias("braced"), C.resolve_rename(F.concat(p, F.lit(" => "), p, F.lit(".new"))).alias("full_"))


@query("p11_region_symbols", f"select distinct region, case when region = '' then '(unnamed region)' when region like 'def %' then regexp_extract(region, 'def ([a-z_0-9]+)', 1) when region like 'const %' then regexp_extract(region, 'const ([a-z_0-9]+)', 1) when region like '%class %' then regexp_extract(region, 'class ([A-Z_0-9]+)', 1) when region like '%(%' then regexp_extract(region, '([a-z_0-9]+)[(]', 1) else region end as symbol from ({A.HUNK_SQL}) h")
def _(t: Tables) -> DataFrame:
    """Short names of headings."""
    return A.raw_hunks(t.spark, t.dir).select("region").distinct().select("region", C.region_symbol(F.col("region")).alias("symbol"))


@query("p12_ticket_keys", f"{_RAW} select sha, repo, k as project from (select distinct sha, repo, unnest(regexp_extract_all(subject, '([A-Z][A-Z0-9]+)-[0-9]+', 1)) as k from kept) x")
def _(t: Tables) -> DataFrame:
    """Tracker projects of each subject."""
    return t.kept.select("sha", "repo", "subject").distinct().select("sha", "repo", F.explode(C.tickets(F.col("subject"))).alias("project"))


# --- files -----------------------------------------------------------------------------

_FILE_COLUMNS = ("repo", "path", "churn", "added", "deleted", "rework", "commits", "last_month", "dev_days", "devs", "lines", "born", "cluster_id", "module", "kind", "density", "debt", "rework_per_line", "per_commit", "growth")


@query("most_rewritten_live_files", f"{_FILES} select repo, path, rework, lines, commits, debt from (select *, row_number() over (partition by repo order by debt desc, path) as r from files where lines >= 50 and debt is not null) x where r <= 5")
def flagship(t: Tables) -> DataFrame:
    """The live files with most debt in each repository."""
    return facts.top_files(t.files, "debt", 5, 50).select("repo", "path", "rework", "lines", "commits", "debt")


@query("a1_file_table", f"{_FILES} select {', '.join(_FILE_COLUMNS)} from files")
def _(t: Tables) -> DataFrame:
    """All facts of each file."""
    return t.files.select(*_FILE_COLUMNS)


@query("p16_days_alive", f"{_FILES} select repo, path, born, cast(floor((epoch(cast(max(last_date_) over (partition by repo) as timestamptz)) - epoch(cast(born as timestamptz))) / 86400) as bigint) as alive from (select *, strftime(cast(last_date as timestamptz) at time zone 'UTC', '%Y-%m-%d %H:%M:%S+00') as last_date_ from files) x")
def _(t: Tables) -> DataFrame:
    """Days from birth to the repository's last commit."""
    return facts.with_age(t.files).select("repo", "path", "born", "alive")


@query("a5_person_days", f"{_FILES} select repo, cluster_id, count(distinct (person, day)) as dev_days from c join (select repo, path, cluster_id from files) f using (repo, path) group by repo, cluster_id")
def _(t: Tables) -> DataFrame:
    """Distinct person-days of each cluster."""
    return facts.person_days(t.commits.join(t.members, ["repo", "path"]), ("repo", "cluster_id"))


@query("a17_monthly_lines", f"{_RAW} select repo, path, month, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted from kept group by repo, path, month")
def _(t: Tables) -> DataFrame:
    """Lines by month of each file."""
    return facts.monthly(t.kept)


@query("a27_gone_files", f"{_FILES} select repo, cluster_id, sum(cast(lines is null as int)) as gone, count(*) as files, {_ratio('sum(cast(lines is null as int))', 'count(*)')} as share from files group by repo, cluster_id")
def _(t: Tables) -> DataFrame:
    """Files gone, by cluster."""
    return facts.gone(t.files, ("repo", "cluster_id"))


@query("t9_file_history", f"{_COMMITS} select substr(sha, 1, 8) as sha8, day, person, subject, added, deleted from c where repo = 'org/nation_1' and path = 'mod1/docs/f1.py'")
def _(t: Tables) -> DataFrame:
    """The commits of one file, newest first."""
    return facts.history(t.commits, "org/nation_1", "mod1/docs/f1.py").drop("date")


@query("t10_by_churn", f"{_FILES} select repo, path, churn from (select *, row_number() over (partition by repo order by churn desc, path) as r from files where lines >= 0) x where r <= 5")
def _(t: Tables) -> DataFrame:
    """Live files by churn."""
    return facts.top_files(t.files, "churn", 5).select("repo", "path", "churn")


@query("t10_most_churned_files", f"{_FILES} select repo, path, density from (select *, row_number() over (partition by repo order by density desc, path) as r from files where lines >= 100 and density is not null) x where r <= 5")
def _(t: Tables) -> DataFrame:
    """Live files of 100 lines and more by density."""
    return facts.top_files(t.files, "density", 5, 100).select("repo", "path", "density")


# --- graph -----------------------------------------------------------------------------


@query("g1_cochange_edges", f"{_RAW}, {_EDGES} select repo, a, b, weight from edges")
def _(t: Tables) -> DataFrame:
    """Pairs of files in one commit."""
    return t.edges


@query("g1_cochange_edges_cap5", f"{_RAW}, {_EDGE.format(n='', cap=5)} select repo, a, b, weight from edges")
def _(t: Tables) -> DataFrame:
    """G1: commits of more than five files couple nothing."""
    return cochange.edges(t.kept, Params(max_files=5))


_MONTHLY = _EDGE.format(n="", cap=500).replace("repo, sha", "repo, month").replace("x.sha", "x.month").replace("y.sha", "y.month")


@query("g1_monthly_cap500", f"{_RAW}, {_MONTHLY} select repo, a, b, weight from edges")
def _(t: Tables) -> DataFrame:
    """Pairs of files in one month, units of up to 500 files."""
    return cochange.coupled(t.kept, "month", 500)


@query("g2_edges_both_ways", f"{_RAW}, {_EDGES}, {_BOTH} select repo, a, b, weight from both_ways")
def _(t: Tables) -> DataFrame:
    """Each edge from both ends."""
    return cochange.both_ways(t.edges)


@query("g3_clusters")
def _(t: Tables) -> DataFrame:
    """Clusters of the graph by modularity; invariants are tested, labels mean nothing."""
    return communities.clusters(t.edges, t.files)


@query(
    "g3_checks",
    f"{_RAW}, {_EDGES}, l as (select repo, count(distinct path) as n from (select repo, a as path from edges union all select repo, b from edges) e group by repo), f as (select repo, count(distinct path) as n from kept group by repo) "
    "select f.repo, coalesce(l.n, 0) as linked, coalesce(l.n, 0) as placed, f.n - coalesce(l.n, 0) as loose, cast(0 as bigint) as misplaced, cast(0 as bigint) as broken, cast(0 as bigint) as crossing, case when l.n is not null then true end as as_good from f left join l on l.repo = f.repo",
)
def _(t: Tables) -> DataFrame:
    """What clusters must keep, whatever their labels."""
    return communities.checks(t.edges, cut(communities.clusters(t.edges, t.files)))


@query("g4_people", f"{_RAW}, {_people('org', 'kept', ())} select distinct author, person from org_ranked")
def _(t: Tables) -> DataFrame:
    """One name for each human, over all repositories."""
    return identity.people(t.kept, ())


@query("g4_people_by_repo", f"{_RAW}, {_people('own', 'kept', ('repo',))} select distinct repo, author, person from own_ranked")
def _(t: Tables) -> DataFrame:
    """The same inside each repository."""
    return identity.people(t.kept)


@query("t7_top_partners", f"{_FILES}, {_EDGES}, {_BOTH} select w.repo, w.a, w.b, w.weight, w.r as rank, f.commits, g.module as partner_module, {_ratio('w.weight', 'f.commits')} as of_commits from (select *, row_number() over (partition by repo, a order by weight desc, b) as r from both_ways) w join files f on f.repo = w.repo and f.path = w.a join files g on g.repo = w.repo and g.path = w.b where r <= 10")
def _(t: Tables) -> DataFrame:
    """The ten strongest partners of each file."""
    return cochange.partners(t.edges, t.files)


# --- effort ----------------------------------------------------------------------------


@query("a6_effort_split", f"{_COMMITS}, b as (select distinct person, day, repo, path, kind from c) select repo, {', '.join(_r(c, 1) + ' as ' + c for c in _DAYS.values())} from ({_SPLIT('repo', 'repo, person, day').replace('select repo, repo,', 'select repo,')}) s")
def _(t: Tables) -> DataFrame:
    """Days of each repository by kind of work."""
    return effort.repo_effort(effort.touched(t.commits))


@query("a7_people_effort", f"{_ORG}, k as ({_SPLIT('person', 'person, day').replace('select person, person,', 'select person,')}), d as (select person, count(distinct day) as days from b group by person), n as (select person, repo, count(*) as n from b group by person, repo), r as (select person, count(*) as repos, first(repo order by n desc, repo) as top_repo from n group by person) select d.person, d.days, r.repos, r.top_repo, {', '.join(_ratio('k.' + c, 'd.days', 3) + ' as ' + c for c in _DAYS.values())} from d join r on r.person = d.person join k on k.person = d.person")
def _(t: Tables) -> DataFrame:
    """People over all repositories."""
    return effort.people_effort(t.base)


@query("a8_person_repos", f"{_ORG}, k as ({_SPLIT('person, repo', 'person, repo, day').replace('select person, repo, person, repo,', 'select person, repo,')}), d as (select person, repo, count(distinct day) as days, count(distinct sha) as commits, cast(sum(churn) as bigint) as churn from c group by person, repo) select d.*, {', '.join(_ratio('k.' + c, 'd.days', 3) + ' as ' + c for c in _DAYS.values())} from d join k on k.person = d.person and k.repo = d.repo")
def _(t: Tables) -> DataFrame:
    """Each person in each repository."""
    return effort.person_repos(t.base, t.org)


_OWNED = "owned as (select * from (select person, repo, path, days, {r} as share, count(*) over (partition by repo, path) - 1 as others from (select person, repo, path, count(*) as days from b group by person, repo, path) x) y where share >= {floor} and days >= {days})"
_OWN = lambda floor, days: _OWNED.format(r=_ratio("days", "sum(days) over (partition by repo, path)"), floor=floor, days=days)


@query("a9_person_ownership", f"{_ORG}, {_OWN(0.6, 3)} select * from owned")
def _(t: Tables) -> DataFrame:
    """Files that one person holds."""
    return effort.ownership(t.base)


@query("u4_nobody_else", f"{_ORG}, {_OWN(0.2, 1)} select * from owned where others = 0")
def _(t: Tables) -> DataFrame:
    """U4: files nobody else touched."""
    return effort.alone(effort.ownership(t.base, Params(ownership_floor=0.2, ownership_days=1)))


@query("a10_person_peers", f"{_ORG}, w as materialized (select distinct repo, path, person from b), p as (select x.person, y.person as peer, count(*) as files, count(distinct x.repo) as repos from w x join w y on x.repo = y.repo and x.path = y.path and x.person <> y.person group by x.person, y.person) select * from (select *, row_number() over (partition by person order by files desc, peer) as rank from p) q where rank <= 12")
def _(t: Tables) -> DataFrame:
    """Those who touch the same files."""
    return effort.peers(t.base)


@query("a18_active_days", f"{_ORG} select person, month, count(distinct day) as days, count(distinct date) as stamps from c group by person, month")
def _(t: Tables) -> DataFrame:
    """Active days and commit times by month."""
    return effort.active_days(t.org)


@query("a19_person_cards", f"{_ORG} select person, cast(sum(churn) as bigint) as churn, min(month) as first_month, max(month) as last_month, count(distinct day) as days, count(distinct repo) as repos, count(distinct (repo, sha)) as commits, count(distinct (repo, path)) as files, string_agg(distinct author, ', ' order by author) as aliases from c group by person")
def _(t: Tables) -> DataFrame:
    """A card for each person."""
    return effort.cards(t.org)


@query("a20_people_summary", f"{_ORG}, p as (select person, count(distinct day) as days, count(distinct repo) as repos from b group by person) select count(*) as people, cast(sum(days) as bigint) as days, cast(quantile_cont(repos, 0.5) as double) as median_repos, max(repos) as max_repos, cast(quantile_cont(days, 0.5) as double) as median_days, max(days) as max_days from p")
def _(t: Tables) -> DataFrame:
    """People in figures."""
    return effort.people_summary(effort.people_effort(t.base))


@query("p18_people_by_name", f"{_ORG} select person, count(distinct day) as days from b where regexp_matches(person, 'build', 'i') group by person")
def _(t: Tables) -> DataFrame:
    """People whose name matches."""
    return effort.named_like(effort.people_effort(t.base), "build").select("person", "days")


# --- clusters --------------------------------------------------------------------------

_CLUSTER = "clusters as materialized (select m.*, t.total_commits, case when m.cluster_id = -1 then 'unclustered (' || num_files || ' files)' else '#' || m.cluster_id || ' ' || dominant_module || ' (' || num_files || ' files)' end as label from (select repo, cluster_id, cast(sum(c) as bigint) as total_churn, cast(sum(n) as bigint) as num_files, count(*) as num_modules, first(module order by n desc, module) as dominant_module from (select repo, cluster_id, module, count(*) as n, sum(churn) as c from files group by all) g group by repo, cluster_id) m left join (select repo, cluster_id, count(distinct sha) as total_commits from c join (select repo, path, cluster_id from files) f using (repo, path) group by repo, cluster_id) t on t.repo = m.repo and t.cluster_id = m.cluster_id)"


@query("a3_cluster_table", f"{_FILES}, {_CLUSTER} select * from clusters")
def _(t: Tables) -> DataFrame:
    """Clusters with their leading module and distinct commits."""
    return t.clusters


@query("t10_worst_coupling", f"{_FILES}, {_CLUSTER} select repo, cluster_id, num_modules, total_churn, rank from (select *, row_number() over (partition by repo order by num_modules desc, total_churn desc, cluster_id) as rank from clusters where cluster_id <> -1) x where rank <= 5")
def _(t: Tables) -> DataFrame:
    """Clusters over most modules."""
    return clusters.worst_coupling(t.clusters).select("repo", "cluster_id", "num_modules", "total_churn", "rank")


_COHESION = f"coh as (select repo, cluster_id, {_ratio('sum(case when ca = cb then weight else 0 end)', 'sum(weight)')} as cohesion from (select repo, ca, cb, weight, unnest(list_distinct([ca, cb])) as cluster_id from (select e.*, x.cluster_id as ca, y.cluster_id as cb from edges e join files x on x.repo = e.repo and x.path = e.a join files y on y.repo = e.repo and y.path = e.b) z) z group by repo, cluster_id)"


@query(
    "a11_cluster_stats",
    f"""{_FILES}, {_EDGES}, {_COHESION},
m as (select repo, cluster_id, module, sum(churn) as ch from files group by all), mr as (select *, row_number() over (partition by repo, cluster_id order by ch desc, module) as r from m),
mm as (select repo, cluster_id, string_agg(case when r <= 3 then module end, ', ' order by r) || case when count(*) > 3 then ' +' || (count(*) - 3) else '' end as modules from mr group by repo, cluster_id),
w as (select repo, cluster_id, count(distinct (person, day)) as dev_days, count(distinct person) as devs, count(distinct sha) as commits from c join (select repo, path, cluster_id from files) f using (repo, path) group by repo, cluster_id),
g as (select repo, cluster_id, cast(sum(churn) as bigint) as churn, count(*) as files, max(churn) as top, first(path order by churn desc, path) as hotspot, max(last_month) as last, {_ratio('sum(case when lines is not null then churn end)', 'sum(lines)')} as churn_per_line, {_ratio('sum(case when lines is not null then rework end)', 'sum(lines)')} as rework_per_line, sum(cast(lines is null as int)) as gone from files group by repo, cluster_id)
select g.repo, g.cluster_id, modules, files, churn, {_ratio('churn', 'sum(churn) over (partition by g.repo)', 3)} as share, churn_per_line, rework_per_line, {_ratio('top', 'churn')} as in_hotspot, hotspot, cohesion, dev_days, devs, {_ratio('dev_days', 'sum(dev_days) over (partition by g.repo)', 3)} as effort, commits, last, gone
from g join mm on mm.repo = g.repo and mm.cluster_id = g.cluster_id join w on w.repo = g.repo and w.cluster_id = g.cluster_id left join coh on coh.repo = g.repo and coh.cluster_id = g.cluster_id""",
)
def _(t: Tables) -> DataFrame:
    """A11 A11a-f A26 J3 W2 W3: everything about each cluster."""
    return clusters.cluster_stats(t.files, t.edges, t.commits)


@query(
    "a12_file_stats",
    f"""{_FILES}, {_EDGES}, {_BOTH},
o as (select z.repo, z.a as path, {_ratio('sum(case when x.cluster_id <> y.cluster_id then weight else 0 end)', 'sum(weight)')} as outside, first(z.b || '  x' || weight order by weight desc, z.b) as partner from both_ways z join files x on x.repo = z.repo and x.path = z.a join files y on y.repo = z.repo and y.path = z.b group by z.repo, z.a)
select f.repo, cluster_id, f.path, churn, {_ratio('churn', 'sum(churn) over (partition by f.repo, cluster_id)', 3)} as share, rework, rework_per_line, debt, per_commit, devs, dev_days, {_ratio('dev_days', 'sum(dev_days) over (partition by f.repo, cluster_id)', 3)} as effort, growth, coalesce(outside, 0) as outside, coalesce(partner, '') as partner, substr(born, 1, 10) as born
from files f left join o on o.repo = f.repo and o.path = f.path""",
)
def _(t: Tables) -> DataFrame:
    """Everything about each file in its cluster."""
    return clusters.file_stats(t.files, t.edges)


@query("w1_hot_files", f"{_FILES} select f.repo, f.cluster_id, f.path, cast(f.density as double) as value, f.density >= q.cut - 1e-9 as hot, q.dropped from files f join (select repo, cluster_id, quantile_cont(density, 0.9) as cut, sum(cast(density is null as int)) as dropped from files group by repo, cluster_id) q on q.repo = f.repo and q.cluster_id = f.cluster_id where f.density is not null")
def _(t: Tables) -> DataFrame:
    """Files in the top tenth of their cluster by density."""
    return clusters.hot(t.files, "density")


@query("w1_hot_by_rework", f"{_FILES} select f.repo, f.cluster_id, f.path, cast(f.rework as double) as value, f.rework >= q.cut - 1e-9 as hot, q.dropped from files f join (select repo, cluster_id, quantile_cont(rework, 0.9) as cut, sum(cast(rework is null as int)) as dropped from files group by repo, cluster_id) q on q.repo = f.repo and q.cluster_id = f.cluster_id where f.rework is not null")
def _(t: Tables) -> DataFrame:
    """Files in the top tenth of their cluster by rework."""
    return clusters.hot(t.files, "rework")


@query("w1_hot_by_churn", f"{_FILES} select f.repo, f.cluster_id, f.path, cast(f.churn as double) as value, f.churn >= q.cut - 1e-9 as hot, q.dropped from files f join (select repo, cluster_id, quantile_cont(churn, 0.9) as cut, sum(cast(churn is null as int)) as dropped from files group by repo, cluster_id) q on q.repo = f.repo and q.cluster_id = f.cluster_id where f.churn is not null")
def _(t: Tables) -> DataFrame:
    """Files in the top tenth of their cluster by churn."""
    return clusters.hot(t.files, "churn")


@query(
    "a24_cluster_screen",
    f"{_FILES}, {_CLUSTER}, g as (select repo, cast(sum(churn) as bigint) as churn, cast(floor(100.0 * sum(cast(cluster_id = -1 as int)) / count(*)) as bigint) as unclustered, first(path order by churn desc, path) as biggest, {_ratio('max(churn)', 'sum(churn)')} as biggest_share from files group by repo), n as (select repo, count(*) as clusters, sum(cast(num_modules > 1 as int)) as cross_module from clusters where cluster_id <> -1 group by repo), w as (select repo, count(distinct sha) as commits, count(distinct author) as authors, count(distinct (person, day)) as dev_days from c group by repo) select g.*, n.clusters, n.cross_module, w.commits, w.authors, w.dev_days from g join n on n.repo = g.repo join w on w.repo = g.repo",
)
def _(t: Tables) -> DataFrame:
    """The card of each repository."""
    return clusters.screen_card(t.files, t.commits)


# --- inside files ----------------------------------------------------------------------

_SYM = f"select *, added + removed as churn, 2 * least(added, removed) as rework, case when region = '' then '(unnamed region)' when region like 'def %' then regexp_extract(region, 'def ([a-z_0-9]+)', 1) when region like 'const %' then regexp_extract(region, 'const ([a-z_0-9]+)', 1) when region like '%class %' then regexp_extract(region, 'class ([A-Z_0-9]+)', 1) when region like '%(%' then regexp_extract(region, '([a-z_0-9]+)[(]', 1) else region end as symbol from ({A.HUNK_SQL}) hx where lower(author) not like '%bot%'"
_HUNKS = f"with recursive hk as materialized ({_SYM}), {_people('hun', 'hk', ('repo', 'path'))}, h as materialized (select k.*, p.person from hk k join hun_ranked p on p.repo = k.repo and p.path = k.path and p.author = k.author)"
_REGIONS = f"""rg as materialized (select a.repo, a.path, a.symbol as region, churn, {_ratio('churn', 'sum(churn) over (partition by a.repo, a.path)', 3)} as share, rework, edits, commits, {_ratio('added - removed', 'churn')} as growth, authors, owner, owner_share, substr(last, 1, 7) as last, case when signature = '' then a.symbol else signature end as signature,
  row_number() over (partition by a.repo, a.path order by rework desc, churn desc, a.symbol) as rank
  from (select repo, path, symbol, cast(sum(churn) as bigint) as churn, cast(sum(rework) as bigint) as rework, cast(sum(added) as bigint) as added, cast(sum(removed) as bigint) as removed, count(*) as edits, count(distinct sha) as commits, max(date) as last, count(distinct person) as authors, first(region order by length(region) desc, region) as signature from h group by repo, path, symbol) a
  join (select repo, path, symbol, first(person order by n desc, person) as owner, {_ratio('max(n)', 'sum(n)')} as owner_share from (select repo, path, symbol, person, count(*) as n from h group by all) q group by repo, path, symbol) o on o.repo = a.repo and o.path = a.path and o.symbol = a.symbol)"""


@query("a14_region_stats", f"{_HUNKS}, {_REGIONS} select * from rg where rank <= 30")
def _(t: Tables) -> DataFrame:
    """Regions of each file."""
    return regions.region_stats(t.hunks)


@query("a14_unnamed_share", f"{_HUNKS} select repo, path, {_ratio(chr(39).join(['sum(case when symbol = ', '(unnamed region)', ' then churn else 0 end)']), 'sum(churn)')} as unnamed from h group by repo, path")
def _(t: Tables) -> DataFrame:
    """Share of churn in unnamed regions."""
    return regions.unnamed_share(t.hunks)


@query("t11_held_by_one", f"{_HUNKS}, {_REGIONS} select repo, path, region, owner, owner_share, share from rg where rank <= 30 and owner_share >= 0.9 and share >= 0.05")
def _(t: Tables) -> DataFrame:
    """Regions that one person holds."""
    return regions.held_by_one(regions.region_stats(t.hunks)).select("repo", "path", "region", "owner", "owner_share", "share")


@query(
    "a15_region_cochange",
    f"{_HUNKS}, s as materialized (select distinct repo, path, sha, symbol from h), z as (select repo, path, sha from s group by all having count(*) between 2 and 40), n as (select repo, path, symbol, count(*) as n from s group by all), e as (select x.repo, x.path, x.symbol as region, y.symbol as partner, count(*) as together from s x join s y on x.repo = y.repo and x.path = y.path and x.sha = y.sha and x.symbol < y.symbol join z on z.repo = x.repo and z.path = x.path and z.sha = x.sha where x.symbol <> '(unnamed region)' and y.symbol <> '(unnamed region)' group by all) select * from (select e.*, {_ratio('together', 'least(a.n, b.n)')} as of_the_rarer, row_number() over (partition by e.repo, e.path order by {_ratio('together', 'least(a.n, b.n)')} desc, together desc, region, partner) as rank from e join n a on a.repo = e.repo and a.path = e.path and a.symbol = e.region join n b on b.repo = e.repo and b.path = e.path and b.symbol = e.partner) q where rank <= 15",
)
def _(t: Tables) -> DataFrame:
    """Regions that change together."""
    return regions.region_cochange(t.hunks)


@query("a16_ticket_projects", f"{_RAW} select repo, path, k as project, count(*) as subjects from (select distinct repo, path, sha, unnest(regexp_extract_all(subject, '([A-Z][A-Z0-9]+)-[0-9]+', 1)) as k from kept) x group by repo, path, k")
def _(t: Tables) -> DataFrame:
    """Tracker projects of each file."""
    return regions.ticket_projects(t.kept)


_BANDS = f"""with raw as materialized ({A.COMMIT_SQL}), lines as materialized ({A.LINES_SQL}),
tc as materialized (select t.repo, t.path, t.sha, t.date, start_, least(end_, lines) as end_ from ({A.TOUCH_SQL}) t join lines l on l.repo = t.repo and l.path = t.path where start_ <= least(end_, lines)),
sz as (select *, cast(ceil(cast(lines as double) / greatest(1, least(48, floor(lines / 8)))) as bigint) as size from lines where lines >= 50),
gr as materialized (select repo, path, s as start_, least(s + size - 1, lines) as end_ from (select *, unnest(range(1, lines + 1, size)) as s from sz) x)"""
_COUNT = "select g.repo, g.path, g.start_, g.end_, count(distinct t.sha) as commits, coalesce(max(substr(t.date, 1, 7)), '') as last from {g} g left join tc t on t.repo = g.repo and t.path = g.path and t.start_ <= g.end_ and t.end_ >= g.start_ group by g.repo, g.path, g.start_, g.end_"
_BAND = f"{_BANDS}, bd as materialized ({_COUNT.format(g='gr')})"


@query("b1_band_grid", f"{_BANDS} select repo, path, start_ as start, end_ as \"end\" from gr")
def _(t: Tables) -> DataFrame:
    """B1: bands of each file."""
    return bands.grid(t.sizes, least=50)


@query("b2_band_commits", f"{_BAND} select repo, path, start_ as start, end_ as \"end\", commits, last from bd")
def _(t: Tables) -> DataFrame:
    """Commits that touch each band."""
    return t.bands


_LIFTED = f"""{_BANDS.replace('with raw', 'with recursive raw')},
pt as materialized (select *, row_number() over (partition by repo, path order by translate(date || sha, '0123456789', '9876543210') desc) as at_ from ({_PATCH}) q where added + removed > 0),
up(repo, path, sha, date, at_, low, high) as (select repo, path, sha, date, at_, old, old + added - 1 from pt union all
  select u.repo, u.path, u.sha, u.date, p.at_, case when u.low < p.old then u.low when u.low < p.old + p.removed then p.old else u.low + p.added - p.removed end, case when u.high < p.old then u.high when u.high < p.old + p.removed then p.old + p.added - 1 else u.high + p.added - p.removed end
  from up u join pt p on p.repo = u.repo and p.path = u.path and p.at_ = u.at_ + 1),
lifted as materialized (select repo, path, sha, date, arg_max(low, at_) as start_, arg_max(high, at_) as end_ from up group by all)"""


@query("s4_lifted_hunks", f"{_LIFTED} select repo, path, sha, date, start_ as start, end_ as \"end\" from lifted")
def _(t: Tables) -> DataFrame:
    """Hunks of a patch log in the line numbers of today."""
    return lifting.lift(logs.parse_hunks(_patches(t), Params(ignore_authors=()))).select("repo", "path", "sha", "date", "start", "end")


@query("b2_from_hunks", f"{_LIFTED} {_COUNT.format(g='gr').replace('tc t', 'lifted t')}".replace("select g.repo, g.path, g.start_, g.end_,", 'select g.repo, g.path, g.start_ as start, g.end_ as "end",'))
def _(t: Tables) -> DataFrame:
    """B2 J8 from S4: commits that touch each band, from a patch log alone."""
    return bands.touched(bands.grid(t.sizes, least=50), lifting.lift(logs.parse_hunks(_patches(t), Params(ignore_authors=()))))


_WIDE = f"""{_BANDS.replace('least(48, floor(lines / 8))', 'least(4, floor(lines / 8))')}, bd as materialized ({_COUNT.format(g='gr')}),
hot as materialized (select * from (select *, max(end_ - start_ + 1) over (partition by repo, path) > 40 as wide, row_number() over (partition by repo, path order by commits desc, start_) as r from bd) x where wide and r <= 6 and commits > 0),
fine as materialized (select repo, path, s as start_, least(s + greatest(1, cast(ceil((end_ - start_ + 1) / 16.0) as bigint)) - 1, end_) as end_ from (select *, unnest(range(start_, end_ + 1, greatest(1, cast(ceil((end_ - start_ + 1) / 16.0) as bigint)))) as s from hot) x),
allb as (select repo, path, start_, end_, commits, last from bd where not exists (select 1 from hot h where h.repo = bd.repo and h.path = bd.path and h.start_ = bd.start_) union all {_COUNT.format(g='fine')})"""


@query("b3_refined_bands", f"{_WIDE} select repo, path, start_ as start, end_ as \"end\", commits, last from allb")
def _(t: Tables) -> DataFrame:
    """The hottest bands cut finer."""
    touches = cut(t.touches)
    return bands.refine(cut(bands.touched(bands.grid(t.sizes, bands=4, least=50), touches)), touches)


@query("b4_merged_bands", f"{_BAND} select repo, path, band, min(start_) as start, max(end_) as \"end\", cast(sum(commits) as bigint) as commits, max(last) as last from (select *, cast(case when n <= 20 then i else floor(i / ceil(n / 20.0)) end as bigint) as band from (select *, count(*) over (partition by repo, path) as n, row_number() over (partition by repo, path order by start_) - 1 as i from bd) x) y group by repo, path, band")
def _(t: Tables) -> DataFrame:
    """Bands folded for a chart."""
    return bands.merge(t.bands)


@query("b5_line_heat", f"{_BAND} select repo, path, unnest(range(start_, end_ + 1)) as line, commits as heat from bd")
def _(t: Tables) -> DataFrame:
    """Heat of each line."""
    return bands.heat(t.bands, t.sizes)


@query("b6_quiet_bands", f"{_BAND} select repo, path, sum(cast(commits = 0 as int)) as bands, cast(sum(case when commits = 0 then end_ - start_ + 1 else 0 end) as bigint) as lines from bd group by repo, path")
def _(t: Tables) -> DataFrame:
    """What no commit touched."""
    return bands.quiet(t.bands)


# --- portfolio -------------------------------------------------------------------------

_SUMMARY = f"""{_FILES}, {_CLUSTER},
aged as (select *, cast(floor((max(epoch(cast(last_date as timestamptz))) over (partition by repo) - epoch(cast(born as timestamptz))) / 86400) as bigint) as alive from files),
fl as materialized (select *, lines is not null and kind = '{C.PRODUCT}' and lines >= 50 as product, lines is not null and born is not null as fresh, lines is not null and born is not null and kind = '{C.PRODUCT}' and lines >= 50 and alive >= 30 and rework > 0 as young from aged),
g as (select repo, cast(sum(churn) as bigint) as total_churn, count(*) as num_files, cast(coalesce(sum(lines), 0) as bigint) as lines_now, {_ratio('sum(case when lines is not null then churn end)', 'sum(lines)')} as density, cast(coalesce(sum(case when lines is not null then rework end), 0) as bigint) as rework, {_ratio('sum(case when lines is not null then rework end)', 'sum(lines)')} as rework_density,
  first(path order by dev_days desc, path) as top_effort_file, max(dev_days) as top_effort_days, first(devs order by dev_days desc, path) as top_effort_devs, first(path order by debt desc, path) filter (product and debt is not null) as top_debt_file, max(debt) filter (product) as top_debt,
  sum(cast(fresh as int)) as new_files, cast(coalesce(sum(case when fresh then rework end), 0) as bigint) as new_rework, first(path order by rework desc, path) filter (young) as top_new_file, max(rework) filter (young) as top_new_rework, substr(first(born order by rework desc, path) filter (young), 1, 10) as top_new_born, first(alive order by rework desc, path) filter (young) as top_new_days from fl group by repo),
n as (select repo, count(*) as num_clusters, sum(cast(num_modules > 1 as int)) as cross_module from clusters where cluster_id <> -1 group by repo),
tm as (select repo, first(dominant_module order by t desc, dominant_module) as top_module from (select repo, dominant_module, sum(total_churn) as t from clusters where cluster_id <> -1 group by all) q group by repo),
w as (select repo, count(distinct sha) as total_commits, count(distinct person) as devs, count(distinct (person, day)) as dev_days from c group by repo),
so as (select repo, {_ratio('max(n)', 'sum(n)')} as solo_share from (select repo, person, count(distinct day) as n from c group by repo, person) q group by repo),
b as (select distinct person, day, repo, path, kind from c), ks as (select repo, {', '.join(_r(c, 1) + ' as ' + c for c in _DAYS.values())} from ({_SPLIT('repo', 'repo, person, day').replace('select repo, repo,', 'select repo,')}) s),
summary as materialized (select g.*, n.num_clusters, n.cross_module, tm.top_module, w.total_commits, w.devs, w.dev_days, so.solo_share, {', '.join('ks.' + c for c in _DAYS.values())} from g join n on n.repo = g.repo join tm on tm.repo = g.repo join w on w.repo = g.repo join so on so.repo = g.repo join ks on ks.repo = g.repo)"""
_TOTAL = "(days_build + days_config + days_tests + days_docs + days_product)"
_PART = f"part as (select *, {_ratio('days_build + days_config', _TOTAL, 3)} as infra, {_ratio('days_tests', _TOTAL, 3)} as tests, (days_build + days_config) / nullif({_TOTAL}, 0) as infra_exact, days_tests / nullif({_TOTAL}, 0) as tests_exact from summary)"


@query("a13_repo_summary", f"{_SUMMARY} select * from summary")
def _(t: Tables) -> DataFrame:
    """A13 A13a-e: the summary row of each repository."""
    return t.summary


_UNCLUSTERED = ("repo", "total_churn", "num_files", "lines_now", "density", "rework", "rework_density", "top_effort_file", "top_effort_days", "top_debt_file", "top_debt", "new_files", "new_rework", "top_new_file", "total_commits", "devs", "dev_days", "solo_share", *_DAYS.values())


@query("job_analyze", f"{_SUMMARY} select {', '.join(_UNCLUSTERED)}, true as clustered from summary")
def _(t: Tables) -> DataFrame:
    """The whole job from log text to summaries, with its own clusters; what depends on their labels is only asked to be there."""
    kept = facts.clean(logs.parse_numstat(_printed(t)).drop("churn"))  # analyze writes them
    done = portfolio.analyze(kept, t.lines, t.births)
    return done.select(*_UNCLUSTERED, ((F.col("num_clusters") > 0) & F.col("top_module").isNotNull()).alias("clustered"))


_AS_OF, _MONTHS = "1998-02-01T00:00:00+00:00", 30
_WINDOWED = _SUMMARY.replace("from raw where lower(author)", "from raw where cast(date as timestamptz) >= timestamptz '1995-08-01 00:00:00+00' and lower(author)")


@query(
    "job_stored",
    f"""{_WINDOWED}, asked as (select repo as path from (select distinct repo from raw) x where repo not like '%an' union all select '/srv/git/never/seen')
select a.path, {', '.join('s.' + c for c in _UNCLUSTERED if c != 'repo')}, cast({_MONTHS} as bigint) as since_months, cast(2 as bigint) as versions,
  case when a.path like '%i%' and a.path like 'org%' then '1 x count is no number; 1 x not a line of counts' when s.repo is null then 'no commits in window' end as error
from asked a left join summary s on s.repo = a.path
union all by name select 'org/old' as path, cast(7 as bigint) as total_churn, cast(1 as bigint) as total_commits, cast(6 as bigint) as since_months, cast(2 as bigint) as versions""",
)
def _(t: Tables) -> DataFrame:
    """S6 S9 P5 A13 in one call: logs with faulty lines, a window, summaries of those asked for, saved over an older version and read back."""
    known = t.raw.select(F.col("repo").alias("path")).distinct()
    bad = known.where("path like '%i%'").select(F.col("path").alias("repo"), F.lit("c0\t1997-01-01T00:00:00+00:00\tMina\tm@x\ts\n3\tmany\tmod1/x.py\nmod1/y.py").alias("value"))
    asked = known.where("path not like '%an'").unionByName(known.limit(1).select(F.lit("/srv/git/never/seen").alias("path")))
    old = known.where("path like '%a%'").select("path", F.lit(7).cast("long").alias("total_churn"), F.lit(1).cast("long").alias("total_commits"), F.lit(6).cast("long").alias("since_months"))
    store = Store(t.spark, f"{folder(t.spark)}/store-{uuid.uuid4().hex}")
    # an older version, with repositories that the job replaces and one that it is not asked for
    store.save(old.unionByName(old.withColumn("path", F.lit("org/old"))))
    # records are read for faults and for facts; these are made of tables, so they are written first
    job.run(cut(_printed(t).unionByName(bad)), t.lines, t.births, asked, _AS_OF, Params(months=_MONTHS), store)
    rows = store.read().join(asked.unionByName(asked.select(F.lit("org/old").alias("path"))).distinct(), "path", "left_semi")
    return rows.select("path", *(c for c in _UNCLUSTERED if c != "repo"), "since_months", F.lit(len(store.versions())).cast("long").alias("versions"), "error")


@query(
    "s9_quarantine",
    f"""{_RAW}, r as (select distinct repo, 'c' || cast(length(repo) as varchar) as id from raw)
select repo, id as sha, 'date is no time' as reason from r where length(repo) % 2 = 0
union all select repo, case when reason = 'no commit id' then '' else id end as sha, reason from r, (values ('no commit id'), ('count is no number'), ('not a line of counts')) f(reason) where length(repo) % 3 = 0""",
)
def _(t: Tables) -> DataFrame:
    """What cannot be read of planted faulty logs, and nothing of the sound ones."""
    repos = A.repos(t.spark, t.dir).withColumn("id", F.concat(F.lit("c"), F.length("repo").cast("string")))
    day = F.concat("id", F.lit("\tyesterday\tMina\tm@x\ts\n1\t2\tx.py"))
    lines = F.concat("id", F.lit("\t1997-01-01T00:00:00+00:00\tMina\tm@x\ts\n1\tx\tx.py\n-\t-\tart.png\nx.py\n"))
    nobody = F.lit("\t1997-01-01T00:00:00+00:00\tMina\tm@x\ts\n1\t2\tx.py")
    bad = repos.where("length(repo) % 2 = 0").select("repo", day.alias("value")).unionByName(repos.where("length(repo) % 3 = 0").select("repo", F.explode(F.array(lines, nobody)).alias("value")))
    return logs.malformed(_printed(t).unionByName(bad)).select("repo", "sha", "reason")


@query("a22_portfolio_totals", f"{_SUMMARY} select {', '.join(_r(f'sum({c})', 1) + ' as ' + c for c in _DAYS.values())}, {_ratio('sum(days_build) + sum(days_config)', f'sum({_TOTAL})')} as infra, {_ratio('sum(days_tests)', f'sum({_TOTAL})', 3)} as tests, {_ratio('sum(rework)', 'sum(total_churn)')} as rework, cast(sum(devs) as bigint) as memberships, {_ratio('sum(new_rework)', 'greatest(1, sum(rework))')} as new_share from summary")
def _(t: Tables) -> DataFrame:
    """All repositories in figures."""
    return portfolio.totals(t.summary)


@query("a23_infra_share", f"{_SUMMARY}, {_PART} select repo, infra, tests from part")
def _(t: Tables) -> DataFrame:
    """Share of infrastructure and tests in each repository."""
    return portfolio.shares(t.summary).select("repo", "infra", "tests")


@query("t1_effort_sinks", f"{_SUMMARY} select repo, top_effort_file, top_effort_days, top_effort_devs from summary order by top_effort_days desc, repo limit 6")
def _(t: Tables) -> DataFrame:
    """Where most days went."""
    return portfolio.effort_sinks(t.summary)


@query("t2_infra_heavy", f"{_SUMMARY}, {_PART} select repo, dev_days, infra from part where infra_exact > 0.15 and dev_days >= 20 order by infra_exact desc, repo limit 6")
def _(t: Tables) -> DataFrame:
    """Repositories with much infrastructure, here over 15 percent."""
    return portfolio.infra_heavy(t.summary, share=0.15)


@query("t3_redesign_candidates", f"{_SUMMARY} select repo, top_debt_file, top_debt from summary where top_debt_file is not null order by top_debt desc, repo limit 6")
def _(t: Tables) -> DataFrame:
    """Worst product files."""
    return portfolio.redesign_candidates(t.summary)


@query("t4_thin_on_tests", f"{_SUMMARY}, {_PART} select repo, dev_days, tests, solo_share from part where tests_exact < 0.1 and dev_days >= 50 order by dev_days desc, repo limit 6")
def _(t: Tables) -> DataFrame:
    """T4: busy repositories with few tests, here under 10 percent."""
    return portfolio.thin_on_tests(t.summary, share=0.1)


@query("t5_new_and_rewritten", f"{_SUMMARY} select repo, top_new_file, top_new_born, top_new_days, top_new_rework, new_files, {_ratio('new_files', 'num_files')} as of_repo from summary where top_new_file is not null order by top_new_rework desc, repo limit 6")
def _(t: Tables) -> DataFrame:
    """T5: new code that is already rewritten."""
    return portfolio.new_and_rewritten(t.summary)


@query("t12_portfolio_table", f"{_SUMMARY} select repo, dev_days, total_churn, density, rework_density from summary")
def _(t: Tables) -> DataFrame:
    """Repositories by person-days."""
    return portfolio.ranking(t.summary).select("repo", "dev_days", "total_churn", "density", "rework_density")


@query("t12_by_density", f"{_SUMMARY} select repo, density, row_number() over (order by density desc nulls last, repo) as place from summary order by density desc nulls last, repo limit 10")
def _(t: Tables) -> DataFrame:
    """The first ten repositories by density, with their places."""
    first = portfolio.ranking(t.summary, "density").limit(10)
    return first.select("repo", "density", F.row_number().over(Window.orderBy(F.desc_nulls_last("density"), "repo")).cast("long").alias("place"))


# --- explorer --------------------------------------------------------------------------


@query("p17_narrowed_files", f"{_FILES} select repo, path, kind, rework, lines from files where contains(lower(path), 'mod0/') and kind in ('product code', 'tests') and lines >= 30 and born is not null and rework >= 5")
def _(t: Tables) -> DataFrame:
    """Files by text, kind, birth, rework and lines."""
    return explore.narrow(t.files, "MOD0/", kinds=("product code", "tests"), live=True, born=True, min_rework=5, min_lines=30).select("repo", "path", "kind", "rework", "lines")


@query("t6_explorer_page", f"{_FILES} select repo, path, debt, rework from files order by debt asc nulls last, repo, path limit 40 offset 80")
def _(t: Tables) -> DataFrame:
    """The third page by debt, rows without debt last."""
    return explore.page(t.files, "debt", descending=False, number=2, size=40).select("repo", "path", "debt", "rework")


@query("t6_by_rework", f"{_FILES} select repo, path, rework from files order by rework desc nulls last, repo, path limit 30 offset 30")
def _(t: Tables) -> DataFrame:
    """The second page by falling rework."""
    return explore.page(t.files, "rework", number=1, size=30).select("repo", "path", "rework")


@query("t6_deep_page", f"{_FILES} select repo, path, rework from files order by rework desc nulls last, repo, path limit 50 offset 3000")
def _(t: Tables) -> DataFrame:
    """A page so deep that only the ranges that hold it are sorted."""
    return explore.page(t.files, "rework", number=60, size=50, shallow=0).select("repo", "path", "rework")


@query("t6_by_born", f"{_FILES} select repo, path, born from files order by born desc nulls last, repo, path limit 25")
def _(t: Tables) -> DataFrame:
    """The youngest files first; files of unknown birth would be last."""
    return explore.page(t.files, "born", size=25).select("repo", "path", "born")


@query("a21_rework_summary", f"{_FILES} select count(*) as files, count(distinct repo) as repos, cast(sum(rework) as bigint) as rework, {_ratio('sum(rework)', 'sum(churn)')} as of_churn, {_ratio('sum(case when lines is not null then rework end)', 'sum(lines)')} as per_line from files")
def _(t: Tables) -> DataFrame:
    """Rework of the organisation."""
    return explore.summary(t.files)
