"""Any orders-and-items tables as commit facts: an order is a commit, its items touch files.

The expressions are plain SQL that other engines also run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LETTER = "chr(cast(97 + c_custkey % 8 as int))"
NAME = f"upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || upper({LETTER})"
NUMBER = "case when l_linenumber % 5 = 0 then l_partkey % 150 else (o_custkey % 10) * 15 + l_partkey % 15 end"
FACTS = {
    "repo": "'org/' || lower(n_name)",
    "sha": "'c' || cast(o_orderkey as string)",
    "date": "cast(cast(o_orderdate as date) as string) || 'T' || lpad(cast(o_orderkey % 24 as string), 2, '0') || ':00:00' || case when o_orderkey % 5 = 0 then '+05:30' else '+00:00' end",
    "author": f"case when o_orderkey % 50 = 0 then 'dependabot[bot]' when o_orderkey % 11 = 0 then 'ext-' || reverse(lower(c_mktsegment)) || {LETTER} when o_orderkey % 3 = 0 then lower(c_mktsegment) || '.' || {LETTER} else {NAME} end",
    "email": f"case when o_orderkey % 50 = 0 then 'bot@ci.example' else lower(c_mktsegment) || '.' || {LETTER} || case when o_orderkey % 7 = 0 then '@laptop.local' else '@corp.example' end end",
    "subject": "'Merged in ' || substr(c_mktsegment, 1, 4) || '-' || cast(o_orderkey as string) || case when o_orderkey % 4 = 0 then ' and OPS-' || cast(o_orderkey % 9 as string) else '' end",
    "path": "case when l_partkey % 40 = 0 then 'poetry.lock' else 'mod' || cast(f % 6 as string) || '/' || case f % 10 when 0 then 'tests/' when 1 then 'docs/' when 2 then 'config/' else 'src/' end || case when f % 10 = 3 then 'Dockerfile' else 'f' end || cast(f as string) || '.py' end",
}
K = "cast(l_suppkey % 4 as string)"
REGION = f"case cast(l_suppkey % 6 as int) when 0 then '' when 1 then 'def save_' || {K} || '(self, a' || cast(l_linenumber as string) || '):' when 2 then 'public void load_' || {K} || '(String a) {{' when 3 then 'const total_' || {K} || ' = useMemo(() => 1)' when 4 then 'public class W_' || {K} || ' extends B {{' else 'getPanelCondi_' || {K} end".replace("{{", "{")
ITEMS = f"select *, {NUMBER} as f from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
ADDED, DELETED = "cast(l_quantity as bigint)", "cast((l_partkey * 7 + l_orderkey) % 40 as bigint)"
COMMIT_SQL = f"select repo, sha, date, author, email, subject, path, cast(sum(a) as bigint) as added, cast(sum(d) as bigint) as deleted from (select {', '.join(f'{v} as {k}' for k, v in FACTS.items())}, {ADDED} as a, {DELETED} as d from ({ITEMS}) items) x group by repo, sha, date, author, email, subject, path"
HUNK_SQL = f"select {', '.join(f'{v} as {k}' for k, v in FACTS.items())}, cast(l_linenumber as bigint) as hunk_no, {REGION} as region, {ADDED} as added, {DELETED} as removed from ({ITEMS}) items"
TOUCH_SQL = f"select {', '.join(f'{v} as {k}' for k, v in FACTS.items())}, cast(1 + l_partkey % 380 as bigint) as start_, cast(1 + l_partkey % 380 + {ADDED} as bigint) as end_ from ({ITEMS}) items"
NUMBER_OF = "cast(nullif(regexp_extract(path, '([0-9]+)[.]py$', 1), '') as int)"
LINES_SQL = f"select distinct repo, path, cast(20 + ({NUMBER_OF} * 13) % 400 as bigint) as lines from raw where path <> 'poetry.lock' and {NUMBER_OF} % 7 <> 0"
BIRTHS_SQL = f"select repo, path, min(date) as born from raw where path <> 'poetry.lock' and {NUMBER_OF} % 3 = 0 group by repo, path"
MEMBERS_SQL = f"select distinct repo, path, cast(floor({NUMBER_OF} / 15) as bigint) as cluster_id from raw where path <> 'poetry.lock'"


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "nation")}
    for t in frames:
        sql = sql.replace(f"from {t} ", f"from {{{t}}} ").replace(f"join {t} ", f"join {{{t}}} ")
    # braces of the texts are not places for tables
    sql = sql.replace("(String a) {'", "(String a) {{'").replace("extends B {'", "extends B {{'")
    return spark.sql(sql, **frames)


# Orders meet their customers before the many items do. What they say of a commit is cut down to what FACTS tells apart,
# so that FACTS gives of these rows what it gives of the tables' own.
_SAID = "o_orderkey % 50 <> 0 and c_mktsegment is not null"
_ORDERS = f"""select o_orderkey, o_custkey, cast(o_orderdate as date) as o_orderdate, case when {_SAID} then c_custkey % 8 end as c_custkey, lower(n_name) as n_name,
  substr(c_mktsegment, 1, 4) || case when {_SAID} then lower(substr(c_mktsegment, 5)) else '' end as c_mktsegment
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""
_ITEMS = f"select *, {NUMBER} as f from lineitem join ({_ORDERS}) o on l_orderkey = o_orderkey"
_ORDER = "o_orderkey, o_orderdate, c_custkey, c_mktsegment, n_name"
_LOCK = "l_partkey % 40 = 0"


_SUMMED = f"""select {_ORDER}, lock, f, cast(sum(a) as bigint) as added, cast(sum(d) as bigint) as deleted
  from (select {_ORDER}, coalesce({_LOCK}, false) as lock, case when {_LOCK} then null else f end as f, {ADDED} as a, {DELETED} as d from ({_ITEMS}) items) x group by {_ORDER}, lock, f"""


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of COMMIT_SQL. Items are summed up by what names their commit and file, before that becomes text, and in the tasks in which they met their order."""
    facts = ", ".join(f"{v.replace(_LOCK, 'lock')} as {k}" for k, v in FACTS.items())
    return _view(spark, sf_dir, f"select {facts}, added, deleted from ({_SUMMED}) y")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, value): the commits of COMMIT_SQL as log records, one for each order. They are gathered where items met their order, so no text is shuffled."""
    line = f"concat_ws('\t', cast(added as string), cast(deleted as string), {FACTS['path'].replace(_LOCK, 'lock')})"
    head = f"concat_ws('\t', {', '.join(FACTS[k] for k in ('sha', 'date', 'author', 'email', 'subject'))})"
    orders = f"select {_ORDER}, collect_list({line}) as body from ({_SUMMED}) y group by {_ORDER}"
    return _view(spark, sf_dir, f"select {FACTS['repo']} as repo, concat({head}, '\n', concat_ws('\n', body), '\n-\t-\tart/logo.png') as value from ({orders}) z")


def raw_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, sha, date, author, added, deleted): what each commit of COMMIT_SQL did to a file, once, with the least of its authors. Numbers tell them apart, where items met their order."""
    return printed(patch_numbers(spark, sf_dir))


def patch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of raw_patches before they are text; `printed` makes them that."""
    one = "o_orderkey, o_orderdate, n_name, lock, f"
    patches = f"select {one}, min({FACTS['author']}) as author, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted from ({_SUMMED}) y group by {one}"
    return _view(spark, sf_dir, patches)


def printed(numbers: DataFrame) -> DataFrame:
    return numbers.selectExpr(*(f"{FACTS[k].replace(_LOCK, 'lock')} as {k}" for k in ("repo", "path", "sha", "date")), "author", "added", "deleted")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo): the repositories of COMMIT_SQL, each once, without its other columns."""
    return _view(spark, sf_dir, f"select distinct {FACTS['repo']} as repo from ({_ORDERS}) o join (select distinct l_orderkey from lineitem ) i on l_orderkey = o_orderkey")


def seen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path) of COMMIT_SQL, each once, without its other columns. Files are told apart by numbers, before they become text.

    Write it before anything is made distinct again: Spark leaves out a distinct below another one, and all items would become text.
    """
    files = f"select distinct n_name, coalesce({_LOCK}, false) as lock, case when {_LOCK} then null else f end as f from ({_ITEMS}) items"
    return _view(spark, sf_dir, f"select {FACTS['repo']} as repo, {FACTS['path'].replace(_LOCK, 'lock')} as path from ({files}) x")


def raw_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HUNK_SQL.replace(ITEMS, _ITEMS))


def raw_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TOUCH_SQL.replace(ITEMS, _ITEMS)).withColumnsRenamed({"start_": "start", "end_": "end"})


def _from_raw(raw: DataFrame, sql: str) -> DataFrame:
    return raw.sparkSession.sql(sql.replace("from raw ", "from {raw} "), raw=raw)


def line_counts(raw: DataFrame) -> DataFrame:
    return _from_raw(raw, LINES_SQL)


def births(raw: DataFrame) -> DataFrame:
    return _from_raw(raw, BIRTHS_SQL)


def membership(raw: DataFrame) -> DataFrame:
    return _from_raw(raw, MEMBERS_SQL)
