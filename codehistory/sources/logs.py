"""Exported logs as facts. A record of a log starts at MARK, so one row is one commit and files stay splittable.

Where commits may be larger than a row should be (a mass commit, the patch of a merge), read
lines instead: a record may then lie across the blocks that a file is read in, and each
line gets the header of its commit from the lines, or blocks, before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.lineage import cut
from ..operators.ordered import carried, numbered_in
from ..params import Params

MARK = "__C__"


def _repo(text: DataFrame) -> Column:
    """The repository of a file: the column of the folder it lies in (repo=...), or the file name without its ending."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.col("repo").cast("string") if "repo" in text.columns else F.regexp_replace(F.url_decode(name), "~", "/")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records (repo, value, position) of the logs in a folder, a file or a folder (repo=...) for each repository."""
    text = spark.read.option("lineSep", "\n" + MARK).text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select(_repo(text).alias("repo"), F.regexp_replace("value", f"^{MARK}", "").alias("value"), place.alias("position")).where("value <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (repo, file, block, row, value) of the logs in a folder; block and row order the lines of a file. Files are split inside of records."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(_repo(text).alias("repo"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


HEADER = ("sha", "date", "author", "email", "subject")


def _place(records: DataFrame) -> list[str]:
    """The place of a record in its log, if it is known."""
    return ["position"] if "position" in records.columns else []


def _headed(records: DataFrame) -> DataFrame:
    """Records with the fields of their first line; missing ones are empty.

    They come from a generator, so that later filters on them stay filters on columns.
    """
    return records.select("repo", *_place(records), "value", F.inline(F.array(_fields(F.substring_index("value", "\n", 1)))))


def _lines(value: Column) -> Column:
    return F.filter(F.split(F.substring(value, F.length(F.substring_index(value, "\n", 1)) + 2, 1 << 30), "\n"), lambda x: x != "")


def parse_numstat(records: DataFrame, params: Params | None = None) -> DataFrame:
    """Commit-file facts of (repo, value) records: bots, generated files and binary changes left out, renames resolved."""
    return _numstat(_headed(records).select("repo", *HEADER, F.explode(_lines(F.col("value"))).alias("line")), params or Params())


def _fields(head: Column) -> Column:
    """The fields of a commit's first line; missing ones are empty."""
    parts = F.split(head, "\t", 5)
    return F.struct(*(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(k) for i, k in enumerate(HEADER)))


def _carried_heads(lines: DataFrame, **more: Column) -> DataFrame:
    """Lines with `head`, the (value, block, row) of the last commit header up to them, and with more that is carried likewise; a block of a file at a time, and from the blocks before."""
    is_head = F.col("value").startswith(MARK)
    text = F.when(is_head, F.substring("value", len(MARK) + 1, 1 << 30))
    return carried(lines, "block", ["file"], ["row"], {"head": F.when(is_head, F.struct(text.alias("value"), "block", "row")), **more}).where("head is not null")


def numstat_of_lines(lines: DataFrame, params: Params | None = None) -> DataFrame:
    """What `parse_numstat` gives, of lines (repo, file, block, row, value); no commit is held as a whole."""
    body = _carried_heads(lines).where(~F.col("value").startswith(MARK) & (F.col("value") != ""))
    return _numstat(body.select("repo", F.col("value").alias("line"), F.inline(F.array(_fields(F.col("head.value"))))), params or Params())


def _place_of(batch: pa.RecordBatch, row: int) -> tuple[str, int]:
    return batch.column("file")[row].as_py(), batch.column("block")[row].as_py()


def _new_block(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows after the first lie in another block than the row before."""
    other = (pc.not_equal(x[1:], x[:-1]) for x in (batch.column("file"), batch.column("block")))
    return pc.or_(*other).to_numpy(zero_copy_only=False)


def _heads_in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of counts (repo, file, block, value) with the last header before them in their block; rows come in the order of the blocks, as they are read."""
    last, place = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value = batch.column("value")
        is_head = pc.starts_with(value, MARK).to_numpy(zero_copy_only=False)
        row = np.arange(n)
        new = np.append(_place_of(batch, 0) != place, _new_block(batch))
        at, begin = np.maximum.accumulate(np.where(is_head, row, -1)), np.maximum.accumulate(np.where(new, row, -1))
        # a block goes on from the batch before: its header stands behind the rows
        from_before = (at < 0) & (begin < 0)
        place = _place_of(batch, n - 1)
        text = pa.concat_arrays([value, pa.array([last], value.type)])
        at = pa.array(np.where(from_before, n, at), mask=(at < begin) & ~from_before)
        last = text[at[-1].as_py()].as_py() if at[-1].is_valid else None
        keep = np.flatnonzero(~is_head & pc.greater(pc.binary_length(value), 0).to_numpy(zero_copy_only=False))
        rows = batch.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*rows.columns, text.take(at.take(pa.array(keep)))], ["repo", "file", "block", "line", "head"])


def _last_heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last of the headers (file, block, value) of each block; rows come in the order of the blocks."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None and _place_of(held, 0) != _place_of(batch, 0):
            yield held
        ends = np.flatnonzero(_new_block(batch))
        if len(ends):
            yield batch.take(pa.array(ends))
        held = batch.slice(batch.num_rows - 1, 1)
    if held is not None:
        yield held


def numstat_of_files(spark: SparkSession, path: str, params: Params | None = None) -> DataFrame:
    """What `numstat_of_lines` gives of the lines that `read_lines` reads, and without shuffling them.

    A block is read by one task, in order, so headers are carried along its lines where they are
    read. The last header of each block, a row for many thousand lines, goes to the blocks after it.
    """
    read = read_lines(spark, path).select("repo", "file", "block", "value")
    lines = read.mapInArrow(_heads_in_blocks, "repo string, file string, block long, line string, head string")
    heads = read.where(F.col("value").startswith(MARK)).select("file", "block", "value").mapInArrow(_last_heads, "file string, block long, value string")
    # all blocks that lines lie in, so that those without a header have one before
    blocks = read.select("file", "block").distinct().join(heads, ["file", "block"], "left")
    before = F.last("value", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    met = lines.join(F.broadcast(blocks.select("file", "block", before.alias("before"))), ["file", "block"], "left").withColumn("head", F.coalesce("head", "before")).where("head is not null")
    return _numstat(met.select("repo", "line", F.inline(F.array(_fields(F.substring("head", len(MARK) + 1, 1 << 30))))), params or Params())


def _numstat(rows: DataFrame, p: Params) -> DataFrame:
    # parts and paths come from generators: a filter would work them out again for each pattern that it asks
    rows = rows.where(~C.is_bot(F.col("author"), p.ignore_authors)).select("repo", *HEADER, F.inline(F.array(F.struct(F.split("line", "\t", 3).alias("x")))))
    rows = rows.where(F.size("x") == 3).where("x[0] <> '-' and x[1] <> '-'")
    read = F.struct(C.resolve_rename(F.col("x")[2]).alias("path"), F.col("x")[0].try_cast("long").alias("added"), F.col("x")[1].try_cast("long").alias("deleted"))
    counts = rows.select("repo", *HEADER, F.inline(F.array(read)))
    return counts.where("added is not null and deleted is not null").where(~C.excluded(F.col("path"), p.exclude)).withColumn("churn", F.col("added") + F.col("deleted"))


def malformed(records: DataFrame) -> DataFrame:
    """(repo, sha, reason, line): what of the (repo, value) records cannot be read as a commit with counts, one row for each fault.

    reason: `no commit id`, `date is no time`, `not a line of counts`, `count is no number`. Lines
    of binary files (`-` for both counts) are sound. Facts never hold what stands here, except
    for lines of commits whose date is no time: windows leave those out.
    """
    # one pass: the records may cost much, and are not read once for headers and again for counts
    lines = _headed(records).select("repo", "sha", "date", F.posexplode_outer(F.split("value", "\n")).alias("nr", "line"))
    is_head = F.coalesce("nr", F.lit(0)) == 0
    fault = F.when(F.trim("sha") == "", "no commit id").when(F.try_to_timestamp("date").isNull(), "date is no time")
    parts = F.split("line", "\t", 3)
    number = lambda i: parts[i].try_cast("long").isNotNull()
    counts = F.when(F.size(parts) != 3, "not a line of counts").when(~((parts[0] == "-") & (parts[1] == "-")) & ~(number(0) & number(1)), "count is no number")
    return lines.select("repo", "sha", F.when(is_head, fault).when(F.col("line") != "", counts).alias("reason"), "line").where("reason is not null")


def parse_births(records: DataFrame, params: Params | None = None) -> DataFrame:
    """(repo, path, born) of (repo, value, position) records, newest first: the last in log order wins. Bots count."""
    p = params or Params()
    rows = records.select("repo", "position", F.substring_index("value", "\n", 1).alias("born"), F.explode(_lines(F.col("value"))).alias("path"))
    return rows.where(~C.excluded(F.col("path"), p.exclude)).groupBy("repo", "path").agg(F.max_by("born", "position").alias("born"))


def parse_line_counts(lines: DataFrame) -> DataFrame:
    """(repo, path, lines) of (repo, value) rows like HEAD:path:count; a path may hold colons."""
    part = lambda i: F.regexp_extract("value", r"^[^:]*:(.*):(\d+)$", i)
    return lines.where(F.col("value").rlike(r"^[^:]*:.*:\d+$")).select("repo", part(1).alias("path"), part(2).cast("long").alias("lines"))


# Fixed value: a hunk header of a unified diff.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$"


def _unquoted(path: Column) -> Column:
    """A path of a patch without the quotes and escapes (of bytes, in octal) that stand around unusual ones."""
    named = F.create_map(*(F.lit(x) for pair in (("\\a", "07"), ("\\b", "08"), ("\\t", "09"), ("\\n", "0A"), ("\\v", "0B"), ("\\f", "0C"), ("\\r", "0D"), ('\\"', "22"), ("\\\\", "5C")) for x in pair))
    parts = F.regexp_extract_all(F.regexp_extract(path, r'^"(.*)"$', 1), F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    octal = lambda x: F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0")
    bytes_ = F.transform(parts, lambda x: F.when(x.rlike(r"^\\[0-7]{3}$"), octal(x)).when(x.startswith("\\"), F.coalesce(F.try_element_at(named, x), F.hex(F.encode(F.substring(x, 2, 9), "UTF-8")))).otherwise(F.hex(F.encode(x, "UTF-8"))))
    return F.when(_quoted(path), F.decode(F.unhex(F.array_join(bytes_, "")), "UTF-8")).otherwise(path)


def _quoted(path: Column) -> Column:
    return path.startswith('"') & path.endswith('"') & (F.length(path) > 1)


def parse_hunks(records: DataFrame, params: Params | None = None) -> DataFrame:
    """A row for each hunk header of (repo, value) records, with their position if they have one; a missing count is 1. The path is that of the new file, of a deleted one that of the old."""
    p = params or Params()
    place = _place(records)
    files = _headed(records).where(~C.is_bot(F.col("author"), p.ignore_authors)).select("repo", *place, *HEADER, F.explode(F.split("value", "\n(?=diff --git )")).alias("part"))
    # no pattern meets the first line of a commit, and parts without hunks
    files = files.where(F.col("part").contains("\n@@ ") | F.col("part").startswith("@@ "))
    # names and paths come from generators: they are asked for many times and found once
    side = lambda mark: F.regexp_extract("part", rf"(?m)^{mark} (.*?)\t?$", 1)
    named = files.select("repo", *place, *HEADER, "part", F.inline(F.array(F.struct(side("---").alias("old"), side(r"\+\+\+").alias("new")))))
    paths = named.select("repo", *place, *HEADER, "part", F.inline(F.array(F.struct(_path(F.col("old"), F.col("new")).alias("path")))))
    lines = paths.select("repo", *place, *HEADER, "path", F.posexplode(F.filter(F.split("part", "\n"), lambda x: x.startswith("@@ "))).alias("hunk_no", "line"))
    return _hunks(lines, place)


def _path(old: Column, new: Column) -> Column:
    """The path of a patch from what stands behind --- and +++."""
    bare = lambda side, name: F.when(name.startswith(side), F.substring(name, 3, 1 << 30)).otherwise(name)
    of = lambda name: F.when(name == "/dev/null", bare("a/", _unquoted(old))).otherwise(bare("b/", name))
    return F.when(_quoted(new), of(_unquoted(new))).otherwise(of(new))


def _hunks(lines: DataFrame, place: list[str]) -> DataFrame:
    # one match for all of its parts; a line that is no header of a hunk stays as it is
    parts = F.split(F.regexp_replace("line", f"{HUNK[:-1]}(?s:.*)$", "$1\t$2\t$3\t$4\t$5"), "\t", 5)
    x = F.col("x")
    rows = lines.select(*(c for c in lines.columns if c != "line"), F.inline(F.array(F.struct(parts.alias("x")))))
    rows = rows.where(~x[0].startswith("@"))
    count = lambda i: F.when(x[i] == "", 1).otherwise(x[i].try_cast("long")).cast("long")
    return rows.select("repo", "path", "sha", "date", "author", "email", "subject", F.col("hunk_no").cast("long").alias("hunk_no"), F.trim(x[4]).alias("region"), count(1).alias("removed"), count(3).alias("added"), x[0].try_cast("long").alias("old_start"), x[2].try_cast("long").alias("new_start"), *place).withColumn("churn", F.col("added") + F.col("removed"))


def hunks_of_lines(lines: DataFrame, params: Params | None = None) -> DataFrame:
    """What `parse_hunks` gives, with positions, of lines (repo, file, block, row, value); no commit and no patch of a file is held as a whole.

    Only headers, the lines that begin a file's patch and hunk headers are shuffled. Lines of a
    hunk that look like `---` or `+++` follow a hunk header, those of a patch do not.
    """
    p = params or Params()
    v = F.col("value")
    told = lines.where(v.startswith(MARK) | v.startswith("diff --git ") | v.startswith("@@ ") | v.startswith("--- ") | v.startswith("+++ "))
    begins = v.startswith("diff --git ")
    seen = _carried_heads(told, last=F.when(begins, F.lit(0)).when(v.startswith("@@ ") | v.startswith(MARK), F.lit(1)), section=F.when(begins, F.struct("block", "row")))
    named = lambda mark: F.when((F.col("last") == 0) & v.startswith(mark), F.regexp_extract("value", rf"^.{{3}} (.*?)\t?$", 1))
    # only some of these lines go on, but all say what stands before those that do
    paths = carried(cut(seen), "block", ["file"], ["row"], {"old": named("--- "), "new": named("+++ ")})
    rows = paths.where(v.startswith("@@ ")).select("repo", F.struct("file", F.col("head.block").alias("block"), F.col("head.row").alias("row")).alias("position"), F.inline(F.array(_fields(F.col("head.value")))), "old", "new", v.alias("line"), "file", "section", "block", "row")
    rows = rows.where(~C.is_bot(F.col("author"), p.ignore_authors)).withColumn("path", _path(F.col("old"), F.col("new")))
    return _hunks(numbered_in(rows, "block", F.col("section.block"), ["file", "section"], [F.col("row")], "hunk_no"), ["position"])


def _hunks_in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hunk headers of lines (repo, file, block, row, value), with what their block says of their commit and patch, and a row without a line that says what each block ends with; rows come in the order of the blocks, as they are read.

    A section begins with a commit or with the patch of a file: its names stand before its first hunk, its hunks are counted from 0.
    """
    # of the block that goes on from the batch before: its last header, whether a section has begun, and of the last section its names and hunks
    place, said = None, None

    def ended() -> pa.RecordBatch:
        repo, file, block, *_ = place
        head, at, begun, old, new, n = said
        of = ([repo], [file], [block], [None], [None], [head], [block if at is not None else None], [at], [begun], [old], [new], [n])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(of, _IN_BLOCKS.types, strict=True)], schema=_IN_BLOCKS)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        repo, file, block, row, value = (batch.column(c) for c in ("repo", "file", "block", "row", "value"))
        at = np.arange(n)
        goes_on = place is not None and place[1:] == _place_of(batch, 0)
        if place is not None and not goes_on:
            yield ended()
        if not goes_on:
            said = (None, None, False, None, None, 0)
        edges = np.flatnonzero(_new_block(batch)) + 1
        begin = np.zeros(n, np.int64)
        begin[edges] = edges
        begin = np.maximum.accumulate(begin)
        is_ = lambda mark, value=value: pc.starts_with(value, mark).to_numpy(zero_copy_only=False)
        head, hunk = is_(MARK), is_("@@ ")
        section = head | is_("diff --git ")
        # n: from the rows before this batch, n + 1: not in this block
        none = np.where(begin == 0, n, n + 1)

        def last(which: np.ndarray, at: np.ndarray = at, begin: np.ndarray = begin, none: np.ndarray = none) -> np.ndarray:
            found = np.maximum.accumulate(np.where(which, at, -1))
            return np.where(found >= begin, found, none)

        heads, sections = last(head), last(section)
        hunks = np.cumsum(hunk)
        # hunks up to each row since the section, or the block, began
        before = np.append(np.where(section | (at == begin), hunks - hunk, 0), 0)
        since = hunks - np.where(sections < n, before[np.minimum(sections, n)], before[begin]) + np.where(sections == n, said[5], 0)
        begun = np.where(sections == n, said[2], sections < n)
        names = []
        for mark, held in (("--- ", said[3]), ("+++ ", said[4])):
            found = last(is_(mark) & (since == 0))
            # those of an earlier section are none
            of = np.where((found < n) & (sections < n) & (found < sections), n + 1, np.where((found == n) & (sections < n), n + 1, found))
            told = np.flatnonzero(np.bincount(of, minlength=n + 2)[:n])
            # only lines that are asked for meet the pattern
            text = [_NAME.match(x).group(1) for x in value.take(pa.array(told)).to_pylist()]
            texts = pa.array([*text, held, None], value.type)
            names.append(texts.take(pa.array(np.searchsorted(np.append(told, [n, n + 1]), of))))
        texts = pa.concat_arrays([pc.utf8_slice_codeunits(value, len(MARK)), pa.array([said[0], None], value.type)])
        rows_ = np.append(row.to_numpy(zero_copy_only=False), [0 if said[1] is None else said[1], 0])
        no_head = (heads == n + 1) | ((heads == n) & (said[0] is None))
        ends = np.append(edges, n) - 1

        def made(of: np.ndarray, line: pa.Array, no: np.ndarray, cols: tuple = (repo, file, block, row), heads: np.ndarray = heads, texts: pa.Array = texts, rows_: np.ndarray = rows_, no_head: np.ndarray = no_head, begun: np.ndarray = begun, names: list = names) -> pa.RecordBatch:
            pick = pa.array(of)
            r, f, b, w = (c.take(pick) for c in cols)
            arrays = [r, f, b, w, line, texts.take(pa.array(heads[of])), pa.array(b.to_numpy(), mask=no_head[of]), pa.array(rows_[heads[of]], mask=no_head[of]), pa.array(begun[of]), *(x.take(pick) for x in names), pa.array(no)]
            return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(arrays, _IN_BLOCKS.types, strict=True)], schema=_IN_BLOCKS)

        found = np.flatnonzero(hunk)
        yield made(found, value.take(pa.array(found)), since[found] - 1)
        if len(ends) > 1:
            yield made(ends[:-1], pa.nulls(len(ends) - 1, value.type), since[ends[:-1]])
        place = (repo[n - 1].as_py(), *_place_of(batch, n - 1))
        said = (None if no_head[-1] else texts[int(heads[-1])].as_py(), None if no_head[-1] else int(rows_[heads[-1]]), bool(begun[-1]), *(x[n - 1].as_py() for x in names), int(since[-1]))
    if place is not None:
        yield ended()


#: The name behind --- or +++, without what ends a line.
_NAME = re.compile("^.{4}([^\n\r\u0085\u2028\u2029]*?)\t?(?:$|[\n\r\u0085\u2028\u2029])", re.DOTALL)
_IN_BLOCKS = pa.schema([*((c, pa.string()) for c in ("repo", "file")), ("block", pa.int64()), ("row", pa.int64()), ("line", pa.string()), ("head", pa.string()), ("head_block", pa.int64()), ("head_row", pa.int64()), ("begun", pa.bool_()), ("old", pa.string()), ("new", pa.string()), ("no", pa.int64())])


def hunks_of_files(spark: SparkSession, path: str, params: Params | None = None) -> DataFrame:
    """What `parse_hunks` gives, with positions, of the logs in a folder. Lines are not shuffled, and written are hunks alone.

    A block is read by one task, in order, so headers and names are carried along its lines where they are read. What each
    block ends with, a row for many thousand lines, goes to the blocks after it.
    """
    p = params or Params()
    kinds = "repo string, file string, block long, row long, line string, head string, head_block long, head_row long, begun boolean, old string, new string, no long"
    found = cut(read_lines(spark, path).select("repo", "file", "block", "row", "value").mapInArrow(_hunks_in_blocks, kinds))
    along = Window.partitionBy("file").orderBy("block")
    # blocks in which no section begins belong to the last one that has begun
    ends = found.where("line is null").withColumn("section", F.sum(F.col("begun").cast("long")).over(along))
    inside = Window.partitionBy("file", "section").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("no").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({"was": F.coalesce(before, F.lit(0)), "n": F.sum("no").over(inside)})
    # names stand before the first hunk
    name = lambda c: F.last(F.when(F.col("was") == 0, F.col(c)), ignorenulls=True).over(inside)
    ends = ends.withColumns({"old_": name("old"), "new_": name("new"), "head_": F.last(F.when(F.col("head").isNotNull(), F.struct("head", "head_block", "head_row")), ignorenulls=True).over(along)})
    held = ends.select("file", "block", *(F.lag(c).over(along).alias(f"_{c}") for c in ("head_", "old_", "new_", "n")))
    met = found.where("line is not null").join(F.broadcast(held), ["file", "block"], "left")
    early = ~F.col("begun")
    named = lambda c: F.when(~early, F.col(c)).otherwise(F.coalesce(F.when(F.coalesce("_n", F.lit(0)) == 0, F.col(c)), f"_{c}_"))
    head = F.when(F.col("head").isNotNull(), F.struct("head", "head_block", "head_row")).otherwise(F.col("_head_"))
    told = met.select("repo", "file", "line", head.alias("head"), F.coalesce(named("old"), F.lit("")).alias("old"), F.coalesce(named("new"), F.lit("")).alias("new"), (F.col("no") + F.when(early, F.coalesce("_n", F.lit(0))).otherwise(0)).alias("hunk_no")).where("head is not null")
    rows = told.select("repo", F.struct("file", F.col("head.head_block").alias("block"), F.col("head.head_row").alias("row")).alias("position"), F.inline(F.array(_fields(F.col("head.head")))), "old", "new", "line", "hunk_no")
    rows = rows.where(~C.is_bot(F.col("author"), p.ignore_authors)).select("repo", "position", *HEADER, "line", "hunk_no", F.inline(F.array(F.struct(_path(F.col("old"), F.col("new")).alias("path")))))
    return _hunks(rows, ["position"])


def parse_touches(records: DataFrame) -> DataFrame:
    """(repo, path, start, end, sha, date) of (repo, path, start, end, value) records: which commits touched a range."""
    head = F.split(F.substring_index("value", "\n", 1), "\t")
    return records.select("repo", "path", "start", "end", head[0].alias("sha"), F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")).alias("date"))


def in_window(commits: DataFrame, as_of: str, months: int) -> DataFrame:
    """Commits of the last months before a moment, by author date; those whose date is no time are left out."""
    return commits.where(F.try_to_timestamp("date") >= F.add_months(F.to_timestamp(F.lit(as_of)), -months).cast("timestamp"))
