"""Hunks of old commits in the line numbers of today, so that bands can be counted from a patch log.

A commit maps the lines of a file before it to lines after it. Ranges are kept by their
ends: the first line moves by one monotone function, the last by another. Outside of hunks
both shift by what the hunks before added and removed; inside of what a hunk replaces the
first line goes to the first new line and the last to the last one. Where nothing new stands
the range turns round (it ends before it begins): it lies between two lines, and a band is
touched if it holds both.

Hunks are dealt out by ranges of file and commit, newest first, so a task has whole files and a
part of at most two others. It goes through them in batches and composes the functions of
neighbouring commits of a file in pairs, then in fours, then in eights, for all files of a batch at
once; touches of the older half of a pair go through the newer half. What a batch makes of a file
stands before the next batch as one commit more. A file in one range and of no more than a block
of commits is done then. Of the others, functions of blocks that follow each other are composed
pairwise, two blocks, then four, then eight, so a touch goes through all later blocks of its file
in as many steps as their number has binary digits. A step is one ordered pass over the pieces of
two neighbouring blocks of commits and the touches between them; a file of any size is spread over
ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lineage import cut
from .ordered import running_last

FILE = ["repo", "path"]
PIECE, IMAGE, TOUCH = 0, 1, 2
#: Commits of a block, as a power of two.
BLOCK = 16
#: Hunks that a range should have at most.
RANGE = 500_000


def _rows(hunks: DataFrame) -> tuple[DataFrame, int]:
    """Hunks with their ranges [old, old + removed) and [new, new + added) and one position for each commit of a file, the first of those it is given at; and how many there are."""
    start = lambda line, n: F.col(line) + F.when(F.col(n) == 0, 1).otherwise(0)  # noqa: E731  without lines the header names the line before
    known = hunks.select(*FILE, "sha", "date", "position", start("old_start", "removed").alias("old"), "removed", start("new_start", "added").alias("new"), "added")
    rows = cut(known.dropna(subset=[*FILE, "sha", "old", "removed", "new", "added"]))
    # hashes of positions, as a minimum of texts sorts its rows
    at = F.xxhash64("position")
    commits = rows.groupBy("repo", "sha").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))
    n, again = commits.agg(F.sum("n"), F.count_if(F.col("low") != F.col("high"))).first()
    if again:
        several = commits.where("low <> high").select("repo", "sha")
        first = F.min("position").over(Window.partitionBy(*FILE, "sha"))
        rows = cut(rows.join(several, ["repo", "sha"], "left_anti").unionByName(rows.join(several, ["repo", "sha"], "left_semi").withColumn("position", first)))
    return rows, n or 0


def _task(block: int, arrow: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its range of hunks; all of it inside of this function, so that it travels with it and workers need no package.

    Functions are pieces in five arrays: node (a commit, or several), first line, whether all of the piece goes to one place, and where
    its first line goes as the first and as the last line of a range. Pieces are in order of node and line; a node's first one begins at 0.
    """

    def pieces_of(commit: np.ndarray, old: np.ndarray, removed: np.ndarray, new: np.ndarray, added: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
        """Functions of commits, whose hunks are in order."""
        first = np.append(True, commit[1:] != commit[:-1])
        # where hunks overlap, which no diff has, the later begins behind the one before
        behind = np.maximum.accumulate(commit * wide + old + removed) - commit * wide
        shift = new + added - old - removed
        before, moved = np.append(0, behind[:-1]), np.append(0, shift[:-1])
        before[first] = moved[first] = 0
        begin = np.maximum(old, before)
        three = lambda a, b, c: np.stack([a, b, c], axis=1).ravel()  # noqa: E731  lines before a hunk, the hunk, lines behind the last one
        is_ = three(before < begin, begin < behind, np.append(first[1:], True))
        no = np.zeros(len(old), bool)
        return tuple(
            x[is_]
            for x in (np.repeat(commit, 3), three(before, begin, behind), three(no, ~no, no), three(before + moved, new, behind + shift), three(before + moved, new + added - 1, behind + shift))
        )

    def composed(pieces: tuple[np.ndarray, ...], count: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, wide: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """One function for each group of count nodes that follow each other, the newest first; and where the touches of nodes go through all newer nodes of their group."""
        low, high = low.copy(), high.copy()
        while (count > 1).any():
            group = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
            older = at & 1 == 1
            alone = ~older & (at == count[group] - 1)
            count = (count + 1) // 2
            pair = (np.cumsum(count) - count)[group] + (at >> 1)
            first = older | alone
            is_first = first[pieces[0]]
            then = [x[~is_first] for x in pieces]
            key = pair[then[0]] * wide + then[1]

            def through(ends: np.ndarray, line: np.ndarray, i: np.ndarray, then: list = then) -> np.ndarray:
                return ends[i] + np.where(then[2][i], 0, line - then[1][i])

            t = np.flatnonzero(older[node])
            base = pair[node[t]] * wide
            for ends, line in ((then[3], low), (then[4], high)):
                line[t] = through(ends, line[t], np.searchsorted(key, base + line[t], "right") - 1)
            node = pair[node]

            own, begin, fixed, lows, highs = (x[is_first] for x in pieces)
            single, base = alone[own], pair[own] * wide
            end = np.append(np.where(own[1:] == own[:-1], begin[1:], wide - 1), wide - 1)
            i = np.searchsorted(key, base + lows, "right") - 1
            j = np.searchsorted(key, base + np.minimum(lows + end - begin, wide - 1), "left")
            n = np.where(single | fixed, 1, j - i)
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            of = i[row] + nth
            cut_at = np.where(nth == 0, lows[row], then[1][of])
            made = [pair[own][row], begin[row] + cut_at - lows[row], then[2][of], through(then[3], cut_at, of), through(then[4], cut_at, of)]
            place = np.cumsum(n) - n
            x = np.flatnonzero(fixed & ~single)
            made[2][place[x]] = True
            made[4][place[x]] = through(then[4], highs[x], np.searchsorted(key, base[x] + highs[x], "right") - 1)
            x = np.flatnonzero(single)
            for k, was in ((2, fixed), (3, lows), (4, highs)):
                made[k][place[x]] = was[x]
            # pieces that go on as the one before are no pieces
            a, b = [x[:-1] for x in made], [x[1:] for x in made]
            same = np.where(a[2], (a[3] == b[3]) & (a[4] == b[4]), a[3] - a[1] == b[3] - b[1])
            keep = np.append(True, (a[0] != b[0]) | (a[2] != b[2]) | ~same)
            pieces = tuple(x[keep] for x in made)
        return pieces, low, high

    def lifted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        # of the file that the rows before end in: its name, whether it is the first of the range, its commits, and the function of its newest block
        name, is_first, done, later = None, True, 0, None

        def table(n: int, **columns: object) -> pa.RecordBatch:
            made = lambda x, t: x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t)
            return pa.RecordBatch.from_arrays([made(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def function(of: tuple[str, str], nth: int, pieces: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            _, begin, fixed, low, high = pieces
            n, less = len(begin), np.where(fixed, 0, begin)
            last = np.append(begin[1:], 1 << 60)
            return table(n, repo=[of[0]] * n, path=[of[1]] * n, start=low - less, end=high - less, part=np.full(n, part), nth=np.full(n, nth), begin=begin, stop=last, fixed=fixed)

        def gone_through(rows: pa.RecordBatch, commit: np.ndarray, new_file: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Touches of whole commits, numbered from 0, and functions of blocks that others follow."""
            nonlocal name, is_first, done, later
            old, removed, new, added = (rows.column(c).to_numpy() for c in ("old", "removed", "new", "added"))
            begins = np.flatnonzero(np.append(True, commit[1:] != commit[:-1]))
            opens = new_file[begins]
            file = np.cumsum(opens)
            # commits of their file before them, those of rows before for the file that goes on
            start = np.append(0, np.flatnonzero(opens))
            nth = np.arange(len(begins)) - start[file] + np.where(file == 0, done, 0)
            new_group = opens | (nth & ((1 << block) - 1) == 0)
            new_group[0] |= later is None
            count = np.diff(np.append(np.flatnonzero(np.append(True, new_group[1:])), len(begins)))
            goes_on = not new_group[0]
            wide = 2 + int(max((old + removed).max(), (new + added).max())) + int((removed + added).sum())
            if goes_on:
                count[0] += 1
                wide += int(max(x.max() for x in later[1:]))
            pieces = pieces_of(commit + goes_on, old, removed, new, added, wide)
            if goes_on:
                pieces = tuple(np.concatenate(x) for x in zip(later, pieces, strict=True))
            pieces, low, high = composed(pieces, count, commit + goes_on, new, new + added - 1, wide)
            if later is not None and new_group[0] and not opens[0]:
                yield function(name, (done - 1) >> block, later)
            first_of = np.append(np.flatnonzero(np.append(True, new_group[1:])), len(begins))
            turns = np.flatnonzero(~opens[first_of[1:-1]])
            if len(turns):
                edges = np.searchsorted(pieces[0], np.arange(len(count) + 1))
                for g in turns:
                    row = int(begins[first_of[g]])
                    yield function((rows.column("repo")[row].as_py(), rows.column("path")[row].as_py()), int(nth[first_of[g]]) >> block, tuple(x[edges[g] : edges[g + 1]] for x in pieces))
            blocks = nth[commit] >> block
            is_open = (blocks > 0) | (is_first & (file[commit] == 0))
            yield table(rows.num_rows, **{c: rows.column(c) for c in ("repo", "path", "sha", "date")}, start=low, end=high, part=pa.array(np.full(rows.num_rows, part), mask=~is_open), nth=pa.array(blocks, mask=~is_open))
            is_first = is_first and not opens.any()
            name = tuple(rows.column(c)[rows.num_rows - 1].as_py() for c in ("repo", "path"))
            done = int(nth[-1]) + 1
            last = pieces[0] == len(count) - 1
            later = (np.zeros(int(last.sum()), np.int64), *(x[last] for x in pieces[1:]))

        def whole(rows: pa.RecordBatch, end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            other = lambda c: pc.not_equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy(zero_copy_only=False)
            new_file = other("repo") | other("path")
            new_commit = new_file | other("sha")
            new_row = new_commit | other("old") | other("removed") | other("new") | other("added")
            new_file, new_commit, new_row = (np.append(True, x) for x in (new_file, new_commit, new_row))
            new_file[0] = name != (rows.column("repo")[0].as_py(), rows.column("path")[0].as_py()) and name is not None
            n = rows.num_rows if end else int(np.flatnonzero(new_commit)[-1])
            held = rows.slice(n)
            if not n:
                return
            commit = np.cumsum(new_commit[:n]) - 1
            # a row that is given twice counts once; its file and commit begin with the first
            keep = np.flatnonzero(new_row[:n])
            rows, commit, new_file = (rows.slice(0, n) if len(keep) == n else rows.take(pa.array(keep))), commit[keep], new_file[:n][keep]
            # nodes and lines are one number in searches: so many commits at once that it has 62 bits
            reach = 2 + sum(f(rows.column(c)).as_py() for f, c in ((pc.max, "old"), (pc.max, "new"), (pc.sum, "removed"), (pc.sum, "added"))) * 2 + (int(max(x.max() for x in later[1:])) if later else 0)
            most = max(1, (1 << 60) // reach - 2)
            for begin in range(0, int(commit[-1]) + 1, most):
                a, b = np.searchsorted(commit, [begin, begin + most])
                yield from gone_through(rows.slice(a, b - a), commit[a:b] - begin, new_file[a:b])

        for batch in batches:
            if batch.num_rows:
                yield from whole(batch if held is None or not held.num_rows else pa.concat_batches([held, batch]), False)
        if held is not None and held.num_rows:
            yield from whole(held, True)
            # the file may go on in the next range
            yield function(name, (done - 1) >> block, later)

    return lifted


def _through(piece: str, line: Column) -> Column:
    """Where a function puts a line: by the piece that it lies in, and as it is without one."""
    return F.when(F.col(piece).isNull(), line).when(F.col(f"{piece}.fixed"), F.col(f"{piece}.value")).otherwise(line + F.col(f"{piece}.value"))


def lift(hunks: DataFrame) -> DataFrame:
    """(repo, path, start, end, sha, date): what each commit touched, in the line numbers after the newest commit.

    Args:
        hunks: (repo, path, sha, date, position, old_start, removed, new_start, added) of all
            commits, newest first by position, those of automation too, as `logs.parse_hunks`
            gives them for records with positions and no ignored authors.

    A range that later commits put lines into stays one range, with those lines; git's own line
    log would cut it in two there. A range whose lines are all gone ends before it begins. A
    rename begins a new file. Each (commit, hunk) has one row, also if it is given twice; a file's history may have any
    number of commits and hunks.
    """
    rows, n = _rows(hunks)
    # a commit of a file lies in one range
    by = [*(F.col(c) for c in FILE), F.col("position"), F.desc("sha")]
    parts = -(-n // RANGE)
    dealt = rows.repartitionByRange(parts, *by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*by)
    schema = StructType(rows.select(*FILE, "sha", "date").schema.fields)
    for name, kind in (("start", "long"), ("end", "long"), ("part", "long"), ("nth", "long"), ("begin", "long"), ("stop", "long"), ("fixed", "boolean")):
        schema = schema.add(name, kind)
    made = cut(dealt.sortWithinPartitions(*by, "old", "new", "removed", "added").select(*FILE, "sha", "date", "old", "removed", "new", "added").mapInArrow(_task(BLOCK, to_arrow_schema(schema)), schema))
    touch = made.where("begin is null").select(*FILE, "start", "end", "sha", "date", "part", "nth")
    # blocks of files that have several, the oldest 0; commits counts them
    file = Window.partitionBy(*FILE)
    blocks = made.where("part is not null").select(*FILE, "part", "nth").distinct()
    blocks = cut(blocks.withColumn("commits", F.count("*").over(file)).withColumn("block", F.row_number().over(file.orderBy(F.desc("part"), F.desc("nth"))) - 1).where("commits > 1"))
    most = blocks.agg(F.max("commits")).first()[0] or 0
    if not most:
        return touch.drop("part", "nth")
    key = [*FILE, "part", "nth"]
    ready = touch.join(F.broadcast(blocks), key, "left_anti").select(*FILE, "start", "end", "sha", "date")
    touch = cut(touch.join(F.broadcast(blocks), key).withColumn("id", F.monotonically_increasing_id()))
    sides = lambda low, high, name: F.explode(F.map_from_arrays(F.array(F.lit("low"), F.lit("high")), F.array(low, high))).alias("side", name)
    pieces = made.where("begin is not null").join(F.broadcast(blocks), key).select(*FILE, "commits", "block", "begin", F.col("stop").alias("end"), "fixed", sides("start", "end", "value"))
    points = touch.select(*FILE, "commits", "id", (F.col("block") + 1).alias("next"), sides("start", "end", "line"))
    done, level = None, 0
    key = [*FILE, "side", "pair"]
    while (1 << level) < most:
        step = 1 << level
        # a touch whose next block begins an odd group goes through that group now
        now = F.shiftright("next", level).bitwiseAND(1) == 1
        at_end = points.where("next >= commits").select("id", "side", "line")
        done = at_end if done is None else done.unionByName(at_end)
        open_ = points.where("next < commits")
        pair, odd = F.shiftright("block", 1), F.col("block").bitwiseAND(1) == 1
        image = F.when(F.col("fixed"), F.col("value")).otherwise(F.col("begin") + F.col("value"))
        held = F.struct("begin", "end", "fixed", "value")
        none = lambda t: F.lit(None).cast(t)
        rows = (
            pieces.select(*FILE, "side", "commits", pair.alias("pair"), F.when(odd, F.col("begin")).otherwise(image).alias("line"), F.when(odd, PIECE).otherwise(IMAGE).alias("role"), F.col("begin").alias("tie"), held.alias("piece"), none("long").alias("id"), none("long").alias("next"))
            .unionByName(open_.where(now).select(*FILE, "side", "commits", F.shiftright("next", level + 1).alias("pair"), "line", F.lit(TOUCH).alias("role"), F.col("id").alias("tie"), none("struct<begin:long,end:long,fixed:boolean,value:long>").alias("piece"), "id", "next"))
        )
        role = F.col("role")
        seen = cut(running_last(rows, key, ["line", "role", "tie"], {"second": F.when(role == PIECE, F.col("piece")), "first": F.when((role == IMAGE) & ~F.col("piece.fixed"), F.col("piece"))}))
        moved = seen.where(role == TOUCH).select(*FILE, "commits", "id", (F.col("next") + step).alias("next"), "side", _through("second", F.col("line")).alias("line"))
        # composed pieces: each of the first block up to where the second changes, and from each change inside a shift of the first on
        d, s, f = F.col("piece.value"), F.col("second"), F.col("first")
        rest = F.least(F.col("piece.end"), F.when(F.col("piece.fixed") | s.isNull(), F.col("piece.end")).otherwise(s["end"] - d))
        fixed = F.col("piece.fixed") | F.coalesce(s["fixed"], F.lit(False))
        whole = seen.where(role == IMAGE).select(
            *FILE, "side", "commits", F.col("pair").alias("block"), F.col("piece.begin").alias("begin"), rest.alias("end"), fixed.alias("fixed"),
            F.when(F.col("piece.fixed"), _through("second", d)).when(fixed, s["value"]).otherwise(d + F.coalesce(s["value"], F.lit(0))).alias("value"),
        )
        begin = F.col("piece.begin") - f["value"]
        inner = seen.where((role == PIECE) & f.isNotNull() & (begin > f["begin"]) & (begin < f["end"])).select(
            *FILE, "side", "commits", F.col("pair").alias("block"), begin.alias("begin"), F.least(f["end"], F.col("piece.end") - f["value"]).alias("end"), F.col("piece.fixed").alias("fixed"),
            F.when(F.col("piece.fixed"), d).otherwise(f["value"] + d).alias("value"),
        )
        points = open_.where(~now).unionByName(moved)
        # functions of more blocks are only needed where a file has more
        pieces = whole.unionByName(inner).where(F.col("commits") > 2 * step)
        level += 1
    left = points.select("id", "side", "line")
    ends = (left if done is None else done.unionByName(left)).groupBy("id").agg(F.max(F.when(F.col("side") == "low", F.col("line"))).alias("start"), F.max(F.when(F.col("side") == "high", F.col("line"))).alias("end"))
    return ready.unionByName(touch.drop("start", "end").join(ends, "id").select(*FILE, "start", "end", "sha", "date"))
