"""Chat formatting: quotations linked to their messages, replies in order.

A line that begins with quote marks ('>', with blanks between) quotes at that depth. Lines
of one depth that follow each other are a passage. A passage is normalised (marks, case,
white space and punctuation at its ends go) and hashed; so is every line and the whole own
text of every message. A join on (conversation, hash) finds the latest earlier message
whose own text a passage or one of its lines repeats, however short; the longest text that
is found decides, so a common short line counts only if nothing longer leads to a message.
The least deeply quoted linked passage names the parent;
messages without one reply to the message before them. Own text is what is not quoted.

Every step is a DataFrame expression: lines are exploded, grouped and joined by
conversation and hash, never by conversation alone. A path of turns puts replies in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def _plain(text: Column) -> Column:
    """Lower case, white space as one blank, no punctuation or blanks at the ends."""
    spaced = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.regexp_replace(spaced, r"^[\s\p{P}]+|[\s\p{P}]+$", "")


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def messages(turns: DataFrame) -> DataFrame:
    """Each turn with the text that is its own and its quoted passages (depth, text)."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")
    marks = lambda x: F.regexp_extract(x, r"^[ \t]*((?:>[ \t]?)*)", 1)
    depth = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    # only texts with a quoting line are parsed
    quotes = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]*>")
    parsed = turns.withColumn("lines", F.when(quotes, F.transform(line, lambda x: F.struct(depth(x).alias("depth"), F.when(depth(x) > 0, F.regexp_replace(x, r"^[ \t]*(?:>[ \t]?)+", "")).otherwise(x).alias("text")))))
    # where the depth changes, a passage begins; each line is copied into its passage once
    size, at = F.size("lines"), lambda i: F.element_at("lines", i)["depth"]
    parsed = parsed.withColumn("starts", F.when(F.col("lines").isNotNull(), F.filter(F.sequence(F.lit(1), size), lambda i: F.when(i == 1, True).otherwise(at(i) != at(F.greatest(i - 1, F.lit(1)))))))
    parsed = parsed.withColumn("spans", F.zip_with("starts", F.concat(F.slice(F.col("starts"), F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(size + 1)), lambda x, y: F.struct(x.alias("a"), y.alias("b"))))
    passage = lambda x: F.struct(at(x["a"]).alias("depth"), F.array_join(F.transform(F.slice(F.col("lines"), x["a"], x["b"] - x["a"]), lambda k: k["text"]), "\n").alias("text"))
    parsed = parsed.withColumn("passages", F.transform("spans", passage))
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["depth"] == 0), lambda p: p["text"]), "\n")
    return (
        parsed.withColumn("body", F.when(F.col("passages").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.regexp_replace(own, r"^\s+|\s+$", "")))
        .withColumn("quoted", F.coalesce(F.filter("passages", lambda p: p["depth"] > 0), F.array().cast("array<struct<depth:int,text:string>>")))
        .drop("passages", "spans", "starts", "lines")
    )


def link(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply-ordered messages without quotes.

    Returns conv_id, turn, role, body (own text), n_quotes (quoted passages), n_linked (of
    them with an earlier message), parent_turn (null for a first message), thread (turn of
    the message that the replies go back to by quotation), depth (quotation links to it) and
    path (the turns from there to this one): a row for each row. The order conv_id, path puts
    each reply under what it quotes, and replies to one message in the order of their turns.
    A message carries as many numbers as stand above it.

    A null text is an empty one; null conversations or turns keep their row, link to nothing
    and are linked by nothing. Repeated rows stay; of equal texts the latest earlier turn is
    the parent. A conversation may be of any size: no step gathers one.
    """
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    parsed = stored(messages(turns), "messages")
    named = parsed.where("conv_id is not null and turn is not null")

    quotes = named.where(F.size("quoted") > 0).select("conv_id", "turn", F.posexplode("quoted").alias("nr", "q")).select("conv_id", "turn", "nr", F.col("q.depth").alias("depth"), F.explode(_parts("q.text")).alias("part"))
    quotes = quotes.where("part <> ''").withColumn("hash", _hash(F.col("part"))).withColumn("size", F.length("part")).drop("part").distinct()
    asked = quotes.select("conv_id", "hash").distinct()
    sources = named.select("conv_id", "turn", F.explode(_parts("body")).alias("part")).where("part <> ''").select("conv_id", F.col("turn").alias("source"), _hash(F.col("part")).alias("hash")).distinct()
    sources = sources.join(asked, ["conv_id", "hash"], "left_semi")
    found = (
        quotes.join(_latest(quotes, sources), ["conv_id", "hash", "turn"])
        .groupBy("conv_id", "turn", "nr", "depth")
        .agg(F.max(F.struct("size", "source"))["source"].alias("source"))
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("depth", (-F.col("source")).alias("back"))).alias("near"), F.count("*").alias("n_linked"))
        .select("conv_id", "turn", (-F.col("near.back")).alias("parent"), "n_linked")
    )
    found = stored(found, "links")
    roots = _roots(found.select("conv_id", "turn", "parent"))

    before = named.select("conv_id", "turn").distinct()
    before = _previous(before)
    out = parsed.join(found, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    thread = F.coalesce("root", "turn")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("parent", "previous").alias("parent_turn"),
        thread.alias("thread"),
        F.coalesce("steps", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.coalesce("chain", F.array().cast("array<long>")), F.array("turn")).alias("path"),
    )


def _parts(text: str) -> Column:
    """The normalised whole and lines of a text. A whole of nothing but marks and blanks is its marks."""
    whole = F.when(_plain(F.col(text)) == "", F.regexp_replace(F.col(text), r"\s+", "")).otherwise(_plain(F.col(text)))
    return F.array_distinct(F.concat(F.array(whole), F.transform(F.split(F.col(text), "\n"), _plain)))


def _latest(quotes: DataFrame, sources: DataFrame, span: int = 1024) -> DataFrame:
    """The latest source before each turn that asks for a hash, by windows over spans of turns: no pairs of all quotes and sources of a common line."""
    from pyspark.sql import Window

    key = ["conv_id", "hash"]
    turns = quotes.select(*key, "turn", F.lit(None).cast("long").alias("source")).union(sources.select(*key, F.col("source").alias("turn"), "source"))
    placed = turns.groupBy(*key, "turn").agg(F.max("source").alias("source")).withColumn("span", F.floor(F.col("turn") / span))
    last = lambda x, by, at: F.last(x, True).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    inner = placed.withColumn("near", last("source", [*key, "span"], "turn"))
    ends = placed.groupBy(*key, "span").agg(F.max("source").alias("end")).withColumn("far", last("end", key, "span")).drop("end")
    return inner.join(ends, [*key, "span"]).select(*key, "turn", F.coalesce("near", "far").alias("source")).where("source is not null")


def _previous(turns: DataFrame, span: int = 1024) -> DataFrame:
    """The turn before each distinct turn of its conversation, by windows over spans of turns.

    A window holds one span of one conversation; the last turn of the nearest earlier span
    comes from a window over the spans, of which there are far fewer.
    """
    from pyspark.sql import Window

    placed = turns.withColumn("span", F.floor(F.col("turn") / span))
    inner = placed.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn")))
    ends = placed.groupBy("conv_id", "span").agg(F.max("turn").alias("last")).withColumn("far", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span"))).drop("last")
    return inner.join(ends, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("near", "far").alias("previous"))


def _roots(links: DataFrame) -> DataFrame:
    """The message that chains of parents end in, the steps to it and the turns of the chain, by pointer doubling."""
    now = stored(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("steps"), F.array("parent").alias("chain")), "roots")
    if not now.head(1):
        return now
    for _ in range(64):
        more = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("steps").alias("extra"), F.col("chain").alias("above"))
        both = now.join(more, ["conv_id", "root"], "left")
        chain = F.when(F.col("up").isNull(), F.col("chain")).otherwise(F.concat("above", "chain"))
        nxt = stored(both.select("conv_id", "turn", F.coalesce("up", "root").alias("root"), (F.col("steps") + F.coalesce("extra", F.lit(0))).alias("steps"), chain.alias("chain"), F.col("up").isNotNull().alias("moved")), "roots")
        if not nxt.where("moved").head(1):
            break
        now = nxt.drop("moved")
    return nxt.drop("moved")
