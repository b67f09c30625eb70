"""Helpers that several operators share: shared storage, filters of fixed size, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a membership filter; 2^27 bits are 16 MiB, whatever the size of the data.
FILTER_BITS = 27


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on this machine alone may be without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows that a Python worker gets at once where texts are read: they are a few kB each, so the usual 10,000 would be tens of MB, several times over.
BATCH_ROWS = 1000


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """Small batches, and shuffle files that go when what they were for is written, not when the driver happens to collect its garbage."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    usual = {key: spark.conf.get(key) for key in ours}
    try:
        for key, value in ours.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `stored` has written of tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = table.__dict__.pop("stored_at", None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The documents, with all their columns, whose id a table (id) does not name. Columns may have any names; rows without an id stay."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(ids, "id", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


class Filter:
    """A Bloom filter with one hash: says of a 64-bit number whether it may be a member."""

    def __init__(self, words: np.ndarray, shift: int) -> None:
        self.words, self.shift = words, np.uint64(shift)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bit = x >> self.shift
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def membership(df: DataFrame, column: str, most_bits: int = FILTER_BITS) -> Filter:
    """A filter for a column of well-mixed longs, of 16 bits a member up to a fixed size.

    Spark sets the bits; the driver receives 2^most_bits bits at most, with their positions.
    A fuller filter lets more pass that an exact join afterwards has to drop; it never
    refuses a member.
    """
    n = df.count()
    bits = min(most_bits, max(12, (16 * n).bit_length()))
    bit = F.shiftrightunsigned(F.col(column), 64 - bits)
    got = (
        df.groupBy(F.shiftright(bit, 6).alias("at"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")).alias("set"))
        .toArrow()
    )
    words = np.zeros(1 << max(0, bits - 6), np.uint64)
    words[got.column("at").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return Filter(words, 64 - bits)


#: A key that holds more than one in HOT of all rows is joined by broadcast; there are less than HOT of them.
HOT = 2000


def hot_keys(keys: DataFrame, n: str = "n") -> DataFrame:
    """Of distinct keys with the number of rows of each, those that hold more than one in HOT of all rows: fewer than HOT, so they can be broadcast."""
    total = keys.agg(F.sum(n)).first()[0] or 0
    return keys.where(F.col(n) * HOT > F.lit(total))


def count_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """An inner join with a table of distinct keys and the number of rows that each has on the left.

    Hot keys are broadcast, so none of them gathers its rows in one task; the others are
    shuffled. Both sides are read twice.
    """
    hot = F.broadcast(hot_keys(right, n))
    cold = right.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def components(links: DataFrame, vertex: str = "doc_id", label: str = "component_id", name: str = "components") -> DataFrame:
    """The smallest vertex reachable from each vertex of a table of links (a, b).

    Alternates large-star and small-star steps (Kiveris et al. 2014), each of which is a
    grouping and a join; the driver sees one checksum a round. Vertices without links are
    not in the result.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stored(links.select("a", "b").where("a <> b").distinct(), name)
    last = None
    for _ in range(60):
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        edges = stored(
            small.select(F.col("m").alias("a"), F.col("u").alias("b")).union(small.select(F.col("m").alias("a"), F.col("v").alias("b"))).where("a <> b").distinct(),
            name,
        )
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle in 60 rounds")
    return edges.groupBy(F.col("b").alias(vertex)).agg(F.min("a").alias(label)).union(edges.select("a", "a").distinct())
