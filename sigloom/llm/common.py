"""Shared helpers: slices of Arrow batches, ranks, joins with hot keys, running folds and components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from sigloom.scratch import mark, release, table

#: Rows that a Python worker turns into objects at once. Spark bounds the bytes of the Arrow batch that they come in.
SLICE = 256
#: What a worker remembers between tasks, by what it serves.
_kept: dict[str, dict] = {}
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def kept(use: str) -> dict:
    """What this worker remembers between tasks for ``use``. A worker that turns to another use forgets the former one's, so an
    executor's idle workers do not hold on to stages that are over."""
    if use not in _kept:
        _kept.clear()
    return _kept.setdefault(use, {})


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, maximal runs without space and 0x09 to 0x0D, in a list for each stretch of about ``size``
    bytes, so that a very long text never stands whole as a list."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = SLICE) -> DataFrame:
    """``df`` mapped by ``f``, a slice of at most ``rows`` rows after the other. Columns stay Arrow arrays unless ``f``
    turns them into something else, so ids beside nulls keep every digit."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield f(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """For what is run inside: Arrow batches of ``rows`` rows at most, so that a task and its worker hold few texts at once.
    The session's own setting is back afterwards; a result that is run later has that one, and its bound of bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def ranks(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int = 64) -> DataFrame:
    """0-based rank of every row within ``keys``, without one task per key.

    Rows are numbered within (keys, part), the part being a hash of the order columns; the parts' counts, at most
    ``parts`` rows for each key, give each part its offset.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    by = [*keys, "_part"]
    counts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = dealt.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    return inside.join(offsets, by).withColumn(name, (F.col("_base") + F.col("_rn")).cast("long")).drop("_part", "_rn", "_base")


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row for each of ``keys`` and in ``n`` the number of its ``rows``.

    Keys with more than one in ``share`` of all rows are fewer than ``share``, so they are broadcast and their rows stay
    where they are; the others are shuffled, none of them being hot. Both sides are read twice: give written tables.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col(n) * share > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(n) * share <= total), keys)
    return rows.join(hot, keys).unionByName(rest)


def fold_running(parts: Column, start: Column, step: Callable[[Column, Column], Column], found: str, chunk: int = 512) -> Column:
    """``aggregate(parts, start, step)`` for steps that append to the array field ``found``, whose other field is ``at``.

    An append copies its array, so ``found`` starts anew in each ``chunk`` of parts and chunks are joined at the end:
    the work of a text with very many parts stays near their number.
    """
    empty = start[found]

    def whole(all_: Column) -> Column:
        def part(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(all_, k * chunk + 1, F.lit(chunk)), F.struct(acc["at"].alias("at"), empty.alias(found)), step)
            return F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(acc[found], x[found]).alias(found)))[0]

        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / chunk).cast("int"))
        return F.when(F.size(all_) <= chunk, F.aggregate(all_, start, step)).otherwise(F.aggregate(chunks, start, part))

    return F.transform(F.array(parts), whole)[0]  # ``parts`` is made once, though it is named often


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds, each a group-by whose hub lists never form: the minimum
    of a node's neighbours is aggregated map-side and joined back. Every round is written to the shared
    folder, and the one before it goes. No links give no rows.
    """
    spark = links.sparkSession
    since = mark(spark)
    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = table(small)
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        release(spark, since, keep=1)
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
