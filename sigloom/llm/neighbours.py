"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes are signs after rotations fitted on a bounded sample, so that they lose least (iterative quantisation); more
bits than dimensions come from several rotations. A code is split into 16-bit substrings, each an index of a shard's
codes. Two codes within Hamming radius r agree to within r // substrings bits on some substring, so probing the
buckets of that smaller radius retrieves every code within r. A query probes radius after radius until enough codes are
sure to be its nearest ones; those are ranked again by their vectors.

Codes and ids alone are dealt to a grid of shards and blocks of queries. Vectors travel once, to the candidates that are
left. Equal vectors are one until the end, each with the ids it can need, so a vector in a third of all rows is one row.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigloom.llm.common import map_slices
from sigloom.scratch import mark, release, table

#: Rows in the sample for rotations; bits of a code; codes ranked again for each neighbour wanted.
SAMPLE, BITS, WIDER = 8_192, 512, 16
#: Codes of a shard and queries of a block at most: a cell of the grid is their product.
SHARD, BLOCK = 65_536, 16_384
#: Queries that an index is built for at least, and the share of the usual margin that a shard's first answer has.
ASKS, MARGIN = 16, 1.0
#: The radius from which the buckets that hold a code are listed.
LISTED = 3
#: Bytes of query vectors that may be broadcast; beyond them they are shuffled.
BROADCAST = 32 << 20
#: The 16-bit masks by their number of ones.
MASKS = [np.flatnonzero(np.bitwise_count(np.arange(65536)) == k).astype(np.int64) for k in range(17)]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): vectors that are not null or zero and hold no null, NaN or infinity, of the commonest length."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    found = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    size = found.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return found.where(F.size("v") == (size["size"] if size else 0))


def _lift(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order inner products: candidates are padded to the longest, queries are scaled.

    A query has no part in the padding, so its sign is free: a hash of the vector, which keeps the padding from leaning
    codes to one side. Queries are divided by their largest component first, so squares stay finite.
    """
    if query:
        x = x / np.abs(x).max(1, keepdims=True)
        return np.hstack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))))
    sign = np.where((np.ascontiguousarray(x).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(1) >> np.uint64(63), 1.0, -1.0)
    x = x / longest
    return np.hstack((x, sign[:, None] * np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))))


def rotations(x: np.ndarray, bits: int = BITS, turns: int = 25, seed: int = 3) -> np.ndarray:
    """(dimensions + 1, bits): rotations that bring the sample's directions nearest to their signs, from several random
    starts. The padding is learned as one more coordinate of common size: as the largest it would fill every bit."""
    rng, out = np.random.default_rng(seed), []
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.hstack((x, rng.normal(size=(len(x), 1)) / np.sqrt(x.shape[1])))
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(turns):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return np.hstack(out)[:, :bits]


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(rows, substrings) of 16 bits each."""
    return np.packbits(x @ rotation >= 0, axis=1).view(np.uint16)


class Index:
    """The codes of a shard, with a table of buckets for each substring, one after the other."""

    def __init__(self, have: np.ndarray):
        self.have, (n, self.m) = have, have.shape
        bucket = (have.astype(np.int64) + np.arange(self.m) * 65536).T.ravel()
        self.rows = (np.argsort(bucket, kind="stable") % max(1, n)).astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=self.m * 65536)))).astype(np.int64)
        self.full = np.flatnonzero(np.diff(self.start))  # buckets that hold a code, by substring
        self.each = np.diff(np.searchsorted(self.full, np.arange(self.m + 1) * 65536))
        self.words = np.ascontiguousarray(have).view(np.uint64) if self.m % 4 == 0 else have

    def held(self, at: np.ndarray) -> np.ndarray:
        """Rows in the buckets ``at``."""
        lo = self.start[at]
        n = self.start[at + 1] - lo
        full = n > 0
        lo, n = lo[full], n[full]
        return self.rows[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows in the buckets whose substring differs from the query's by exactly ``radius`` bits, for any substring."""
        return self.held(((code.astype(np.int64)[:, None] ^ MASKS[radius]) + np.arange(self.m)[:, None] * 65536).ravel())

    def nearest(self, code: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, distances, radius probed): all rows within the smallest Hamming radius that holds ``want`` of them, or
        all rows if there are fewer. What probes up to radius t leave out is m (t + 1) bits away or more.

        Buckets are named by masks while these are few; from ``LISTED`` on, the buckets that hold a code are listed by their
        distance once, and those of each radius are probed.
        """
        seen, fresh = np.zeros(len(self.have), bool), np.zeros(len(self.have), bool)
        far = np.full(len(self.have), self.m * 16 + 1, np.int32)
        own = np.ascontiguousarray(code).view(self.words.dtype)
        apart = None
        for t in range(17):
            if t < LISTED:
                fresh[self.probe(code, t)] = True
            else:
                if apart is None:
                    apart = np.bitwise_count(self.full.astype(np.uint16) ^ np.repeat(code, self.each))
                fresh[self.held(self.full[apart == t])] = True
            rows = np.flatnonzero(fresh & ~seen)
            far[rows] = np.bitwise_count(self.words[rows] ^ own).sum(1, dtype=np.int32)
            seen |= fresh
            sure = far[far < self.m * (t + 1)]
            if len(sure) >= want or seen.all():
                break
        reach = np.partition(sure, want - 1)[want - 1] if len(sure) >= want else self.m * 16
        rows = np.flatnonzero(far <= reach)
        return rows, far[rows], t


def _coded(rows: DataFrame, rotation: np.ndarray, longest: float) -> DataFrame:
    """(id, code, ask): each vector's code as a candidate, and where ``asks`` is true the one as a query."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        have, ask = codes(_lift(x, longest, False), rotation), codes(_lift(x, longest, True), rotation)
        wanted = batch.column(2).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in have], pa.binary()), pa.array([c.tobytes() if w else None for c, w in zip(ask, wanted)], pa.binary())], ["id", "code", "ask"])

    return map_slices(rows.select("id", "v", "asks"), run, "id long, code binary, ask binary", 4096)


def candidates(coded: DataFrame, want: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id): for each row with ``ask`` the ``want`` codes nearest to it in Hamming distance, and ties.

    Codes are dealt to shards by a hash and queries to blocks, as many as keep a cell bounded and all cores busy with an
    index that serves ``ASKS`` queries at least. A shard first gives the codes within the radius that holds its part of
    ``want`` and a margin for how unevenly a hash deals. Where all that it gave is within the radius of the query's
    ``want`` nearest so far, it may have more, and is asked again for ``want``; so the result is that of one shard.
    """
    n, asks = coded.count(), coded.where("ask IS NOT NULL").count()
    shards = max(1, ceil(n / shard))
    blocks = max(ceil(asks / block), min(ceil(asks / ASKS), ceil(2 * coded.sparkSession.sparkContext.defaultParallelism / shards)), 1)
    each = want if shards == 1 else min(want, ceil(want / shards + MARGIN * (5 * sqrt(want / shards) + 5)))

    def search(wanted: int):
        def run(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(asks):
                ids = rows["id"].to_numpy()
                index = Index(np.frombuffer(b"".join(rows["code"]), np.uint16).reshape(len(rows), -1))
                for ask, code in zip(asks["id"].tolist(), asks["ask"]):
                    found, far, _ = index.nearest(np.frombuffer(code, np.uint16), wanted)
                    out.append((np.full(len(found), ask), ids[found], far))
            columns = [np.concatenate([np.empty(0, kind), *[o[k] for o in out]]).astype(kind) for k, kind in enumerate((np.int64, np.int64, np.int32))]
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "far"), columns))).assign(shard=key[0])[["query_id", "shard", "vec_id", "far"]]

        return run

    result = "query_id long, shard long, vec_id long, far int"
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(name)
    own = lambda n: F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(n))
    rows = coded.select(own(shards).alias("shard"), every("block", blocks), "id", "code")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of its own, as both sides come from one table
    some = fresh(coded.where("ask IS NOT NULL").select("id", "ask")).select(every("shard", shards), own(blocks).alias("block"), "id", "ask")
    found = rows.groupBy("shard", "block").cogroup(some.groupBy("shard", "block")).applyInPandas(search(each), result)
    nearest_of = lambda df: df.withColumn("place", F.rank().over(W.partitionBy("query_id").orderBy("far"))).where(F.col("place") <= want)
    if each < want:
        found = table(found)
        reach = nearest_of(found).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= want, F.max("far")).alias("reach"))
        given = found.groupBy("query_id", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("last"))
        more = table(given.join(reach, "query_id").where((F.col("n") >= each) & (F.col("reach").isNull() | (F.col("last") <= F.col("reach")))).select("query_id", "shard"))
        if not more.isEmpty():
            again = more.join(fresh(coded.where("ask IS NOT NULL").select(F.col("id").alias("query_id"), "ask")), "query_id").select("shard", F.pmod(F.xxhash64(F.lit(5), "query_id"), F.lit(blocks)).alias("block"), F.col("query_id").alias("id"), "ask")
            wanted = rows.join(again.select("shard", "block").distinct(), ["shard", "block"])
            whole = wanted.groupBy("shard", "block").cogroup(again.groupBy("shard", "block")).applyInPandas(search(want), result)
            found = found.join(more, ["query_id", "shard"], "left_anti").unionByName(whole)
    return nearest_of(found).select("query_id", "vec_id")


def _first(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the ``k`` other rows of the largest inner product
    among those found.

    ``vectors`` are (id, v) as from ``usable``; a repeated row (id and vector) counts once, and rows with the query's id are
    left out. All other rows are returned if there are fewer than ``k``. Ties go to the smaller id; equal vectors are ties; a product that is not a
    number counts as the least; empty tables give no rows.
    """
    spark, result = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    since = mark(spark)
    once = vectors.select("id", "v").distinct()
    each = _first(once, ["v"], [F.asc("id")], k + 1)  # of equal vectors no more are needed
    ids = table(each.withColumn("rep", F.min("id").over(W.partitionBy("v"))).select("id", "rep", "place", "v"))
    queries = once.where(is_query)
    reps = table(ids.where("place = 1").join(queries.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left").select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks")))
    held = reps.orderBy(F.xxhash64("id")).limit(sample).select("v").collect()  # ``sample`` rows at most
    if not held:
        return spark.createDataFrame([], result)
    peak = reps.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]  # squares of parts of it are finite
    longest = peak * sqrt(reps.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))).first()[0])
    longest = min(longest, float(np.finfo(float).max))
    rotation = rotations(np.array([r.v for r in held]), bits)
    coded = table(_coded(reps, rotation, longest))
    near = table(candidates(coded, WIDER * k, shard, block))

    @F.arrow_udf("double")
    def product(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        with np.errstate(over="ignore", invalid="ignore"):
            return pa.array((x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) * y.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)).sum(1))

    one, two = reps.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), reps.where("asks").select(F.col("id").alias("query_id"), F.col("v").alias("y"))
    if two.count() * len(held[0].v) * 8 <= BROADCAST:
        two = F.broadcast(two)
    scored = near.join(one, "vec_id").join(two, "query_id").select("query_id", "vec_id", product("x", "y").alias("score"))
    sunk = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    best = scored.withColumn("order", sunk).withColumn("r", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("order")))).where(F.col("r") <= k + 1)
    members = ids.select(F.col("rep").alias("vec_id"), F.col("id").alias("other"))
    lists = table(_first(best.join(members, "vec_id"), ["query_id"], [F.desc("order"), F.asc("other")], k + 1).select(F.col("query_id").alias("rep"), "other", "score", "order"))
    asked = table(queries.join(reps.where("asks").select(F.col("id").alias("rep"), "v"), "v").select("id", "rep"))
    release(spark, since, keep=2)
    ranked = _first(asked.join(lists, "rep").where("id <> other"), ["id"], [F.desc("order"), F.asc("other")], k, "rank")
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")


def neighbour_report(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``nearest`` for the rows whose id is divisible by ``every``, against all rows. Rows with a null id, and vectors that
    are null, zero, of another length or hold a null, NaN or infinity, take no part; ties go to the smaller id; a repeated row
    counts once; other columns are ignored, whatever their names; an empty table gives no rows."""
    return nearest(usable(embeddings, "vec_id", "embedding"), F.col("id") % every == 0, k)
