"""Near-duplicate texts by SimHash and similarity: fingerprint links first, then whatever they leave, exactly.

A text is the set of its shingles' 64-bit hashes, and its fingerprint is the SimHash of the same shingles. Fingerprints
within 2 bits are linked through the vantage-point tree, and the links are verified on the whole sets. Two texts alike at
a share may have fingerprints far apart, so a prefix-filter join finds the rest: if two sets of n and m are alike at
``share`` (Jaccard), each has one of the first n - ceil(share n) + 1 of its hashes, under an order common to all, in the
other's: these are a text's keys. Any order is exact; shingles that are common in a sample come last, so buckets stay
small. Only buckets that still hold texts of several groups are joined, those over ``HOT`` texts first as stars, and then
only their pairs that are not yet in one group. Candidates whose keys leave too little room for an overlap go; the others
are verified, and only their texts travel.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import components, map_slices, small_batches
from sigloom.llm.simhash import fingerprint_links, shingle_hashes, simhash
from sigloom.scratch import mark, release, table

#: Words of a shingle, the least similarity, the bits within which fingerprints are linked, and the texts a bucket may
#: hold to be joined pairwise at once.
WORDS, SHARE, WITHIN, HOT = 5, Fraction(4, 5), 2, 32
#: Texts in the sample that tells common shingles, the most of these, and the rows that may be broadcast.
SAMPLE, COMMON, BROADCAST = 10_000, 50_000, 1_000_000


def _set(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes])).view(np.int64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes (as signed numbers) of the text's shingles; a shorter text is one shingle; no words: none."""
    return _set(list(shingle_hashes(text, words)))


def prefix(hashes: np.ndarray, common: np.ndarray, share: Fraction = SHARE) -> np.ndarray:
    """The keys of a set: its first hashes, those in ``common`` (sorted) after the others."""
    last = np.isin(hashes, common, assume_unique=True)
    need = -(-share.numerator * len(hashes) // share.denominator)
    return np.concatenate((hashes[~last], hashes[last]))[: len(hashes) - need + 1]


def _few(df: DataFrame) -> DataFrame:
    df = table(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df


def common_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes that three or more texts of a sample share: ``COMMON`` at most."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *[shingle_set(t, words) for t in batch.column(0).to_pylist()]]))], ["h"])

    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1, SAMPLE / max(1, docs.count())))
    counted = map_slices(docs.where(part).select("text"), run, "h long").groupBy("h").count().where("count > 2")
    return np.sort(np.array([r.h for r in counted.orderBy(F.desc("count"), "h").limit(COMMON).collect()], np.int64))


def prefixes(docs: DataFrame, words: int = WORDS, share: Fraction = SHARE) -> DataFrame:
    """(doc_id, text_key, uid, n, fp, keys): uid a hash of the whole set, so that equal sets are one; n its size; fp the
    fingerprint of the text's shingles."""
    common = common_shingles(docs, words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets, prints = [], []
        for text in batch.column(2).to_pylist():
            hashes = list(shingle_hashes(text, words))
            prints.append(simhash(iter(hashes)))
            sets.append(_set(hashes))
        uid = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        keys = [prefix(s, common, share) if len(s) else s for s in sets]
        columns = [batch.column(0), batch.column(1), pa.array(uid), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "uid", "n", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_slices(rows, run, "doc_id long, text_key long, uid long, n int, fp long, keys array<long>")


def _may(share: Fraction) -> Column:
    """Whether sets of ``n`` and ``m``, whose first common key has the places ``i`` and ``j``, can be alike."""
    p, q = share.numerator, share.denominator
    return F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * (p + q) >= (F.col("n") + F.col("m")) * p


def _pairs(left: DataFrame, right: DataFrame, share: Fraction, also: str) -> DataFrame:
    """Pairs of sets with a common key, of different groups, that can be alike."""
    a = left.select("key", F.col("uid").alias("a"), "n", F.col("pos").alias("i"), F.col("root").alias("root_a"))
    b = right.select("key", F.col("uid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("root").alias("root_b"))
    return a.join(b, "key").where("root_a <> root_b").where(_may(share)).where(also).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    """(uid): the sets of ``pairs``."""
    return pairs.select(F.col("a").alias("uid")).distinct().union(pairs.select("b").distinct()).distinct()


def plausible(sets: DataFrame, pairs: DataFrame, share: Fraction) -> DataFrame:
    """The ``pairs`` whose keys allow the overlap: what two sets share is among both's keys as far as the shorter list of
    keys goes in the common order, and beyond it at most the rest of that list's set."""
    p, q = share.numerator, share.denominator
    ids = _few(_ends(pairs))
    keys = sets.join(ids, "uid", "left_semi")
    one, two = keys.select(F.col("uid").alias("a"), "n", F.col("keys").alias("x")), keys.select(F.col("uid").alias("b"), F.col("n").alias("m"), F.col("keys").alias("y"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("n", "m") * q >= F.greatest("n", "m") * p)
    most = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("n") - F.size("x"), F.col("m") - F.size("y"))
    return table(both.where(most * (p + q) >= (F.col("n") + F.col("m")) * p).select("a", "b"))


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are alike at ``share``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["uid", "set"])

    since = mark(docs.sparkSession)
    pairs = plausible(sets, pairs, share)
    ids = _ends(pairs)
    wanted = _few(sets.join(ids, "uid", "left_semi").select("uid", "first.*"))
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("own_key"), "text")
    held = texts.join(wanted, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))).select("uid", "text")
    with small_batches(docs.sparkSession):
        whole = table(map_slices(held, run, "uid long, set array<long>").dropDuplicates(["uid"]))
    both = pairs.join(whole.select(F.col("uid").alias("a"), F.col("set").alias("x")), "a").join(whole.select(F.col("uid").alias("b"), F.col("set").alias("y")), "b")
    p, q = share.numerator, share.denominator
    sizes = F.size("x") + F.size("y")
    near = both.where((F.least(F.size("x"), F.size("y")) * (p + q) >= sizes * p) & (F.size(F.array_intersect("x", "y")) * (p + q) >= sizes * p))
    found = table(near.select("a", "b"))
    release(docs.sparkSession, since, keep=1)
    return found


def fingerprint_pairs(sets: DataFrame, within: int = WITHIN) -> DataFrame:
    """Candidate pairs of sets by their fingerprints: the first set of a fingerprint with its others, and the first sets of
    fingerprints that the vantage-point tree links."""
    since = mark(sets.sparkSession)
    firsts = table(sets.groupBy("fp").agg(F.min("uid").alias("a"), F.max("uid").alias("last")))
    alike = sets.join(firsts.where("a < last"), "fp").where("a < uid").select("a", F.col("uid").alias("b"))
    linked = table(fingerprint_links(firsts, within))
    one, two = firsts.select(F.col("fp").alias("x"), F.col("a").alias("p")), firsts.select(F.col("fp").alias("y"), F.col("a").alias("q"))
    near = linked.join(one, linked.a == one.x).join(two, linked.b == two.y).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    found = table(alike.unionByName(near).distinct())
    release(sets.sparkSession, since, keep=1)
    return found


def _grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with ``root``, the smallest set that ``links`` lead to."""
    roots = components(links)
    return table(sets.join(roots, sets.uid == roots.node, "left").select("uid", "n", "keys", F.coalesce("root", "uid").alias("root")))


def similar_links(docs: DataFrame, sets: DataFrame, words: int = WORDS, share: Fraction = SHARE, hot: int = HOT) -> DataFrame:
    """(a, b): links among ``sets``, with the same connected sets as all pairs alike at ``share``."""
    links = verified(docs, sets, fingerprint_pairs(sets), words, share)
    since = mark(docs.sparkSession)
    every = _grouped(sets, links).select("uid", "n", "root", F.posexplode("keys").alias("pos", "key"))
    counted = every.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("uid").alias("a"), F.max("uid").alias("b"))
    stats = table(counted.where("lo < hi"))
    members = every.join(_few(stats.where("size > 2").select("key", "size")), "key")
    # How much of a text its shared keys are: the least changed of many copies has most of them, and is like most others.
    shared = members.groupBy("uid").agg((F.count(F.lit(1)) / F.first("n")).alias("shared"))
    twos = table(stats.where("size = 2").select("a", "b"))
    members = table(members.join(shared, "uid"))
    release(docs.sparkSession, since, keep=2)
    small, large = members.where(F.col("size") <= hot), members.where(F.col("size") > hot)
    centres = large.groupBy("key").agg(F.max(F.struct("shared", "uid", "n", "pos", "root")).alias("c")).select("key", "c.*")
    tried = table(reduce(DataFrame.unionByName, [twos, _pairs(small, small, share, "a < b"), _pairs(centres, large, share, "a <> b")]).distinct())
    links = links.unionByName(verified(docs, sets, tried, words, share))
    if large.isEmpty():
        return links
    roots = components(links)
    named = table(large.drop("root").join(roots, large.uid == roots.node, "left").select("key", "uid", "n", "pos", F.coalesce("root", "uid").alias("root")))
    open_ = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = named.join(open_, "key", "left_semi")
    more = table(_pairs(rest, rest, share, "a < b").distinct().join(tried, ["a", "b"], "left_anti"))
    return links.unionByName(verified(docs, sets, more, words, share))


def keep_first_alike(docs: DataFrame, words: int = WORDS, share: Fraction = SHARE, hot: int = HOT) -> DataFrame:
    """One row of ``docs`` for each group of texts linked by similarity, that of the smallest doc_id (nulls first); all
    columns as they are. Null, empty and wordless texts are one group; of repeated rows one stays; ties of similarity at
    ``share`` are links; an empty table gives no rows."""
    spark = docs.sparkSession
    since = mark(spark)
    with small_batches(spark):
        prints = table(prefixes(docs, words, share))
    sets = table(prints.groupBy("uid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "text_key")).alias("first")))
    release(spark, since, keep=1)
    roots = components(similar_links(docs, sets, words, share, hot))
    named = sets.join(roots, sets.uid == roots.node, "left").select("first", F.coalesce("root", "uid").alias("root"))
    kept = table(named.groupBy("root").agg(F.min("first").alias("kept")).select(F.col("kept.doc_id").alias("_sg_id"), F.col("kept.text_key").alias("_sg_key")))
    release(spark, since, keep=1)
    keyed = docs.withColumns({"_sg_own": F.col("doc_id").cast("long"), "_sg_hash": F.xxhash64("text")})
    chosen = keyed.join(kept, F.col("_sg_own").eqNullSafe(F.col("_sg_id")) & (F.col("_sg_hash") == F.col("_sg_key")), "left_semi")
    return chosen.dropDuplicates(["_sg_own", "_sg_hash"]).select(*docs.columns)
